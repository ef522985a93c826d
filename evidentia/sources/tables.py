"""Parquet tables, and tables written between the steps of iterative operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose driver and executors are one process, takes a temporary one; a cluster
    without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Open(threading.local):
    """Places of the tables written within each open ``steps`` block, by thread."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/evidentia-steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open.blocks:
        _open.blocks[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextlib.contextmanager
def steps() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written within the block at its end, but for those given to ``keep``, which go to the block around it."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written_to)
        return df

    _open.blocks.append([])
    try:
        yield keep
    finally:
        spark = SparkSession.getActiveSession()
        for path in _open.blocks.pop():
            if path in kept:
                if _open.blocks:
                    _open.blocks[-1].append(path)
            elif spark is not None:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
