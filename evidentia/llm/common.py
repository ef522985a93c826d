"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, steps, table, written  # noqa: F401  for the operators of this package


def texts_of(column: pa.Array) -> list[str]:
    """A string column's values with null as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def chunks(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters together; a longer text is a range of its own."""
    start = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > size:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield start, len(texts)


#: What a worker may let go of between partitions: each operator with a cache adds how.
LET_GO: list[Callable[[], None]] = []
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def released() -> None:
    """Gives a worker's free memory back: workers stay for the next stages, and an executor holds all of them."""
    for f in LET_GO:
        f()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(f: Callable) -> Callable:
    """A function of a group that gives memory back when it is done."""

    def call(key, batch):
        try:
            return f(key, batch)
        finally:
            released()

    return call


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about ``size`` bytes of a text column together, one row at least, so that few texts are held as Python objects at a time."""
    for batch in batches:
        total = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mapped(df: DataFrame, columns: list[str], schema: str, over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over just ``columns``; a worker gives memory back at the end of each partition."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from over(batches)
        released()

    return df.select(*columns).mapInArrow(tidy, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Most bits of an id filter: 2**27 bits are 16 MB.
FILTER_BITS = 27


def id_filter(ids: DataFrame, column: str, bits: int | None = None) -> tuple[np.ndarray, int]:
    """A Bloom filter with two hashes over a long column, built on the executors and merged by or.

    Its size follows the count of ids up to 2**FILTER_BITS bits, so it is small enough to broadcast at any input
    size. It has no false negatives; a false positive only sends a row to a join that drops it.
    """
    spark = ids.sparkSession
    if bits is None:
        bits = int(min(FILTER_BITS, max(13, np.ceil(np.log2(max(1, ids.count()) * 12)))))
    part = 16  # 2**16 bits (8 KB) a piece

    def local(batches):
        seen = np.zeros(1 << bits >> 3, np.uint8)
        for b in batches:
            x = np.asarray(b.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
            for at in places(x, bits):
                np.bitwise_or.at(seen, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        pieces = seen.reshape(-1, min(len(seen), 1 << part >> 3))
        keep = np.flatnonzero(pieces.any(axis=1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int64)), pa.array([pieces[k].tobytes() for k in keep], pa.binary())], ["piece", "bits"])

    def merged(key, batches):
        out = np.zeros(len(batches["bits"][0].as_py()), np.uint8)
        for x in batches["bits"].to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "piece long, bits binary"
    rows = ids.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(local, schema).groupBy("piece").applyInArrow(merged, schema).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    size = min(len(out), 1 << part >> 3)
    for r in rows:
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.bits, np.uint8)
    del spark
    return out, bits


def places(x: np.ndarray, bits: int) -> list[np.ndarray]:
    a = mix(x + np.uint64(0x9E3779B97F4A7C15))
    return [a >> np.uint64(64 - bits), (a * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)]


def maybe_in(seen: np.ndarray, bits: int, x: np.ndarray) -> np.ndarray:
    """For each id whether the filter may hold it."""
    out = np.ones(len(x), bool)
    for at in places(x.astype(np.int64).view(np.uint64), bits):
        out &= (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out
