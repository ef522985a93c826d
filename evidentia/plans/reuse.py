"""Reuse of committed results: looked up by a digest of all that a step depends on, and verified before they are taken."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..sources.delimited import digests, exists, hadoop, put_in_place, read_json, write_json
from .report import COMMITTED, Result, members, result_path
from .workflow import cache_key

#: Sections of the configuration that steps read, by the first word of their name; other steps read all.
SECTIONS = {"netinfer": ("batch", "inference"), "proximity": ("proximity",), "gps": ("signature",), "kg": ("graph",), "prepare": ("species",), "register": ()}


#: Steps that are taken always, and steps that make the run's own folder, whose result is in the digests of the inputs.
ALWAYS, OWN = ("create_run_workspace", "generate_run_report"), ("create_run_workspace", "register_inputs")


def contents(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """A digest for each file or folder: of its files' digests, which Spark takes in parallel."""
    out = {}
    for key, path in sorted(paths.items()):
        rows = digests(spark, path).select("sha256").orderBy("sha256").collect()  # one row per file
        out[key] = "+".join(r.sha256 for r in rows)
    return out


def outputs(spark: SparkSession, run: str, node: str, task: str) -> list[str] | None:
    """The digests of the files that a step has committed; None where it has not."""
    path = result_path(run, node, task)
    if not exists(spark, path):
        return None
    result = read_json(spark, path)
    if result["status"] not in COMMITTED:
        return None
    found = [read_json(spark, f"{run}/artifacts/manifests/{node}/{task}/{i}.json") for i in result["outputs"]]
    return sorted(f"{m['artifact_type']}:{f['sha256']}" for m in found for f in m["files"])


def key_of(spark: SparkSession, run: str, node: str, task: str, waits: tuple[tuple[str, str], ...], config: dict, code: str, inputs: dict[str, str], resources: dict[str, str]) -> str | None:
    """The name of a step's result; None for a step that is taken always. A step that was skipped hands nothing on. inputs, resources: digests of contents."""
    if node in ALWAYS:
        return None
    given = {f"{n}:{t}": outputs(spark, run, n, t) for n, t in waits if n not in OWN}
    own = SECTIONS.get(node.split("_")[0])
    used = config if own is None else {k: config[k] for k in own}
    return cache_key({**given, **{f"input:{k}": v for k, v in inputs.items()}}, used, code, resources, {"node": node, "task": task, "run": run if node in OWN else ""})


def remember(spark: SparkSession, cache: str, key: str, run: str, result: Result, manifests: dict[str, dict]) -> None:
    """Enters a committed result under its key."""
    write_json(spark, {"key": key, "run": run, "node_id": result.node, "task_id": result.task, "metrics": result.metrics, "manifests": manifests}, f"{cache}/{key}.json")


def whole(spark: SparkSession, path: str, files: list[dict]) -> bool:
    """Whether the files at a path are those that were committed; files that cannot be read are not."""
    try:
        return exists(spark, path) and members(spark, path) == files
    except Py4JJavaError:
        return False


def found(spark: SparkSession, cache: str, key: str, run: str) -> tuple[dict[str, str], dict] | None:
    """(artifacts, metrics) of the result under a key, if all its files are still as they were committed; those of another run are copied into this one."""
    path = f"{cache}/{key}.json"
    if not exists(spark, path):
        return None
    told = read_json(spark, path)
    if told["key"] != key:
        return None
    for m in told["manifests"].values():
        at = f"{told['run']}/{m['relative_path']}"
        if not whole(spark, at, m["files"]):
            return None
    artifacts = {}
    for kind, m in told["manifests"].items():
        artifacts[kind] = f"{run}/{m['relative_path']}"
        if told["run"] != run:
            copied(spark, f"{told['run']}/{m['relative_path']}", artifacts[kind])
    return artifacts, told["metrics"]


def copied(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder beside its new place, then moved there."""
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    (a, files), (b, others) = hadoop(spark, source), hadoop(spark, staged)
    others.mkdirs(b.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, a, others, b, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} cannot be copied")
    put_in_place(spark, staged, target)
