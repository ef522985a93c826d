"""Distributed union-find: connected components of links by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, written

#: Rows of a lookup table that may be broadcast, and links that one task may join (4 MB).
BROADCAST_ROWS, TASK_LINKS = 300_000, 250_000


def looked_up(rows: DataFrame, found: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined to a written table with unique keys: broadcast below a checked count, else a sort-merge join whose hot keys Spark splits."""
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, key, how)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over links between two arrays of ids."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i, p in enumerate(parent):  # a parent is never larger than its node
        parent[i] = parent[p]
    return nodes, nodes[np.array(parent, np.int64)] if len(nodes) else nodes


def contracted(links: DataFrame) -> DataFrame:
    """The links as stars: each task's own links go through a union-find of its own, so at most one link per node is left of each task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.append(a, np.asarray(batch.column(0))), np.append(b, np.asarray(batch.column(1)))
            a, b = union_find(a, b)
            a, b = a[a != b], b[a != b]
            if len(a) > 1_000_000:  # bounded memory: what has been joined so far is handed on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(over, "a long, b long")


def joined_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) over all links of one task."""
    own = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if own:
        node, top = union_find(np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own]))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(top, pa.int64())], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that it is connected with.

    Each round takes the smallest label among a node and its neighbours (combined before the shuffle), and then the
    label of that label. Rounds grow with the logarithm of a component's width as a rule. Every round is written to the
    shared folder. Where a count shows that the links left are few, one task's union-find takes their place.
    """
    with steps() as keep:
        stars = written(contracted(links), "stars")
        if stars.count() <= TASK_LINKS:
            return keep(written(stars.coalesce(1).mapInArrow(joined_whole, "node long, component long"), "labels"))
        both = written(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", F.col("b").alias("node")), "arcs")
        labels = written(both.groupBy(F.col("node")).agg(F.least(F.min("a"), F.col("node")).alias("component")), "labels")
        total = None
        while True:
            near = both.join(labels, "node").select(F.col("a").alias("node"), "component")
            lower = written(near.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("component")), "lower")
            above = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
            labels = written(lower.join(above, "component").select("node", F.col("top").alias("component")), "labels")
            now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
            if now == total:
                return keep(labels)
            total = now
