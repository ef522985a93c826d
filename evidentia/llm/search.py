"""Nearest neighbours by largest inner product: exact in tiles, or approximate with a tree of k-means cells.

Both lay queries in tiles and rows in shards of bounded size, bring each tile and shard together in one task, keep a
short list per query there, and merge the lists in a tree, so no task sees more than a tile, a shard or a few lists.

Cases: vectors that are null, or hold null or non-finite components, take no part, neither do rows without an id; the
approximate search also leaves out zero and empty vectors. Vectors of different length have no inner product and never
meet. A query's own row is each row of its id; equal scores go to the smaller id; a repeated id is one row. An empty
table, or one without queries, gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Rows of a shard and queries of a tile.
SHARD, TILE = 2048, 4096
#: Lists that one merge takes.
FAN_IN = 16


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column as rows, if all have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def by_length(ids: np.ndarray, column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    return {int(n): (ids[at], matrix(column.take(pa.array(at)))) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while all sums stay below 2**53, else in 64-bit integers."""
    bound = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**53 else a @ b.T


def short_lists(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best columns without its own id; ties go to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    ids, scores = ids[first], scores[:, first]
    out = []
    for q, row in zip(query_ids.tolist(), scores):
        own = np.searchsorted(ids, q)
        if k + 1 < len(ids):
            edge = np.partition(row, len(ids) - k - 1)[len(ids) - k - 1]
            at = np.flatnonzero(row >= edge)
        else:
            at = np.arange(len(ids))
        at = at[(at != own) | (ids[np.minimum(own, len(ids) - 1)] != q)]
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append((ids[at], row[at]))
    return out


def listed(query_ids: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    ends = np.cumsum([0, *(len(x) for x, _ in lists)]).astype(np.int32)
    ids = pa.array(np.concatenate([x for x, _ in lists]) if lists else [], pa.int64())
    scores = pa.array(np.concatenate([x for _, x in lists]) if lists else [], kind)
    best = pa.StructArray.from_arrays([ids, scores], ["id", "score"])
    return pa.table({"query_id": pa.array(query_ids, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(ends), best)})


def slot(count: int, size: int, column: str = "id") -> tuple[Column, int]:
    """A column that deals rows over blocks of about ``size`` rows by the hash of their id, and the number of blocks."""
    blocks = max(1, math.ceil(count / size))
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int"), blocks


def merged(lists: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from per-block lists, merged FAN_IN lists at a time."""
    worse = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    )
    while True:
        blocks = math.ceil(blocks / FAN_IN)
        lists = lists.withColumn("block", (F.col("block") / FAN_IN).cast("int"))
        lists = lists.groupBy("query_id", "block").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best"))), worse), 1, k).alias("best"))
        if blocks <= 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("at", "found")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("vec_id"), F.col("found.score").alias("score"))


def exact_top_k(df: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products of floor(scale * component).

    ``queries`` has the columns of ``df``. Tiles of queries and shards of rows meet once each.
    """
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows, asked = usable(df, vec_id, vector).withColumn("vector", whole), usable(queries, vec_id, vector).withColumn("vector", whole)
    n, m = rows.count(), asked.count()
    (row_block, shards), (query_block, tiles) = slot(n, shard), slot(m, tile)
    rows = rows.withColumn("block", row_block).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    asked = asked.withColumn("tile", query_block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            own = by_length(np.asarray(left["id"]), left["vector"])
            for size, (query_ids, q) in by_length(np.asarray(right["id"]), right["vector"]).items():
                if size in own:
                    ids, x = own[size]
                    out.append(listed(query_ids, short_lists(query_ids, ids, product(q, x), k), pa.int64()))
        found = pa.concat_tables(out) if out else listed(np.zeros(0, np.int64), [], pa.int64())
        return found.append_column("block", pa.array(np.full(len(found), left["block"][0].as_py() if len(left) else 0), pa.int32()))

    schema = "query_id long, best array<struct<id:long,score:long>>, block int"
    return merged(rows.groupBy("tile", "block").cogroup(asked.groupBy("tile", "block")).applyInArrow(meet, schema), shards, k)


class Tree:
    """Cells of hierarchical k-means, searched best bin first."""

    def __init__(self, points: np.ndarray, leaves: int, branching: int = 8, rounds: int = 8):
        self.centres: list[np.ndarray] = [points.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        heap, leaf_count, rng = [(-len(points), 0, np.arange(len(points)))], 1, np.random.default_rng(7)
        while heap and leaf_count < leaves:  # the fullest cell is split next
            size, node, own = heapq.heappop(heap)
            some = points[own]
            distinct = np.unique(some, axis=0)
            k = min(branching, len(distinct), leaves - leaf_count + 1)
            if k < 2:
                continue
            centres = distinct[rng.choice(len(distinct), k, replace=False)]
            for _ in range(rounds):
                near = self.nearest(some, centres)
                for c in range(k):
                    if (near == c).any():
                        centres[c] = some[near == c].mean(axis=0)
            near = self.nearest(some, centres)
            for c in range(k):
                self.children[node].append(len(self.centres))
                heapq.heappush(heap, (-int((near == c).sum()), len(self.centres), own[near == c]))
                self.centres.append(centres[c])
                self.children.append([])
            leaf_count += k - 1
        self.nodes = np.array(self.centres)
        self.norms = (self.nodes**2).sum(axis=1)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, found by descent."""
        out = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, own = waiting.pop()
            children = self.children[node]
            if not children or not len(own):
                out[own] = node
                continue
            near = self.nearest(x[own], self.nodes[children])
            waiting += [(child, own[near == c]) for c, child in enumerate(children)]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first: a queue holds the nodes seen, nearest centre on top."""
        far = self.norms - 2 * q @ self.nodes.T
        out = []
        for row in far.tolist():
            queue, order = [(row[0], 0)], []
            while queue and len(order) < most:
                _, node = heapq.heappop(queue)
                if not self.children[node]:
                    order.append(node)
                for child in self.children[node]:
                    heapq.heappush(queue, (row[child], child))
            out.append(order)
        return out


def tree_search(
    df: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", recall: float = 0.97, sample: int = 20_000, probes: int = 128, shard: int = SHARD, tile: int = TILE
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, in double precision, found with a tree.

    Inner products become distances by one more component, so that all rows have the same norm. The tree is fitted to
    ``sample`` rows at most, chosen by the hash of their id; its cells, about twice the root of the row count and 4096 at
    most, hold every row. The cells that queries visit, nearest first, widen until the ``probes`` calibration queries at
    most, chosen by hash too and compared with all rows, reach ``recall`` of their exact neighbours. A full cell is
    split over several shards. A query that finds fewer than k rows in its cells visits all cells.
    """
    norm = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    every = usable(df, vec_id, vector).withColumn("norm", norm("vector")).where("norm > 0")
    asked = usable(queries, vec_id, vector).withColumn("norm", norm("vector")).where("norm > 0")
    schema = "query_id long, best array<struct<id:long,score:double>>, block int"
    sizes = {r[0]: r for r in every.groupBy(F.size("vector")).agg(F.count("*"), F.max("norm")).collect()}
    spark, out = df.sparkSession, None
    for width, (_, n, top) in sorted(sizes.items()):  # one tree for each length of vectors; there is one as a rule
        found = _searched(every.where(F.size("vector") == width), asked.where(F.size("vector") == width), n, top, k, recall, sample, probes, shard, tile, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _searched(rows: DataFrame, asked: DataFrame, n: int, top: float, k: int, recall: float, sample: int, probes: int, shard: int, tile: int, schema: str) -> DataFrame:
    def lifted(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))[:, None]])

    flat = lambda q: np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
    thinned = lambda frame, count, most: frame.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, math.ceil(count / (0.9 * most))))) == 0).limit(most)
    fitted = thinned(rows, n, sample).select("vector").toArrow()
    fitted = matrix(fitted["vector"]) if len(fitted) else matrix(rows.select("vector").limit(sample).toArrow()["vector"])
    tree = Tree(lifted(fitted), int(min(4096, max(8, 2 * math.sqrt(n)))))
    told = rows.sparkSession.sparkContext.broadcast(tree)  # 4096 leaves at most
    m = asked.count()

    # calibration: exact neighbours of a bounded set of queries, with the leaf that holds each
    tried = thinned(asked, m, probes).select("id", "vector").toArrow()
    visits = len(tree.leaves)
    if len(tried):
        probe_ids, probe = np.asarray(tried["id"]), matrix(tried["vector"]).astype(np.float64)

        def exact(batches):
            for b in batches:
                ids, x = np.asarray(b.column(0)), matrix(b.column(1)).astype(np.float64)
                if len(ids):
                    lists = short_lists(probe_ids, ids, probe @ x.T, k)
                    leaf = dict(zip(ids.tolist(), told.value.leaf_of(lifted(x)).tolist()))
                    flat_ids = np.concatenate([i for i, _ in lists])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(probe_ids, [len(i) for i, _ in lists])), pa.array(flat_ids, pa.int64()), pa.array(np.concatenate([s for _, s in lists]), pa.float64()), pa.array([leaf[i] for i in flat_ids.tolist()], pa.int64())], ["query_id", "id", "score", "leaf"])

        found = rows.select("id", "vector").mapInArrow(exact, "query_id long, id long, score double, leaf long")
        best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "leaf")))), 1, k).alias("best")).collect()
        place = {q: {leaf: i for i, leaf in enumerate(order)} for q, order in zip(probe_ids.tolist(), tree.visits(flat(probe), visits))}
        depth = np.sort([place[r.query_id][x.leaf] for r in best for x in r.best])
        visits = 1 + int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) if len(depth) else 1

    leaf_of = lambda batches: (
        pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told.value.leaf_of(lifted(matrix(b.column(1)))) if len(b) else np.zeros(0, np.int64))], ["id", "vector", "leaf"]) for b in batches
    )
    kind = dict(rows.dtypes)["vector"]
    placed = rows.select("id", "vector").mapInArrow(leaf_of, f"id long, vector {kind}, leaf long")
    # shards: neighbouring leaves together up to a shard's rows; a fuller leaf over several shards
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    shards_of: dict[int, list[int]] = {}
    block = room = 0
    for leaf in sorted(counts):
        if counts[leaf] > shard:
            parts = math.ceil(counts[leaf] / shard)
            block, room = block + 1, 0
            shards_of[leaf] = list(range(block, block + parts))
            block += parts
            continue
        if room + counts[leaf] > shard:
            block, room = block + 1, 0
        shards_of[leaf] = [block]
        room += counts[leaf]
    blocks = block + 1
    shards_told = rows.sparkSession.sparkContext.broadcast(shards_of)  # a list per leaf, and a number per full shard
    query_block, tiles = slot(m, tile)

    def dealt(batches):
        for b in batches:
            at = mix(np.asarray(b.column(0)).view(np.uint64)) >> np.uint64(8)
            own = [shards_told.value[leaf] for leaf in b.column(2).to_pylist()]
            block = [s[h % len(s)] for s, h in zip(own, at.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int32())], ["id", "vector", "leaf", "block"])

    left = placed.mapInArrow(dealt, f"id long, vector {kind}, leaf long, block int").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def routed(batches):
        for b in batches:
            if not len(b):
                continue
            order = told.value.visits(flat(matrix(b.column(1))), len(tree.leaves) if visits >= len(tree.leaves) else visits)
            rows_out: list[tuple[int, int, list[int]]] = []
            for i, leaves in enumerate(order):
                held = 0
                by_block: dict[int, list[int]] = {}
                for leaf in leaves:
                    held += counts.get(leaf, 0)
                    for s in shards_told.value.get(leaf, ()):
                        by_block.setdefault(s, []).append(leaf)
                if held <= k:
                    by_block = {}
                    for leaf, own in shards_told.value.items():
                        for s in own:
                            by_block.setdefault(s, []).append(leaf)
                rows_out += [(i, s, leaves) for s, leaves in by_block.items()]
            at = pa.array([r[0] for r in rows_out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array([r[1] for r in rows_out], pa.int32()), pa.array([r[2] for r in rows_out], pa.list_(pa.int64()))], ["id", "vector", "tile", "block", "leaves"])

    right = asked.select("id", "vector", query_block.alias("tile")).mapInArrow(routed, f"id long, vector {kind}, tile int, block int, leaves array<long>")

    def meet(rows_in: pa.Table, asked_in: pa.Table) -> pa.Table:
        if not len(rows_in) or not len(asked_in):
            return listed(np.zeros(0, np.int64), [], pa.float64()).append_column("block", pa.array([], pa.int32()))
        ids, x, leaf = np.asarray(rows_in["id"]), matrix(rows_in["vector"]).astype(np.float64), np.asarray(rows_in["leaf"])
        query_ids, q = np.asarray(asked_in["id"]), matrix(asked_in["vector"]).astype(np.float64)
        here, at = np.unique(leaf, return_inverse=True)
        visited = np.zeros((len(query_ids), len(here)), bool)
        wanted = asked_in["leaves"].combine_chunks()
        owner = np.repeat(np.arange(len(query_ids)), np.asarray(wanted.value_lengths()))
        cell = np.asarray(wanted.flatten())
        place = np.minimum(np.searchsorted(here, cell), len(here) - 1)
        hit = here[place] == cell
        visited[owner[hit], place[hit]] = True
        scores = q @ x.T
        scores[~visited[:, at]] = -np.inf
        lists = [(i[s > -np.inf], s[s > -np.inf]) for i, s in short_lists(query_ids, ids, scores, k)]
        found = listed(query_ids, lists, pa.float64())
        return found.append_column("block", pa.array(np.full(len(found), rows_in["block"][0].as_py()), pa.int32()))

    return merged(left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(meet, schema), blocks, k)
