"""Centroid clustering of integer vectors: exact k-means by kd-tree filtering.

Every task builds kd-trees over blocks of its own vectors. A node holds its vectors' count, their integer sums and their
box. The trees are written once; each round then only sends the centroids. A node starts with its parent's candidates;
the one nearest to the box's middle is compared with each of the others at the box's corner that favours the other most,
and the others that lose even there, strictly, are pruned. A node with one candidate left is assigned whole, by its count
and sums; the vectors of a leaf that keeps several are compared with those one by one. All numbers are integers, so the
result is that of the plain algorithm, whatever the partitioning.

What a task hands on are counts and sums of k centroids, and the driver holds k centroids; vectors stay in the tasks.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part; a component whose
integer reaches 2**27 in size is an error, since the squared distance would not fit a long; repeated rows are vectors of
their own; with fewer vectors than centroids each vector starts one, and without any the result is empty; a row without
id is assigned, but starts no centroid; of equal starting hashes the smaller vector comes first; columns other than the
id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: Vectors in one tree, and in a leaf at most.
BLOCK, LEAF = 8192, 32
#: Components stay below this, so that sums of squares of differences fit a long.
LARGEST = 1 << 27
#: Below this the products of components are exact in double precision.
EXACT = 1 << 22

TREES = "ids array<long>, points binary, nodes binary"


@dataclass
class Tree:
    """Vectors in the order of a kd-tree's leaves; nodes in level order, children of i at 2i+1 and 2i+2.

    ``nodes`` has a row for each: first vector, end, sums, least and largest components; equal ends mean that there is no such node.
    """

    points: np.ndarray
    nodes: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """A tree and the order of the given vectors in it."""
        n, width = points.shape
        levels = max(1, int(np.ceil(np.log2(max(1, n / LEAF)))) + 1)
        spans = np.zeros((2**levels - 1, 2), np.int64)
        order = np.arange(n)
        spans[0] = 0, n
        for i in range(2 ** (levels - 1) - 1):
            a, b = spans[i]
            middle = (a + b) // 2
            if b - a > 1:
                own = order[a:b]
                some = points[own]
                widest = int((some.max(axis=0) - some.min(axis=0)).argmax())
                order[a:b] = own[np.argpartition(some[:, widest], middle - a)]
            spans[2 * i + 1], spans[2 * i + 2] = (a, middle), (middle, b)
        points = points[order]
        nodes = np.zeros((len(spans), 2 + 3 * width), np.int64)
        nodes[:, :2] = spans
        for i, (a, b) in enumerate(spans.tolist()):
            if b > a:
                own = points[a:b]
                nodes[i, 2:] = np.concatenate([own.sum(axis=0, dtype=np.int64), own.min(axis=0), own.max(axis=0)])
        return Tree(points, nodes), order

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, their candidates as a boolean matrix), level by level: first those with one candidate, at the last level all that are left."""
        width, k = self.points.shape[1], len(centroids)
        at, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        last = (len(self.nodes) - 1) // 2
        while len(at):
            here = self.nodes[at, 1] > self.nodes[at, 0]
            at, alive = at[here], alive[here]
            low, high = self.nodes[at, 2 + width : 2 + 2 * width], self.nodes[at, 2 + 2 * width :]
            far = np.stack([((low + high - 2 * z) ** 2).sum(axis=1) for z in centroids], axis=1) if len(at) else np.zeros((0, k), np.int64)
            nearest = np.where(alive, far, np.iinfo(np.int64).max).argmin(axis=1)
            best = centroids[nearest]
            for c in range(k):
                corner = np.where(centroids[c] > best, high, low)
                beaten = ((corner - centroids[c]) ** 2).sum(axis=1) > ((corner - best) ** 2).sum(axis=1)
                alive[:, c] &= ~beaten | (nearest == c)
            done = (alive.sum(axis=1) == 1) | (at >= last)
            yield at[done], alive[done]
            at, alive = np.repeat(at[~done], 2), np.repeat(alive[~done], 2, axis=0)
            at = 2 * at + 1 + (np.arange(len(at)) & 1)

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of each centroid's vectors."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        width = self.points.shape[1]
        for at, alive in self.filtered(centroids):
            single = alive.sum(axis=1) == 1
            owner = alive[single].argmax(axis=1)
            np.add.at(counts, owner, self.nodes[at[single], 1] - self.nodes[at[single], 0])
            np.add.at(sums, owner, self.nodes[at[single], 2 : 2 + width])
            rows, owner = self.resolved(at[~single], alive[~single], centroids)[:2]
            counts += np.bincount(owner, minlength=len(centroids))
            for c in np.unique(owner):
                sums[c] += self.points[rows[owner == c]].sum(axis=0, dtype=np.int64)
        return counts, sums

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector."""
        label, distance = np.zeros(len(self.points), np.int32), np.zeros(len(self.points), np.int64)
        for at, alive in self.filtered(centroids):
            rows, owner, far = self.resolved(at, alive, centroids)
            label[rows], distance[rows] = owner, far
        return label, distance

    def resolved(self, at: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, nearest of its node's candidates, squared distance) of the nodes' vectors; of equally near ones the first."""
        first, size = self.nodes[at, 0], self.nodes[at, 1] - self.nodes[at, 0]
        own = np.repeat(np.arange(len(at)), size)
        rows = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]
        points = self.points[rows]
        far = np.where(alive[own], squared(points, centroids), np.iinfo(np.int64).max)
        label = far.argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
        return rows, label, far[np.arange(len(rows)), label]


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances between all points and centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT // max(1, points.shape[1] // 64):
        p, z = points.astype(np.float64), centroids.astype(np.float64)
        return ((p**2).sum(axis=1)[:, None] - 2 * (p @ z.T) + (z**2).sum(axis=1)).astype(np.int64)
    return np.stack([((points.astype(np.int64) - z) ** 2).sum(axis=1) for z in centroids], axis=1)


def integer_vectors(vectors: DataFrame, id_column: str, column: str, dimension: int, scale: int) -> DataFrame:
    """(id, point): the rows that take part, each component x as floor(scale * x)."""
    x = F.col(column)
    good = x.isNotNull() & (F.size(x) == dimension) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v))
    point = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    small = F.forall("point", lambda v: F.abs(v) < LARGEST)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), column).where(good).select("id", point.alias("point"))
    return rows.select("id", F.when(small, F.col("point")).otherwise(F.raise_error(F.lit("a component is too large for squared distances in a long"))).alias("point"))


def trees(points: DataFrame) -> DataFrame:
    """A written table of kd-trees over each task's vectors."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def built() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            flat = rows["point"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            tree, order = Tree.build(flat.reshape(len(rows), -1).astype(np.int32))
            ids = rows["id"].combine_chunks().take(pa.array(order))
            offsets = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), pa.array([tree.points.tobytes()]), pa.array([tree.nodes.tobytes()])], ["ids", "points", "nodes"])

        total = 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, BLOCK - total)
                held.append(part)
                start, total = start + part.num_rows, total + part.num_rows
                if total == BLOCK:
                    yield built()
                    total = 0
        if total:
            yield built()

    return written(mapped(points, ["id", "point"], TREES, over), "kd-trees")


def tree_of(batch: pa.RecordBatch, i: int, dimension: int) -> Tree:
    points = np.frombuffer(batch.column("points")[i].as_py(), np.int32).reshape(-1, dimension)
    return Tree(points, np.frombuffer(batch.column("nodes")[i].as_py(), np.int64).reshape(-1, 2 + 3 * dimension))


def start(points: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the smallest lowercase-hex sha256 of prefix and id."""
    first = points.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")).cast("binary"), 256), "point").limit(k)
    return np.array([r.point for r in first.select("point").collect()], np.int64)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each one's mean; one without vectors stays."""
    dimension = centroids.shape[1]
    places = np.arange(centroids.size)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                n, s = tree_of(batch, i, dimension).assigned(centroids)
                counts, sums = counts + n, sums + s
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.repeat(counts, dimension)), pa.array(sums.ravel())], ["place", "n", "total"])

    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = mapped(forest, ["points", "nodes"], "place long, n long, total long", over).groupBy("place").agg(big("n"), big("total")).collect()
    out = centroids.copy().ravel()
    for r in found:
        if r.n:
            out[r.place] = int(r.total) // int(r.n)
    return out.reshape(centroids.shape)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, prefix: str = "3:", id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector that takes part, as a written table, and the final centroids."""
    points = integer_vectors(vectors, id_column, column, dimension, scale)
    forest = trees(points)
    centroids = start(points, k, prefix)
    if not len(centroids):
        centroids = np.zeros((0, dimension), np.int64)
        return written(points.where("false").select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "clusters"), centroids
    for _ in range(rounds):
        before, centroids = centroids, moved(forest, centroids)
        if (before == centroids).all():  # nothing moves any more
            break

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, distance = tree_of(batch, i, dimension).labels(centroids)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(label), pa.array(distance)], [id_column, "cluster", "distance"])

    return written(mapped(forest, ["ids", "points", "nodes"], f"`{id_column}` long, cluster int, distance long", over), "clusters"), centroids


def digest(centroid: np.ndarray) -> str:
    """Lowercase hex sha256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with each cluster's and the whole inertia and the digest of its centroid: one row a centroid is broadcast."""
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    rows = [(c, n, sum(sums.values()), digest(centroids[c])) for c, n in sorted(sums.items())]
    told = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster")


def oracle_sql(k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, prefix: str = "3:") -> str:
    """The rounds one after another in DuckDB SQL."""
    parts = [
        f"""v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY h, p) - 1 AS INTEGER) AS cluster, p FROM (
                SELECT sha256('{prefix}' || vec_id) AS h, p FROM v WHERE vec_id IS NOT NULL ORDER BY h, p LIMIT {k})
        )""",
    ]
    near = lambda i: f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, p, cluster, distance FROM (
                SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS place FROM (
                    SELECT v.r, v.vec_id, v.p, c.cluster, CAST(list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
                    FROM v CROSS JOIN c{i} c)) WHERE place = 1
        )"""  # noqa: E731
    for i in range(rounds):
        parts.append(near(i))
        parts.append(f"""c{i + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(n.p, c.p) AS p FROM c{i} c LEFT JOIN (
                SELECT cluster, list(CAST(q AS BIGINT) ORDER BY place) AS p FROM (
                    SELECT cluster, place, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS q FROM (
                        SELECT cluster, place, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT cluster, unnest(p) AS x, unnest(range({dimension})) AS place FROM a{i}) GROUP BY ALL))
                GROUP BY cluster) n USING (cluster)
        )""")
    parts.append(near(rounds))
    return f"""WITH {", ".join(parts)}
        SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
