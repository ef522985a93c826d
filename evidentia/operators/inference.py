"""Network-based inference on a drug - target - substructure graph: weighted transition, propagation, similarity and prediction.

Inputs are long tables; a query is a compound with its substructures, and an official drug as a query also has known
targets. Ties of scores and of similarities are broken by the smaller id.

Queries never meet drugs as pairs: the two steps over a drug are taken once for the graph, from substructures and targets
to targets, and similarities are counted within blocks of queries and drugs, which hand on the nearest drugs of each wanted
target only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import significant
from ..sources.tables import steps, written

#: Rows of a small side that may be broadcast; a larger one is joined by sort and merge.
BROADCAST_ROWS = 200_000
#: Significant digits by which scores are put in order: sums that differ by the order of addition only are ties.
DIGITS = 12
#: Edges of the drugs or queries in a block, and queries in a block.
BLOCK_EDGES, BLOCK_QUERIES = 4_000_000, 20_000
#: Cells of a matrix that a block is made into, and how many of them an edge may stand for; others are counted over lists.
CELLS, CELLS_PER_EDGE = 64_000_000, 32
#: Rows of a join that cost as much as a product of matrices by its cells.
PRODUCTS_PER_ROW = 100
#: Rows of two steps that may be broadcast; more are joined by sort and merge.
TWO_STEP_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Shares of a query's substructures and of the graph's substructure edges, exponent of the column sums, length of the normalised head, similar drugs, steps, and predictions kept."""

    # fixed values of the method
    alpha: float = 0.4
    beta: float = 0.2
    gamma: float = -0.5
    delta: int = 20
    epsilon: int = 4
    steps: int = 2
    most: int = 10

    def __post_init__(self) -> None:
        if not (0 <= self.alpha <= 1 and 0 <= self.beta <= 1 and self.delta >= 0 and self.epsilon >= 1 and self.steps >= 1 and self.most >= 1):
            raise ValueError("inference parameters are out of range")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if ``rows``, its counted size, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tied(column: Column) -> Column:
    """A score rounded to DIGITS significant digits, for comparison; however small, it stays positive."""
    return F.format_string(f"%.{DIGITS - 1}e", column.cast("double")).cast("double")


def transition(drug_sub: DataFrame, drug_target: DataFrame, beta: float, gamma: float) -> DataFrame:
    """(src, dst, p): adjacency beta on substructures and 1 - beta on targets, both ways; columns scaled by their sum to the power gamma; rows to one.

    Only drugs that have a target take part, so that no mass goes where no target can be reached. Inputs: (drug, sub)
    and (drug, target), ids unique over kinds; repeated pairs count once.
    """
    targets = drug_target.select("drug", F.col("target").alias("other")).distinct()
    subs = drug_sub.select("drug", F.col("sub").alias("other")).distinct().join(targets.select("drug").distinct(), "drug", "left_semi")
    one_way = subs.withColumn("w", F.lit(float(beta))).union(targets.withColumn("w", F.lit(1.0 - beta))).where("w > 0")
    both = one_way.select(F.col("drug").alias("src"), F.col("other").alias("dst"), "w").union(one_way.select(F.col("other").alias("src"), F.col("drug").alias("dst"), "w"))
    column = both.groupBy("dst").agg(F.sum("w").alias("c"))
    scaled = both.join(column, "dst").select("src", "dst", (F.col("w") * F.pow("c", F.lit(float(gamma)))).alias("w"))
    return scaled.join(scaled.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def represented(query_sub: DataFrame, drug_sub: DataFrame) -> DataFrame:
    """(query, sub) of the substructures that the graph has."""
    return query_sub.select("query", "sub").distinct().join(drug_sub.select("sub").distinct(), "sub", "left_semi").select("query", "sub")


def sub_degree(query_sub: DataFrame) -> DataFrame:
    """(query, degree): a query's distinct substructures, those that the graph lacks too."""
    return query_sub.groupBy("query").agg(F.countDistinct("sub").alias("degree"))


def seeds(query_sub: DataFrame, known: DataFrame, alpha: float) -> DataFrame:
    """(query, node, mass): alpha over a query's substructures, all of them counted, and 1 - alpha over its known targets."""
    subs = query_sub.select("query", "sub").distinct().join(sub_degree(query_sub), "query").select("query", F.col("sub").alias("node"), (F.lit(float(alpha)) / F.col("degree")).alias("mass"))
    held = known.groupBy("query").agg(F.countDistinct("target").alias("n"))
    return subs.union(known.select("query", "target").distinct().join(held, "query").select("query", F.col("target").alias("node"), (F.lit(1.0 - alpha) / F.col("n")).alias("mass")))


def propagate(mass: DataFrame, moves: DataFrame, steps: int) -> DataFrame:
    """(query, node, mass) after so many steps along the transition, all nodes; sums are combined before each shuffle."""
    for _ in range(steps):
        mass = mass.join(moves, mass.node == moves.src).groupBy("query", F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
    return mass


def two_steps(into: DataFrame, out: DataFrame) -> DataFrame:
    """(src, dst, p) of two steps by way of a drug. into: (src, drug, p); out: (drug, dst, q)."""
    return into.join(out, "drug").groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a column, and each row's place among them."""
    own = column.combine_chunks().dictionary_encode()
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    return own.dictionary, own.indices.to_numpy()


def cells(row: np.ndarray, column: np.ndarray, value: np.ndarray, first: int, rows: int, columns: int) -> np.ndarray:
    """A matrix of ``rows`` rows from ``first`` on; ``row`` is in ascending order, and a cell's values are summed."""
    own = slice(*np.searchsorted(row, (first, first + rows)))
    return np.bincount((row[own] - first) * columns + column[own], value[own], rows * columns).reshape(rows, columns)


def from_cells(found: np.ndarray, left: pa.Array, right: pa.Array, schema: pa.Schema) -> pa.Table:
    """Rows (left, right, value) of the cells that are not 0."""
    a, b = np.nonzero(found)
    return pa.Table.from_arrays([left.take(pa.array(a)), right.take(pa.array(b)), pa.array(found[a, b])], schema=schema)


def product(left: DataFrame, right: DataFrame, by: str, row: str, column: str, value: str, over: str, blocks: int) -> DataFrame:
    """(row, column, value): the sums of w * v over ``by`` from left (row, by, w) and right (by, column, v), as products of matrices.

    ``over`` is the column whose values are dealt out over blocks: ``by``, then both sides have it and a block's sums are
    added up afterwards, or ``row``, then each block gets the whole right side, which must be small. A block takes 1,024 of
    those values at a time, so its matrices have no more than 1,024 times the other side's values.
    """
    kind = {**dict(left.dtypes), **dict(right.dtypes)}
    spec = f"{row} {kind[row]}, {column} {kind[column]}, {value} double"
    schema = arrow_schema(left, spec)

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        rows, i = coded(a[row])
        columns, j = coded(b[column])
        shared, k = coded(b[by])
        h = pc.index_in(a[by], shared)
        kept = pc.is_valid(h).to_numpy()
        i, h, w, v = i[kept], h.drop_null().to_numpy(), a["w"].to_numpy()[kept], b["v"].to_numpy()
        if over == row:
            order, other = np.argsort(i, kind="stable"), cells(*(x[np.argsort(k, kind="stable")] for x in (k, j, v)), 0, len(shared), len(columns))
            i, h, w = i[order], h[order], w[order]
            parts = [from_cells(cells(i, h, w, at, min(1024, len(rows) - at), len(shared)) @ other, rows[at : at + 1024], columns, schema) for at in range(0, len(rows), 1024)]
            return pa.concat_tables(parts)
        mine, theirs, total = np.argsort(h, kind="stable"), np.argsort(k, kind="stable"), np.zeros((len(rows), len(columns)))
        i, h, w, j, k, v = i[mine], h[mine], w[mine], j[theirs], k[theirs], v[theirs]
        for at in range(0, len(shared), 1024):
            n = min(1024, len(shared) - at)
            total += cells(h, i, w, at, n, len(rows)).T @ cells(k, j, v, at, n, len(columns))
        return from_cells(total, rows, columns, schema)

    block = F.pmod(F.xxhash64(over), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = left.withColumn("_b", block).groupBy("_b").cogroup(right.withColumn("_b", block if over == by else every).groupBy("_b")).applyInArrow(multiply, spec)
    return met if over == row else met.groupBy(row, column).agg(F.sum(value).alias(value))


def blocks_of(df: DataFrame, rows: int) -> int:
    """Blocks of so many rows, and enough for all cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_EDGES))


def dense_two_steps(into: DataFrame, out: DataFrame, products: int, drugs: int, rows: int) -> DataFrame | None:
    """``two_steps`` as products of matrices, where these cost less than the ``products`` rows of the join; else None."""
    if products < TWO_STEP_ROWS:
        return None
    n, m = into.select("src").distinct().count(), out.select("dst").distinct().count()
    if n * m > CELLS // 8 or 1024 * max(n, m) > CELLS or drugs * n * m > products * PRODUCTS_PER_ROW:
        return None
    return product(into.select("src", "drug", F.col("p").alias("w")), out.select("drug", "dst", F.col("q").alias("v")), "drug", "src", "dst", "p", "drug", blocks_of(into, rows))


def arrow_schema(df: DataFrame, spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in df.sparkSession.createDataFrame([], spec).schema])


def spread(mass: DataFrame, table: DataFrame) -> DataFrame:
    """(query, node, mass) one application of a written table of ``two_steps`` on.

    Queries are dealt out first; a table small enough to be broadcast then needs no further shuffle, else partial sums
    are combined before it. No row has a query and a drug.
    """
    n = table.count()
    if n <= TWO_STEP_ROWS:
        nodes, ends = table.agg(F.count_distinct("src"), F.count_distinct("dst")).first()
        asked = mass.agg(F.count("*").alias("rows"), F.count_distinct("query").alias("queries")).first()
        if asked.rows * n > TWO_STEP_ROWS * max(1, nodes) and nodes * ends <= CELLS // 8 and 1024 * nodes <= CELLS and asked.queries * nodes * nodes * ends <= asked.rows * n * PRODUCTS_PER_ROW:
            rows = mass.select("query", F.col("node").alias("src"), F.col("mass").alias("w"))
            found = product(rows, table.select("src", "dst", F.col("p").alias("v")), "src", "query", "dst", "mass", "query", blocks_of(mass, asked.rows))
            return found.withColumnRenamed("dst", "node").select("query", "node", "mass")
    dealt = mass.repartition("query") if n <= TWO_STEP_ROWS else mass
    other = F.broadcast(table) if n <= TWO_STEP_ROWS else table
    return dealt.join(other, dealt.node == other.src).groupBy("query", F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))


def reached(mass: DataFrame, moves: DataFrame, drugs: DataFrame, targets: DataFrame, steps: int, table: bool | None = None) -> DataFrame:
    """(query, target, score) of the targets with mass after so many steps, from mass on substructures and targets.

    Two steps by way of a drug are one table of substructures and targets, which all queries share. For few queries over a
    dense graph that table takes more products than the queries' own steps; then these are taken one by one. Both ways
    are counted before and give the same scores; ``table`` chooses. After an odd number of steps all mass lies on drugs,
    so no target has any.
    """
    if steps % 2:
        return mass.select("query", F.col("node").alias("target"), F.col("mass").alias("score")).limit(0)
    by_drug, ends = small(drugs.select("drug").distinct(), drugs.count()), targets.select(F.col("target").alias("dst"))
    into = moves.join(by_drug.withColumnRenamed("drug", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("drug"), "p")
    out = moves.join(by_drug.withColumnRenamed("drug", "src"), "src", "left_semi").select(F.col("src").alias("drug"), "dst", F.col("p").alias("q"))
    last = out.join(small(ends, ends.count()), "dst", "left_semi")
    mass = written(mass.select("query", "node", "mass"), "mass")
    products = None
    if table is None:
        asked = into.join(mass.select(F.col("node").alias("src")).distinct(), "src", "left_semi") if steps == 2 else into
        per_drug = asked.groupBy("drug").agg(F.count("*").alias("i")).join(last.groupBy("drug").agg(F.count("*").alias("o")), "drug")
        r = per_drug.agg(F.sum(F.col("i") * F.col("o")).alias("products"), F.sum("o").alias("ends"), F.count("*").alias("drugs")).first()
        first = mass.join(into.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node").agg(F.sum("n")).first()[0] or 0
        pairs = min(first, mass.select("query").distinct().count() * (r.drugs or 0))  # rows of queries and drugs
        products = r.products or 0
        table = products <= first + pairs * (r.ends or 0) // max(1, r.drugs or 0)
    if not table:
        return propagate(mass, moves, steps).join(targets.select(F.col("target").alias("node")), "node", "left_semi").where("mass > 0").select("query", F.col("node").alias("target"), F.col("mass").alias("score"))
    if steps > 2:
        between = written(two_steps(into, out), "two-steps")
        for _ in range(steps // 2 - 1):
            mass = spread(mass, between)
        mass = written(mass, "mass")
    into = into.join(mass.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    dense = dense_two_steps(into, last, products, r.drugs or 0, into.count()) if products else None
    return spread(mass, written(dense if dense is not None else two_steps(into, last), "two-steps")).where("mass > 0").select("query", F.col("node").alias("target"), F.col("mass").alias("score"))


def threshold_normalised(scores: DataFrame, queries: DataFrame, targets: DataFrame, delta: int) -> DataFrame:
    """(query, target, score, normalised) over all targets in the order of score, descending, and id.

    The first min(delta + known + 1, number of targets) count 1; others are shares of the last of these, 0 if that is 0.
    Rows are those that are not 0: what propagation reached, and for a query that reached fewer targets than the head
    holds, the first of the others. scores: (query, target, score) with positive scores; queries: (query, known);
    targets: (target). No query meets all targets: what fills a head is taken from the first ids.
    """
    n = targets.count()
    place = F.row_number().over(Window.partitionBy("query").orderBy(tied(F.col("score")).desc(), "target"))
    edged = queries.select("query", F.least(F.lit(delta + 1) + F.coalesce("known", F.lit(0)), F.lit(n)).cast("long").alias("edge"))
    rows = scores.join(edged, "query").withColumn("place", place)
    last = rows.where("place = edge").select("query", F.col("score").alias("last"))
    rows = rows.join(last, "query", "left")
    own = rows.select("query", "target", "score", F.when(F.col("place") <= F.col("edge"), 1.0).otherwise(F.col("score") / F.col("last")).alias("normalised"))
    # heads that are not full
    reached = scores.groupBy("query").agg(F.count("*").alias("reached"))
    short = edged.join(reached, "query", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < edge")
    short = written(short.select("query", "reached", "edge"), "short-heads")
    most = short.agg(F.max(F.col("reached") + F.col("edge"))).first()[0]
    if most is None:
        return own
    first = targets.select("target").orderBy("target").limit(most)  # twice the longest head at most
    first = first.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("target")))
    wanted = short.select("query", "reached", "edge", F.explode(F.sequence(F.lit(1), (F.col("reached") + F.col("edge")).cast("int"))).alias("at"))
    free = wanted.join(small(first, most), "at").join(scores.select("query", "target"), ["query", "target"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("target"))).where("k <= edge - reached")
    return own.unionByName(free.select("query", "target", F.lit(0.0).alias("score"), F.lit(1.0).alias("normalised")))


def tanimoto(left: DataFrame, right: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """(a, b, common, similarity) of all pairs that share an item. left: (a, item), right: (b, item); degree: (a, na), where a has items that ``left`` leaves out.

    A hot item's rows are split over tasks by adaptive execution; pairs are combined before they are shuffled.
    """
    left, right = left.select("a", "item").distinct(), right.select("b", "item").distinct()
    na = degree if degree is not None else left.groupBy("a").agg(F.count("*").alias("na"))
    nb = right.groupBy("b").agg(F.count("*").alias("nb"))
    common = left.join(right, "item").groupBy("a", "b").agg(F.count("*").alias("common"))
    return common.join(na, "a").join(nb, "b").select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))


NEAR = "query {query}, target {target}, drug {drug}, similarity double, weight double"


def nearest_in_block(most: int, schema: pa.Schema):
    """For a block of queries and one of drugs: the ``most`` drugs of each wanted target that are most like the query, of this block's."""

    def near(queries: pa.Table, drugs: pa.Table) -> pa.Table:
        if not queries.num_rows or not drugs.num_rows:
            return schema.empty_table()
        drugs = drugs.sort_by("drug").combine_chunks()
        queries = queries.combine_chunks()
        flat = lambda t, c: t[c].combine_chunks().flatten()
        sizes = lambda t, c: pc.list_value_length(t[c]).to_numpy()
        subs = pc.unique(flat(drugs, "subs"))
        at = pc.index_in(flat(drugs, "subs"), subs).to_numpy()
        owner = np.repeat(np.arange(len(drugs)), sizes(drugs, "subs"))
        order = np.argsort(at, kind="stable")
        postings, first = owner[order], np.searchsorted(at[order], np.arange(len(subs) + 1))
        known = flat(drugs, "known")
        targets = pc.unique(known.field("target"))
        of = pc.index_in(known.field("target"), targets).to_numpy()
        holder = np.repeat(np.arange(len(drugs)), sizes(drugs, "known"))
        weight = known.field("weight").to_numpy(zero_copy_only=False)
        by_target = np.argsort(of, kind="stable")
        holders, weights, begin = holder[by_target], weight[by_target], np.searchsorted(of[by_target], np.arange(len(targets) + 1))
        size, asked = drugs["n"].to_numpy(), queries["n"].to_numpy()
        own = pc.fill_null(pc.index_in(flat(queries, "subs"), subs), -1).to_numpy()
        wanted = pc.fill_null(pc.index_in(flat(queries, "wanted"), targets), -1).to_numpy()
        cut, goal = np.append(0, np.cumsum(sizes(queries, "subs"))), np.append(0, np.cumsum(sizes(queries, "wanted")))
        rows, found = [], []
        edges, width = len(at) + len(of), len(drugs) * (len(subs) + len(targets))
        dense = width <= CELLS and width <= edges * CELLS_PER_EDGE
        if dense:  # matrices of drugs and substructures, drugs and targets
            has = np.zeros((len(drugs), len(subs)), np.float32)
            has[owner, at] = 1
            place_of = np.full((len(drugs), len(targets)), -1, np.int32)
            place_of[holder, of] = np.arange(len(of))
            holders_of = np.diff(begin)
        for i in range(len(queries)):
            if dense:
                if i % 256 == 0:
                    some = slice(cut[i], cut[min(i + 256, len(queries))])
                    line = np.repeat(np.arange(min(256, len(queries) - i)), np.diff(cut[i : i + 257]))
                    shown = np.zeros((min(256, len(queries) - i), len(subs)), np.float32)
                    shown[line[own[some] >= 0], own[some][own[some] >= 0]] = 1
                    every = (shown @ has.T).astype(np.int64)
                common = every[i % 256]
            else:
                mine = own[cut[i] : cut[i + 1]]
                lists = [postings[first[x] : first[x + 1]] for x in mine[mine >= 0].tolist()]
                common = np.bincount(np.concatenate(lists), minlength=len(drugs)) if lists else np.zeros(len(drugs), np.int64)
            like = common / np.maximum(size + asked[i] - common, 1)
            some = wanted[goal[i] : goal[i + 1]]
            some = some[some >= 0]
            if dense:  # the drugs in their order, until each target has enough or all of its own
                n, need = min(len(drugs), 16 * most), np.minimum(holders_of[some], most)
                while len(some):
                    edge = np.partition(like, len(like) - n)[len(like) - n]
                    best = np.flatnonzero(like >= edge)
                    best = best[np.argsort(-like[best], kind="stable")]
                    held = place_of[np.ix_(best, some)]
                    taken = (held >= 0) & (np.cumsum(held >= 0, axis=0) <= most)
                    met = taken.sum(axis=0) == need
                    who, target = np.nonzero(taken & (met | (len(best) == len(like))))
                    rows.append(np.full(len(who), i))
                    found.append((some[target], best[who], like[best[who]], weight[held[who, target]]))
                    some, need = some[~met], need[~met]
                    if len(best) == len(like):
                        break
                    n = min(len(drugs), 8 * n)
                continue
            many = begin[some + 1] - begin[some]
            place = np.arange(many.sum()) + np.repeat(begin[some] - (np.cumsum(many) - many), many)
            who, target = holders[place], np.repeat(some, many)
            best = np.lexsort((who, -like[who], target))
            ends = np.flatnonzero(np.append(True, np.diff(target[best]) != 0)) if len(best) else best
            rank = np.arange(len(best)) - np.repeat(ends, np.diff(np.append(ends, len(best))))
            best = best[rank < most]
            rows.append(np.full(len(best), i))
            found.append((target[best], who[best], like[who[best]], weights[place[best]]))
        if not rows:
            return schema.empty_table()
        rows = np.concatenate(rows)
        target, who, like, weight = (np.concatenate(x) for x in zip(*found))
        columns = [queries["query"].take(pa.array(rows)), targets.take(pa.array(target)), drugs["drug"].take(pa.array(who)), pa.array(like.astype(float)), pa.array(weight.astype(float))]
        return pa.Table.from_arrays(columns, schema=schema)

    return near


def neighbour_weight(query_sub: DataFrame, degree: DataFrame, wanted: DataFrame, drug_sub: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(query, target, weight) of the wanted pairs: the mean known weight of the ``most`` drugs of a target that are most like the query.

    Likeness is the share of common substructures in all; drugs without any count too, in the order of their ids. Each
    block of queries meets each block of drugs in one task, which counts common substructures over the drugs' lists and
    hands on ``most`` drugs of each wanted target; a substructure that many drugs have is split over the blocks. No table
    of pairs is made. query_sub: (query, sub), once each; degree: (query, degree); wanted: (query, target); drug_sub:
    (drug, sub); known: (drug, target, weight), each pair once.
    """
    kind = {c: dict(df.dtypes)[c] for c, df in (("query", wanted), ("target", known), ("drug", known))}
    subs = drug_sub.select("drug", "sub").distinct().groupBy("drug").agg(F.collect_list("sub").alias("subs"))
    held = known.groupBy("drug").agg(F.collect_list(F.struct("target", F.col("weight").cast("double").alias("weight"))).alias("known"))
    kind_sub = dict(drug_sub.dtypes)["sub"]
    drugs = written(held.join(subs, "drug", "left").select("drug", F.coalesce("subs", F.array().cast(f"array<{kind_sub}>")).alias("subs"), "known").withColumn("n", F.size("subs")), "drugs")
    asked = wanted.select("query", "target").distinct().groupBy("query").agg(F.collect_list("target").alias("wanted"))
    own = query_sub.groupBy("query").agg(F.collect_list("sub").alias("subs"))
    asked = asked.join(own, "query", "left").join(degree.select("query", F.col("degree").alias("n")), "query", "left")
    asked = written(asked.select("query", F.coalesce("subs", F.array().cast(f"array<{kind_sub}>")).alias("subs"), "wanted", F.coalesce("n", F.lit(0)).cast("int").alias("n")), "asked")
    edges = drugs.agg(F.sum(F.greatest(F.col("n") + F.size("known"), F.lit(1)))).first()[0] or 0
    told = asked.agg(F.count("*").alias("queries"), F.sum(F.size("subs") + F.size("wanted")).alias("edges")).first()
    n_drugs = max(1, -(-edges // BLOCK_EDGES))
    n_queries = max(1, -(-told.queries // BLOCK_QUERIES), -(-(told.edges or 0) // BLOCK_EDGES))
    n_queries = max(n_queries, min(wanted.sparkSession.sparkContext.defaultParallelism // n_drugs, -(-told.queries // 64)))  # work for all cores
    spread_over = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", spread_over("query", n_queries)).withColumn("_d", every(n_drugs)).groupBy("_q", "_d")
    right = drugs.withColumn("_d", spread_over("drug", n_drugs)).withColumn("_q", every(n_queries)).groupBy("_q", "_d")
    schema = NEAR.format(**kind)
    to_arrow = arrow_schema(wanted, schema)
    near = left.cogroup(right).applyInArrow(nearest_in_block(most, to_arrow), schema)
    if n_drugs > 1:
        place = F.row_number().over(Window.partitionBy("query", "target").orderBy(F.desc("similarity"), "drug"))
        near = near.withColumn("_place", place).where(F.col("_place") <= most)
    return near.groupBy("query", "target").agg(F.avg("weight").alias("weight"))


def contenders(normal: DataFrame, held: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(query, target, normalised) of the targets that can be among the ``most`` best: a score lies between those of the target's least and largest known weight.

    held: (query, target) that are no predictions; known: (drug, target, weight).
    """
    bounds = known.groupBy("target").agg(F.min("weight").alias("_least"), F.max("weight").alias("_most"))
    rows = normal.join(held, ["query", "target"], "left_anti").join(small(bounds, bounds.count()), "target")
    rows = rows.select("query", "target", "normalised", (F.col("normalised") * F.col("_least")).alias("_low"), (F.col("normalised") * F.col("_most")).alias("_high")).where("_high > 0")
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_low"))))
    edge = F.max(F.when((F.col("_place") == most) & (F.col("_low") > 0), F.col("_low"))).over(Window.partitionBy("query"))
    return placed.withColumn("_edge", edge).where(F.col("_edge").isNull() | (F.col("_high") >= F.col("_edge") * (1 - 1e-9))).select("query", "target", "normalised")


def predicted(scores: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(query, target, score, rank): the ``most`` best positive scores per query without its known targets; ties by target."""
    fresh = scores.where(F.col("score") > 0).join(known, ["query", "target"], "left_anti")
    own = Window.partitionBy("query").orderBy(tied(F.col("score")).desc(), "target")
    return fresh.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def predict(query_sub: DataFrame, drug_sub: DataFrame, drug_target: DataFrame, settings: Settings, known: DataFrame | None = None) -> DataFrame:
    """(query, target, score, rank): the whole prediction, from substructures to ranked targets.

    query_sub: (query, sub); drug_sub: (drug, sub); drug_target: (drug, target, weight), each pair once; known: (query,
    target) of queries that are official drugs. A query none of whose substructures the graph has gets no prediction.
    """
    with steps() as keep:
        targets = written(drug_target.select("target").distinct(), "targets")
        held = written(drug_target.select("drug").distinct(), "held")
        # the similarity looks at drugs with a target; the graph's substructures are those of all drugs
        own_sub = written(drug_sub.select("drug", "sub").distinct(), "drug-sub")
        weights = written(drug_target.select("drug", "target", F.col("weight").cast("double").alias("weight")), "drug-target")
        shown = written(represented(query_sub, own_sub), "represented")
        degree = sub_degree(query_sub)
        none = shown.select("query", F.col("sub").alias("target")).limit(0)
        known = none if known is None else known.select("query", "target").distinct().join(shown.select("query").distinct(), "query", "left_semi")
        known = written(known, "known")
        moves = written(transition(own_sub, weights, settings.beta, settings.gamma), "moves")
        subs = shown.join(degree, "query").select("query", F.col("sub").alias("node"), (F.lit(settings.alpha) / F.col("degree")).alias("mass"))
        counts = known.groupBy("query").agg(F.count("*").alias("known"))
        mass = subs.union(known.join(counts, "query").select("query", F.col("target").alias("node"), (F.lit(1.0 - settings.alpha) / F.col("known")).alias("mass")))
        scores = written(reached(mass, moves, held, targets, settings.steps), "scores")
        queries = shown.select("query").distinct().join(counts, "query", "left")
        normal = written(threshold_normalised(scores, queries, targets, settings.delta), "normalised")
        rows = written(contenders(normal, known, weights, settings.most), "contenders")
        means = neighbour_weight(shown, degree, rows, own_sub.join(held, "drug", "left_semi"), weights, settings.epsilon)
        final = rows.join(means, ["query", "target"]).select("query", "target", (F.col("normalised") * F.col("weight")).alias("score"))
        return keep(written(predicted(final, known, settings.most), "predicted"))


def official_queries(drug_sub: DataFrame, drug_target: DataFrame, drugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_sub, known) of official drugs as queries. drugs: (drug); those that the graph lacks are left out."""
    inside = drugs.select("drug").distinct().join(drug_target.select("drug").distinct(), "drug", "left_semi")
    return drug_sub.join(inside, "drug", "left_semi").select(F.col("drug").alias("query"), "sub"), drug_target.join(inside, "drug", "left_semi").select(F.col("drug").alias("query"), "target")


def known_rows(drug_target: DataFrame, drugs: DataFrame) -> DataFrame:
    """(drug, target, weight, place): known targets of the drugs by weight, descending, and id."""
    own = Window.partitionBy("drug").orderBy(F.desc("weight"), "target")
    return drug_target.join(drugs.select("drug").distinct(), "drug", "left_semi").withColumn("place", F.row_number().over(own))


def raw_rows(predictions: DataFrame, source_type: str, known: DataFrame | None = None) -> DataFrame:
    """The six raw columns: predictions with their rank, then known targets with the rank "-"; scores to nine digits. predictions: (query, target, score, rank)."""
    text = lambda c: significant(F.col(c))
    rows = predictions.select(F.lit(source_type).alias("source_type"), F.col("query").alias("source_id"), F.lit("TARGET").alias("target_type"), F.col("target").alias("uniprot_id"), text("score").alias("score"), F.col("rank").cast("string").alias("rank"), F.lit(0).alias("_kind"), F.col("rank").alias("_place"))
    if known is not None:
        rows = rows.unionByName(known.select(F.lit(source_type).alias("source_type"), F.col("drug").alias("source_id"), F.lit("TARGET").alias("target_type"), F.col("target").alias("uniprot_id"), text("weight").alias("score"), F.lit("-").alias("rank"), F.lit(1).alias("_kind"), F.col("place").alias("_place")))
    return rows


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch_id``, batch_0001 and on, of ``size`` rows each in the order of a numeric column."""
    from .ranking import global_position

    placed = global_position(rows, order, [F.col(order)], "_place")
    return placed.withColumn("batch_id", F.format_string("batch_%04d", (F.floor((F.col("_place") - 1) / size) + 1).cast("long"))).drop("_place")


def structure_queries(compounds: DataFrame, official: DataFrame) -> DataFrame:
    """compounds (_ord, ID, SMILES, match_key) with official_drug_id, input_type and input_id.

    official: (_ord, drug_id, match_key); of drugs with one structure the first stands. A compound without a match key
    is a COMPOUND that goes into no batch.
    """
    first = official.where(F.coalesce("match_key", F.lit("")) != "").groupBy("match_key").agg(F.min_by("drug_id", "_ord").alias("official_drug_id"))
    rows = compounds.join(first, "match_key", "left").withColumn("official_drug_id", F.coalesce("official_drug_id", F.lit("")))
    is_drug = F.col("official_drug_id") != ""
    return rows.withColumns({"netinfer_input_type": F.when(is_drug, "DRUG").otherwise("COMPOUND"), "netinfer_input_id": F.when(is_drug, F.col("official_drug_id")).otherwise(F.col("ID"))})


def known_first(rows: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """Each compound's targets: known ones first, by score where they have one, then predictions by rank; a symbol counts once, from its first row.

    rows: (compound_id, uniprot_id, evidence, prediction_rank, _ord[, score]); names: (uniprot_id, gene_symbol), blank or
    missing symbols fall back to the id.
    """
    named = rows.where((F.col("evidence") == "known") | F.col("prediction_rank").between(1, most)).join(names, "uniprot_id", "left")
    symbol = F.coalesce(F.when(F.trim("gene_symbol") != "", F.col("gene_symbol")), F.col("uniprot_id"))
    known = F.col("evidence") == "known"
    score = F.when(known, F.col("score").cast("double")) if "score" in rows.columns else F.lit(None).cast("double")
    named = named.withColumn("gene_symbol", symbol).withColumn("_kind", (~known).cast("int")).withColumn("_key", F.when(known, 0).otherwise(F.coalesce("prediction_rank", F.lit(0)))).withColumn("_score", score)
    order = ["_kind", "_key", F.desc_nulls_last("_score"), "_ord", "uniprot_id"]
    kept = named.withColumn("_n", F.row_number().over(Window.partitionBy("compound_id", "gene_symbol").orderBy(*order))).where("_n = 1")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("compound_id").orderBy(*order))).drop("_n", "_kind", "_key", "_score")


def merged_targets(mapping: DataFrame, raw: DataFrame, names: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(targets, missing): every user id that maps to a source gets all of the source's targets.

    mapping: (ID, SMILES, match_key, netinfer_input_type, netinfer_input_id); raw: (source_type, source_id, uniprot_id,
    score, evidence, prediction_rank, _ord). missing: (ID, reason).
    """
    met = mapping.join(raw, (mapping.netinfer_input_type == raw.source_type) & (mapping.netinfer_input_id == raw.source_id)).select(F.col("ID").alias("compound_id"), "SMILES", "uniprot_id", "score", "evidence", "prediction_rank", "_ord")
    targets = known_first(met, names, most)
    reason = F.when(F.trim(F.coalesce("match_key", F.lit(""))) == "", "standardization_failed").otherwise("no_prediction_rows")
    return targets, mapping.join(targets.select(F.col("compound_id").alias("ID")).distinct(), "ID", "left_anti").select("ID", reason.alias("reason"))


def consistent_mapping(mapping: DataFrame) -> Column:
    """Whether a mapping row keeps its rules: a DRUG has a key, its official id as input id and no batch; a COMPOUND has no official id and its own id, and a batch just if it has a key."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    drug = filled("match_key") & (F.col("official_drug_id") == F.col("netinfer_input_id")) & ~filled("batch_id") & filled("official_drug_id")
    compound = ~filled("official_drug_id") & (F.col("netinfer_input_id") == F.col("ID")) & (filled("batch_id") == filled("match_key"))
    return F.coalesce(F.when(F.col("netinfer_input_type") == "DRUG", drug).when(F.col("netinfer_input_type") == "COMPOUND", compound), F.lit(False))
