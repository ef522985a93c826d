"""Knowledge graph: edge union, node indices, canonical direction, splits, reverse edges, negatives, aggregation and scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import holdout
from ..sources.tables import steps, written
from .ranking import first_wins, global_position, running_sums

TRIPLE = ["x_id", "relation", "y_id"]


def union_edges(sources: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """The sources' edges in their order, each triple once from its first source; empty, looping and dangling edges go.

    sources: (x_id, relation, y_id, _ord); nodes: (node_id).
    """
    rows = reduce(DataFrame.unionByName, [s.select(*TRIPLE, "_ord").withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    rows = rows.where((F.col("x_id") != F.col("y_id")) & F.col("relation").isNotNull() & (F.col("relation") != ""))
    for end in ("x_id", "y_id"):
        rows = rows.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return first_wins(rows.select(*TRIPLE, "_ord", "source"), TRIPLE, F.col("source"), F.col("_ord"))


def node_index(base: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, node_index): base nodes keep their order, new ones follow in theirs. Inputs: (node_id, _ord), numeric order."""
    n = base.agg(F.count("*").alias("_n"))
    old = global_position(base, "_ord", [F.col("_ord"), F.col("node_id")], "_p").select("node_id", (F.col("_p") - 1).alias("node_index"))
    fresh = new.join(base, "node_id", "left_anti")
    fresh = global_position(fresh, "_ord", [F.col("_ord"), F.col("node_id")], "_p").crossJoin(F.broadcast(n)).select("node_id", (F.col("_p") - 1 + F.col("_n")).alias("node_index"))
    return old.unionByName(fresh)


def type_index(nodes: DataFrame) -> DataFrame:
    """Adds each node's 0-based place within its type by node_index, range by range."""
    placed = global_position(nodes, "node_index", [F.col("node_index"), F.col("node_id")], "_p", within=["node_type"])
    return placed.withColumn("type_index", F.col("_p") - 1).drop("_p")


#: Columns of the two ends that change places together.
ENDS = ("type", "id", "index", "idx", "name", "source")


def swapped(edges: DataFrame, when: Column) -> dict[str, Column]:
    """The columns of both ends, exchanged where ``when`` holds; all that the table has of ENDS."""
    own = [e for e in ENDS if {f"x_{e}", f"y_{e}"} <= set(edges.columns)]
    return {f"{a}_{e}": F.when(when, F.col(f"{b}_{e}")).otherwise(F.col(f"{a}_{e}")) for e in own for a, b in (("x", "y"), ("y", "x"))}


def canonical(edges: DataFrame, *order: Column) -> DataFrame:
    """Edges of nodes of one type with the smaller index first, and each (x_id, relation, y_id) once, from its first row in ``order``.

    A table without ids is made distinct by types and indices. All columns of an end move together.
    """
    swap = (F.col("x_type") == F.col("y_type")) & (F.col("x_index") > F.col("y_index"))
    rows = edges.withColumns(swapped(edges, swap))
    keys = TRIPLE if {"x_id", "y_id"} <= set(edges.columns) else ["x_type", "x_index", "relation", "y_type", "y_index"]
    rest = [F.col(c) for c in rows.columns if c not in keys]
    return first_wins(rows, keys, *(order or rest)) if rest else rows.distinct()


def split(edges: DataFrame, key: Column, pinned: Column, seed: int, test: float, valid: float) -> DataFrame:
    """Adds ``split``: per relation shares for test and valid in the order of a seeded digest; pinned rows train.

    key: a text that is unique within a relation. The order follows the digest's first 52 bits, then the key.
    """
    rows = edges.withColumn("_pinned", pinned).withColumn("_key", key)
    rows = rows.withColumn("_draw", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_key")), 1, 13), 16, 10).cast("double"))
    n = rows.groupBy("relation", "_pinned").agg(F.count("*").alias("_n"))
    rows = global_position(rows, "_draw", [F.col("_draw"), F.col("_key")], "_k", within=["relation", "_pinned"]).join(n, ["relation", "_pinned"])
    n_valid, n_test = holdout(F.col("_n"), valid, test)
    name = F.when(F.col("_pinned"), "train").when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_valid, "valid").otherwise("train")
    return rows.withColumn("split", name).drop("_pinned", "_key", "_draw", "_n", "_k")


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reverses with all columns: a relation between types gets ``rev_``, within a type the ends change places.

    Each (x_id, relation, y_id), per split where the table has one, stands once; without ids rows are made distinct.
    """
    within = F.col("x_type") == F.col("y_type")
    back = edges.withColumns({**swapped(edges, F.lit(True)), "relation": F.when(within, F.col("relation")).otherwise(F.concat(F.lit("rev_"), F.col("relation")))})
    both = edges.withColumn("_back", F.lit(0)).unionByName(back.select(*edges.columns).withColumn("_back", F.lit(1)))
    if not {"x_id", "y_id"} <= set(edges.columns):
        return both.drop("_back").distinct()
    keys = [*TRIPLE, *(["split"] if "split" in edges.columns else [])]
    rest = [F.col(c) for c in both.columns if c not in [*keys, "_back"]]
    return first_wins(both, keys, F.col("_back"), *rest).drop("_back")


def checked_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the type-local indices x_idx and y_idx; an end that is no node, or has another type than its node, is an error. nodes: (node_id, node_type, type_index)."""
    out = edges
    for end in ("x", "y"):
        own = nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("node_type").alias("_type"), F.col("type_index").alias(f"{end}_idx"))
        out = out.join(own, f"{end}_id", "left").withColumn(f"_{end}_bad", F.col("_type").isNull() | (F.col("_type") != F.col(f"{end}_type"))).drop("_type")
    out = written(out, "ends")  # read by the count and by what follows
    bad = out.agg(F.sum((F.col("_x_bad") | F.col("_y_bad")).cast("long"))).first()[0]
    if bad:
        raise ValueError(f"{bad} edges have an end that is no node of its type")
    return out.drop("_x_bad", "_y_bad")


def training_frames(nodes: DataFrame, edges: DataFrame, custom_id: str, seed: int, test: float, valid: float, pin: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed nodes, base edges with their split, directed edges): canonical edges, held out per relation, with reverses per split.

    The positives of the custom disease stay in train where ``pin`` says so. nodes: (node_id, node_type, node_index);
    edges: x_type, x_id, x_index, relation, y_type, y_id, y_index and more.
    """
    typed = type_index(nodes)
    key = F.concat_ws("|", "x_id", "relation", "y_id")
    pinned = F.lit(pin) & (F.col("relation") == "drug_disease") & (F.col("y_id") == custom_id)
    with steps() as keep:  # each stage is written once, as the next one reads it several times
        base = written(canonical(checked_ends(edges, typed)), "canonical")
        base = keep(written(split(base, key, F.coalesce(pinned, F.lit(False)), seed, test, valid), "base-edges"))
    return typed, base, with_reverse(base)


#: How a negative end is drawn: (which end, the weight of a node by its number of edges there, null for all nodes alike).
NEGATIVES: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "fix_dst": ("dst", lambda n: F.lit(1.0)),
    "fix_src": ("src", lambda n: F.lit(1.0)),
    "multinomial_dst": ("dst", lambda n: F.pow(n.cast("double"), F.lit(0.75))),
    "multinomial_src": ("src", lambda n: F.pow(n.cast("double"), F.lit(0.75))),
    "corrupt_dst": ("dst", None),
    "corrupt_src": ("src", None),
}


def negatives(edges: DataFrame, seed: int, method: str = "fix_dst", each: int = 1, ends: DataFrame | None = None) -> DataFrame:
    """(src, relation, dst, draw, negative): ``each`` random ends per edge, drawn by a digest of the edge.

    fix_*: alike among the ends that the relation has; multinomial_*: by their number of edges to the power 0.75;
    corrupt_*: alike among ``ends`` (relation, node), all nodes of the type. Weighted ends lie on a line of buckets, so
    a draw is found by joining its bucket; hot relations are spread over their buckets.
    """
    side, weight = NEGATIVES[method]
    if weight is None:
        if ends is None:
            raise ValueError(f"{method} needs all nodes of the type")
        pool = ends.select("relation", F.col("node").alias("negative"), F.lit(1.0).alias("_w")).distinct()
    else:
        pool = edges.groupBy("relation", F.col(side).alias("negative")).agg(weight(F.count("*")).alias("_w"))
    # each end's stretch of the line, in whole units so that the same seed draws the same end anywhere
    pool = pool.withColumn("_w", F.greatest(F.lit(1), F.round(F.col("_w") * 1000)).cast("long"))
    # places follow the ends' own order where they are numbers, else that of a digest
    numeric = dict(pool.dtypes)["negative"] in ("int", "bigint", "smallint")
    pool = pool.withColumn("_at", F.col("negative").cast("double") if numeric else F.pmod(F.xxhash64("negative"), F.lit(1 << 40)).cast("double"))
    placed = global_position(pool, "_at", [F.col("_at"), F.col("negative")], "_place", within=["relation"]) if weight is None or method.startswith("fix") else pool
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "src", "relation", "dst")), 1, 14), 16, 10).cast("long")
    asked = edges.select("src", "relation", "dst").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("_draw", draw)
    if weight is None or method.startswith("fix"):
        n = pool.groupBy("relation").agg(F.count("*").alias("_n"))
        rows = asked.join(F.broadcast(n), "relation").withColumn("_place", F.col("_draw") % F.col("_n") + 1)  # one row per relation
        return rows.join(placed.select("relation", "_place", "negative"), ["relation", "_place"]).select("src", "relation", "dst", "draw", "negative")
    unique = global_position(pool, "_at", [F.col("_at"), F.col("negative")], "_place", within=["relation"])
    line = running_sums(unique, ["relation"], "_place", ["_w"]).select("relation", "negative", (F.col("_run__w") - F.col("_w")).alias("_from"), F.col("_run__w").alias("_to"))
    total = line.groupBy("relation").agg(F.max("_to").alias("_total"))
    width = 65_536
    cells = line.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    rows = asked.join(F.broadcast(total), "relation").withColumn("_point", F.col("_draw") % F.col("_total")).withColumn("_cell", F.floor(F.col("_point") / width))
    met = rows.join(cells, ["relation", "_cell"]).where((F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to")))
    return met.select("src", "relation", "dst", "draw", "negative")


def mean_of_neighbours(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(dst, relation, at, value): one hop of mean aggregation per relation, elementwise. vectors: (node, vec)."""
    rows = edges.join(vectors, edges.src == vectors.node).select("dst", "relation", F.posexplode("vec").alias("at", "value"))
    return rows.groupBy("dst", "relation", "at").agg(F.avg(F.col("value").cast("double")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mapped_vector(vec: Column) -> Column:
    """The linear map of a row's ``matrix`` and ``bias``."""
    return F.zip_with(F.transform("matrix", lambda row: dot(row, vec)), "bias", lambda a, b: a + b)


def as_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, vec) from (keys, at, value)."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("vec"))


def summed_over_relations(inputs: DataFrame, weights: DataFrame, slope: float | None) -> DataFrame:
    """(node, vec) from (dst, relation, vec): the linear map of each relation, summed, and the leaky rectifier if it is asked for."""
    mapped = inputs.join(F.broadcast(weights), "relation").select("dst", F.posexplode(mapped_vector(F.col("vec"))).alias("at", "value"))  # one row per relation is broadcast
    summed = mapped.groupBy("dst", "at").agg(F.sum("value").alias("value"))
    value = F.col("value") if slope is None else F.when(F.col("value") > 0, F.col("value")).otherwise(F.col("value") * slope)
    return as_vectors(summed.withColumn("value", value), "dst").withColumnRenamed("dst", "node")


def relation_layer(edges: DataFrame, vectors: DataFrame, weights: DataFrame, slope: float | None = None) -> DataFrame:
    """(node, vec): one layer of relational convolution: per relation a linear map of the mean of the in-neighbours, summed over relations.

    edges: (src, relation, dst); vectors: (node, vec); weights: (relation, matrix, bias), matrix as rows of the output.
    The mean of linear maps is the linear map of the mean, so vectors are averaged before they are multiplied. slope:
    of the leaky rectifier that follows, if any. Nodes without in-neighbours have no row.
    """
    return summed_over_relations(as_vectors(mean_of_neighbours(edges, vectors), "dst", "relation"), weights, slope)


def attention_shares(edges: DataFrame, vectors: DataFrame, weights: DataFrame, slope: float = 0.01) -> DataFrame:
    """(src, relation, dst, n, share): each edge's share of its destination's attention within a relation; equal edges count ``n`` times.

    weights: as for ``attention_layer``. An edge's logit is the leaky rectifier of a part of its source and a part of its
    destination, so each is computed once per node and relation, not per edge. The softmax takes two aggregations: the
    largest logit of each destination, then the sum of the exponents of what lies below it.
    """
    one = edges.where("src IS NOT NULL AND relation IS NOT NULL AND dst IS NOT NULL").groupBy("src", "relation", "dst").agg(F.count("*").alias("n"))
    one = one.join(vectors.select(F.col("node").alias("src")), "src", "left_semi").join(vectors.select(F.col("node").alias("dst")), "dst", "left_semi")
    known = F.broadcast(weights)  # one row per relation
    of_src = one.select("src", "relation").distinct().join(vectors.withColumnRenamed("node", "src"), "src").join(known, "relation").select("src", "relation", dot(F.col("from_source"), mapped_vector(F.col("vec"))).alias("_src"))
    maps = weights.select(F.col("relation").alias("other"), "matrix", "bias")
    towards = F.broadcast(weights.select("relation", "other", "from_destination").join(maps, "other"))
    of_dst = one.select("dst", "relation").distinct().join(vectors.withColumnRenamed("node", "dst"), "dst").join(towards, "relation").select("dst", "relation", dot(F.col("from_destination"), mapped_vector(F.col("vec"))).alias("_dst"))
    e = F.col("_src") + F.col("_dst")
    rows = one.join(of_src, ["src", "relation"]).join(of_dst, ["dst", "relation"]).select("src", "relation", "dst", "n", F.when(e > 0, e).otherwise(e * slope).alias("_e"))
    tops = rows.groupBy("dst", "relation").agg(F.max("_e").alias("_top"))
    rows = rows.join(tops, ["dst", "relation"]).withColumn("_x", F.exp(F.col("_e") - F.col("_top")))
    totals = rows.groupBy("dst", "relation").agg(F.sum(F.col("_x") * F.col("n")).alias("_total"))
    return rows.join(totals, ["dst", "relation"]).select("src", "relation", "dst", "n", (F.col("_x") / F.col("_total")).alias("share"))


def attention_layer(edges: DataFrame, vectors: DataFrame, weights: DataFrame, slope: float = 0.01, rectified: float | None = None) -> DataFrame:
    """(node, vec): one layer of relational convolution with attention: per relation a linear map of the in-neighbours by their shares, summed over relations.

    edges: (src, relation, dst); vectors: (node, vec); weights: (relation, other, matrix, bias, from_source,
    from_destination): the two halves of the attention vector, and the relation whose map a destination takes (the
    relation itself within one type, its reverse between two). Shares add up to one, so vectors are added up before they
    are multiplied. slope: of the logits' leaky rectifier; rectified: of one that follows, if any. Ends without a vector
    take no part.
    """
    rows = attention_shares(edges, vectors, weights, slope).join(vectors.withColumnRenamed("node", "src"), "src")
    part = rows.select("dst", "relation", F.posexplode("vec").alias("at", "value"), (F.col("share") * F.col("n")).alias("_w"))
    mean = part.groupBy("dst", "relation", "at").agg(F.sum(F.col("value").cast("double") * F.col("_w")).alias("value"))
    return summed_over_relations(as_vectors(mean, "dst", "relation"), weights.select("relation", "matrix", "bias"), rectified)


def distmult(u: Column, w: Column, v: Column) -> Column:
    """Sum of the products of three vectors' components."""
    three = F.zip_with(F.zip_with(u, w, lambda a, b: a.cast("double") * b.cast("double")), v, lambda a, b: a * b.cast("double"))
    return F.aggregate(three, F.lit(0.0), lambda s, x: s + x)


def seed_ensemble(rankings: DataFrame, tops: tuple[int, ...] = (100, 200)) -> DataFrame:
    """Per node over seeds: counts, mean, median, spread and extremes of rank, mean and spread of score, shares in the top. rankings: (seed, node_id, rank, score)."""
    shares = [F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}_freq") for k in tops]
    return rankings.groupBy("node_id").agg(
        F.countDistinct("seed").alias("n_seeds"), F.avg("rank").alias("rank_mean"), F.median("rank").alias("rank_median"), F.coalesce(F.stddev_samp("rank"), F.lit(0.0)).alias("rank_std"),
        F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"), F.avg("score").alias("score_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"), *shares,
    )


def incomplete(rankings: DataFrame, seeds: int) -> DataFrame:
    """Nodes that some seed lacks or has twice; ``complete`` refuses rankings that have any."""
    return rankings.groupBy("node_id").agg(F.countDistinct("seed").alias("n_seeds"), F.count("*").alias("n_rows")).where((F.col("n_seeds") != seeds) | (F.col("n_rows") != F.col("n_seeds")))


def complete(rankings: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """``rankings`` if every seed of the configuration, and no other, ranks the same nodes once."""
    if not seeds or len(set(seeds)) < len(seeds):
        raise ValueError("seeds must be there and be unique")
    found = {r.seed for r in rankings.select("seed").distinct().limit(len(seeds) + 1).collect()}  # one row per seed
    if found != set(seeds):
        raise ValueError(f"rankings of seeds {sorted(found)}; configured are {sorted(seeds)}")
    bad = incomplete(rankings, len(seeds)).limit(1).count()
    if bad:
        raise ValueError("seeds rank different nodes, or a node twice")
    return rankings


def ranked_candidates(nodes: DataFrame, scores: DataFrame, tag: str, positives: DataFrame | None = None) -> DataFrame:
    """(node_id, node_name, source_ids, compound_ids, rank, score, is_train_positive) of the nodes with a candidate's tag, by score, descending, and id.

    nodes: (node_id, node_name, source_ids); scores: (node_id, score); positives: (node_id).
    """
    from ..functions.text import stripped

    parts = F.transform(F.split(F.coalesce("source_ids", F.lit("")), ";"), stripped)
    ids = F.array_distinct(F.filter(F.transform(F.filter(parts, lambda x: x.startswith(tag)), lambda x: stripped(F.substring(x, F.lit(len(tag) + 1), F.length(x)))), lambda x: x != ""))
    rows = nodes.withColumn("_ids", ids).where(F.size("_ids") > 0).join(scores, "node_id")
    rows = global_position(rows, "score", [F.col("score").desc(), F.col("node_id")], "rank", ascending=False)
    if positives is not None:
        rows = rows.join(positives.select("node_id").distinct().withColumn("is_train_positive", F.lit(True)), "node_id", "left")
    else:
        rows = rows.withColumn("is_train_positive", F.lit(None).cast("boolean"))
    return rows.select("node_id", "node_name", "source_ids", F.to_json("_ids").alias("compound_ids"), "rank", "score", F.coalesce("is_train_positive", F.lit(False)).alias("is_train_positive"))
