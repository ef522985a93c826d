"""Network proximity: degree-matched random sets drawn as rows, walks from many modules at once as bit sets, and their stored distances.

A draw is a function of (seed, purpose, draw, node, attempt) alone, so every task makes its own draws and a lost task
makes the same ones again. A walk keeps one bit for each module at every node: all modules move one step by one join of
the frontier with the edges and an or of words, whatever their number.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import steps, written
from .graph import arcs, degree_bins, in_bin

#: Attempts after the first to draw a place that no other node of the set has got.
REDRAWS = 20
#: Words of 64 modules that a row of a walk holds; more modules go in blocks of so many.
WORDS = 16
#: Hexadecimal digits of a digest that a draw takes: 52 bits.
DIGITS = 13


def places(degrees: DataFrame, bins: DataFrame) -> DataFrame:
    """(node, bin, position, members): each node's place among its degree bin's nodes in their order.

    Nodes are split by ranges of (bin, node), so a bin with most of the nodes lies in many tasks.
    """
    ranged = written(in_bin(degrees, bins).select("node", "bin").repartitionByRange("bin", "node").withColumn("_part", F.spark_partition_id()), "bin-ranges")
    before = Window.partitionBy("bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.groupBy("bin", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row for each range and bin that meet
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("bin", "_part").orderBy("node")) - 1)
    placed = numbered.join(own, ["bin", "_part"]).join(F.broadcast(bins.select("bin", "members")), "bin")  # bins are few
    return placed.select("node", "bin", (F.col("_before") + F.col("_k")).alias("position"), "members")


def stand_ins(names: list[bytes], owner: np.ndarray, position: np.ndarray, members: np.ndarray, draw: int, seed: int, purpose: str, redraws: int) -> np.ndarray:
    """The place that each row of a bin draws, -1 for none: any place of its bin but its own, all alike, by a digest of (seed, purpose, draw, node, attempt).

    Rows are in the order of their positions. Of a set's rows that draw one place the first keeps it, and the others draw
    again, up to ``redraws`` times. ``owner`` numbers the sets, ``members`` is the bin's number of nodes in each row.
    """
    begin = hashlib.md5(f"{seed}|{purpose}|{draw}|".encode())
    width = int(members.max()) + 1
    out, rows, taken = np.full(len(names), -1, np.int64), np.arange(len(names)), np.empty(0, np.int64)
    for attempt in range(redraws + 1):
        told, tail = [], f"|{attempt}".encode()
        for i in rows.tolist():
            own = begin.copy()
            own.update(names[i] + tail)
            told.append(own.digest())
        at = (np.frombuffer(b"".join(told), ">u8")[::2] >> np.uint64(64 - 4 * DIGITS)).astype(np.int64) % (members[rows] - 1)
        at += at >= position[rows]
        key = owner[rows] * width + at
        wins = np.zeros(len(rows), bool)
        wins[np.unique(key, return_index=True)[1]] = True
        if len(taken):
            wins &= ~np.isin(key, taken)
        out[rows[wins]] = at[wins]
        taken, rows = np.concatenate([taken, key[wins]]), rows[~wins]
        if not len(rows):
            break
    return out


def asked_places(chosen: DataFrame, placed: DataFrame, draws: int) -> DataFrame:
    """(set_id, bin, word, name, position, members): the chosen nodes in the graph, once for each word of 64 draws. A node without another in its bin is an error."""
    own = written(chosen.join(placed, "node").select("set_id", "bin", F.col("node").cast("string").alias("name"), "position", "members"), "chosen")
    if own.where("members < 2").limit(1).count():
        raise ValueError("a node has no other node in its degree bin")
    words = F.explode(F.sequence(F.lit(0), F.lit(draws // 64)))
    return own.withColumn("word", words) if draws else own.withColumn("word", F.lit(0)).limit(0)


def in_order(asked: pa.Table) -> tuple[pa.Array, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(sets, names, owner, position, members) of a bin's rows in the order of their positions."""
    asked = asked.sort_by("position").combine_chunks()
    coded = pc.dictionary_encode(asked["set_id"], null_encoding="encode").combine_chunks()
    names = [x.encode() for x in asked["name"].to_pylist()]
    return coded.dictionary, names, coded.indices.to_numpy().astype(np.int64), asked["position"].to_numpy(), asked["members"].to_numpy()


def draws_of(word: int, draws: int) -> range:
    """The draws, counted from 1, that lie in a word of 64."""
    return range(max(1, 64 * word), min(draws, 64 * word + 63) + 1)


def matched_draws(chosen: DataFrame, placed: DataFrame, draws: int, seed: int, purpose: str, redraws: int = REDRAWS) -> DataFrame:
    """(set_id, draw, node): for draws 1 to ``draws``, each chosen node's stand-in from its degree bin, as a written table.

    chosen: (set_id, node), each pair once; nodes that ``placed`` lacks are left out. Of a set's nodes that draw one
    place the first keeps it, and the others draw again, up to ``redraws`` times; who then has none is left out, as two
    equal nodes of a set are one. A node without another in its bin is an error. A task draws for one bin and 64 draws.
    """
    asked = asked_places(chosen, placed, draws)
    kind = dict(asked.dtypes)

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        sets, names, owner, position, members = in_order(table)
        rows = []
        for d in draws_of(key[1].as_py(), draws):
            at = stand_ins(names, owner, position, members, d, seed, purpose, redraws)
            held = np.flatnonzero(at >= 0)
            rows.append((owner[held], np.full(len(held), d), at[held]))
        own, d, at = (np.concatenate(x) if rows else np.empty(0, np.int64) for x in (zip(*rows) if rows else [()] * 3))
        return pa.table({"set_id": sets.take(pa.array(own)), "draw": pa.array(d, pa.int32()), "bin": pa.array(np.full(len(d), key[0].as_py()), table.schema.field("bin").type), "place": pa.array(at)})

    found = asked.groupBy("bin", "word").applyInArrow(draw, f"set_id {kind['set_id']}, draw int, bin {kind['bin']}, place long")
    return written(found.join(placed.select("bin", F.col("position").alias("place"), "node"), ["bin", "place"]).select("set_id", "draw", "node"), "stand-ins")


def drawn_distances(chosen: DataFrame, placed: DataFrame, levels: DataFrame, words: int, draws: int, seed: int, purpose: str, redraws: int = REDRAWS) -> DataFrame:
    """(set_id, module, total, n): the summed distance from random module r to the r-th stand-ins of each set, and their number, r from 1 to ``draws``.

    The stand-ins are those of ``matched_draws``, but no row is made of one: they lie in the bin of the node that they
    stand for, so a bin's rows meet the bin's distances from 64 modules in one task, which holds a byte or two for each
    of the bin's nodes and each of these modules and hands on a sum for each set and draw.
    """
    asked = asked_places(chosen, placed, draws)
    kind = dict(asked.dtypes)
    near = levels.join(placed.select("node", "bin", "position"), "node").select("bin", "position", "distance", "block", F.posexplode("bits").alias("_k", "bits"))
    near = near.where("bits <> 0").select("bin", (F.col("block") * words + F.col("_k")).alias("word"), "position", "distance", "bits")

    def total(key: tuple, table: pa.Table, far: pa.Table) -> pa.Table:
        schema = pa.schema([("set_id", table.schema.field("set_id").type), ("module", pa.int64()), ("total", pa.int64()), ("n", pa.int64())])
        if not table.num_rows or not far.num_rows:
            return schema.empty_table()
        sets, names, owner, position, members = in_order(table)
        steps_to = np.full((int(members[0]), 64), -1, np.int8 if pc.max(far["distance"]).as_py() < 128 else np.int32)
        at, bits, distance = far["position"].to_numpy(), far["bits"].to_numpy().view(np.uint64), far["distance"].to_numpy()
        for begin in range(0, len(at), 1 << 14):
            part = slice(begin, begin + (1 << 14))
            row, bit = np.nonzero((bits[part, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
            steps_to[at[part][row], bit] = distance[part][row]
        rows = []
        for d in draws_of(key[1].as_py(), draws):
            place = stand_ins(names, owner, position, members, d, seed, purpose, redraws)
            step = np.where(place >= 0, steps_to[np.maximum(place, 0), d % 64], -1)
            met = step >= 0
            rows.append((np.bincount(owner[met], step[met], len(sets)), np.bincount(owner[met], minlength=len(sets))))
        if not rows:
            return schema.empty_table()
        sums, counts = (np.stack(x).ravel().astype(np.int64) for x in zip(*rows))
        module = np.repeat(np.array(draws_of(key[1].as_py(), draws)), len(sets))
        return pa.Table.from_arrays([sets.take(pa.array(np.tile(np.arange(len(sets)), len(rows)))), pa.array(module), pa.array(sums), pa.array(counts)], schema=schema)

    parts = asked.groupBy("bin", "word").cogroup(near.groupBy("bin", "word")).applyInArrow(total, f"set_id {kind['set_id']}, module long, total long, n long")
    return parts.where("n > 0").groupBy("set_id", "module").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def ors(words: int) -> list[Column]:
    return [F.bit_or(f"w{k}").alias(f"w{k}") for k in range(words)]


def walk(edges: DataFrame, sources: DataFrame, modules: int) -> tuple[DataFrame, int]:
    """(block, node, distance, bits), a written table, and its words: ``bits`` are those of the modules that reach a node in so many steps.

    edges: (u, v); sources: (module, node) with modules from 0 to ``modules`` - 1. Module m is bit m % 64 of word
    m // 64, counted within a block of WORDS words.
    """
    words = min(WORDS, -(-modules // 64))
    both = written(arcs(edges), "arcs")
    bit = F.expr("shiftleft(1L, cast(module % 64 as int))")
    word = F.expr(f"(module div 64) % {words}")
    begin = sources.select("module", "node").withColumns({f"w{k}": F.when(word == k, bit).otherwise(F.lit(0).cast("long")) for k in range(words)})
    frontier = written(begin.groupBy(F.expr(f"cast(module div {64 * words} as int)").alias("block"), "node").agg(*ors(words)), "frontier")
    seen, levels, step = frontier, [frontier.withColumn("distance", F.lit(0))], 0
    names = [f"w{k}" for k in range(words)]
    while True:
        step += 1
        near = frontier.join(both, frontier.node == both.src).groupBy("block", F.col("dst").alias("node")).agg(*ors(words))
        old = seen.select("block", "node", *[F.col(w).alias(f"_{w}") for w in names])
        fresh = near.join(old, ["block", "node"], "left").select("block", "node", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"_{w}"), F.lit(0).cast("long")))).alias(w) for w in names])
        frontier = written(fresh.where(reduce(Column.__or__, [F.col(w) != 0 for w in names])), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("distance", F.lit(step)))
        seen = written(seen.unionByName(frontier).groupBy("block", "node").agg(*ors(words)), "seen")
    told = reduce(DataFrame.unionByName, levels).select("block", "node", "distance", F.array(*names).alias("bits"))
    return written(told, "levels"), words


def has(module: str, words: int) -> Column:
    """Whether ``bits`` hold a module, and the block is the module's."""
    in_block = F.expr(f"block = {module} div {64 * words}")
    return in_block & F.expr(f"element_at(bits, cast(({module} div 64) % {words} as int) + 1) & shiftleft(1L, cast({module} % 64 as int)) <> 0")


def checked(levels: DataFrame, nodes: int, modules: int, words: int) -> DataFrame:
    """``levels``, if each module has just one distance, 0 or more, to each of the nodes, and no step is missing."""
    count = lambda bits: F.coalesce(F.sum(F.aggregate(bits, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))), F.lit(0))
    found = levels.agg(count("bits").alias("pairs"), F.min("distance").alias("least"), F.max("distance").alias("most"), F.count_distinct("distance").alias("steps")).first()
    merged = levels.groupBy("block", "node").agg(*[F.bit_or(F.element_at("bits", k + 1)).alias(f"w{k}") for k in range(words)])
    once = merged.agg(count(F.array(*[f"w{k}" for k in range(words)])).alias("pairs"), F.count_distinct("node").alias("nodes")).first()
    if found.pairs != nodes * modules or once.pairs != found.pairs or once.nodes != nodes or found.least != 0 or found.steps != found.most + 1:
        raise ValueError("the graph is not connected, or its distances are not whole")
    return levels


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number, and the exclusive or and sums of two hashes of each."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    told = df.select(F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit("again"), *cells).alias("g"))
    r = told.agg(F.count("*"), F.bit_xor("h"), F.bit_xor("g"), F.sum(F.pmod("h", F.lit(2**40))), F.sum(F.pmod("g", F.lit(2**40)))).first()
    return ".".join(map(str, r))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of Parquet files; None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def distances_of(edges: DataFrame, module: DataFrame, placed: DataFrame, draws: int, seed: int, nodes: int, cache: str | None = None, least: int = 0) -> tuple[DataFrame, int]:
    """The levels of the module (0) and of its random modules (1 to ``draws``), and their words, from ``cache`` where it has them.

    The cache is a folder with one table for each key: the digest of the edges, the module and what the draws hang on. A
    description of one row is written after the table. A table without it is made anew; one that is not as described, or
    that fails ``checked``, is an error.
    """
    spark = edges.sparkSession
    key = path = None
    if cache is not None:
        key = hashlib.sha256("|".join([table_digest(edges), table_digest(module), str(draws), str(seed), str(least), str(REDRAWS), str(WORDS)]).encode()).hexdigest()
        path = f"{cache.rstrip('/')}/{key}"
        described = stored(spark, f"{path}/description")
        if described is not None and (told := described.first()) is not None:
            levels = stored(spark, f"{path}/levels")
            if levels is None or levels.count() != told.n_rows or told.nodes != nodes or told.modules != draws + 1:
                raise ValueError(f"the stored distances at {path} are not those of their description")
            return checked(levels, nodes, draws + 1, told.words), told.words
    with steps() as keep:
        one = module.select(F.lit(0).alias("set_id"), "node").distinct()
        inside = one.join(placed.select("node"), "node", "left_semi").select(F.lit(0).cast("long").alias("module"), "node")
        if inside.isEmpty():
            raise ValueError("the module has no node in the graph")
        random = matched_draws(one, placed, draws, seed, "module").select(F.col("draw").cast("long").alias("module"), "node")
        levels, words = walk(edges, inside.unionByName(random), draws + 1)
        levels = keep(checked(levels, nodes, draws + 1, words))
    if path is not None:
        levels.repartitionByRange("node").sortWithinPartitions("node", "distance").write.mode("overwrite").parquet(f"{path}/levels")
        told = [(key, nodes, draws + 1, words, levels.count())]
        spark.createDataFrame(told, "key string, nodes long, modules long, words int, n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/description")
    return levels, words


def proximity_z(edges: DataFrame, module: DataFrame, target_sets: DataFrame, least: int, draws: int, seed: int, cache: str | None = None) -> DataFrame:
    """(set_id, mean_distance, z) of each set of nodes against degree-matched random modules and sets, as a written table.

    The r-th random set is measured from the r-th random module. Equal sets are scored once. A graph that is not
    connected, or a module without a node in it, is an error. Nodes of a set that the graph lacks are left out; a set
    without any other has neither value. ``cache``: a folder whose stored distances are used, and added to.
    """
    with steps() as keep:
        both = arcs(edges)
        own = written(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "degrees")
        bins = written(degree_bins(own.groupBy("degree").agg(F.count("*").alias("nodes")), least), "bins")
        placed = written(places(own, bins), "places")
        levels, words = distances_of(edges, module, placed, draws, seed, placed.count(), cache, least)
        sets = target_sets.select("set_id", "node").distinct().join(placed.select("node"), "node", "left_semi").groupBy("set_id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
        sets = written(sets.withColumn("_key", F.sha2(F.to_json(F.struct("nodes")).cast("binary"), 256)), "sets")
        sets = written(sets.join(sets.groupBy("_key").agg(F.min("set_id").alias("_first")), "_key"), "sets")
        asked = sets.where("set_id = _first").select("set_id", F.explode("nodes").alias("node"))
        random = drawn_distances(asked, placed, levels, words, draws, seed, "set").select("set_id", "module", (F.col("total") / F.col("n")).alias("m"))
        met = asked.withColumn("module", F.lit(0).cast("long")).withColumnRenamed("node", "_node").join(levels, (F.col("_node") == F.col("node")) & has("module", words))
        means = met.groupBy("set_id", "module").agg(F.avg("distance").alias("m")).unionByName(random)
        null = F.when(F.col("module") > 0, F.col("m"))
        scored = means.groupBy("set_id").agg(F.max(F.when(F.col("module") == 0, F.col("m"))).alias("mean_distance"), F.avg(null).alias("mean"), F.stddev_pop(null).alias("sd"))
        z = F.when(F.col("sd") == 0, 0.0).otherwise((F.col("mean_distance") - F.col("mean")) / F.col("sd"))
        known = sets.select(F.col("set_id").alias("_own"), F.col("_first").alias("set_id")).join(scored.select("set_id", "mean_distance", z.alias("z")), "set_id").select(F.col("_own").alias("set_id"), "mean_distance", "z")
        return keep(written(target_sets.select("set_id").distinct().join(known, "set_id", "left"), "proximity"))
