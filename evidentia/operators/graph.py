"""Simple graphs: edges, degrees and their bins, components and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import steps, written

#: Rounds whose results are read apart before they are written as one table.
ROUNDS = 16


def simple_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) with u < v: undirected edges once, without self-loops and missing ends."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def interactions(df: DataFrame) -> DataFrame:
    """(u, v) from the first two columns of a table of texts: blanks, any case of "nan" and self-loops are left out."""
    a, b = (text.blank_to_empty(F.col(f"`{c}`")) for c in df.columns[:2])
    return simple_edges(df.select(F.nullif(a, F.lit("")).alias("a"), F.nullif(b, F.lit("")).alias("b")), "a", "b")


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge as (src, dst)."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node is connected with, by least labels and pointer jumping."""
    with steps() as keep:
        both = written(arcs(edges), "arcs")
        labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
        changed = 1
        while changed:
            near = both.join(labels, both.dst == labels.node).select(F.col("src").alias("node"), "component").union(labels)
            lower = near.groupBy("node").agg(F.min("component").alias("component"))
            lower = written(lower, "lower")
            above = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
            jumped = written(lower.join(above, "component").select("node", F.col("top").alias("component")), "labels")
            changed = jumped.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
            labels = jumped
        return keep(labels)


def largest_component(labels: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equal ones that with the smallest node."""
    sizes = labels.groupBy("component").count()
    top = sizes.orderBy(F.desc("count"), "component").limit(1).select("component")
    return labels.join(F.broadcast(top), "component", "left_semi").select("node")


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance) to the nearest source, by frontier joins until no node is new; up to ``most`` steps if given."""
    with steps() as keep:
        both = written(arcs(edges), "arcs")
        seen = written(sources.select("node").distinct().withColumn("distance", F.lit(0)), "seen")
        frontier, step = seen, 0
        while most is None or step < most:
            step += 1
            fresh = both.join(frontier, both.src == frontier.node).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(step))
            fresh = written(fresh, "frontier")
            if fresh.isEmpty():
                break
            seen, frontier = seen.unionByName(fresh), fresh
            if step % ROUNDS == 0:
                seen = written(seen, "seen")
        return keep(written(seen, "distances"))


def degree_bins(histogram: DataFrame, least: int) -> DataFrame:
    """(bin, low, high, members): degrees in ascending order fill a bin until it has ``least`` nodes; a short last bin joins the one before.

    histogram: (degree, nodes), one row per distinct degree; the fold runs over that short list.
    """
    rows = F.array_sort(F.collect_list(F.struct("degree", "nodes")))
    start = F.expr("named_struct('done', cast(array() as array<struct<low:bigint,high:bigint,members:bigint>>), 'low', cast(null as bigint), 'high', cast(null as bigint), 'members', 0L)")

    def step(acc: Column, x: Column) -> Column:
        low, members = F.coalesce(acc["low"], x["degree"].cast("long")), acc["members"] + x["nodes"]
        whole = F.struct(low.alias("low"), x["degree"].cast("long").alias("high"), members.alias("members"))
        full = members >= least
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(whole))).otherwise(acc["done"]).alias("done"),
            F.when(~full, low).alias("low"),
            F.when(~full, x["degree"].cast("long")).alias("high"),
            F.when(full, F.lit(0).cast("long")).otherwise(members).alias("members"),
        )

    def finish(acc: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        joined = F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(F.struct(last["low"].alias("low"), acc["high"].alias("high"), (last["members"] + acc["members"]).alias("members"))))
        alone = F.array(F.struct(acc["low"].alias("low"), acc["high"].alias("high"), acc["members"].alias("members")))
        return F.when(acc["members"] == 0, acc["done"]).when(F.size(acc["done"]) == 0, alone).otherwise(joined)

    folded = histogram.groupBy().agg(rows.alias("rows")).select(F.aggregate("rows", start, step, finish).alias("bins"))
    return folded.select(F.posexplode("bins").alias("bin", "b")).select("bin", "b.low", "b.high", "b.members")


def in_bin(nodes: DataFrame, bins: DataFrame) -> DataFrame:
    """Each node with the bin that holds its degree. Bins are few: no more than distinct degrees."""
    return nodes.join(F.broadcast(bins), nodes.degree.between(bins.low, bins.high)).select("node", "degree", "bin")
