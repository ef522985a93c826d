"""Ranking, first-wins dedup and the consensus over evidence streams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Ranges of the leading column that a global order is split over.
RANGES = 32
#: The columns of the final candidates, in their order.
FINAL_COLUMNS = ("final_rank", "compound_id", "compound_name", "evidence_mode", "evidence_count", "consensus_rank_percentile_mean", "kg_rank_mean", "kg_score_mean", "proximity_z", "gps_score")

COMPARE = {"lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v}


def passes(column: Column, operator: str, threshold: float) -> Column:
    """A comparison named by its operator."""
    return COMPARE[operator](column, F.lit(threshold))


def directed(column: Column, direction: str) -> Column:
    """A value whose ascending order is the wanted one."""
    return {"ascending": column, "descending": -column}[direction]


def range_of(df: DataFrame, lead: str, ascending: bool = True) -> Column:
    """The number of the quantile range that a row's numeric leading column falls in; nulls are the last range."""
    cuts = sorted(set(df.approxQuantile([lead], [i / RANGES for i in range(1, RANGES)], 0.01)[0]))
    part = F.lit(0)
    for x in cuts:
        part = part + (F.col(lead) > F.lit(x)).cast("int")
    return F.coalesce(part if ascending else F.lit(len(cuts)) - part, F.lit(len(cuts) + 1))


def sums_before(df: DataFrame, within: list[str], values: list[str], part: str = "_part") -> DataFrame:
    """(within, part, _before_VALUE): the sums of the values over the ranges before each. Rows: RANGES per group at most."""
    before = Window.partitionBy(*within or [F.lit(0)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    own = df.groupBy(*within, part).agg(*[F.sum(v).alias(v) for v in values])
    return own.select(*within, part, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values])


def global_position(df: DataFrame, lead: str, order: list[Column], out: str, ties: bool = False, ascending: bool = True, within: list[str] | None = None) -> DataFrame:
    """Adds the row's place in a total order (or its least tied rank), over all rows or in each group, without bringing a group's rows to one task.

    Rows are split at quantiles of the numeric leading column; each range is ranked by a window of its own, and the
    rows of the ranges before are added. ``order`` starts with the leading column. Rows whose leading value is null come
    last in either direction.
    """
    within = within or []
    rows = df.withColumn("_part", range_of(df, lead, ascending)).withColumn("_one", F.lit(1))
    offsets = sums_before(rows, within, ["_one"])
    place = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*within, "_part").orderBy(*order))
    met = rows.join(F.broadcast(offsets) if not within else offsets, [*within, "_part"])
    return met.withColumn(out, (place + F.col("_before__one")).cast("long")).drop("_part", "_before__one", "_one")


def running_sums(df: DataFrame, within: list[str], lead: str, values: list[str], ascending: bool = True) -> DataFrame:
    """Adds _run_VALUE: sums of the values over a group's rows up to each row in the order of a numeric column that is unique in the group."""
    rows = df.withColumn("_part", range_of(df, lead, ascending))
    order = F.col(lead).asc() if ascending else F.col(lead).desc()
    own = Window.partitionBy(*within, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(sums_before(rows, within, values), [*within, "_part"])
    return met.withColumns({f"_run_{v}": F.sum(v).over(own) + F.col(f"_before_{v}") for v in values}).drop("_part", *[f"_before_{v}" for v in values])


def percentile(df: DataFrame, value: str, out: str, ascending: bool = True) -> DataFrame:
    """Adds the least tied rank over the number of rows."""
    n = df.agg(F.count("*").alias("_n"))
    order = [F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()]
    return global_position(df, value, order, "_rank", ties=True, ascending=ascending).crossJoin(F.broadcast(n)).withColumn(out, F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order, which must be total. Rows are combined before the shuffle."""
    kept = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_place", F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*kept), "_place").alias("_row")) if kept else ranked.select(*keys).distinct()
    return best.select(*[k if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def selection(ensemble: DataFrame, most: int) -> DataFrame:
    """The first ``most`` nodes by mean, median and spread of rank, score and id, with their place."""
    order = [F.col("rank_mean"), F.col("rank_median"), F.col("rank_std"), F.col("score_mean").desc(), F.col("node_id")]
    top = ensemble.orderBy(*order).limit(most)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # ``most`` rows at most


def expanded(selected: DataFrame, tag: str = "UserLibrary") -> DataFrame:
    """The selected nodes' compounds, one row per compound: of a compound's nodes the one selected first stands.

    selected: as ``selection`` gives it with node_name and compound_ids (a JSON list) or source_ids (tags).
    """
    listed = F.from_json(F.coalesce("compound_ids", F.lit("")), "array<string>") if "compound_ids" in selected.columns else F.lit(None).cast("array<string>")
    tagged = F.transform(text.tagged(F.coalesce("source_ids", F.lit("")), tag), text.stripped) if "source_ids" in selected.columns else F.array().cast("array<string>")
    ids = F.array_distinct(F.filter(F.when(F.coalesce(F.size(listed), F.lit(-1)) > 0, listed).otherwise(tagged), lambda x: x != ""))
    rows = selected.withColumn("compound_id", F.explode(ids))
    return first_wins(rows.select("compound_id", F.col("node_name").alias("compound_name"), "position", F.col("rank_mean").alias("kg_rank_mean"), F.col("score_mean").alias("kg_score_mean"), "node_id"), ["compound_id"], F.col("position"), F.col("node_id"))


@dataclass(frozen=True)
class Evidence:
    """A stream beside the graph's: a table with compound_id and a value, what passes, and which direction is better."""

    frame: DataFrame
    value: str
    operator: str = "lt"
    threshold: float = 0.0
    direction: str = "ascending"


def consensus(selected: DataFrame, others: list[tuple[DataFrame, str, str, float]] | list[Evidence]) -> DataFrame:
    """The final ranking over candidates that every evidence stream has and passes.

    selected: (compound_id, position, ...), the compounds of ``selection``'s top nodes; others: the other streams, the
    lower value being better unless its direction says otherwise. Adds the percentiles within the intersection, their
    mean and the final rank. A stream's null value does not pass. The intersection is no larger than the selection, a
    fixed number of nodes, so it is ranked in one task and each stream is read once.
    """
    streams = [e if isinstance(e, Evidence) else Evidence(*e) for e in others]
    met = selected
    for e in streams:
        own = e.frame.where(passes(F.col(e.value), e.operator, e.threshold)).select("compound_id", e.value)
        met = met.join(own, "compound_id")
    names = ["position", *(e.value for e in streams)]
    value = {"position": F.col("position"), **{e.value: directed(F.col(e.value), e.direction) for e in streams}}
    every = Window.partitionBy(F.lit(0))
    met = met.withColumns({f"{v}_percentile": F.rank().over(every.orderBy(value[v])) / F.count("*").over(every) for v in names})
    met = met.withColumn("consensus", sum((F.col(f"{v}_percentile") for v in names), F.lit(0.0)) / len(names))
    order = [F.col("consensus"), *(F.col(f"{v}_percentile") for v in names)]
    order += [F.col("kg_rank_mean")] if "kg_rank_mean" in selected.columns else []
    order += [value[e.value] for e in streams] + [F.col("compound_id")]
    return met.withColumn("final_rank", F.row_number().over(every.orderBy(*order)))


def candidates(ensemble: DataFrame, proximity: Evidence, signature: Evidence | None = None, most: int = 200, tag: str = "UserLibrary") -> DataFrame:
    """The final candidates in their ten columns. ensemble: with node_name and compound_ids or source_ids; an empty intersection gives an empty table."""
    streams = [proximity] + ([signature] if signature else [])
    ranked = consensus(expanded(selection(ensemble, most), tag), streams)
    gps = F.col(signature.value).cast("double") if signature else F.lit(None).cast("double")
    return ranked.select(
        F.col("final_rank").cast("int").alias("final_rank"), "compound_id", "compound_name", F.lit("kg_proximity_gps" if signature else "kg_proximity").alias("evidence_mode"), F.lit(1 + len(streams)).alias("evidence_count"),
        F.col("consensus").alias("consensus_rank_percentile_mean"), "kg_rank_mean", "kg_score_mean", F.col(proximity.value).cast("double").alias("proximity_z"), gps.alias("gps_score"),
    )


def funnel(ensemble: DataFrame, proximity: Evidence, signature: Evidence | None = None, most: int = 200, tag: str = "UserLibrary") -> DataFrame:
    """One row of twelve counters, from the graph's nodes to the final candidates; each table is aggregated once."""
    top = selection(ensemble, most)
    compounds = expanded(top, tag)
    listed = F.from_json(F.coalesce("compound_ids", F.lit("")), "array<string>") if "compound_ids" in top.columns else F.transform(text.tagged(F.coalesce("source_ids", F.lit("")), tag), text.stripped)
    size = F.coalesce(F.size(F.array_distinct(F.filter(listed, lambda x: x != ""))), F.lit(0))

    def of(e: Evidence | None, name: str) -> list[DataFrame]:
        if e is None:
            return []
        return [e.frame.agg(F.count("*").alias(f"{name}_input_compounds"), F.coalesce(F.sum(passes(F.col(e.value), e.operator, e.threshold).cast("long")), F.lit(0)).alias(f"{name}_threshold_pass"))]

    parts = [
        ensemble.agg(F.count("*").alias("kg_input_nodes")),
        top.agg(F.count("*").alias("kg_top_n_nodes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("kg_expanded_rows")),
        compounds.agg(F.count("*").alias("kg_top_n_unique_compounds")),
        *of(proximity, "proximity"), *of(signature, "gps"),
        consensus(compounds, [proximity] + ([signature] if signature else [])).agg(F.count("*").alias("final_candidates")),
    ]
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    if signature is None:
        row = row.withColumns({"gps_input_compounds": F.lit(0).cast("long"), "gps_threshold_pass": F.lit(0).cast("long")})
    more = {"kg_top_n_requested": F.lit(most).cast("long"), "kg_duplicate_compound_mappings_resolved": F.col("kg_expanded_rows") - F.col("kg_top_n_unique_compounds"), "intersection_candidates": F.col("final_candidates")}
    return row.withColumns(more)
