"""Identifier mapping: symbols and synonyms to ids, structures to unique matches, rejects beside the good rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def gene_dictionary(info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(official (key, id, symbol, _ord), synonyms (key, id)) of a table with GeneID, Symbol, Synonyms and _ord; keys in upper case.

    Rows without an id or a symbol are left out; an id that is no number is an error.
    """
    rows = info.select(text.stripped(F.coalesce("GeneID", F.lit(""))).alias("id"), text.stripped(F.coalesce("Symbol", F.lit(""))).alias("symbol"), text.synonyms(F.col("Synonyms")).alias("others"), "_ord").where("id <> '' AND symbol <> ''")
    if rows.where(~F.col("id").rlike("^[0-9]+$")).limit(1).count():
        raise ValueError("the dictionary has an id that is no number")
    return rows.select(F.upper("symbol").alias("key"), "id", "symbol", "_ord"), rows.select(F.explode("others").alias("key"), "id").select(F.upper("key").alias("key"), "id")


def map_symbols(records: DataFrame, official: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, rejected). records: (_ord, symbol, given_id); official: (key, id, symbol, _ord); synonyms: (key, id); keys in upper case.

    An official symbol beats a synonym; several ids are ambiguous; a given id must be numeric, official and agree; blank
    values count as absent. mapped: (entrez_id, symbol, source, _ord), the official symbol and the first record of each
    id; rejected: (_ord, input_value, reason).
    """
    single = lambda d, name: d.groupBy("key").agg(F.count_distinct("id").alias(f"n_{name}"), F.min("id").alias(f"id_{name}"))
    names = official.groupBy("id").agg(F.min_by("symbol", "_ord").alias("official"))
    clean = lambda c: text.stripped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = records.select("_ord", clean("symbol").alias("symbol"), clean("given_id").alias("given"))
    rows = rows.withColumn("key", F.upper("symbol")).join(single(official, "own"), "key", "left").join(single(synonyms, "other"), "key", "left")
    rows = rows.join(names.select(F.col("id").alias("given"), F.col("official").alias("given_official")), "given", "left")
    n_own, n_other = F.coalesce("n_own", F.lit(0)), F.coalesce("n_other", F.lit(0))
    found = F.when(n_own == 1, F.col("id_own")).when((n_own == 0) & (n_other == 1), F.col("id_other"))
    given, has_symbol = F.col("given") != "", F.col("symbol") != ""
    reason = (
        F.when(given & ~F.col("given").rlike("^[0-9]+$"), "invalid_entrez_id")
        .when(given & F.col("given_official").isNull(), "unknown_entrez_id")
        .when(~given & ~has_symbol, "empty_input_value")
        .when(has_symbol & (n_own > 1), "ambiguous_symbol")
        .when(has_symbol & (n_own == 0) & (n_other > 1), "ambiguous_synonym")
        .when(has_symbol & (n_own + n_other == 0), "unknown_symbol")
        .when(given & has_symbol & (found != F.col("given")), "symbol_entrez_mismatch")
    )
    source = F.when(~has_symbol, "entrez").when(n_own == 1, "symbol").otherwise("synonym")
    value = F.when(given & has_symbol, F.concat(F.lit("symbol="), F.col("symbol"), F.lit(";entrez_id="), F.col("given"))).when(has_symbol, F.col("symbol")).otherwise(F.col("given"))
    rows = rows.select("_ord", value.alias("input_value"), reason.alias("reason"), F.coalesce(found, F.when(given, F.col("given"))).alias("entrez_id"), source.alias("source"))
    good = rows.where("reason IS NULL").groupBy("entrez_id").agg(F.min_by("source", F.struct("_ord", "source")).alias("source"), F.min("_ord").alias("_ord"))
    good = good.join(names.withColumnRenamed("id", "entrez_id"), "entrez_id").select("entrez_id", F.col("official").alias("symbol"), "source", "_ord")
    return good, rows.where("reason IS NOT NULL").select("_ord", "input_value", "reason")


def first_win_dictionary(info: DataFrame) -> DataFrame:
    """(symbol, entrez_id), case kept: a symbol's first row wins; a synonym counts where no symbol has it, from its first row. info: GeneID, Symbol, Synonyms, _ord."""
    rows = info.select(text.stripped(F.coalesce("GeneID", F.lit(""))).alias("entrez_id"), text.stripped(F.coalesce("Symbol", F.lit(""))).alias("symbol"), text.synonyms(F.col("Synonyms")).alias("others"), "_ord").where("entrez_id <> '' AND symbol <> ''")
    own = rows.groupBy("symbol").agg(F.min_by(F.struct("entrez_id", "others"), "_ord").alias("r"), F.min("_ord").alias("_ord"))
    named = own.select("symbol", "r.entrez_id", F.lit(0).alias("_kind"), "_ord", F.lit(0).alias("_at"))
    other = own.select(F.posexplode("r.others").alias("_at", "symbol"), "r.entrez_id", "_ord").select("symbol", "entrez_id", F.lit(1).alias("_kind"), "_ord", "_at")
    return named.unionByName(other).groupBy("symbol").agg(F.min_by("entrez_id", F.struct("_kind", "_ord", "_at")).alias("entrez_id"))


def single_ids(rows: DataFrame, symbol: str = "gene_symbol", entrez: str = "entrez_id") -> DataFrame:
    """(gene_symbol, entrez_id): symbols in upper case with the first id of a semicolon list; a symbol with several ids is an error, blanks are left out."""
    clean = rows.select(F.upper(text.blank_to_empty(F.col(symbol))).alias("gene_symbol"), text.first_token(text.blank_to_empty(F.col(entrez))).alias("entrez_id")).where("gene_symbol <> '' AND entrez_id <> ''")
    one = clean.groupBy("gene_symbol").agg(F.min("entrez_id").alias("entrez_id"), F.max("entrez_id").alias("_last"))
    bad = [r.gene_symbol for r in one.where("entrez_id <> _last").orderBy("gene_symbol").limit(20).collect()]
    if bad:
        raise ValueError(f"symbols with several ids: {bad}")
    return one.drop("_last")


def by_symbol(rows: DataFrame, ids: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows with entrez_id, unmapped symbols with their occurrences and members). rows: with gene_symbol; ids: (gene_symbol, entrez_id)."""
    keyed = rows.withColumn("gene_symbol", F.upper(text.stripped(F.col("gene_symbol"))))
    return keyed.join(ids, "gene_symbol"), unmatched(keyed, ids, "gene_symbol", by)


def unique_by_name(rows: DataFrame, nodes: DataFrame, node_type: str) -> DataFrame:
    """(value, node_id): each value's one node of that type by its name without regard to case; none or several are an error. rows: (value); nodes: (node_id, node_type, node_name)."""
    own = nodes.where(F.col("node_type") == node_type).select(F.lower("node_name").alias("_name"), "node_id")
    met = rows.select("value").distinct().join(own, F.lower("value") == F.col("_name"), "left").groupBy("value").agg(F.count("node_id").alias("n"), F.min("node_id").alias("node_id"))
    bad = [r.value for r in met.where("n <> 1").orderBy("value").limit(20).collect()]
    if bad:
        raise ValueError(f"names that match no {node_type}, or several: {bad}")
    return met.select("value", "node_id")


def split_valid(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one). Each is a filter of one projection; write the judged rows first where the source is dear to read twice."""
    rows = df.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def reason_histogram(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def unique_match(rows: DataFrame, reference: DataFrame, key: str, matched: str) -> DataFrame:
    """Rows with the reference id of their key where exactly one reference has it; others stay without one."""
    single = reference.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(matched).alias("_n"), F.min(matched).alias(matched)).where("_n = 1").drop("_n")
    return rows.join(single, key, "left")


def unmatched(rows: DataFrame, known: DataFrame, key: str, by: str) -> DataFrame:
    """(key, occurrences, list of distinct values of ``by``) of the keys that ``known`` lacks."""
    missing = rows.join(known, key, "left_anti")
    return missing.groupBy(key).agg(F.count("*").alias("occurrences"), F.array_join(F.sort_array(F.collect_set(F.col(by).cast("string"))), ";").alias("members"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that one side only has, with the side."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("only_in", F.lit("left"))
    return left.union(b.select(key).distinct().join(a, key, "left_anti").withColumn("only_in", F.lit("right")))
