"""Rules of tables, judged in one pass: as an aggregation, or beside the write of a result; and membership both ways.

A rule is a condition that a row must not meet. All rules of a table are counted together, each with the least key of a
row that breaks it, so one scan tells all that is wrong.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty
from .delimited import ContractError, hadoop, put_in_place, read_table

#: Examples that an error names.
SHOWN = 10


@dataclass(frozen=True)
class Rule:
    """What is wrong with a row where ``broken`` holds; unknown counts as whole."""

    name: str
    broken: Column


@dataclass
class Verdict:
    """Rows, and for each broken rule its rows and an example's key."""

    rows: int
    broken: dict[str, tuple[int, str | None]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return not self.broken

    def told(self) -> str:
        return "; ".join(f"{name}: {n} rows, such as {key!r}" for name, (n, key) in self.broken.items())


def measures(rules: list[Rule], key: Column) -> list[Column]:
    """The counts that judge all rules; they can be aggregated or observed."""
    out = [F.count(F.lit(1)).alias("_rows")]
    for i, r in enumerate(rules):
        bad = F.coalesce(r.broken, F.lit(False))
        out += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, F.coalesce(key.cast("string"), F.lit("(null)")))).alias(f"key{i}")]
    return out


def verdict(rules: list[Rule], found: dict) -> Verdict:
    return Verdict(found["_rows"], {r.name: (found[f"n{i}"], found[f"key{i}"]) for i, r in enumerate(rules) if found[f"n{i}"]})


def judged(df: DataFrame, rules: list[Rule], key: str) -> Verdict:
    """All rules over a table by one aggregation."""
    return verdict(rules, df.agg(*measures(rules, F.col(key))).first().asDict())


def write_checked(df: DataFrame, path: str, rules: list[Rule], key: str, partition: str | None = None, at_least: int = 0) -> Verdict:
    """Writes a table and judges it in the same pass; it is moved to its place only if it breaks no rule and has ``at_least`` rows."""
    seen = Observation()
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    out = df.observe(seen, *measures(rules, F.col(key))).write
    (out.partitionBy(partition) if partition else out).parquet(staged)
    found = verdict(rules, seen.get)
    if not found or found.rows < at_least:
        at, files = hadoop(df.sparkSession, staged)
        files.delete(at, True)
        raise ContractError(found.told() if not found else f"{found.rows} rows, {at_least} at least are needed")
    put_in_place(df.sparkSession, staged, path)
    return found


def membership(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_left, n_right) of the keys that one side lacks or the left has more than once, by one shuffle of counts."""
    tag = lambda df, a, b: df.select(*keys, F.lit(a).alias("l"), F.lit(b).alias("r"))
    both = tag(left, 1, 0).union(tag(right, 0, 1)).groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    return both.where("n_left = 0 OR n_right = 0 OR n_left > 1")


def same_members(left: DataFrame, right: DataFrame, *keys: str, names: tuple[str, str] = ("left", "right"), repeated: bool = False) -> None:
    """An error that names what each side lacks and what the left repeats (unless that is allowed), all from one job."""
    odd = membership(left, right, *keys)
    kind = F.when(F.col("n_left") == 0, f"missing in {names[0]}").when(F.col("n_right") == 0, f"missing in {names[1]}").otherwise(f"repeated in {names[0]}")
    odd = odd.withColumn("kind", kind)
    if repeated:
        odd = odd.where("n_left = 0 OR n_right = 0")
    shown = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("(null)")) for k in keys])
    rows = odd.groupBy("kind").agg(F.count("*").alias("n"), F.min(shown).alias("example")).orderBy("kind").collect()  # three kinds
    if rows:
        raise ContractError("; ".join(f"{r.n} {r.kind}, such as {r.example!r}" for r in rows))


def canonical(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.strip().lower())


# fixed values of the formats
IDS = ("id", "compoundid", "drugid", "targetmolid", "moleculeid")
STRUCTURES = ("smiles", "smile", "canonicalsmiles", "smilesstandardized", "standardizedsmiles")
GENE_HEADERS = ("symbol", "genesymbol", "gene", "genename", "hgncsymbol", "entrezid", "geneid")
POSITIVE_TYPES = ("library_id", "base_drug_name", "base_drug_id")
LINK_TYPES = ("base_disease_id", "base_disease_name")


def _whole(rows: DataFrame, what: str, rules: list[Rule], *extra: Column) -> dict:
    """The counts of a table without rows that break a rule, with more counts of the same pass."""
    fields = Rule("another number of fields", F.col("_broken").isNotNull())
    rules = [fields, *rules]
    found = rows.agg(*measures(rules, F.col(rows.columns[0])), *extra).first().asDict()
    told = verdict(rules, found)
    if not told.rows:
        raise ContractError(f"{what} has no data rows")
    if not told:
        raise ContractError(f"{what}: {told.told()}")
    return found


def _cell(name: str) -> Column:
    return blank_to_empty(F.col(f"`{name}`"))


def _compounds(spark: SparkSession, path: str) -> dict:
    rows = read_table(spark, path, sep="," if path.lower().endswith(".csv") else "\t")
    own = {k: [c for c in rows.columns if canonical(c) in names] for k, names in (("id", IDS), ("smiles", STRUCTURES))}
    if any(len(v) != 1 for v in own.values()):
        raise ContractError("a compound table has one column of ids and one of structures")
    found = _whole(rows, "the compound table", [], F.count_if((_cell(own["id"][0]) != "") & (_cell(own["smiles"][0]) != "")).alias("usable"))
    if not found["usable"]:
        raise ContractError("no row of the compound table has an id and a structure")
    return {"rows": found["_rows"], "usable_rows": found["usable"]}


def _genes(spark: SparkSession, path: str) -> dict:
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    first = lines.first()
    if first is None:
        raise ContractError("the gene file has no records")
    header = any(canonical(x) in GENE_HEADERS for x in re.split(r"[\t,]", first.value))
    n = lines.count() - header
    if n < 1:
        raise ContractError("the gene file has a header only")
    return {"records": n, "header_detected": header}


def _targets(spark: SparkSession, path: str) -> dict:
    items = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = items.select(F.explode("m").alias("key", "value")).select("key", F.get_json_object("value", "$.targets").alias("raw"))
    told = judged(rows, [Rule("an empty id", F.trim("key") == ""), Rule("no list of targets", ~F.coalesce(F.col("raw").startswith("["), F.lit(False)))], "key")
    if not told.rows:
        raise ContractError("the target file has no compounds")
    if not told:
        raise ContractError(told.told())
    return {"compound_count": told.rows}


def _mapping(spark: SparkSession, path: str) -> dict:
    rows = read_table(spark, path, sep="\t")
    if not {"genesymbol", "entrezid"} <= {canonical(c) for c in rows.columns}:
        raise ContractError("a target mapping has gene_symbol and entrez_id")
    return {"rows": _whole(rows, "the target mapping", [])["_rows"]}


def _typed(allowed: tuple[str, ...]):
    def check(spark: SparkSession, path: str) -> dict:
        rows = read_table(spark, path, ("input_type", "value"), "\t")
        kind, value = _cell("input_type"), _cell("value")
        filled = (kind != "") | (value != "")
        rules = [Rule("half a record", filled & ((kind == "") | (value == ""))), Rule("an input_type that is not known", filled & (kind != "") & ~kind.isin(*allowed))]
        found = _whole(rows, "the table", rules, F.count_if(filled).alias("usable"), F.sort_array(F.collect_set(F.when(filled, kind))).alias("types"))
        if not found["usable"]:
            raise ContractError("the table has no usable rows")
        return {"rows": found["usable"], "input_types": found["types"]}

    return check


def _tpm(spark: SparkSession, path: str) -> dict:
    columns = [c for c in read_table(spark, path, sep="\t").columns if c != "_broken"]  # empty and repeated names are errors there
    if len(columns) < 3 or columns[0] != "GeneID":
        raise ContractError("a matrix has GeneID and two samples at least")
    return {"sample_column_count": len(columns) - 1}


def _metadata(spark: SparkSession, path: str) -> dict:
    rows = read_table(spark, path, ("sample_id", "group"), "\t")
    sample, group = _cell("sample_id"), F.lower(_cell("group"))
    rules = [Rule("an empty sample_id or a group that is not known", (sample == "") | ~group.isin("control", "disease"))]
    found = _whole(rows, "the metadata", rules, F.count_distinct(sample).alias("samples"), F.count_if(group == "control").alias("control"), F.count_if(group == "disease").alias("disease"))
    if found["samples"] != found["_rows"]:
        raise ContractError("sample_id values repeat")
    if not found["control"] or not found["disease"]:
        raise ContractError("the metadata needs both groups")
    return {"sample_count": found["_rows"], "groups": {"control": found["control"], "disease": found["disease"]}}


#: Checks of an upload by its kind.
UPLOADS = {
    "compounds": _compounds, "disease_genes": _genes, "drug_targets": _targets, "target_mapping": _mapping, "positive_drugs": _typed(POSITIVE_TYPES),
    "disease_links": _typed(LINK_TYPES), "expression_tpm": _tpm, "expression_metadata": _metadata,
}


def validate_upload(spark: SparkSession, kind: str, path: str) -> dict:
    """What a file of a kind holds, if its structure is right; all its rows are looked at, in one pass. A file that breaks rules is a ContractError."""
    if kind not in UPLOADS:
        raise ContractError(f"there is no upload of the kind {kind}")
    return {"kind": kind, "status": "passed", "details": UPLOADS[kind](spark, path)}


def stated(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(rule, n, example) of each rule over a table, broken or not: one row per rule from one aggregation."""
    told = df.agg(*measures(rules, F.col(key)))
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"key{i}").alias("example")) for i, r in enumerate(rules)]
    return told.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
