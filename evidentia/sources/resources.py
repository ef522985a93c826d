"""Readers of a run's inputs and resources: gene lists and dictionaries, mappings, node and edge tables, priors, matrices, manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .delimited import ContractError, by_alias, read_table, require, separator, sheet_table, sniffed, strict, with_order

#: Names of symbol and id columns, in canonical form, and of the columns of a compound library and a target mapping.
SYMBOL_NAMES = ("symbol", "genesymbol", "gene", "genename", "hgncsymbol")
ENTREZ_NAMES = ("entrezid", "geneid", "ncbiid", "ncbigeneid")
COMPOUND_NAMES = {"ID": ("id", "compoundid", "drugid", "targetmolid", "moleculeid"), "SMILES": ("smiles", "smile", "canonicalsmiles", "smilesstandardized", "standardizedsmiles")}
MAPPING_NAMES = {"gene_symbol": ("Gene symbol", "gene_symbol", "symbol"), "entrez_id": ("Gene ID", "entrez_id", "gene_id")}
#: Names of a comparison's two files.
TPM_NAME, METADATA_NAME = r"TPM_matrix(?:_(.+))?\.tsv", r"metadata(?:_(.+))?\.tsv"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, line) of a text file's lines that are not blank; a byte order mark goes."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_ord"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r$", "").alias("line"))
    return rows.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, symbol, given_id) of a list of genes whose shape its first line and its width tell.

    A header with the name of a symbol or an id column names the columns; without one, one column of numbers is ids, one
    other column symbols, and two columns are symbol and id. Rows that are blank in both are left out. No record, a row
    of another width than the header, or more than two columns without a header are errors.
    """
    lines = lines_of(spark, path)
    head = lines.orderBy("_ord").limit(1).collect()
    if not head:
        raise ContractError("the gene list is empty")
    sep = "\t" if "\t" in head[0].line else "," if "," in head[0].line else None
    cells = F.transform(F.split("line", re.escape(sep)), lambda x: text.stripped(F.regexp_replace(x, '^"|"$', ""))) if sep else F.array(text.stripped(F.col("line")))
    rows = lines.select("_ord", cells.alias("c"))
    names = [text.header_key_of(x.strip().strip('"')) for x in (head[0].line.split(sep) if sep else [head[0].line])]
    header = bool(set(names) & {*SYMBOL_NAMES, *ENTREZ_NAMES})
    at = lambda i: F.coalesce(F.get("c", i), F.lit(""))
    if header:
        rows = rows.where(F.col("_ord") != head[0]._ord)
        symbols, ids = ([i for i, n in enumerate(names) if n in own] for own in (SYMBOL_NAMES, ENTREZ_NAMES))
        if len(symbols) > 1 or len(ids) > 1:
            raise ContractError("the gene list names an identifier twice")
        if rows.where(F.size("c") != len(names)).limit(1).count():
            raise ContractError("a row of the gene list has another width than the header")
        symbol, given = (at(symbols[0]) if symbols else F.lit("")), (at(ids[0]) if ids else F.lit(""))
    else:
        widest, other = rows.agg(F.max(F.size("c")), F.sum((~at(0).rlike("^[0-9]+$") & (at(0) != "")).cast("long"))).first()
        if widest == 1:
            symbol, given = (F.lit(""), at(0)) if not other else (at(0), F.lit(""))
        elif widest == 2:
            symbol, given = at(0), at(1)
        else:
            raise ContractError("a gene list without a header has one or two columns")
    out = rows.select("_ord", symbol.alias("symbol"), given.alias("given_id")).where("symbol <> '' OR given_id <> ''")
    if out.isEmpty():
        raise ContractError("the gene list has no record")
    return out


def gene_info(spark: SparkSession, path: str) -> DataFrame:
    """(GeneID, Symbol, Synonyms, _ord) of a plain or packed dictionary with tabs."""
    rows = with_order(read_table(spark, path, ("GeneID", "Symbol", "Synonyms"), "\t"))
    return rows.select("GeneID", "Symbol", "Synonyms", "_ord")


def disease_genes(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, symbol, entrez_id) of normalised genes, of each id the first row; blank and repeated ids go, none at all is an error."""
    from ..operators.ranking import first_wins

    rows = with_order(read_table(spark, path, ("symbol", "entrez_id"), "\t"))
    rows = rows.select("_ord", F.upper(text.blank_to_empty(F.col("symbol"))).alias("symbol"), text.first_token(text.blank_to_empty(F.col("entrez_id"))).alias("entrez_id")).where("entrez_id <> ''")
    out = first_wins(rows, ["entrez_id"], F.col("_ord"), F.col("symbol"))
    if out.isEmpty():
        raise ContractError("no usable gene ids")
    return out


def compound_library(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, ID, SMILES, further columns) of a library with any separator; ids must be there and be unique."""
    rows = with_order(strict(read_table(spark, path, sep=sniffed(spark, path))))
    rows = by_alias(rows, COMPOUND_NAMES)
    rows = rows.withColumns({"ID": text.stripped(F.col("ID")), "SMILES": text.stripped(F.coalesce("SMILES", F.lit("")))})
    return require(rows, unique=("ID",), filled=("ID",))


def normalised_compounds(spark: SparkSession, path: str, canonical) -> DataFrame:
    """(_ord, ID, SMILES, canonical, further columns) of a normalised library. canonical: from ``chem.column``."""
    rows = require(with_order(read_table(spark, path, ("ID", "SMILES"))).drop("_broken"), unique=("ID",), filled=("ID",))
    return rows.withColumn("canonical", F.coalesce(canonical(F.col("SMILES")), F.lit("")))


def target_mapping(spark: SparkSession, path: str, sheet: str = "Target information") -> DataFrame:
    """(gene_symbol, entrez_id), symbols in upper case, of a workbook or a delimited file; symbols with several ids are errors."""
    from ..operators.mapping import single_ids

    rows = sheet_table(spark, path, sheet) if re.search(r"\.xls[xm]$", path) else read_table(spark, path, sep="," if path.endswith(".csv") else "\t").drop("_broken")
    found = {n: [c for c in rows.columns if c.strip() in own] for n, own in MAPPING_NAMES.items()}
    if any(len(v) != 1 for v in found.values()):
        raise ContractError("a target mapping has one symbol and one id column")
    out = single_ids(rows.select(*[F.col(f"`{v[0]}`").alias(n) for n, v in found.items()]))
    if out.isEmpty():
        raise ContractError("the target mapping has no usable record")
    return out


def provided_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(gene_symbol, entrez_id) of a mapping that the user gives: exactly these columns, ids of digits, a symbol with one id."""
    rows = read_table(spark, path, sep="\t").drop("_broken")
    if rows.columns != ["gene_symbol", "entrez_id"]:
        raise ContractError("a given mapping has the columns gene_symbol and entrez_id")
    rows = rows.select(F.upper(text.stripped(F.coalesce("gene_symbol", F.lit("")))).alias("gene_symbol"), text.stripped(F.coalesce("entrez_id", F.lit(""))).alias("entrez_id"))
    if rows.where((F.col("gene_symbol") == "") | ~F.col("entrez_id").rlike("^[0-9]+$")).limit(1).count():
        raise ContractError("a row of the given mapping is not valid")
    one = rows.groupBy("gene_symbol").agg(F.min("entrez_id").alias("entrez_id"), F.count_distinct("entrez_id").alias("n"))
    if one.where("n > 1").limit(1).count():
        raise ContractError("the given mapping has a symbol with several ids")
    if one.isEmpty():
        raise ContractError("the given mapping is empty")
    return one.drop("n")


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """The base nodes with _ord; ids must be there and be unique."""
    from ..operators.construct import NODE_COLUMNS

    rows = with_order(read_table(spark, path, NODE_COLUMNS, "\t")).drop("_broken")
    return require(rows.withColumn("node_id", text.blank_to_empty(F.col("node_id"))), unique=("node_id",), filled=("node_id",))


def edge_table(spark: SparkSession, path: str) -> DataFrame:
    """The base edges with _ord, read in parallel."""
    from ..operators.construct import EDGE_COLUMNS

    return with_order(read_table(spark, path, EDGE_COLUMNS, ",")).drop("_broken")


def prior_table(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, input_type, value) of an optional input; blank rows go, half-blank ones are errors."""
    rows = with_order(read_table(spark, path, ("input_type", "value"), "\t")).select("_ord", text.blank_to_empty(F.col("input_type")).alias("input_type"), text.blank_to_empty(F.col("value")).alias("value")).where("input_type <> '' OR value <> ''")
    if rows.where("input_type = '' OR value = ''").limit(1).count():
        raise ContractError("an optional input has an incomplete row")
    return rows


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """(gene, features array<float>) of a table whose first column is the gene; genes are unique and features are numbers."""
    rows = read_table(spark, path).drop("_broken")
    gene, *names = rows.columns
    out = rows.select(text.stripped(F.col(f"`{gene}`")).alias("gene"), F.array(*[F.expr(f"try_cast(`{c}` AS float)") for c in names]).alias("features"))
    if out.where(F.exists("features", lambda x: x.isNull() | F.isnan(x))).limit(1).count():
        raise ContractError("a feature is no number")
    return require(out, unique=("gene",), filled=("gene",))


def sample_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, group) of a comparison's samples: groups control and disease, both there, samples unique."""
    rows = strict(read_table(spark, path, ("sample_id", "group"), "\t"))
    rows = rows.select(text.stripped(F.coalesce("sample_id", F.lit(""))).alias("sample_id"), F.lower(text.stripped(F.coalesce("group", F.lit("")))).alias("group"))
    require(rows, unique=("sample_id",), filled=("sample_id", "group"), allowed={"group": ("control", "disease")})
    if rows.select("group").distinct().count() != 2:
        raise ContractError("samples need a control and a disease group")
    return rows


def expression(spark: SparkSession, tpm: str, metadata: str) -> DataFrame:
    """(GeneID, sample, group, value), one row per gene and sample of a comparison. Genes are unique and not blank, values numbers; samples that only the matrix has are left out."""
    from ..operators.signal import long_form

    wide = strict(read_table(spark, tpm, sep="\t"))
    gene, *samples = wide.columns
    if gene != "GeneID" or len(samples) < 2:
        raise ContractError("a matrix has GeneID and two samples at least")
    groups = sample_table(spark, metadata)
    own = {r.sample_id for r in groups.collect()}  # columns of one file
    if missing := sorted(own - set(samples)):
        raise ContractError(f"samples that the matrix lacks: {missing[:10]}")
    wide = require(wide.withColumn("GeneID", text.stripped(F.col("GeneID"))), unique=("GeneID",), filled=("GeneID",))
    chosen = [s for s in samples if s in own]
    rows = long_form(wide.select("GeneID", *[f"`{s}`" for s in chosen]), "GeneID", chosen).withColumn("value", F.expr("try_cast(value AS double)"))
    if rows.where(F.col("value").isNull() | F.isnan("value")).limit(1).count():
        raise ContractError("the matrix has a value that is no number")
    return rows.join(F.broadcast(groups.withColumnRenamed("sample_id", "sample")), "sample").select("GeneID", "sample", "group", "value")  # columns of one file


def expression_pairs(names: list[str]) -> list[tuple[str, str, str]]:
    """(comparison id, matrix, metadata) of the files that pair up by their suffix: none first, then numbers, then texts.

    A file without its partner, no pair at all, and suffixes that give one id twice or none that is portable are errors.
    """
    tpm = {m[1] or "": n for n in sorted(names) if (m := re.fullmatch(TPM_NAME, n))}
    metadata = {m[1] or "": n for n in sorted(names) if (m := re.fullmatch(METADATA_NAME, n))}
    if orphans := sorted([n for s, n in tpm.items() if s not in metadata] + [n for s, n in metadata.items() if s not in tpm]):
        raise ContractError(f"files without a partner: {orphans}")
    if not tpm:
        raise ContractError("no pair of matrix and metadata")
    order = sorted(tpm, key=lambda s: (0, 0, "") if not s else (1, int(s), s) if s.isdigit() else (2, 0, s))
    ids = [f"comparison_{s}" if s else "comparison_1" for s in order]
    if len(set(ids)) < len(ids) or not all(text.portable_segment(i) for i in ids):
        raise ContractError("suffixes give no portable ids of their own")
    return [(i, tpm[s], metadata[s]) for i, s in zip(ids, order)]


def long_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(compound, gene, effect, _ord) of a matrix with genes as rows and a column per compound."""
    rows = with_order(read_table(spark, path, sep=separator(path))).drop("_broken")
    gene, *compounds = [c for c in rows.columns if c != "_ord"]
    if not compounds:
        raise ContractError("profiles have no compound")
    long = rows.select(F.col(f"`{gene}`").alias("gene"), "_ord", *[f"`{c}`" for c in compounds]).unpivot(["gene", "_ord"], compounds, "compound", "effect")
    return long.select("compound", "gene", F.expr("try_cast(effect AS int)").alias("effect"), "_ord")


def official_drugs(spark: SparkSession, path: str, match_key, sheet: str = "Drug information") -> DataFrame:
    """(_ord, drug_id, match_key) of the workbook's drugs. match_key: from ``chem.column``."""
    rows = with_order(sheet_table(spark, path, sheet)).select("_ord", text.stripped(F.coalesce("Drug ID", F.lit(""))).alias("drug_id"), F.col("SMILES (standardized)").alias("smiles")).where("drug_id <> ''")
    return rows.select("_ord", "drug_id", F.coalesce(match_key(F.col("smiles")), F.lit("")).alias("match_key"))


def official_targets(spark: SparkSession, path: str, sheet: str = "Target information") -> DataFrame:
    """(uniprot_id, gene_symbol, entrez_id) of the workbook's targets, of each id the first row; blank symbols stay blank."""
    from ..operators.ranking import first_wins

    rows = with_order(sheet_table(spark, path, sheet))
    entrez = text.first_token(text.blank_to_empty(F.col("Gene ID"))) if "Gene ID" in rows.columns else F.lit("")
    rows = rows.select(text.blank_to_empty(F.col("UniProt AC")).alias("uniprot_id"), text.blank_to_empty(F.col("Gene symbol")).alias("gene_symbol"), entrez.alias("entrez_id"), "_ord").where("uniprot_id <> ''")
    return first_wins(rows, ["uniprot_id"], F.col("_ord"), F.col("gene_symbol"), F.col("entrez_id")).select("uniprot_id", "gene_symbol", "entrez_id")
