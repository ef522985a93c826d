"""Delimited and other file sources with contracts, and atomic sinks."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import header_key_of, portable_segment, stable_json, stripped


class ContractError(ValueError):
    """A table that breaks its contract."""


def separator(path: str) -> str:
    return "\t" if re.search(r"\.(tsv|tab)(\.gz)?$", path) else ","


def sniffed(spark: SparkSession, path: str) -> str:
    """The suffix's separator, or another one, whichever first gives the header more than one cell."""
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("\ufeff")
    for sep in dict.fromkeys((separator(path), ",", "\t")):
        try:
            if len(next(csv.reader([line], delimiter=sep, strict=True), [])) > 1:
                return sep
        except csv.Error:
            continue
    raise ContractError(f"{path} is no table with commas or tabs")


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = (), sep: str | None = None) -> DataFrame:
    """A delimited file as text columns; empty or repeated headers and missing columns are errors. A byte order mark is dropped by the reader."""
    head = spark.read.option("header", False).option("sep", sep or separator(path)).csv(path).first()
    names = [(x or "").strip().lstrip("﻿") for x in (head or [])]
    if not names or "" in names or len(set(names)) < len(names):
        raise ContractError(f"empty or repeated header in {path}")
    if missing := [c for c in required if c not in names]:
        raise ContractError(f"{path} lacks {missing}")
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField("_broken", StringType())])
    rows = spark.read.option("header", True).option("sep", sep or separator(path)).option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").option("enforceSchema", True).schema(schema).csv(path)
    blank = F.coalesce(*[F.nullif(stripped(F.col(f"`{n}`")), F.lit("")) for n in names]).isNull()
    return rows.where(~(blank & F.col("_broken").isNull()))


def strict(df: DataFrame) -> DataFrame:
    """The rows of ``read_table`` if every one has as many fields as the header and there is one at least. The counts are an aggregation of one pass; nothing is kept."""
    bad, n = df.agg(F.count("_broken"), F.count(F.lit(1))).first()
    if bad or not n:
        raise ContractError(f"{bad} rows with another number of fields" if bad else "no data rows")
    return df.drop("_broken")


def by_alias(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns renamed by their canonical header; the named ones come first, others follow. Each name needs exactly one match."""
    chosen = {}
    for name, own in aliases.items():
        keys = {header_key_of(a) for a in (name, *own)}
        found = [c for c in df.columns if header_key_of(c) in keys]
        if len(found) != 1:
            raise ContractError(f"{name}: {len(found)} columns match")
        chosen[found[0]] = name
    rest = [c for c in df.columns if c not in chosen]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in chosen.items()], *[f"`{c}`" for c in rest])


def with_order(df: DataFrame) -> DataFrame:
    """Adds ``_ord``, which follows file order: files by name, rows as read within a task."""
    return df.withColumn("_ord", F.monotonically_increasing_id())


def edge_file(spark: SparkSession, path: str, kinds: tuple[str, str]) -> DataFrame:
    """A headerless file of typed weighted edges; another node type, an empty id or a weight that is negative or not finite is an error."""
    rows = spark.read.option("sep", separator(path)).schema("source_type string, source_id string, target_type string, target_id string, weight string").csv(path)
    rows = rows.withColumn("weight", F.expr("try_cast(weight AS double)"))
    good = (F.col("source_type") == kinds[0]) & (F.col("target_type") == kinds[1]) & (F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != "") & (F.col("weight") >= 0) & (F.col("weight") < float("inf"))
    bad = rows.where(~F.coalesce(good, F.lit(False))).limit(1).count()
    if bad:
        raise ContractError(f"{path} has rows that are no {kinds[0]}-{kinds[1]} edges")
    return rows


def raw_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless predictions of exactly six fields; rank "-" or "known" marks known targets."""
    fields = F.split("value", r"\t")
    rows = spark.read.text(path).where(stripped(F.col("value")) != "")
    if rows.where((F.size(fields) != 6) | F.exists(F.slice(fields, 1, 4), lambda x: stripped(x) == "")).limit(1).count():
        raise ContractError(f"{path} has rows without six fields")
    names = ("source_type", "source_id", "target_type", "uniprot_id")
    rank = F.lower(F.trim(fields[5]))
    known = rank.isin("-", "known")
    return rows.select(*[stripped(fields[i]).alias(n) for i, n in enumerate(names)], F.expr("try_cast(split(value, '\\\\t')[4] AS double)").alias("score"), F.when(known, "known").otherwise("predicted").alias("evidence"), F.when(~known, rank.try_cast("int")).alias("prediction_rank"))


def target_items(spark: SparkSession, path: str) -> DataFrame:
    """(compound_id, smiles, position, gene_symbol, uniprot_id, evidence, score, prediction_rank) of a JSON object keyed by compound; symbols in upper case, scores and ranks as numbers or null where they are none.

    A compound without targets has one row with a null position.
    """
    item = "struct<gene_symbol:string,uniprot_id:string,evidence:string,score:string,prediction_rank:string>"
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"map<string,struct<smiles:string,targets:array<{item}>>>", {"mode": "FAILFAST"}).alias("m"))
    rows = whole.select(F.explode("m").alias("compound_id", "v")).select(text_of("compound_id"), text_of("v.smiles").alias("smiles"), F.posexplode_outer("v.targets").alias("position", "t"))
    number = lambda c: F.when(F.col(c).rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), F.expr(f"try_cast({c} AS double)"))
    return rows.select("compound_id", "smiles", "position", F.upper(text_of("t.gene_symbol")).alias("gene_symbol"), text_of("t.uniprot_id").alias("uniprot_id"), F.lower(text_of("t.evidence")).alias("evidence"), number("t.score").alias("score"), number("t.prediction_rank").alias("prediction_rank"), F.col("t.score").alias("_score"))


def text_of(name: str):
    """A column's text without white space at its ends, null as the empty text."""
    return stripped(F.coalesce(F.col(name), F.lit(""))).alias(name.rsplit(".", 1)[-1])


def checked_items(items: DataFrame, given: bool = False) -> DataFrame:
    """``target_items`` if the evidence is known or predicted, predictions have whole ranks from 1 to 10, and scores are numbers.

    given: also that known targets stand before predicted ones, ranks do not fall, and ids and symbols are there and
    symbols unique in a compound.
    """
    known, rank = F.col("evidence") == "known", F.col("prediction_rank")
    fine = F.col("position").isNull() | (F.col("evidence").isin("known", "predicted") & (known | F.coalesce(rank.between(1, 10) & (rank == F.floor(rank)), F.lit(False))) & (F.col("_score").isNull() | F.col("score").isNotNull()))
    rows = items.withColumn("_fine", fine)
    if given:
        own = Window.partitionBy("compound_id").orderBy("position")
        lag = F.struct(known.alias("known"), F.coalesce(rank, F.lit(0.0)).alias("rank"))
        rows = rows.withColumn("_before", F.lag(lag).over(own)).withColumn("_same", F.count("*").over(Window.partitionBy("compound_id", "gene_symbol")))
        order = F.col("_before").isNull() | F.when(known, F.col("_before.known")).otherwise(F.col("_before.known") | (F.col("_before.rank") <= rank))
        rows = rows.withColumn("_fine", F.col("_fine") & (F.col("position").isNull() | (order & (F.col("_same") == 1) & (F.col("gene_symbol") != "") & (F.col("uniprot_id") != "")))).drop("_before", "_same")
    if rows.where(~F.coalesce("_fine", F.lit(False)) | (F.col("compound_id") == "")).limit(1).count():
        raise ContractError("a target breaks the rules of evidence, rank, score or order")
    return rows.drop("_fine", "_score").withColumn("prediction_rank", F.col("prediction_rank").cast("int"))


def drug_targets(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The valid targets of a JSON object; most: known ones first, then predictions by rank, of each symbol the first, no more than ``most`` of a compound, with their place."""
    rows = checked_items(target_items(spark, path)).where("position IS NOT NULL").withColumn("place", F.col("position"))
    if most is None:
        return rows
    known = F.col("evidence") == "known"
    order = [(~known).cast("int"), F.when(known, 0).otherwise(F.col("prediction_rank")), F.col("position")]
    first = rows.where("gene_symbol <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("compound_id", "gene_symbol").orderBy(*order))).where("_n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("compound_id").orderBy(*order))).where(F.col("place") <= most).drop("_n")


def provided_targets(spark: SparkSession, path: str, compounds: DataFrame, mapping: DataFrame) -> DataFrame:
    """Targets that the user gives: exactly the library's compounds with their structures, and symbols that the mapping has. compounds: (ID, SMILES); mapping: (gene_symbol, entrez_id)."""
    rows = checked_items(target_items(spark, path), True)
    own = rows.select("compound_id", "smiles").distinct().join(compounds.select(F.col("ID").alias("compound_id"), F.col("SMILES").alias("_smiles")), "compound_id", "full")
    if own.where(~F.coalesce(F.col("smiles") == F.col("_smiles"), F.lit(False))).limit(1).count():
        raise ContractError("given targets name other compounds or structures than the library")
    rows = rows.where("position IS NOT NULL")
    if rows.isEmpty() or rows.join(mapping, "gene_symbol", "left_anti").limit(1).count():
        raise ContractError("no given target, or one whose symbol the mapping lacks")
    return rows


def require(df: DataFrame, unique: tuple[str, ...] = (), filled: tuple[str, ...] = (), allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``df`` if it keeps its contract; all rules are counted in one job, duplicates in a second."""
    rules = {f"empty {c}": F.sum((F.coalesce(F.col(c).cast("string"), F.lit("")) == "").cast("long")) for c in filled}
    rules |= {f"{c} not allowed": F.sum((~F.coalesce(F.col(c).isin(*v), F.lit(False))).cast("long")) for c, v in (allowed or {}).items()}
    found = df.agg(*[v.alias(k) for k, v in rules.items()]).first().asDict() if rules else {}
    broken = [k for k, v in found.items() if v]
    if unique and df.groupBy(*unique).count().where("count > 1").limit(1).count():
        broken.append(f"repeated {unique}")
    if broken:
        raise ContractError("; ".join(broken))
    return df


def hadoop(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = hadoop(spark, path)
    return files.exists(at)


def put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """Moves a whole result to its place. What is there already is set aside first and comes back if the move fails."""
    source, files = hadoop(spark, staged)
    target, _ = hadoop(spark, path)
    aside, _ = hadoop(spark, f"{path}.replaced-{uuid.uuid4().hex}")
    there = files.exists(target)
    if there and not files.rename(target, aside):
        raise OSError(f"{path} cannot be set aside")
    if not files.rename(source, target):
        if there:
            files.rename(aside, target)
        raise OSError(f"{path} cannot be put in place")
    if there:
        files.delete(aside, True)


def write_table(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """A delimited file set with these columns, null as the empty text, moved into place when it is whole."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.select(*columns).write.option("header", True).option("sep", separator(path)).option("nullValue", "").option("emptyValue", "").csv(staged)
    put_in_place(df.sparkSession, staged, path)


def write_one_file(df: DataFrame, path: str, columns: tuple[str, ...], packed: bool = False) -> None:
    """The same as one file in the rows' order, byte for byte equal for equal rows; packed: as gzip with no time in it. For results of bounded size: one task writes it."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    out = df.select(*columns).coalesce(1).write.option("header", True).option("sep", separator(path)).option("nullValue", "").option("emptyValue", "").option("lineSep", "\n")
    (out.option("compression", "gzip") if packed else out).csv(staged)
    folder, files = hadoop(df.sparkSession, staged)
    part = next(x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith("part-"))
    put_in_place(df.sparkSession, part.toString(), path)
    files.delete(folder, True)


def write_matrix(df: DataFrame, path: str) -> None:
    """A table of vectors as Parquet, moved into place when it is whole."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    put_in_place(df.sparkSession, staged, path)


def write_text(spark: SparkSession, value: str, path: str) -> None:
    """A small text, moved into place when it is whole."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    at, files = hadoop(spark, staged)
    out = files.create(at, True)
    out.write(bytearray(value.encode()))
    out.close()
    put_in_place(spark, staged, path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small document with sorted keys."""
    write_text(spark, stable_json(value) + "\n", path)


def read_json(spark: SparkSession, path: str) -> object:
    """A small document."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each file, read piece by piece by the task that has its name, so that no file is held whole."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= WHOLE_FILE).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = [(r.path, r.size) for r in names.where(F.col("size") > WHOLE_FILE).limit(LARGE_FILES + 1).collect()]
    if len(large) > LARGE_FILES:
        raise ContractError(f"more than {LARGE_FILES} files above {WHOLE_FILE} bytes")
    if not large:
        return small
    return small.union(spark.createDataFrame([(p, n, streamed_digest(spark, p)) for p, n in large], "path string, size long, sha256 string"))


#: Bytes of a file that a task may hold whole, and how many larger ones the driver streams.
WHOLE_FILE, LARGE_FILES = 64_000_000, 1_000


def streamed_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, a buffer at a time, through the file system of its path."""
    jvm = spark._jvm
    at, files = hadoop(spark, path)
    total = jvm.java.security.MessageDigest.getInstance("SHA-256")
    source = jvm.java.security.DigestInputStream(files.open(at), total)
    sink = jvm.java.io.OutputStream.nullOutputStream()
    try:
        source.transferTo(sink)
    finally:
        source.close()
    return "".join(f"{b & 255:02x}" for b in total.digest())


def registered(spark: SparkSession, requests: list[dict], folder: str, now: str) -> list[dict]:
    """Copies inputs byte for byte into a folder and tells their size and SHA-256. requests: input_key, path, source[, role, pair_id, original_name].

    Names that differ in case only, a repeated (input_key, pair_id, role), a name that is not portable or a file that is
    there already are errors before anything is copied; if a copy fails, those made so far are taken back.
    """
    if not requests:
        raise ContractError("no input to register")
    rows = [{"role": None, "pair_id": None, **r, "original_name": r.get("original_name") or r["path"].rsplit("/", 1)[-1]} for r in requests]
    for what, keys in (("names", [r["original_name"].casefold() for r in rows]), ("inputs", [(r["input_key"], r["pair_id"], r["role"]) for r in rows])):
        if len(set(keys)) < len(keys):
            raise ContractError(f"repeated {what}")
    if bad := [r["original_name"] for r in rows if not portable_segment(r["original_name"])]:
        raise ContractError(f"names that are not portable: {bad}")
    made = []
    conf = spark._jsc.hadoopConfiguration()
    util = spark._jvm.org.apache.hadoop.fs.FileUtil
    for r in rows:
        target, files = hadoop(spark, f"{folder}/{r['original_name']}")
        if files.exists(target):
            raise ContractError(f"{r['original_name']} is registered already")
    out = []
    try:
        for r in rows:
            source, own = hadoop(spark, r["path"])
            target, files = hadoop(spark, f"{folder}/{r['original_name']}")
            before = streamed_digest(spark, r["path"])
            made.append((target, files))
            util.copy(own, source, files, target, False, False, conf)
            digest = streamed_digest(spark, target.toString())
            if digest != before:
                raise ContractError(f"{r['path']} changed while it was copied")
            out.append({"input_key": r["input_key"], "role": r["role"], "pair_id": r["pair_id"], "original_name": r["original_name"], "registered_path": target.toString(), "size_bytes": files.getFileStatus(target).getLen(), "sha256": digest, "registered_at": now, "source": r["source"]})
    except Exception:
        for target, files in made:
            files.delete(target, False)
        raise
    return out


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each listed file with whether it is missing, changed or as listed. manifest: (name, sha256)."""
    own = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("sha256").alias("_found"))
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("sha256"), "changed").otherwise("ok")
    return manifest.join(own, "name", "left").select("name", state.alias("state"))


class SheetSource(DataSource):
    """``spark.read.format("evidentia-sheet").option("sheet", name).load(path)``: a workbook's sheet as text columns, for paths that all executors have. ``sheet_table`` reads any path."""

    @classmethod
    def name(cls) -> str:
        return "evidentia-sheet"

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in next(iter(sheet_rows(self.options["path"], self.options["sheet"])))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], self.options["sheet"], len(schema))


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def read(self, partition):
        rows = iter(sheet_rows(self.path, self.sheet))
        next(rows)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


def sheet_table(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A workbook's sheet as text columns; the file comes through Spark's reader, so any file system will do, and one task parses it."""
    book = spark.read.format("binaryFile").load(path).select("content")
    head = book.mapInPandas(_first_row(sheet), "names array<string>").first()
    if head is None:
        raise ContractError(f"{path} has no sheet {sheet}")
    names = [(n or "").strip() for n in head.names]
    while names and not names[-1]:
        names.pop()
    if "" in names or len(set(names)) < len(names):
        raise ContractError(f"empty or repeated header in {sheet}")
    rows = book.mapInPandas(_data_rows(sheet, len(names)), "at long, cells array<string>")
    return rows.orderBy("at").select(*[F.get("cells", i).alias(n) for i, n in enumerate(names)])


def _first_row(sheet: str):
    def read(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame({"names": [next(iter(rows_of(content, sheet)))]})

    return read


def _data_rows(sheet: str, width: int):
    def read(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(rows_of(content, sheet))[1:]
                cells = [(r + [None] * width)[:width] for r in rows]
                yield pd.DataFrame({"at": range(len(cells)), "cells": cells})

    return read


def sheet_rows(path: str, sheet: str):
    """The rows of a sheet as lists of texts; a workbook is a small file that one task reads."""
    with open(path.removeprefix("file:"), "rb") as f:
        yield from rows_of(f.read(), sheet)


def rows_of(content: bytes, sheet: str):
    """The same of a workbook's bytes."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = next((s for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet") if s.get("name") == sheet), None)
        if found is None:
            raise ContractError(f"the workbook has no sheet {sheet}")
        target = targets[found.get(link)].lstrip("/")
        for row in ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{main}row"):
            cells: list[str | None] = []
            for c in row:
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                value = c.find(f"{main}v")
                text = None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{main}t"))
                cells += [None] * (at - 1 - len(cells)) + [text]
            yield cells
