"""A corpus pipeline: quality, line dedup, one document of each group of near copies, and packing.

Cases, of each stage: a null text is judged as the empty text; line dedup and the join leave it as it is, and it packs as
its end token alone. Long texts are read whole. Rows that repeat an id are copies of one document: all of them pass or go
in the first three stages, and packing packs each. Rows without id pass the second and third stage as they are. An empty
table gives empty tables. Only the columns of documents are handed on; others, whatever their names, are dropped after the
first stage that selects, and no stage reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import line_dedup, ngram_join, packing, quality
from evidentia.llm.common import table, written
from evidentia.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject; it learns from the labels of ``docs``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier document has; one that has no text left, and had some, goes."""
    left = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return left.where(~emptied).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the smallest of their group of near copies."""
    found = written(ngram_join.similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return ngram_join.without(docs, found).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.piece_digests(packing.pack_documents(docs, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
