"""Queries of the sources and of text and step operators: the driver's tables are written as files in the formats that the sources read, and read back.

Each query has its DuckDB SQL over the tables themselves beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .operators import construct, inference, knowledge, mapping, ranking, signal
from .plans import workflow
from .sources import delimited, resources, rules
from .sources.tables import shared_dir, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def filed(df: DataFrame, name: str, header: bool = True, sep: str | None = None) -> str:
    """The place of a table written as delimited files; the suffix of ``name`` names the separator unless it is given."""
    path = f"{shared_dir(df.sparkSession)}/evidentia-files/{uuid.uuid4().hex}/{name}"
    df.write.option("header", header).option("sep", sep or delimited.separator(name)).option("nullValue", "").option("emptyValue", "").csv(path)
    return path


def one_file(df: DataFrame, name: str) -> str:
    """The same as one file."""
    path = f"{shared_dir(df.sparkSession)}/evidentia-files/{uuid.uuid4().hex}/{name}"
    delimited.write_one_file(df, path, tuple(df.columns))
    return path


def named(spark: SparkSession, d: str, source: str, /, **columns: str) -> DataFrame:
    return table(spark, d, source).select(*[F.expr(v).alias(k) for k, v in columns.items()])


# ---- sources


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part")
def delimited_read(spark, d):
    path = filed(named(spark, d, "part", key="p_partkey", name="p_name", kind="p_type", size="p_size"), "part.tsv")
    return delimited.read_table(spark, path, ("key", "size")).drop("_broken")


@query("SELECT ',' AS separator, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def delimiter_sniff(spark, d):
    """The suffix says tabs, the header commas."""
    path = filed(named(spark, d, "supplier", key="s_suppkey", name="s_name"), "supplier.tsv", sep=",")
    found = delimited.sniffed(spark, path)
    return delimited.read_table(spark, path, sep=found).drop("_broken").withColumn("separator", F.lit(found))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer")
def strict_read(spark, d):
    return delimited.strict(delimited.read_table(spark, filed(named(spark, d, "customer", key="c_custkey", segment="c_mktsegment"), "customer.csv")))


@query("SELECT 'c' || c_custkey AS \"ID\", upper(c_mktsegment) AS \"SMILES\", c_nationkey || '' AS nation FROM customer")
def alias_projection(spark, d):
    """A library's columns by any of their names; further columns follow."""
    path = filed(named(spark, d, "customer", nation="c_nationkey", **{"Compound ID": "'c' || c_custkey", "Canonical_SMILES": "' ' || upper(c_mktsegment)"}), "library.csv")
    return resources.compound_library(spark, path).select("ID", "SMILES", "nation")


@query("SELECT upper(left(c_mktsegment, 3)) || c_custkey AS symbol, CAST(c_custkey * 3 AS VARCHAR) AS given_id FROM customer")
def gene_list_with_header(spark, d):
    path = one_file(named(spark, d, "customer", note="c_name", **{"Gene Symbol": "upper(left(c_mktsegment, 3)) || c_custkey", "Entrez ID": "c_custkey * 3"}), "genes.tsv")
    return resources.gene_list(spark, path).select("symbol", "given_id")


@query("SELECT '' AS symbol, CAST(o_orderkey AS VARCHAR) AS given_id FROM orders")
def gene_list_of_ids(spark, d):
    path = filed(named(spark, d, "orders", id="o_orderkey"), "ids.tsv", header=False)
    return resources.gene_list(spark, path).select("symbol", "given_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"GeneID\", p_name AS \"Symbol\", CASE WHEN p_size % 3 = 0 THEN '-' ELSE p_brand || '|' || p_type END AS \"Synonyms\" FROM part")
def gene_dictionary_read(spark, d):
    path = filed(named(spark, d, "part", GeneID="p_partkey", Symbol="p_name", Synonyms="CASE WHEN p_size % 3 = 0 THEN '-' ELSE p_brand || '|' || p_type END"), "gene_info.tsv")
    return resources.gene_info(spark, path).drop("_ord")


EDGE_SQL = "SELECT 'D' || l_suppkey AS source_id, 'S' || l_partkey AS target_id, round(sum(l_quantity), 6) AS weight, count(*) AS n FROM lineitem GROUP BY ALL"


@query(EDGE_SQL)
def typed_edges_read(spark, d):
    path = filed(named(spark, d, "lineitem", a="'DRUG'", b="'D' || l_suppkey", c="'SUB'", e="'S' || l_partkey", w="l_quantity"), "edges.tsv", header=False)
    rows = delimited.edge_file(spark, path, ("DRUG", "SUB"))
    return rows.groupBy("source_id", "target_id").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


@query("""SELECT 'S' || l_suppkey AS source_id, CASE WHEN l_linenumber <= 2 THEN 'known' ELSE 'predicted' END AS evidence, count(*) AS n, round(sum(l_tax), 6) AS score,
       CAST(max(CASE WHEN l_linenumber > 2 THEN l_linenumber END) AS INTEGER) AS most FROM lineitem GROUP BY ALL""")
def raw_predictions_read(spark, d):
    """Ranks "-" and " Known" mark known targets."""
    rank = "CASE l_linenumber WHEN 1 THEN '-' WHEN 2 THEN ' Known' ELSE string(l_linenumber) END"
    path = filed(named(spark, d, "lineitem", a="'COMPOUND'", b="'S' || l_suppkey", c="'TARGET'", e="'P' || l_partkey", s="l_tax", r=rank), "raw.tsv", header=False)
    rows = delimited.raw_predictions(spark, path)
    return rows.groupBy("source_id", "evidence").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.max("prediction_rank").cast("int").alias("most"))


@query("SELECT 'n' || p_partkey AS node_id, p_type AS node_type, p_name AS node_name FROM part")
def node_table_read(spark, d):
    names = dict(zip(construct.NODE_COLUMNS, ("p_partkey", "' n' || p_partkey", "p_type", "p_name", "'B'", "'B:' || p_partkey", "''", "p_type")))
    return resources.node_table(spark, filed(named(spark, d, "part", **names), "nodes.tsv")).select("node_id", "node_type", "node_name")


@query("SELECT 'r' || l_returnflag AS relation, 'n' || l_suppkey AS x_id, count(*) AS n FROM lineitem GROUP BY ALL")
def edge_table_read(spark, d):
    own = {"x_id": "'n' || l_suppkey", "y_id": "'n' || l_partkey", "relation": "'r' || l_returnflag"}
    rows = named(spark, d, "lineitem", **{c: own.get(c, "'x'") for c in construct.EDGE_COLUMNS})
    return resources.edge_table(spark, filed(rows, "edges.csv")).groupBy("relation", "x_id").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN quality = 1 THEN 'library_id' ELSE 'base_drug_id' END AS input_type, 'c' || doc_id AS value FROM labels WHERE toxic = 0")
def prior_table_read(spark, d):
    """Rows that are blank in both columns go."""
    rows = named(spark, d, "labels", input_type="CASE WHEN toxic = 0 THEN CASE WHEN quality = 1 THEN 'library_id' ELSE 'base_drug_id' END ELSE ' ' END", value="CASE WHEN toxic = 0 THEN 'c' || doc_id ELSE 'NaN' END")
    return resources.prior_table(spark, filed(rows, "positive_drugs.tsv")).select("input_type", "value")


@query("SELECT CAST(vec_id AS VARCHAR) AS gene, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[3] AS DOUBLE), 5) AS third FROM embeddings")
def feature_table_read(spark, d):
    path = filed(named(spark, d, "embeddings", gene="vec_id", a="embedding[0]", b="embedding[1]", c="embedding[2]"), "features.csv")
    rows = resources.feature_table(spark, path)
    return rows.select("gene", F.round(F.col("features")[0].cast("double"), 5).alias("first"), F.round(F.col("features")[2].cast("double"), 5).alias("third"))


@query("SELECT 's' || o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 'control' ELSE 'disease' END AS \"group\" FROM orders")
def sample_table_read(spark, d):
    return resources.sample_table(spark, filed(named(spark, d, "orders", sample_id="'s' || o_orderkey", group="CASE WHEN o_orderstatus = 'F' THEN 'Control' ELSE 'disease ' END"), "metadata.tsv"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "GeneID", s.sample, CASE WHEN s.sample = 'c' THEN 'control' ELSE 'disease' END AS "group",
       round(CASE s.sample WHEN 'a' THEN p_size WHEN 'b' THEN p_retailprice ELSE p_partkey % 7 END, 6) AS value FROM part, (VALUES ('a'), ('b'), ('c')) s(sample)""")
def expression_read(spark, d):
    """A matrix with a sample that the metadata lacks, in long form with its groups."""
    tpm = filed(named(spark, d, "part", GeneID="p_partkey", a="p_size", b="p_retailprice", other="p_size * 2", c="p_partkey % 7"), "TPM_matrix.tsv")
    groups = spark.createDataFrame([("a", "disease"), ("b", "Disease"), ("c", "control")], "sample_id string, group string")
    return resources.expression(spark, tpm, filed(groups, "metadata.tsv")).withColumn("value", F.round("value", 6))


@query("""SELECT compound, CAST(p_partkey AS VARCHAR) AS gene, CAST(CASE compound WHEN 'a' THEN p_size % 3 - 1 ELSE p_partkey % 2 END AS INTEGER) AS effect FROM part, (VALUES ('a'), ('b')) c(compound)""")
def long_profiles_read(spark, d):
    return resources.long_profiles(spark, filed(named(spark, d, "part", Gene="p_partkey", a="p_size % 3 - 1", b="p_partkey % 2"), "profiles.csv")).drop("_ord")


@query("SELECT upper('g' || p_partkey) AS gene_symbol, CAST(p_partkey * 7 AS VARCHAR) AS entrez_id FROM part")
def provided_mapping_read(spark, d):
    return resources.provided_mapping(spark, filed(named(spark, d, "part", gene_symbol="' g' || p_partkey", entrez_id="p_partkey * 7"), "target_mapping.tsv"))


@query("SELECT upper(p_brand || '-' || p_size) AS gene_symbol, CAST(any_value(p_size * 7 + length(p_brand)) AS VARCHAR) AS entrez_id FROM part GROUP BY 1")
def target_mapping_read(spark, d):
    path = filed(named(spark, d, "part", symbol="lower(p_brand || '-' || p_size)", gene_id="(p_size * 7 + length(p_brand)) || ';9'"), "map.csv")
    return resources.target_mapping(spark, path).select("gene_symbol", "entrez_id")


@query("SELECT upper(p_brand) AS symbol, CAST(p_size AS VARCHAR) AS entrez_id FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1")
def disease_genes_read(spark, d):
    """Of each id the first row of the file."""
    path = one_file(named(spark, d, "part", key="p_partkey", symbol="p_brand", entrez_id="p_size || ';1'").orderBy("key").drop("key"), "disease_genes.tsv")
    return resources.disease_genes(spark, path).select("symbol", "entrez_id")


@query("SELECT 'c' || s_suppkey AS \"ID\", s_name AS \"SMILES\", s_name AS canonical FROM supplier")
def normalised_compounds_read(spark, d):
    path = filed(named(spark, d, "supplier", ID="'c' || s_suppkey", SMILES="s_name"), "compounds.normalized.csv")
    return resources.normalised_compounds(spark, path, lambda c: c).select("ID", "SMILES", "canonical")


@query("SELECT n_nationkey AS key, n_name AS name, CAST(1 AS BIGINT) AS files, true AS same FROM nation")
def deterministic_file(spark, d):
    """A result of bounded size is written twice, packed, and read back: one file, byte for byte the same."""
    rows = named(spark, d, "nation", key="n_nationkey", name="n_name").orderBy("key")
    at = f"{shared_dir(spark)}/evidentia-files/{uuid.uuid4().hex}"
    for name in ("one", "two"):
        delimited.write_one_file(rows, f"{at}/{name}.csv.gz", ("key", "name"), packed=True)
    seen = spark.createDataFrame([tuple(x.sha256 for x in (delimited.digests(spark, f"{at}/{name}.csv.gz").first() for name in ("one", "two")))], "a string, b string")
    back = delimited.read_table(spark, f"{at}/one.csv.gz").drop("_broken")
    return back.crossJoin(F.broadcast(seen)).select(F.col("key").cast("int").alias("key"), "name", F.lit(1).cast("long").alias("files"), (F.col("a") == F.col("b")).alias("same"))  # one row is broadcast


@query("SELECT s_suppkey AS key, round(s_acctbal, 2) AS value FROM supplier")
def matrix_sink(spark, d):
    path = f"{shared_dir(spark)}/evidentia-files/{uuid.uuid4().hex}/matrix.parquet"
    delimited.write_matrix(named(spark, d, "supplier", key="s_suppkey", value="s_acctbal"), path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 2))


# ---- rules


@query("""SELECT rule, n, example FROM (
       SELECT 'a price of none' AS rule, count(*) FILTER (l_extendedprice <= 0) AS n, CAST(min(CASE WHEN l_extendedprice <= 0 THEN l_orderkey * 10 + l_linenumber END) AS VARCHAR) AS example FROM lineitem
       UNION ALL SELECT 'a large discount', count(*) FILTER (l_discount > 0.05), min(CASE WHEN l_discount > 0.05 THEN CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END) FROM lineitem
       UNION ALL SELECT 'returned', count(*) FILTER (l_returnflag = 'R'), min(CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END) FROM lineitem)""")
def rules_in_one_pass(spark, d):
    rows = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    own = [rules.Rule("a price of none", F.col("l_extendedprice") <= 0), rules.Rule("a large discount", F.col("l_discount") > 0.05), rules.Rule("returned", F.col("l_returnflag") == "R")]
    return rules.stated(rows, own, "key")


@query("""SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a
       FULL JOIN (SELECT p_partkey AS k, count(*) AS n FROM part WHERE p_size > 3 GROUP BY 1) b ON a.k = b.k WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1""")
def membership_both_ways(spark, d):
    return rules.membership(named(spark, d, "lineitem", key="l_partkey"), named(spark, d, "part", key="CASE WHEN p_size > 3 THEN p_partkey END").where("key IS NOT NULL"), "key")


# ---- texts


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^a-z0-9]', '', 'g') AS key FROM part")
def header_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.header_key(F.expr("p_name || ' (' || p_brand || ')'")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS token, CASE WHEN p_size % 2 = 0 THEN 'protein:ncbi:' || p_size END AS protein FROM part")
def first_tokens(spark, d):
    token = text.first_token(F.expr("CASE WHEN p_size % 2 = 0 THEN ' ' || p_size || ' ;' || p_brand ELSE p_brand END"))
    return table(spark, d, "part").select("p_partkey", token.alias("token"), text.protein_key(token).alias("protein"))


@query("SELECT l_orderkey * 10 + l_linenumber AS line, printf('%.9g', l_extendedprice / 7) AS large, printf('%.9g', l_tax / 7000) AS small FROM lineitem")
def significant_digits(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), text.significant(F.col("l_extendedprice") / 7).alias("large"), text.significant(F.col("l_tax") / 7000).alias("small"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown, round(CASE WHEN next IS NOT NULL THEN greatest(0, epoch_us(next) - epoch_us(ts)) / 1e6 END, 6) AS seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events)""")
def iso_times_and_durations(spark, d):
    """Times as ISO text and back; the seconds to a user's next event, not below 0."""
    rows = table(spark, d, "events").withColumn("shown", text.iso_time(F.col("ts"))).withColumn("back", text.from_iso(F.col("shown")))
    later = F.lead("back").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("_next", later).select("event_id", "shown", F.when(F.col("_next").isNotNull(), F.round(text.seconds_between(F.col("back"), F.col("_next")), 6)).alias("seconds"))


@query("SELECT p_partkey, p_brand AS first, 2 AS n FROM part WHERE p_size % 4 > 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size % 4 = 0")
def json_cells(spark, d):
    cell = F.expr("CASE p_size % 4 WHEN 0 THEN ' ' ELSE ' ' || to_json(array(p_brand, p_type)) END")
    found = text.json_list(cell)
    return table(spark, d, "part").select("p_partkey", found[0].alias("first"), F.when(found.isNotNull(), F.size(found)).alias("n"))


@query("SELECT p_partkey, p_brand AS \"box.name\" FROM part")
def toxicity_fields_dropped(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("name"), F.col("p_size").alias("Toxicity_score")).alias("box"), F.col("p_type").alias("toxicity"))
    return text.without_fields(rows, "toxic").select("p_partkey", F.col("box.name").alias("box.name"))


# ---- mapping and inference


@query("""WITH o AS (SELECT p_type AS k, min(p_partkey) AS first FROM part WHERE p_size % 5 = 0 GROUP BY 1)
       SELECT 'c' || l_orderkey * 10 + l_linenumber AS "ID", coalesce('D' || first, '') AS official_drug_id, CASE WHEN first IS NULL THEN 'COMPOUND' ELSE 'DRUG' END AS netinfer_input_type,
              coalesce('D' || first, 'c' || l_orderkey * 10 + l_linenumber) AS netinfer_input_id FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN o ON o.k = p_type""".replace("'c' || l_orderkey * 10 + l_linenumber", "'c' || (l_orderkey * 10 + l_linenumber)"))
def structure_match_first_wins(spark, d):
    """Of official drugs with one structure the first stands."""
    part = table(spark, d, "part")
    official = part.where("p_size % 5 = 0").select(F.col("p_partkey").alias("_ord"), F.expr("'D' || p_partkey").alias("drug_id"), F.col("p_type").alias("match_key"))
    lines = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.expr("l_orderkey * 10 + l_linenumber").alias("_ord"), F.expr("'c' || (l_orderkey * 10 + l_linenumber)").alias("ID"), F.col("p_name").alias("SMILES"), F.col("p_type").alias("match_key"))
    return inference.structure_queries(lines, official).select("ID", "official_drug_id", "netinfer_input_type", "netinfer_input_id")


@query("SELECT o_orderkey AS key, 'batch_' || printf('%04d', CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 64 + 1 AS INTEGER)) AS batch_id FROM orders")
def batch_assignment(spark, d):
    return inference.batches(named(spark, d, "orders", key="o_orderkey"), "key", 64)


@query("SELECT p_partkey AS key, 'edge:' || printf('%09d', CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER)) AS edge_id FROM part")
def surrogate_ids(spark, d):
    return construct.numbered(named(spark, d, "part", key="p_partkey"), "key", "edge:%09d", "edge_id")


@query("""WITH m AS (SELECT p_name AS s, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part WHERE p_size % 3 > 0 GROUP BY 1)
       SELECT CAST(l_orderkey AS VARCHAR) AS compound, CAST(k AS VARCHAR) AS entrez_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN m ON m.s = p_name WHERE m.n = 1 GROUP BY ALL""")
def symbols_to_ids(spark, d):
    """Symbols with one id; those with several are left out here, so the mapping has one row each."""
    part = table(spark, d, "part")
    ids = part.where("p_size % 3 > 0").groupBy(F.col("p_name").alias("gene_symbol")).agg(F.count_distinct("p_partkey").alias("n"), F.min("p_partkey").cast("string").alias("entrez_id")).where("n = 1").select(F.upper("gene_symbol").alias("gene_symbol"), "entrez_id")
    rows = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").cast("string").alias("compound"), F.upper("p_name").alias("gene_symbol"))
    met, _ = mapping.by_symbol(rows, ids, "compound")
    return met.groupBy("compound", "entrez_id").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS gene, round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def gene_space_semi_join(spark, d):
    """Signature genes that the profiles have."""
    change = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("GeneID")).agg(F.avg("l_quantity").alias("log2fc_mean"))
    own = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("GeneID"))
    return signal.disease_signature(change, own).select(F.col("GeneID").cast("long").alias("gene"), F.round("disease_log2FC_mean", 6).alias("value"))


@query("""WITH s AS (SELECT 'n' || p_partkey AS node_id, round(sum(l_quantity), 6) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
       SELECT node_id, CAST(row_number() OVER (ORDER BY score DESC, node_id) AS BIGINT) AS rank, score, p_size > 40 AS is_train_positive FROM s JOIN part ON 'n' || p_partkey = node_id WHERE p_size % 2 = 0""")
def candidate_ranking(spark, d):
    """Nodes with a library tag by score; positives are marked."""
    part = table(spark, d, "part")
    nodes = part.select(F.expr("'n' || p_partkey").alias("node_id"), F.col("p_name").alias("node_name"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'B:x;UserLibrary:' || p_partkey ELSE 'B:y' END").alias("source_ids"))
    scores = table(spark, d, "lineitem").groupBy(F.expr("'n' || l_partkey").alias("node_id")).agg(F.round(F.sum("l_quantity"), 6).alias("score"))
    positive = part.where("p_size > 40").select(F.expr("'n' || p_partkey").alias("node_id"))
    return knowledge.ranked_candidates(nodes, scores, "UserLibrary:", positive).select("node_id", "rank", "score", "is_train_positive")


@query("SELECT l_partkey AS key, CAST(-max(l_tax) AS DOUBLE) AS down, max(l_tax) AS up, max(l_tax) > 0.04 AS passes FROM lineitem GROUP BY 1")
def direction_and_comparison(spark, d):
    top = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_tax").alias("v"))
    return top.select("key", ranking.directed(F.col("v"), "descending").alias("down"), ranking.directed(F.col("v"), "ascending").alias("up"), ranking.passes(F.col("v"), "gt", 0.04).alias("passes"))


# ---- workflow


STATES = "CASE WHEN s_suppkey % 10 = 0 THEN 'FAILED' WHEN s_suppkey % 7 = 0 THEN 'SKIPPED' WHEN s_suppkey % 3 = 0 THEN 'BLOCKED' ELSE 'SUCCEEDED' END"


@query(f"""WITH RECURSIVE n AS (SELECT s_suppkey AS k, {STATES} AS state FROM supplier),
       e AS (SELECT a.k AS before, b.k AS after FROM n a JOIN n b ON b.k = a.k * 2 OR b.k = a.k * 2 + 1),
       r AS (SELECT k FROM n WHERE state = 'FAILED' UNION SELECT after FROM r JOIN e ON before = r.k)
       SELECT k AS node, CASE WHEN state = 'FAILED' THEN 'READY' WHEN k IN (SELECT k FROM r) AND state IN ('SUCCEEDED', 'BLOCKED') THEN 'PENDING' ELSE state END AS state FROM n""")
def retry_scope(spark, d):
    """Suppliers as nodes of a binary tree; failed ones are retried with all that follows."""
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.expr(STATES).alias("state"))
    edges = nodes.select(F.col("node").alias("before"), F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("after")).join(nodes.select(F.col("node").alias("after")), "after", "left_semi")
    return workflow.retry_scope(nodes, written(edges.select("before", "after"), "tree"))


@query("SELECT o_custkey AS node, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1")
def latest_state(spark, d):
    return workflow.latest(named(spark, d, "orders", node="o_custkey", state="o_orderstatus", at="o_orderdate", key="o_orderkey"), "node", "state", "at", "key")
