"""Queries over the driver's tables, one or more for each group of operators.

Roles: a supplier stands for a drug or candidate, a part for a target, an order line for a drug-target edge, words of a
part's type for substructures, a customer for a compound, return flags R and N for disease and control, the remainder of
an order's key by five for a training seed, and the event table for a workflow's log. In the inference the targets are
nation, priority and return flag of who bought from the supplier, the substructures brand and size of the parts that it
supplies, and the queries the types of parts. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import file_queries
from .functions import stats, text
from .operators import graph, inference, knowledge, mapping, ranking, signal
from .operators.proximity import proximity_z
from .plans import workflow
from .sources.delimited import manifest_check
from .sources.tables import steps, table, written
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- evidence streams


def line_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def seed_rankings(spark: SparkSession, d: str) -> DataFrame:
    """(seed, node_id, rank, score): suppliers by revenue within each fifth of the orders."""
    scored = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("seed"), F.col("l_suppkey").alias("node_id")).agg(F.round(F.sum(revenue()), 2).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "node_id")))


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    rows = knowledge.seed_ensemble(seed_rankings(spark, d), (20, 50))
    return rows.withColumns({c: r6(F.col(c)) for c in ("rank_mean", "rank_median", "rank_std", "score_mean", "score_std", "top20_freq", "top50_freq")})


def proximity(spark: SparkSession, d: str) -> DataFrame:
    """(compound_id, z): each supplier's mean discount against that of all suppliers."""
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("compound_id")).agg(F.avg("l_discount").alias("m"))
    both = own.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    return own.crossJoin(F.broadcast(both)).select("compound_id", r6(stats.zscore(F.col("m"), F.col("mean"), F.col("sd"))).alias("z"))  # one row


def signature(spark: SparkSession, d: str) -> DataFrame:
    """(compound_id, gps): change of the log quantity from not returned to returned lines."""
    logs = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "N")).withColumn("x", F.log2(F.col("l_quantity") + 1))
    mean = lambda g: F.avg(F.when(F.col("l_returnflag") == g, F.col("x")))
    return logs.groupBy(F.col("l_suppkey").alias("compound_id")).agg(r6(mean("R") - mean("N")).alias("gps"))


def selected(spark: SparkSession, d: str) -> DataFrame:
    return ranking.selection(ensemble(spark, d), 200).select(F.col("node_id").alias("compound_id"), "position")


@query
def consensus_two_evidence(spark, d):
    out = ranking.consensus(selected(spark, d), [(proximity(spark, d), "z", "lt", 0.0)])
    return out.select("final_rank", "compound_id", "position", "z", r6("consensus").alias("consensus"))


@query
def consensus_three_evidence(spark, d):
    out = ranking.consensus(selected(spark, d), [(proximity(spark, d), "z", "lt", 0.0), (signature(spark, d), "gps", "lt", 0.0)])
    return out.select("final_rank", "compound_id", "position", "z", "gps", r6("consensus").alias("consensus"))


def named_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The ensemble with names and the compounds of each node: every supplier's own, and that of the supplier before it."""
    rows = ensemble(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("node_name")), "node_id")
    ids = F.filter(F.array(F.col("node_id").cast("string"), F.when(F.col("node_id") % 3 == 0, (F.col("node_id") - 1).cast("string"))), lambda x: x.isNotNull())
    return rows.withColumn("compound_ids", F.to_json(ids))


def evidence(spark: SparkSession, d: str) -> list[ranking.Evidence]:
    text_id = lambda df: df.withColumn("compound_id", F.col("compound_id").cast("string"))
    return [ranking.Evidence(text_id(proximity(spark, d)), "z"), ranking.Evidence(text_id(signature(spark, d)), "gps")]


@query
def stage_counts_funnel(spark, d):
    return ranking.funnel(named_ensemble(spark, d), *evidence(spark, d))


@query
def final_candidates(spark, d):
    rows = ranking.candidates(named_ensemble(spark, d), *evidence(spark, d))
    return rows.withColumns({c: r6(c) for c in ("consensus_rank_percentile_mean", "kg_rank_mean", "kg_score_mean", "proximity_z", "gps_score")})


@query
def min_rank_percentile_desc(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    return ranking.percentile(rows, "p_size", "percentile", ascending=False).select("p_partkey", "p_size", r6("percentile").alias("percentile"))


@query
def topn_select_then_expand(spark, d):
    top = ranking.selection(ensemble(spark, d), 50).select("node_id", "position")
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), "l_partkey")
    rows = lines.join(F.broadcast(top), "node_id").select("l_partkey", "position", "node_id")  # 50 rows
    return ranking.first_wins(rows, ["l_partkey"], F.col("position"), F.col("node_id"))


@query
def ensemble_seed_aggregate(spark, d):
    return ensemble(spark, d).drop("top20_freq", "top50_freq")


@query
def ensemble_top_freq(spark, d):
    return ensemble(spark, d).select("node_id", "top20_freq", "top50_freq")


@query
def ensemble_incomplete_seeds(spark, d):
    orders = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("seed"), F.col("o_custkey").alias("node_id")).distinct()
    return knowledge.incomplete(orders, 5)


# ---- windows and dedup


@query
def first_wins_dedup(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return ranking.first_wins(rows, ["l_suppkey", "l_partkey"], F.col("l_orderkey"), F.col("l_linenumber"))


@query
def last_wins_dedup(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.first_wins(rows, ["o_custkey"], -F.col("o_orderkey"))


@query
def duplicate_id_count(spark, d):
    rows = table(spark, d, "part")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("p_name"))).where("n > 1").select("p_partkey", "p_name", "n")


def target_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_linenumber", "l_orderkey")
    known = F.col("l_returnflag") == "A"
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.select(
        F.col("l_suppkey").alias("compound_id"), F.col("l_partkey").alias("uniprot_id"), F.when(known, "known").otherwise("predicted").alias("evidence"), F.when(~known, F.col("l_linenumber")).alias("prediction_rank"), order.alias("_ord")
    )


@query
def known_first_targets(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("uniprot_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("gene_symbol"))
    rows = inference.known_first(target_rows(spark, d).withColumn("uniprot_id", F.col("uniprot_id").cast("string")), names.withColumn("uniprot_id", F.col("uniprot_id").cast("string")), 3)
    return rows.select("compound_id", "position", "gene_symbol", "evidence")


# ---- mapping and rejects


def dictionaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a dictionary: the name is the symbol, the words of the type are synonyms."""
    info = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("GeneID"), F.col("p_name").alias("Symbol"), F.regexp_replace("p_type", " ", "|").alias("Synonyms"), F.col("p_partkey").alias("_ord"))
    return mapping.gene_dictionary(info)


def symbol_records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    symbol = F.when(F.col("l_orderkey") % 3 == 0, F.upper("p_name")).when(F.col("l_orderkey") % 3 == 1, F.col("p_brand")).otherwise(F.lower(F.split("p_type", " ")[0]))
    given = F.when(F.col("l_orderkey") % 4 == 0, (F.col("p_partkey") + F.col("l_orderkey") % 8).cast("string"))
    return lines.select(line_id().alias("_ord"), F.when(F.col("l_linenumber") != 7, symbol).alias("symbol"), given.alias("given_id"))


@query
def map_symbol_synonym(spark, d):
    good, bad = mapping.map_symbols(symbol_records(spark, d), *dictionaries(spark, d))
    own = good.select(F.col("entrez_id").alias("value"), F.lit("mapped").alias("reason"), F.col("_ord").alias("ord"), "symbol", "source")
    return own.unionByName(bad.select(F.col("input_value").alias("value"), "reason", F.col("_ord").alias("ord")), allowMissingColumns=True)


@query
def reason_histogram(spark, d):
    _, bad = mapping.map_symbols(symbol_records(spark, d), *dictionaries(spark, d))
    return mapping.reason_histogram(bad)


@query
def unmapped_report(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey")
    known = table(spark, d, "part").where("p_size <= 48").select(F.col("p_partkey").alias("key"))
    return mapping.unmatched(lines, known, "key", "l_suppkey")


@query
def valid_reject_split(spark, d):
    docs = table(spark, d, "documents")
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.length("text") < 100, "short").when(F.col("text").contains("|"), "table")
    good, bad = mapping.split_valid(docs.select("doc_id", "lang", "text"), reason)
    return good.groupBy("lang").agg(F.count("*").alias("n")).withColumn("reason", F.lit("valid")).unionByName(bad.groupBy("lang", "reason").agg(F.count("*").alias("n")))


@query
def unique_structure_match(spark, d):
    part = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_size").alias("key"), F.col("p_partkey").alias("matched_id"))
    asked = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(line_id().alias("line"), F.concat_ws("/", "p_type", "p_size").alias("key"))
    return mapping.unique_match(asked, part, "key", "matched_id").select("line", "key", "matched_id")


@query
def key_set_equality(spark, d):
    a = table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return mapping.same_keys(a, b, "key")


@query
def source_tag_extract(spark, d):
    tags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.when(F.col("l_linenumber") == 2, "Other:").otherwise("UserLibrary:"), F.col("l_suppkey").cast("string")))), ";").alias("source_ids"))
    return tags.select("l_orderkey", F.array_join(text.tagged(F.col("source_ids"), "UserLibrary"), ",").alias("members"), text.union_of_tags(F.col("source_ids"), F.lit("Other:0; ;Base:1"), F.col("source_ids")).alias("merged"))


# ---- graphs


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    """(u, v): suppliers as negative and parts as positive numbers."""
    lines = table(spark, d, "lineitem").select((-1 - F.col("l_suppkey")).alias("a"), F.col("l_partkey").alias("b"))
    return graph.simple_edges(lines, "a", "b")


@query
def undirected_simple_graph(spark, d):
    return edges_of(spark, d)


@query
def node_degree(spark, d):
    return graph.degrees(edges_of(spark, d))


def part_degrees(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return pairs.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("degree"))


@query
def degree_bins(spark, d):
    return graph.degree_bins(part_degrees(spark, d).groupBy("degree").agg(F.count("*").alias("nodes")), 100)


@query
def degree_bin_membership(spark, d):
    own = part_degrees(spark, d)
    bins = graph.degree_bins(own.groupBy("degree").agg(F.count("*").alias("nodes")), 100)
    return graph.in_bin(own, bins)


@query
def connected_components(spark, d):
    return graph.components(edges_of(spark, d))


@query
def largest_component(spark, d):
    return graph.largest_component(graph.components(edges_of(spark, d)))


def sources_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 50 = 1").select((-1 - F.col("s_suppkey")).alias("node"))


@query
def multi_source_bfs(spark, d):
    edges = edges_of(spark, d)
    inside = sources_of(spark, d).join(graph.degrees(edges), "node", "left_semi")
    return graph.distances(edges, inside)


@query
def mean_set_distance(spark, d):
    steps = multi_source_bfs(spark, d).withColumnRenamed("node", "key")
    sets = table(spark, d, "part").select("p_size", F.col("p_partkey").alias("key"))
    return sets.join(steps, "key").groupBy("p_size").agg(r6(F.avg("distance")).alias("mean_distance"), F.count("*").alias("n"))


@query
def degree_matched_z(spark, d):
    with steps() as keep:
        edges = written(edges_of(spark, d), "edges")
        inside = graph.largest_component(graph.components(edges))
        kept = written(edges.join(inside.withColumnRenamed("node", "u"), "u", "left_semi"), "kept")
        sets = table(spark, d, "part").select(F.col("p_size").alias("set_id"), F.col("p_partkey").alias("node"))
        found = keep(proximity_z(kept, sources_of(spark, d), sets, 100, 1000, 452456))
    return found.withColumns({c: r6(c) for c in ("mean_distance", "z")})


# ---- network inference


def drug_sub(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.concat(F.lit("D"), F.col("l_suppkey")).alias("drug"), F.concat(F.lit("S"), F.col("p_brand"), F.lit("|"), F.col("p_size")).alias("sub")).distinct()


def drug_target(spark: SparkSession, d: str) -> DataFrame:
    """(drug, target, weight): the quantity that a group of buyers has from a supplier."""
    buyers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "o_orderpriority")
    lines = table(spark, d, "lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    target = F.concat(F.lit("T"), F.col("c_nationkey"), F.lit("|"), F.col("o_orderpriority"), F.lit("|"), F.col("l_returnflag"))
    return lines.groupBy(F.concat(F.lit("D"), F.col("l_suppkey")).alias("drug"), target.alias("target")).agg(F.sum("l_quantity").alias("weight"))


def query_sub(spark: SparkSession, d: str) -> DataFrame:
    """Types of parts with the brand and size of their parts, and one substructure that no drug has."""
    part = table(spark, d, "part")
    own = part.select(F.concat(F.lit("Q"), F.col("p_type")).alias("query"), F.concat(F.lit("S"), F.col("p_brand"), F.lit("|"), F.col("p_size")).alias("sub"))
    return own.union(part.select(F.concat(F.lit("Q"), F.col("p_type")), F.lit("none"))).distinct()


SETTINGS = inference.Settings()


def network_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both edge lists, written once."""
    return written(drug_sub(spark, d), "drug-sub"), written(drug_target(spark, d), "drug-target")


def moves(spark: SparkSession, d: str) -> DataFrame:
    return inference.transition(*network_of(spark, d), SETTINGS.beta, SETTINGS.gamma)


def two_step(spark: SparkSession, d: str) -> DataFrame:
    asked = query_sub(spark, d)
    none = asked.select("query", F.col("sub").alias("target")).limit(0)
    subs, targets = network_of(spark, d)
    steps = written(inference.transition(subs, targets, SETTINGS.beta, SETTINGS.gamma), "moves")
    return inference.reached(inference.seeds(asked, none, SETTINGS.alpha), steps, targets.select("drug").distinct(), targets.select("target").distinct(), SETTINGS.steps)


@query
def nbi_transition(spark, d):
    return moves(spark, d).select("src", "dst", F.round("p", 9).alias("p"))


@query
def nbi_two_step_scores(spark, d):
    return two_step(spark, d).withColumn("score", F.round("score", 9))


@query
def nbi_threshold_normalize(spark, d):
    targets = drug_target(spark, d).select("target").distinct()
    queries = query_sub(spark, d).select("query").distinct().withColumn("known", F.lit(0))
    rows = inference.threshold_normalised(written(two_step(spark, d), "scores"), queries, targets, SETTINGS.delta)
    return rows.select("query", "target", r6("normalised").alias("normalised"))


def similar(spark: SparkSession, d: str) -> DataFrame:
    return inference.tanimoto(query_sub(spark, d).select(F.col("query").alias("a"), F.col("sub").alias("item")), drug_sub(spark, d).select(F.col("drug").alias("b"), F.col("sub").alias("item")))


@query
def tanimoto_pairs(spark, d):
    return similar(spark, d).select("a", "b", "common", r6("similarity").alias("similarity"))


@query
def topk_neighbor_mean_weight(spark, d):
    targets = drug_target(spark, d)
    wanted = query_sub(spark, d).select("query").distinct().crossJoin(F.broadcast(targets.select("target").distinct()))  # groups of buyers are few at any size
    asked, subs = query_sub(spark, d), written(drug_sub(spark, d), "drug-sub")
    rows = inference.neighbour_weight(inference.represented(asked, subs), inference.sub_degree(asked), wanted, subs, targets, SETTINGS.epsilon)
    return rows.select("query", "target", r6("weight").alias("weight"))


@query
def nbi_predict_novel(spark, d):
    return inference.predict(query_sub(spark, d), *network_of(spark, d), SETTINGS).withColumn("score", r6("score"))


@query
def nbi_topn_excluding_known(spark, d):
    """Official drugs as queries: their known targets hold mass and are left out of the predictions."""
    subs, targets = network_of(spark, d)
    asked, known = inference.official_queries(subs, targets, subs.select("drug"))
    return inference.predict(asked, subs, targets, SETTINGS, known).withColumn("score", r6("score"))


@query
def nbi_known_rows(spark, d):
    targets = drug_target(spark, d)
    rows = inference.raw_rows(targets.limit(0).select(F.col("drug").alias("query"), "target", F.col("weight").alias("score"), F.lit(1).alias("rank")), "DRUG", inference.known_rows(targets, targets.select("drug")).withColumn("weight", F.col("weight") / 7))
    return rows.select("source_id", "uniprot_id", "score", "rank", F.col("_place").alias("place"))


# ---- differential signal


def part_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "N"))
    return rows.select(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("group"), F.col("l_quantity").alias("value"))


def welched(spark: SparkSession, d: str) -> DataFrame:
    logs = part_samples(spark, d).withColumn("x", F.log2(F.col("value") + 1))
    return stats.welch(stats.group_moments(logs, ["gene"], F.col("group"), F.col("x"), "N", "R"))


@query
def tpm_unpivot(spark, d):
    wide = table(spark, d, "lineitem").select(line_id().alias("gene"), "l_quantity", "l_extendedprice", "l_discount")
    return signal.long_form(wide, "gene", ["l_quantity", "l_extendedprice", "l_discount"])


@query
def welch_t_df(spark, d):
    return welched(spark, d).select("gene", "n_control", "n_disease", r6("t").alias("t"), r6("dof").alias("dof"))


@query
def welch_p(spark, d):
    return stats.with_p(welched(spark, d)).select("gene", r6("t").alias("t"), F.round("p", 9).alias("p"))


def surrogate(spark: SparkSession, d: str) -> DataFrame:
    rows = welched(spark, d).withColumn("p", r6(F.exp(-F.abs(F.coalesce("t", F.lit(0.0))) * 2))).withColumn("log2fc", r6(F.col("mean_disease") - F.col("mean_control")))
    return stats.bh_adjusted(rows, "p", "gene", "padj")


@query
def bh_adjust(spark, d):
    return surrogate(spark, d).select("gene", "p", r6("padj").alias("padj"))


@query
def deg_classify(spark, d):
    kept = part_samples(spark, d).groupBy("gene").agg(signal.expressed(F.col("value"), F.col("group"), 25.0, 0.5, "N", "R").alias("kept"))
    rows = written(surrogate(spark, d).drop("padj").join(kept, "gene"), "kept")
    adjusted = stats.bh_adjusted(rows.where("kept").select("gene", "p"), "p", "gene", "padj").select("gene", r6("padj").alias("padj"))
    rows = rows.join(adjusted, "gene", "left")
    return rows.select("gene", "log2fc", "kept", "padj", signal.regulation(F.col("log2fc"), F.col("padj"), 0.9, 0.05).alias("regulation"))


@query
def differential_table(spark, d):
    rows = signal.differential(part_samples(spark, d).withColumnRenamed("gene", "GeneID"), "GeneID", "N", "R", 25.0, 0.5, 0.05, 0.05)
    return rows.select("GeneID", r6("log2fc").alias("log2fc"), F.round("p", 9).alias("p"), F.round("padj", 9).alias("padj"), "pass_filter", "regulation")


@query
def deg_direction_consistent(spark, d):
    tables = []
    for status in ("year1", "year2"):
        lines = table(spark, d, "lineitem").where(F.col("l_orderkey") % 2 == (0 if status == "year1" else 1)).where(F.col("l_returnflag").isin("R", "N"))
        rows = lines.select(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("group"), F.log2(F.col("l_quantity") + 1).alias("x"))
        m = stats.group_moments(rows, ["gene"], F.col("group"), F.col("x"), "N", "R").withColumn("log2fc", r6(F.col("mean_disease") - F.col("mean_control")))
        m = m.withColumn("padj", F.abs("log2fc") / 10).withColumn("regulation", F.when(F.col("log2fc") > 0.05, "up").when(F.col("log2fc") < -0.05, "down").otherwise("not_sig"))
        tables.append(m.where("log2fc IS NOT NULL"))
    out = signal.consistent(tables, "gene")
    return out.select("gene", "n", "direction", "log2fc_mean", "abs_log2fc_mean", "padj_max")


@query
def profile_threshold_class(spark, d):
    share = lambda k: F.round(F.aggregate(F.filter("embedding", lambda x, i: i % 3 == k), F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return table(spark, d, "embeddings").select("vec_id", signal.effect_class(F.array(share(0), share(1), share(2)), 0.05).alias("effect"))


def profile_rows(spark: SparkSession, d: str) -> DataFrame:
    """(profile, position, gene): genes of each supplier in the order of their quantity."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("profile"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("q"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("q"), "gene")))


@query
def gsea_es(spark, d):
    return signal.enrichment(profile_rows(spark, d), "profile", "position", F.col("gene") % 13 == 0).select("profile", r6("es").alias("es"), "hits", "n")


@query
def reversal_score(spark, d):
    """Each set size has its own null of twenty draws, made by digests so that SQL draws the same."""
    rows = written(profile_rows(spark, d), "profiles")
    up, down = (written(signal.enrichment(rows, "profile", "position", F.col("gene") % 13 == k), "enrichment") for k in (0, 1))
    null = signal.digest_nulls(up.select("n", "hits").union(down.select("n", "hits")), 20)
    return signal.reversal(up, down, written(null, "nulls"), "profile").select("profile", r6("score").alias("score"))


# ---- knowledge graph


def kg_sources(spark: SparkSession, d: str) -> list[DataFrame]:
    lines = table(spark, d, "lineitem")
    base = lines.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("x_id"), F.lit("supplies").alias("relation"), F.concat(F.lit("p"), F.col("l_partkey")).alias("y_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_ord"))
    more = lines.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("x_id"), F.when(F.col("l_returnflag") == "R", "returns").otherwise("supplies").alias("relation"), F.concat(F.lit("p"), F.col("l_partkey")).alias("y_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_ord"))
    return [base, more]


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"), F.lit("drug").alias("node_type"), F.col("s_suppkey").alias("_ord"))
    p = table(spark, d, "part").where("p_size > 5").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node_id"), F.lit("protein").alias("node_type"), (F.col("p_partkey") + 10_000_000).alias("_ord"))
    return s.union(p)


@query
def kg_edge_union_first_wins(spark, d):
    return knowledge.union_edges(kg_sources(spark, d), kg_nodes(spark, d)).select("x_id", "relation", "y_id", "source", F.col("_ord").alias("ord"))


@query
def kg_node_index(spark, d):
    nodes = kg_nodes(spark, d)
    base = nodes.where("node_type = 'drug'")
    new = nodes.where("node_type = 'protein' OR _ord <= 3")
    return knowledge.node_index(base.select("node_id", "_ord"), new.select("node_id", "_ord"))


@query
def kg_type_local_index(spark, d):
    nodes = kg_nodes(spark, d).select("node_id", "node_type", F.col("_ord").alias("node_index"))
    return knowledge.type_index(nodes).select("node_id", "node_type", F.col("type_index").cast("int").alias("type_index"))


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    across = lines.select(F.lit("drug").alias("x_type"), F.col("l_suppkey").alias("x_index"), F.concat(F.lit("rel"), F.col("l_returnflag")).alias("relation"), F.lit("protein").alias("y_type"), F.col("l_partkey").alias("y_index"))
    within = lines.select(F.lit("protein").alias("x_type"), F.col("l_partkey").alias("x_index"), F.lit("ppi").alias("relation"), F.lit("protein").alias("y_type"), (F.col("l_partkey") * 7 % 1000).alias("y_index"))
    return across.union(within)


@query
def kg_canonicalize_undirected(spark, d):
    return knowledge.canonical(typed_edges(spark, d))


@query
def kg_relation_split(spark, d):
    edges = knowledge.canonical(typed_edges(spark, d))
    key = F.concat_ws("|", "x_type", "x_index", "relation", "y_type", "y_index")
    return knowledge.split(edges, key, F.col("x_index") % 17 == 0, 42, 0.05, 0.1)


@query
def kg_reverse_edges(spark, d):
    edges = knowledge.canonical(typed_edges(spark, d))
    key = F.concat_ws("|", "x_type", "x_index", "relation", "y_type", "y_index")
    return knowledge.with_reverse(knowledge.split(edges, key, F.col("x_index") % 17 == 0, 42, 0.05, 0.1))


@query
def kg_training_frames(spark, d):
    """From a graph with ids to directed edges with their split."""
    nodes = kg_nodes(spark, d).select("node_id", "node_type", F.col("_ord").alias("node_index"))
    kind = nodes.select(F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.col("node_index").alias("index"))
    side = lambda e: kind.select(*[F.col(c).alias(f"{e}_{c}") for c in ("id", "type", "index")])
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("x_id"), F.concat(F.lit("rel"), F.col("l_returnflag")).alias("relation"), F.concat(F.lit("p"), F.col("l_partkey")).alias("y_id"))
    within = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("x_id"), F.lit("ppi").alias("relation"), F.concat(F.lit("p"), F.col("l_partkey") * 7 % 1000 + 1).alias("y_id"))
    graph_rows = lines.union(within).distinct().join(side("x"), "x_id").join(side("y"), "y_id")  # an edge of many lines meets its nodes once
    _, _, directed = knowledge.training_frames(nodes, graph_rows, "none", 42, 0.05, 0.1)
    return directed.select("x_id", "x_idx", "relation", "y_id", "y_idx", "split")


@query
def negative_samples_fix_dst(spark, d):
    edges = typed_edges(spark, d).where("x_type = 'drug'").select(F.col("x_index").alias("src"), "relation", F.col("y_index").alias("dst")).distinct()
    return knowledge.negatives(edges, 7).drop("draw")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


@query
def distmult_score(spark, d):
    v = vectors(spark, d)
    relation = v.where("vec_id = 0").select(F.col("vec").alias("w"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("vec_v"))
    return v.join(other, "vec_id").crossJoin(F.broadcast(relation)).select("vec_id", F.round(knowledge.distmult(F.col("vec"), F.col("w"), F.col("vec_v")), 9).alias("score"))  # one row


@query
def rgcn_mean_aggregate(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.concat(F.lit("r"), F.col("l_linenumber") % 3).alias("relation"), F.col("l_suppkey").alias("dst")).distinct()
    return knowledge.mean_of_neighbours(edges, vectors(spark, d).select(F.col("vec_id").alias("node"), "vec")).select("dst", "relation", F.col("at").cast("int").alias("at"), r6("value").alias("value"))


def relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, vectors, weights): all lines as edges between the vectors' ids, the vectors' first four components, and maps by a rule."""
    n = table(spark, d, "embeddings").count()
    edges = table(spark, d, "lineitem").select((F.col("l_partkey") % n).alias("src"), F.concat(F.lit("r"), F.col("l_linenumber") % 3).alias("relation"), (F.col("l_suppkey") * 7 % n).alias("dst"))
    some = vectors(spark, d).select(F.col("vec_id").alias("node"), F.slice(F.col("vec").cast("array<double>"), 1, 4).alias("vec"))
    rows = []
    for k, other in enumerate(("r0", "r2", "r1")):
        matrix = [[((i * 3 + j * 5 + k) % 7 - 3) / 10 for j in range(4)] for i in range(4)]
        rows.append((f"r{k}", other, matrix, [(i + k) / 10 for i in range(4)], [((i + 2 * k) % 5 - 2) / 4 for i in range(4)], [((2 * i + k) % 5 - 2) / 4 for i in range(4)]))
    return edges, some, spark.createDataFrame(rows, "relation string, other string, matrix array<array<double>>, bias array<double>, from_source array<double>, from_destination array<double>")


def spelt(rows: DataFrame) -> DataFrame:
    return rows.select("node", F.posexplode("vec").alias("at", "value")).select("node", F.col("at").cast("int").alias("at"), r6("value").alias("value"))


@query
def relation_layer(spark, d):
    edges, some, weights = relations(spark, d)
    return spelt(knowledge.relation_layer(edges, some, weights.select("relation", "matrix", "bias"), 0.01))


@query
def attention_shares(spark, d):
    edges, some, weights = relations(spark, d)
    return knowledge.attention_shares(edges, some, weights).withColumn("share", r6("share"))


@query
def attention_layer(spark, d):
    edges, some, weights = relations(spark, d)
    return spelt(knowledge.attention_layer(edges, some, weights, rectified=0.01))


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 1000).alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query
def auroc_by_relation(spark, d):
    return stats.auroc(scored_labels(spark, d), "score", "label", ["lang"]).select("lang", r6("auroc").alias("auroc"), "n")


@query
def average_precision(spark, d):
    return stats.average_precision(scored_labels(spark, d), "score", "label", ["lang"]).select("lang", r6("average_precision").alias("average_precision"))


# ---- workflow


@query
def event_state_violations(spark, d):
    """Types of events as states of a node, held against the transitions that are allowed."""
    states = F.create_map(*[F.lit(x) for x in ("signup", "PENDING", "view", "READY", "click", "QUEUED", "purchase", "RUNNING", "error", "FAILED")])
    log = table(spark, d, "events").select("user_id", states[F.col("event_type")].alias("state"), "ts", "event_id")
    return workflow.violations(log, workflow.transitions_table(spark), "user_id", "state", "ts", "event_id").select("event_id", "user_id", "before", "after")


@query
def event_latest_status(spark, d):
    return workflow.latest(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query
def event_status_counts(spark, d):
    rows = stream.status_counts(table(spark, d, "events").select("event_type", "ts"), "1 day", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def dag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as nodes; each waits for those of half and of a third of its number, some of which are not there."""
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 5 == 0, "PENDING").when(F.col("o_orderkey") % 31 == 0, "FAILED").otherwise("SUCCEEDED").alias("state"))
    keys = nodes.select("node")
    waits = keys.select((F.col("node") / 2).cast("long").alias("before"), F.col("node").alias("after")).union(keys.select((F.col("node") / 3).cast("long").alias("before"), F.col("node").alias("after")))
    return nodes, waits.where("before > 0").distinct()


@query
def dag_ready_nodes(spark, d):
    return workflow.ready(*dag(spark, d))


@query
def dag_downstream(spark, d):
    nodes, edges = dag(spark, d)
    return workflow.downstream(edges, nodes.where("state = 'FAILED'").select("node"))


@query
def eta_interval(spark, d):
    history = table(spark, d, "events").select(F.col("event_type").alias("task"), F.col("value").alias("seconds"))
    remaining = spark.createDataFrame([("view",), ("click",), ("purchase",), ("archive",)], "task string")
    reference = spark.createDataFrame([("archive", 10.0, 20.0)], "task string, low double, high double")
    return workflow.eta(history, remaining, reference=reference).select("status", *[r6(c).alias(c) for c in ("low", "middle", "high")], "unknown")


@query
def eta_scale(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("expected"))
    return workflow.scale(pairs).select(r6("scale").alias("scale"))


@query
def run_status_rollup(spark, d):
    return workflow.rollup(table(spark, d, "events"), "user_id", "event_type", {"error": 5, "purchase": 4, "click": 3, "view": 2, "signup": 1})


@query
def run_status_by_user(spark, d):
    """Customers with their orders as nodes; those without money have asked to cancel."""
    states = F.create_map(*[F.lit(x) for x in ("F", "SUCCEEDED", "O", "READY", "P", "RUNNING")])
    orders = table(spark, d, "orders")
    state = F.when(F.col("o_orderkey") % 97 == 0, "FAILED").when(F.col("o_orderkey") % 89 == 0, "BLOCKED").otherwise(states[F.col("o_orderstatus")])
    asked = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return workflow.run_status(orders.select("o_custkey", state.alias("state")), "o_custkey", cancelled=asked)


@query
def run_progress(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("RUNNING").alias("state"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3 / 2).alias("progress"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"))
    return workflow.progress(rows).select("run", "total", "complete", "uncertain", "percent")


@query
def timing_summary(spark, d):
    rows = table(spark, d, "events")
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"), seconds.alias("wall_us"))


@query
def label_sets(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_shipdate").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.count("*").alias("n"))


@query
def manifest_digest_check(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    listed = table(spark, d, "documents").where("doc_id % 3 <> 1").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise(F.sha2("lang", 256)).alias("sha256"))
    return manifest_check(files, listed.union(spark.createDataFrame([("none", "0")], "name string, sha256 string")))


QUERIES.update(file_queries.QUERIES)
