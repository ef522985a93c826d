"""The steps of a run, from input files to files with their contracts, each committed by its result.

``RUNNERS`` maps each step to its function, or to another one that a caller registers; ``run`` takes a plan's nodes in
order. Paths are any that Spark reads.
"""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chem, text
from .operators import construct, graph, inference, knowledge, mapping, proximity, ranking, signal, training
from .plans import reuse, workflow
from .plans.config import Config, checked, document, frozen
from .plans.report import Result, candidate_count, commit, members, report, skip_summary, write_report
from .sources import delimited, resources, rules
from .sources.delimited import ContractError, read_json, registered, write_json, write_matrix, write_one_file
from .sources.tables import written


@dataclass
class Context:
    """A run's folder, its inputs (key to path), its resources, its configuration, and the chemistry and profile models it uses.

    ``cache``: a folder that runs share, where results are found again; the run's own if it is empty.
    """

    spark: SparkSession
    run: str
    inputs: dict[str, str]
    resources: dict[str, str]
    config: Config = Config()
    disease: construct.Disease = construct.Disease("disease", "disease", "disease:custom")
    chemistry: Callable[[], chem.Provider] = chem.provider
    code: str = ""
    cache: str = ""
    digests: dict[str, dict[str, str]] = dataclasses.field(default_factory=dict)
    clock: Callable[[], str] = lambda: datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    def at(self, name: str) -> str:
        return f"{self.run}/artifacts/{name}"

    @property
    def remembered(self) -> str:
        return self.cache or f"{self.run}/artifacts/cache"

    def contents(self) -> dict[str, dict[str, str]]:
        """The digests of inputs and resources, taken once."""
        if not self.digests:
            self.digests.update(inputs=reuse.contents(self.spark, self.inputs), resources=reuse.contents(self.spark, self.resources))
        return self.digests

    def registered(self, key: str) -> str:
        return f"{self.run}/inputs/original/{self.inputs[key].rsplit('/', 1)[-1]}"


Runner = Callable[[Context, str], tuple[dict[str, str], dict[str, object]]]
RUNNERS: dict[str, Runner] = {}


def runner(f: Runner) -> Runner:
    RUNNERS[f.__name__] = f
    return f


@runner
def create_run_workspace(c: Context, task: str):
    """The run's folder; one that is there already is another run's."""
    path, files = delimited.hadoop(c.spark, f"{c.run}/run.json")
    if files.exists(path):
        raise ContractError("the run's folder is in use")
    write_json(c.spark, {"run": c.run.rsplit("/", 1)[-1], "created_at": c.clock(), "config": document(checked(c.config))}, f"{c.run}/run.json")
    return {}, {}


@runner
def register_inputs(c: Context, task: str):
    rows = registered(c.spark, [{"input_key": k, "path": p, "source": "upload"} for k, p in sorted(c.inputs.items())], f"{c.run}/inputs/original", c.clock())
    out = c.at("inputs/registry.json")
    write_json(c.spark, rows, out)
    return {"input_registry": out}, {"input_count": len(rows)}


@runner
def prepare_compound_library(c: Context, task: str):
    rows = resources.compound_library(c.spark, c.registered("compound_library"))
    canonical = chem.column(c.chemistry, "canonical", "string")
    rows = written(rows.withColumn("_canonical", canonical(F.col("SMILES"))), "library")
    reason = F.when(F.col("SMILES") == "", "empty_smiles").when(F.col("_canonical").isNull(), "rdkit_parse_failed")
    good, bad = mapping.split_valid(rows, reason)
    n_good, n_bad = good.count(), bad.count()
    if not n_good:
        raise ContractError("the library has no valid structure")
    paths = {"compounds_normalized": c.at("input_prepare/compounds.normalized.csv"), "invalid_smiles": c.at("input_prepare/invalid_smiles.tsv")}
    columns = ["ID", "SMILES", *[x for x in rows.columns if x not in ("ID", "SMILES", "_ord", "_canonical")]]
    write_one_file(good.orderBy("_ord"), paths["compounds_normalized"], tuple(columns))
    write_one_file(bad.orderBy("_ord"), paths["invalid_smiles"], ("ID", "SMILES", "reason"))
    return paths, {"input_count": n_good + n_bad, "valid_count": n_good, "invalid_count": n_bad, "additional_column_count": len(columns) - 2}


@runner
def prepare_disease_genes(c: Context, task: str):
    good, bad = mapping.map_symbols(resources.gene_list(c.spark, c.registered("disease_genes")), *mapping.gene_dictionary(resources.gene_info(c.spark, c.resources["gene_info"])))
    good, bad = written(good, "genes"), written(bad, "unmapped")
    n_good = good.count()
    paths = {"disease_genes_normalized": c.at("input_prepare/disease_genes.normalized.tsv"), "unmapped_genes": c.at("input_prepare/unmapped_genes.tsv")}
    write_one_file(bad.orderBy("_ord"), paths["unmapped_genes"], ("input_value", "reason"))
    if not n_good:
        raise ContractError("no gene of the list maps to an id")
    write_one_file(good.orderBy("_ord"), paths["disease_genes_normalized"], ("symbol", "entrez_id"))
    return paths, {"mapped_count": n_good, "unmapped_count": bad.count()}


@runner
def import_drug_targets(c: Context, task: str):
    own = resources.provided_mapping(c.spark, c.registered("target_mapping"))
    compounds = delimited.read_table(c.spark, c.at("input_prepare/compounds.normalized.csv"), ("ID", "SMILES"))
    rows = written(delimited.provided_targets(c.spark, c.registered("drug_targets"), compounds, own), "targets")
    paths = {"drug_targets": c.at("targets/drug_targets.parquet"), "target_mapping": c.at("targets/target_mapping.tsv")}
    write_matrix(rows.withColumn("place", F.col("position") + 1), paths["drug_targets"])
    write_one_file(own.orderBy("gene_symbol"), paths["target_mapping"], ("gene_symbol", "entrez_id"))
    return paths, {"target_count": rows.count(), "mapping_count": own.count(), "target_source": "provided"}


@runner
def prepare_expression_inputs(c: Context, task: str):
    names = {c.registered(k).rsplit("/", 1)[-1]: c.registered(k) for k in c.inputs if k.startswith("expression")}
    out = []
    for name, tpm, metadata in resources.expression_pairs(list(names)):
        groups = resources.sample_table(c.spark, names[metadata])
        counts = {r.group: r["count"] for r in groups.groupBy("group").count().collect()}  # two rows
        out.append({"comparison_id": name, "tpm_path": names[tpm], "metadata_path": names[metadata], "sample_counts": {"total": sum(counts.values()), **counts}, "sha256": {"tpm": delimited.streamed_digest(c.spark, names[tpm]), "metadata": delimited.streamed_digest(c.spark, names[metadata])}})
    path = c.at("input_prepare/expression_comparisons.json")
    write_json(c.spark, {"schema_version": "1.0", "comparisons": out}, path)
    return {"expression_comparisons_manifest": path}, {"comparison_count": len(out)}


@runner
def gps_predict_drug_profiles(c: Context, task: str):
    """Profiles by the model of the resources, or the precomputed table that they name."""
    path = c.at("gps/profiles.parquet")
    if "profiles" in c.resources:
        rows = resources.long_profiles(c.spark, c.resources["profiles"])
    else:
        import io

        import numpy as np

        content = bytes(c.spark.read.format("binaryFile").load(c.resources["profile_model"]).first().content)
        with np.load(io.BytesIO(content), allow_pickle=False) as arrays:  # plain arrays only, never code
            lines = sorted({k.split("/")[0] for k in arrays.files})
            model = signal.ProfileModel({x: [(arrays[f"{x}/w{i}"], arrays[f"{x}/b{i}"]) for i in range(sum(k.startswith(f"{x}/w") for k in arrays.files))] for x in lines})
        features = {r.gene: np.asarray(r.features) for r in resources.feature_table(c.spark, c.resources["gene_features"]).collect()}  # one row per gene
        bits = chem.column(c.chemistry, "bits", "array<int>")
        compounds = delimited.read_table(c.spark, c.at("input_prepare/compounds.normalized.csv"), ("ID", "SMILES")).select(F.col("ID").alias("compound"), bits(F.col("SMILES")).alias("fingerprint")).where("fingerprint IS NOT NULL")
        rows = signal.predicted_profiles(compounds, features, model, c.config.resources.get("cell_line", lines[0]), c.config.signature.threshold).withColumn("_ord", F.lit(0).cast("long"))
    write_matrix(rows.select("compound", "gene", F.col("effect").cast("int").alias("effect"), "_ord"), path)
    return {"gps_drug_profiles": path}, {"compound_count": c.spark.read.parquet(path).select("compound").distinct().count()}


@runner
def gps_build_disease_signature(c: Context, task: str):
    s, spark = c.config.signature, c.spark
    listed = read_json(spark, c.at("input_prepare/expression_comparisons.json"))["comparisons"]
    for x in listed:
        for kind in ("tpm", "metadata"):
            if delimited.streamed_digest(spark, x[f"{kind}_path"]) != x["sha256"][kind]:
                raise ContractError(f"{x[f'{kind}_path']} has changed since it was listed")
    comparisons = [(x["comparison_id"], resources.expression(spark, x["tpm_path"], x["metadata_path"])) for x in listed]
    core = written(signal.combined(comparisons, "control", "disease", s.floor, s.share, s.fdr, s.change), "core")
    dictionary = mapping.first_win_dictionary(resources.gene_info(spark, c.resources["gene_info"]))
    profiles, counts = signal.profile_ids(spark.read.parquet(c.at("gps/profiles.parquet")), dictionary)
    paths = {"gps_drug_profiles_entrez": c.at("gps/profiles.entrez.parquet"), "gps_disease_signature": c.at("gps/Disease_GPS.csv")}
    write_matrix(profiles, paths["gps_drug_profiles_entrez"])
    found = written(signal.disease_signature(core, spark.read.parquet(paths["gps_drug_profiles_entrez"])), "signature")
    n = found.count()
    if not n:
        raise ContractError("the consistent genes and the profiles have no gene in common")
    write_one_file(found.orderBy("disease_log2FC_mean", "GeneID"), paths["gps_disease_signature"], ("GeneID", "disease_log2FC_mean", "disease_direction"))
    return paths, {"comparison_count": len(listed), "direction_consistent_deg_count": core.count(), "disease_profile_gene_count": n, **counts}


@runner
def gps_score_compounds(c: Context, task: str):
    own = delimited.read_table(c.spark, c.at("gps/Disease_GPS.csv")).select("GeneID", F.col("disease_log2FC_mean").cast("double").alias("disease_log2FC_mean"))
    scores = signal.scored_profiles(c.spark.read.parquet(c.at("gps/profiles.entrez.parquet")), own, c.config.signature.null_draws, c.config.signature.seed)
    scores = written(scores.withColumnRenamed("score", "GPS_score_zRGES_like_lower_better"), "scores")
    path = c.at("gps/scores.csv")
    write_one_file(scores.orderBy("GPS_score_zRGES_like_lower_better", "ID"), path, ("ID", "GPS_score_zRGES_like_lower_better"))
    return {"gps_scores": path}, {"compound_count": scores.count()}


@runner
def netinfer_prepare_inputs(c: Context, task: str):
    frozen(c.config.inference)
    key = chem.column(c.chemistry, "match_key", "string")
    compounds = delimited.with_order(delimited.read_table(c.spark, c.at("input_prepare/compounds.normalized.csv"), ("ID", "SMILES"))).select("_ord", "ID", "SMILES").withColumn("match_key", F.coalesce(key(F.col("SMILES")), F.lit("")))
    official = resources.official_drugs(c.spark, c.resources["workbook"], key)
    rows = written(inference.structure_queries(compounds, official), "mapping")
    novel = inference.batches(rows.where("netinfer_input_type = 'COMPOUND' AND match_key <> ''").select("ID", "_ord"), "_ord", c.config.batch).select("ID", "batch_id")
    rows = written(rows.join(novel, "ID", "left").withColumn("batch_id", F.coalesce("batch_id", F.lit(""))), "mapping")
    paths = {"netinfer_input_mapping": c.at("netinfer/input_mapping.tsv"), "netinfer_target_map": c.at("netinfer/target_map.tsv"), "netinfer_batch_input": c.at("netinfer/batches.parquet")}
    columns = ("ID", "SMILES", "match_key", "official_drug_id", "netinfer_input_type", "netinfer_input_id", "batch_id")
    if rows.where(~inference.consistent_mapping(rows)).limit(1).count():
        raise ContractError("a row of the mapping breaks its rules")
    write_one_file(rows.orderBy("_ord"), paths["netinfer_input_mapping"], columns)
    write_one_file(resources.official_targets(c.spark, c.resources["workbook"]).orderBy("uniprot_id"), paths["netinfer_target_map"], ("uniprot_id", "gene_symbol", "entrez_id"))
    edges = chem.substructure_edges(rows.where("batch_id <> ''"), c.chemistry).join(novel.withColumnRenamed("ID", "compound"), "compound")
    write_matrix(edges, paths["netinfer_batch_input"])
    batch = rows.where("batch_id <> ''").groupBy("batch_id").agg(F.count("*").alias("compound_count")).orderBy("batch_id")
    listed = [{"batch_id": r.batch_id, "compound_count": r.compound_count} for r in batch.collect()]  # one row per batch
    paths["netinfer_batch_manifest"] = c.at("netinfer/batch_manifest.json")
    write_json(c.spark, {"schema_version": "1.0", "batch_size": c.config.batch, "batch_count": len(listed), "batches": listed}, paths["netinfer_batch_manifest"])
    return paths, {"batch_count": len(listed), "standardization_failed_count": rows.where("match_key = ''").count()}


def networks(c: Context) -> tuple[DataFrame, DataFrame]:
    """(drug_sub, drug_target) of the resources; of repeated pairs the last row counts."""

    def last(path: str, kind: str, name: str) -> DataFrame:
        rows = delimited.with_order(delimited.edge_file(c.spark, path, ("DRUG", kind)))
        return rows.groupBy(F.col("source_id").alias("drug"), F.col("target_id").alias(name)).agg(F.max_by("weight", "_ord").alias("weight"))

    return last(c.resources["drug_substructures"], "SUB", "sub").select("drug", "sub"), last(c.resources["drug_targets"], "TARGET", "target")


PREDICTIONS = "source_type string, source_id string, target_type string, uniprot_id string, score string, rank string, _kind int, _place int, batch_id string"


@runner
def netinfer_predict_known(c: Context, task: str):
    subs, targets = networks(c)
    drugs = delimited.read_table(c.spark, c.at("netinfer/input_mapping.tsv")).where("netinfer_input_type = 'DRUG'").select(F.col("netinfer_input_id").alias("drug")).distinct()
    asked, known = inference.official_queries(subs, targets, drugs)
    rows = inference.raw_rows(inference.predict(asked, subs, targets, c.config.inference, known), "DRUG", inference.known_rows(targets, drugs))
    path = c.at("netinfer/known.parquet")
    write_matrix(rows, path)
    return {"netinfer_known_predictions": path}, {"prediction_row_count": c.spark.read.parquet(path).count()}


def batch_members(c: Context) -> DataFrame:
    """(batch_id, compound) of the mapping's compounds that belong to a batch."""
    return delimited.read_table(c.spark, c.at("netinfer/input_mapping.tsv")).where("batch_id <> ''").select("batch_id", F.col("netinfer_input_id").alias("compound"))


def predicted_batches(c: Context) -> str:
    """The place of all batches' predictions, one folder for each; the first batch that is asked for makes them in one job.

    The batches' input must name just the compounds of the mapping, each in its batch, and the predictions no others.
    """
    own = {"settings": document(c.config.inference), "batches": [f["sha256"] for f in members(c.spark, c.at("netinfer/batches.parquet"))], "resources": c.contents()["resources"]}
    path = c.at(f"netinfer/predictions-{text.digest(own)[:16]}.parquet")
    if delimited.exists(c.spark, path):
        return path
    subs, targets = networks(c)
    asked, given = batch_members(c), c.spark.read.parquet(c.at("netinfer/batches.parquet")).select("batch_id", "compound", "sub")
    rules.same_members(given.select("batch_id", "compound"), asked, "batch_id", "compound", names=("the batches' input", "the mapping"), repeated=True)
    raw = inference.raw_rows(inference.predict(given.select(F.col("compound").alias("query"), "sub"), subs, targets, c.config.inference), "COMPOUND")
    rows = raw.join(asked.withColumnRenamed("compound", "source_id"), "source_id", "left")
    kept = [rules.Rule("a source that no batch has", F.col("batch_id").isNull()), rules.Rule("a score that is no positive number", ~F.coalesce(F.expr("try_cast(score AS double)") > 0, F.lit(False)))]
    rules.write_checked(rows.select(*raw.columns, "batch_id"), path, kept, "source_id", "batch_id")
    return path


@runner
def netinfer_predict_batch(c: Context, task: str):
    """One batch of those that are predicted together; a compound without substructures that the graph has gets no row and does not fail its batch."""
    path = predicted_batches(c)
    if not batch_members(c).where(F.col("batch_id") == task).limit(1).count():
        raise ContractError(f"there is no batch {task}")
    own = f"{path}/batch_id={task}"
    if not delimited.exists(c.spark, own):  # none of its compounds has a prediction
        write_matrix(c.spark.createDataFrame([], PREDICTIONS).drop("batch_id"), own)
    return {"netinfer_batch_predictions": own}, {"prediction_row_count": c.spark.read.parquet(own).count()}


@runner
def netinfer_merge_targets(c: Context, task: str):
    own = delimited.read_table(c.spark, c.at("netinfer/input_mapping.tsv")).drop("_broken")
    listed = [b["batch_id"] for b in read_json(c.spark, c.at("netinfer/batch_manifest.json"))["batches"]]
    raw = c.spark.read.parquet(c.at("netinfer/known.parquet")).withColumn("batch_id", F.lit(None).cast("string"))
    if listed:
        raw = raw.unionByName(c.spark.read.schema(PREDICTIONS).parquet(predicted_batches(c)))
    raw = raw.withColumn("_part", F.coalesce(F.regexp_extract("batch_id", r"(\d+)$", 1).cast("long"), F.lit(0)))
    asked = own.select(F.col("netinfer_input_type").alias("source_type"), F.col("netinfer_input_id").alias("source_id"), F.lit(True).alias("_asked")).distinct()
    wrong = rules.judged(raw.join(asked, ["source_type", "source_id"], "left"), [rules.Rule("a target_type that is not TARGET", F.col("target_type") != "TARGET"), rules.Rule("a source that was not asked for", F.col("_asked").isNull())], "source_id")
    if not wrong:
        raise ContractError(wrong.told())
    known = F.lower(F.trim("rank")).isin("-", "known")
    raw = raw.select("source_type", "source_id", "uniprot_id", F.expr("try_cast(score AS double)").alias("score"), F.when(known, "known").otherwise("predicted").alias("evidence"), F.when(~known, F.expr("try_cast(rank AS int)")).alias("prediction_rank"), (F.col("_part") * 1e9 + F.col("_kind") * 1e6 + F.col("_place")).alias("_ord"))
    names = delimited.read_table(c.spark, c.at("netinfer/target_map.tsv")).select("uniprot_id", "gene_symbol")
    targets, missing = inference.merged_targets(own, raw, names, c.config.inference.most)
    paths = {"drug_targets": c.at("netinfer/drug_targets.parquet"), "missing_predictions": c.at("netinfer/missing_predictions.tsv")}
    write_matrix(targets.select("compound_id", F.col("SMILES").alias("smiles"), F.col("position"), "gene_symbol", "uniprot_id", "evidence", "score", "prediction_rank", F.col("position").alias("place")), paths["drug_targets"])
    write_one_file(missing.orderBy("ID"), paths["missing_predictions"], ("ID", "reason"))
    return paths, {"compounds_with_targets": c.spark.read.parquet(paths["drug_targets"]).select("compound_id").distinct().count()}


def targets_of(c: Context) -> tuple[DataFrame, DataFrame]:
    """(targets, mapping (gene_symbol, entrez_id)) that the run has: given or inferred."""
    if "drug_targets" in c.inputs:
        return c.spark.read.parquet(c.at("targets/drug_targets.parquet")), resources.target_mapping(c.spark, c.at("targets/target_mapping.tsv"))
    return c.spark.read.parquet(c.at("netinfer/drug_targets.parquet")), resources.target_mapping(c.spark, c.at("netinfer/target_map.tsv"))


@runner
def proximity_prepare_network(c: Context, task: str):
    edges = graph.interactions(delimited.read_table(c.spark, c.resources["interactions"]).drop("_broken"))
    inside = written(graph.largest_component(graph.components(edges)), "inside")
    kept = written(edges.join(inside.withColumnRenamed("node", "u"), "u", "left_semi"), "network")
    genes = resources.disease_genes(c.spark, c.at("input_prepare/disease_genes.normalized.tsv")).select(F.col("entrez_id").alias("node")).join(inside, "node", "left_semi")
    targets, own = targets_of(c)
    met, unmapped = mapping.by_symbol(targets, own, "compound_id")
    sets = met.select(F.col("compound_id").alias("set_id"), F.col("entrez_id").alias("node")).join(inside, "node", "left_semi").select("set_id", "node").distinct()
    sets = written(sets, "sets")
    asked = delimited.read_table(c.spark, c.at("input_prepare/compounds.normalized.csv"), ("ID",)).select("ID")
    reason = F.when(F.col("_n").isNull(), "no_targets").otherwise("no_targets_in_network")
    skipped = asked.join(sets.select(F.col("set_id").alias("ID")).distinct(), "ID", "left_anti").join(targets.groupBy(F.col("compound_id").alias("ID")).agg(F.count("*").alias("_n")), "ID", "left").select("ID", reason.alias("reason"))
    paths = {"proximity_network": c.at("proximity/network.parquet"), "proximity_module": c.at("proximity/module.parquet"), "proximity_targets": c.at("proximity/targets.parquet"), "proximity_skipped_compounds": c.at("proximity/skipped_compounds.tsv"), "proximity_unmapped_targets": c.at("proximity/unmapped_targets.tsv")}
    for name, df in (("proximity_network", kept), ("proximity_module", genes), ("proximity_targets", sets)):
        write_matrix(df, paths[name])
    write_one_file(skipped.orderBy("ID"), paths["proximity_skipped_compounds"], ("ID", "reason"))
    write_one_file(unmapped.orderBy("gene_symbol"), paths["proximity_unmapped_targets"], ("gene_symbol", "occurrences", "members"))
    n = genes.count()
    if not n:
        raise ContractError("no disease gene lies in the network")
    return paths, {"edge_count": kept.count(), "module_gene_count": n}


@runner
def proximity_score_compounds(c: Context, task: str):
    p, read = c.config.proximity, c.spark.read
    z = proximity.proximity_z(read.parquet(c.at("proximity/network.parquet")), read.parquet(c.at("proximity/module.parquet")), read.parquet(c.at("proximity/targets.parquet")), p.least_bin, p.draws, p.seed, c.at("proximity/distances"))
    rows = written(z.where("z IS NOT NULL").select(F.col("set_id").alias("ID"), "z"), "scores")
    path = c.at("proximity/scores.tsv")
    write_one_file(rows.orderBy("z", "ID"), path, ("ID", "z"))
    return {"proximity_scores": path}, {"compound_count": rows.count()}


@runner
def kg_construct_graph(c: Context, task: str):
    spark, g = c.spark, c.config.graph
    settings = construct.Settings(g.tag, g.prefix, g.top_targets)
    canonical = chem.column(c.chemistry, "canonical", "string")
    base = resources.node_table(spark, c.resources["base_nodes"])
    structures = delimited.read_table(spark, c.resources["base_structures"], ("node_id", "smiles"), "\t").select("node_id", canonical(F.col("smiles")).alias("canonical"))
    compounds = written(resources.normalised_compounds(spark, c.at("input_prepare/compounds.normalized.csv"), canonical), "compounds")
    targets, own = targets_of(c)
    matches = construct.matched_compounds(compounds, structures, base, settings)
    bits, rejects = chem.fingerprint_edges(matches, c.chemistry)
    optional = {k: resources.prior_table(spark, c.registered(k)) if k in c.inputs else None for k in ("positive_drugs", "disease_links")}
    made = construct.construct(base, resources.edge_table(spark, c.resources["base_edges"]), structures, compounds, targets.withColumn("position", F.col("place")), own, resources.disease_genes(spark, c.at("input_prepare/disease_genes.normalized.tsv")), c.disease, settings, optional["positive_drugs"], optional["disease_links"], bits, rejects)
    paths = {k: c.at(f"kg/construction/{n}") for k, n in (("kg_nodes", "node.parquet"), ("kg_edges", "edges.parquet"), ("kg_graph", "kg.parquet"), ("kg_drug_match_report", "drug_smiles_match_report.tsv"), ("kg_invalid_smiles", "invalid_smiles.tsv"), ("kg_unmapped_targets", "unmapped_target_symbols.tsv"), ("kg_construction_manifest", "manifest.json"))}
    for name, df in (("kg_nodes", made.nodes), ("kg_edges", made.edges), ("kg_graph", made.graph)):
        write_matrix(df, paths[name])
    write_one_file(made.matches.orderBy("library_id"), paths["kg_drug_match_report"], tuple(made.matches.columns))
    write_one_file(made.invalid.orderBy("ID", "reason"), paths["kg_invalid_smiles"], ("ID", "SMILES", "reason"))
    write_one_file(made.unmapped.orderBy("gene_symbol"), paths["kg_unmapped_targets"], ("gene_symbol", "occurrence_count", "compound_ids", "reason"))
    write_json(spark, {"schema_version": "1.0", "disease": dataclasses.asdict(c.disease), "metrics": made.metrics, "structures_approximate": c.chemistry().approximate}, paths["kg_construction_manifest"])
    return paths, made.metrics


@runner
def kg_prepare_training_data(c: Context, task: str):
    g, read = c.config.graph, c.spark.read
    nodes, base, directed = knowledge.training_frames(read.parquet(c.at("kg/construction/node.parquet")), read.parquet(c.at("kg/construction/kg.parquet")), c.disease.custom_node_id, g.split_seed, g.test, g.valid, g.pin)
    paths = {k: c.at(f"kg/training_data/{k.removeprefix('kg_')}.parquet") for k in ("kg_nodes_typed", "kg_base_edges", "kg_directed_edges")}
    for name, df in zip(paths, (nodes, base, directed)):
        write_matrix(df, paths[name])
    return paths, {"num_base_edges": read.parquet(paths["kg_base_edges"]).count(), "num_directed_edges": read.parquet(paths["kg_directed_edges"]).count()}


@runner
def kg_pretrain(c: Context, task: str):
    g = c.config.graph
    settings = training.Pretraining(dimension=g.dimension, epochs=g.pretrain_epochs, batch=g.pretrain_batch, rate=g.pretrain_rate)
    state, history, summary = training.trained_checkpoint(c.spark.read.parquet(c.at("kg/training_data/directed_edges.parquet")), settings, g.split_seed)
    paths = {"kg_pretrain_checkpoint": c.at("kg/pretrain/checkpoint.parquet"), "kg_pretrain_history": c.at("kg/pretrain/history.json"), "kg_pretrain_summary": c.at("kg/pretrain/summary.json")}
    write_matrix(c.spark.createDataFrame([(bytearray(state),)], "state binary"), paths["kg_pretrain_checkpoint"])
    write_json(c.spark, finite(history), paths["kg_pretrain_history"])
    write_json(c.spark, finite(summary), paths["kg_pretrain_summary"])
    return paths, {"epochs_completed": summary["epochs_completed"], "best_epoch": summary["best_epoch"]}


def finite(value):
    """A document with null for numbers that are not finite."""
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))) else value


@runner
def kg_finetune_seed(c: Context, task: str):
    """One seed's ranking of the candidates."""
    g, read = c.config.graph, c.spark.read
    seed = int(task.removeprefix("seed-"))
    settings = training.Finetuning(seeds=(seed,), epochs=g.finetune_epochs, rate=g.finetune_rate)
    state = bytes(read.parquet(c.at("kg/pretrain/checkpoint.parquet")).first().state)
    directed = read.parquet(c.at("kg/training_data/directed_edges.parquet"))
    scores, summaries = training.seeds_trained(directed, state, g.dimension, settings, c.disease.custom_node_id, g.split_seed)
    nodes = read.parquet(c.at("kg/training_data/nodes_typed.parquet")).where("node_type = 'drug'")
    own = nodes.join(scores.withColumnRenamed("type_index", "_at"), nodes.type_index == F.col("_at")).select("node_id", "score")
    positives = directed.where((F.col("relation") == "drug_disease") & (F.col("y_id") == c.disease.custom_node_id) & (F.col("split") == "train")).select(F.col("x_id").alias("node_id"))
    ranked = written(knowledge.ranked_candidates(nodes, own, g.tag, positives), "ranking")
    if ranked.isEmpty():
        raise ContractError("no candidate has the tag")
    paths = {"kg_seed_ranking": c.at(f"kg/finetune/{task}/ranking.parquet"), "kg_seed_summary": c.at(f"kg/finetune/{task}/summary.json")}
    write_matrix(ranked, paths["kg_seed_ranking"])
    import json

    write_json(c.spark, finite(json.loads(summaries.first().summary)), paths["kg_seed_summary"])
    return paths, {"candidate_count": ranked.count()}


@runner
def kg_aggregate_seeds(c: Context, task: str):
    seeds = c.config.graph.seeds
    rows = None
    for s in seeds:
        own = c.spark.read.parquet(c.at(f"kg/finetune/seed-{s}/ranking.parquet")).withColumn("seed", F.lit(s))
        rows = own if rows is None else rows.unionByName(own)
    knowledge.complete(rows, seeds)
    names = rows.groupBy("node_id").agg(*[F.min_by(x, "seed").alias(x) for x in ("node_name", "source_ids", "compound_ids")])
    out = written(knowledge.seed_ensemble(rows).join(names, "node_id"), "ensemble")
    path = c.at("kg/ensemble/ranking.tsv")
    columns = ("node_id", "node_name", "source_ids", "compound_ids", "n_seeds", "rank_mean", "rank_median", "rank_std", "rank_min", "rank_max", "score_mean", "score_std", "top100_freq", "top200_freq")
    write_one_file(out.orderBy("rank_mean", "rank_median", "rank_std", F.desc("score_mean"), "node_id"), path, columns)
    flat = {f"seed_{s}.{k}": v for s in seeds for k, v in flattened(read_json(c.spark, c.at(f"kg/finetune/seed-{s}/summary.json"))).items() if not isinstance(v, list)}
    summary = c.at("kg/ensemble/seed_summaries.json")
    write_json(c.spark, flat, summary)
    return {"kg_ensemble_ranking": path, "kg_seed_summaries": summary}, {"node_count": out.count()}


def flattened(value: dict, before: str = "") -> dict[str, object]:
    """A nested document with one level of dotted keys."""
    out: dict[str, object] = {}
    for k, v in value.items():
        out |= flattened(v, f"{before}{k}.") if isinstance(v, dict) else {f"{before}{k}": v}
    return out


def score_table(c: Context, path: str, value: str) -> DataFrame:
    """(compound_id, value) of a score file: ids there and unique, values finite numbers."""
    rows = delimited.require(delimited.read_table(c.spark, path, ("ID", value)).drop("_broken"), unique=("ID",), filled=("ID",)).select(F.col("ID").alias("compound_id"), F.expr(f"try_cast(`{value}` AS double)").alias(value))
    if rows.where(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).limit(1).count():
        raise ContractError(f"{value} has a value that is no finite number")
    return rows


@runner
def rank_candidates(c: Context, task: str):
    """The final candidates; an empty intersection is a result with the status no_candidates_passed."""
    numbers = ["rank_mean", "rank_median", "rank_std", "score_mean"]
    own = delimited.require(delimited.read_table(c.spark, c.at("kg/ensemble/ranking.tsv")).drop("_broken"), unique=("node_id",), filled=("node_id",))
    own = written(own.withColumns({n: F.col(n).cast("double") for n in numbers}), "ensemble")
    r = c.config.ranking
    gps = any(k.startswith("expression") for k in c.inputs)
    z = ranking.Evidence(score_table(c, c.at("proximity/scores.tsv"), "z"), "z", r.proximity.operator, r.proximity.threshold, r.proximity.direction)
    name = "GPS_score_zRGES_like_lower_better"
    g = ranking.Evidence(score_table(c, c.at("gps/scores.csv"), name), name, r.gps.operator, r.gps.threshold, r.gps.direction) if gps else None
    tag = c.config.graph.tag.rstrip(":")
    out = written(ranking.candidates(own, z, g, r.most, tag), "candidates")
    paths = {"final_candidates": c.at("final/final_candidates.tsv"), "ranking_summary": c.at("final/ranking_summary.json")}
    write_one_file(out.orderBy("final_rank"), paths["final_candidates"], ranking.FINAL_COLUMNS)
    counts = {k: int(v) for k, v in ranking.funnel(own, z, g, r.most, tag).first().asDict().items()}
    write_json(c.spark, {"schema_version": "1.0", "status": "succeeded" if counts["final_candidates"] else "no_candidates_passed", "evidence_mode": "kg_proximity_gps" if gps else "kg_proximity", "stage_counts": counts}, paths["ranking_summary"])
    return paths, counts


@runner
def generate_run_report(c: Context, task: str):
    rejects = [(k, p) for k, p in (("invalid_smiles", "input_prepare/invalid_smiles.tsv"), ("unmapped_genes", "input_prepare/unmapped_genes.tsv"), ("missing_predictions", "netinfer/missing_predictions.tsv"), ("proximity_skipped_compounds", "proximity/skipped_compounds.tsv"), ("kg_invalid_smiles", "kg/construction/invalid_smiles.tsv"), ("kg_unmapped_targets", "kg/construction/unmapped_target_symbols.tsv"))]
    skipped = []
    for name, p in rejects:
        path, files = delimited.hadoop(c.spark, c.at(p))
        if files.exists(path):
            skipped.append(skip_summary(delimited.read_table(c.spark, c.at(p)), name, f"artifacts/{p}"))
    summary = read_json(c.spark, c.at("final/ranking_summary.json"))
    inputs = read_json(c.spark, c.at("inputs/registry.json"))
    made = report(c.spark, c.run, document(c.config), inputs, summary, candidate_count(c.spark, c.at("final/final_candidates.tsv")), skipped)
    return write_report(c.spark, c.run, finite(made)), {"node_count": len(made["nodes"])}


def execute(c: Context, node: str, task: str = "main", waits: tuple[tuple[str, str], ...] | None = None) -> Result:
    """Runs one step and commits its result; an error is a result with its text, and is raised.

    waits: what the step waits for. If they are given, a result of the same inputs, settings, code and resources is taken
    instead, if all its files are as they were; it is committed as CACHED.
    """
    started = c.clock()
    key = None
    if waits is not None:
        own = c.contents()
        key = reuse.key_of(c.spark, c.run, node, task, waits, document(c.config), c.code, {**own["inputs"], "disease": text.digest(document(c.disease))}, own["resources"])
    if node == "create_run_workspace" and waits is not None and reuse.outputs(c.spark, c.run, node, task) is not None:
        result = Result(node, task, "CACHED", started, c.clock())  # a run goes on in its own folder
    elif key is not None and (known := reuse.found(c.spark, c.remembered, key, c.run)):
        result = Result(node, task, "CACHED", started, c.clock(), *known)
    else:
        try:
            artifacts, metrics = RUNNERS[node](c, task)
        except Exception as e:
            commit(c.spark, c.run, Result(node, task, "FAILED", started, c.clock(), error=f"{type(e).__name__}: {e}"))
            raise
        result = Result(node, task, "SUCCEEDED", started, c.clock(), artifacts, finite({k: v for k, v in metrics.items() if not isinstance(v, dict)}))
    manifests = commit(c.spark, c.run, result, text.digest(document(c.config)), c.code)
    if key is not None and result.status == "SUCCEEDED":
        reuse.remember(c.spark, c.remembered, key, c.run, result, manifests)
    return result


def run(c: Context) -> workflow.Plan:
    """All steps that the inputs call for, in the plan's order; the batches of the inference are planned when they are known."""
    inputs = workflow.Inputs(compounds="compound_library" in c.inputs, genes="disease_genes" in c.inputs, targets="drug_targets" in c.inputs, mapping="target_mapping" in c.inputs, comparisons=sum(k.startswith("expression") for k in c.inputs) // 2, species=c.config.species)
    plan = workflow.build_plan(inputs, c.config.graph.seeds)
    done: set[tuple[str, str]] = set()
    while todo := [n for n in plan.nodes if (n.node, n.task) not in done]:
        n = todo[0]
        if n.state != "SKIPPED":
            execute(c, n.node, n.task, n.waits)
        done.add((n.node, n.task))
        if n.node == "netinfer_prepare_inputs" and n.state != "SKIPPED":
            listed = tuple(b["batch_id"] for b in read_json(c.spark, c.at("netinfer/batch_manifest.json"))["batches"])
            plan = workflow.fan_out(plan, "netinfer_predict_batch", listed, "netinfer_prepare_inputs", "netinfer")
    return plan
