"""Construction of the knowledge graph: drugs matched or new, proteins, the disease, six sources of edges, and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import written
from .mapping import unique_by_name
from .ranking import first_wins, global_position

#: Columns of the node table, the edge table and the graph table, and of the reports.
NODE_COLUMNS = ("node_index", "node_id", "node_type", "node_name", "node_source", "source_ids", "description", "node_type_raw")
EDGE_COLUMNS = ("edge_id", "x_index", "y_index", "x_id", "y_id", "x_type", "y_type", "relation", "relation_raw", "edge_type", "source_db", "evidence", "score", "rank", "original_relation")
GRAPH_COLUMNS = ("x_type", "x_id", "x_index", "x_name", "x_source", "relation", "y_type", "y_id", "y_index", "y_name", "y_source", "source_db", "evidence", "score", "rank", "original_relation", "edge_type", "edge_id")
CANDIDATE = ("x_id", "y_id", "relation", "relation_raw", "edge_type", "source_db", "evidence", "score", "rank", "original_relation")
#: The sources of edges in the order of their precedence.
CATEGORIES = ("base", "netinfer_dti", "pubchemfp", "disease_gene", "positive_drug", "disease_link")


@dataclass(frozen=True)
class Disease:
    name: str
    slug: str
    custom_node_id: str
    source_tag: str = "custom"
    identifier: str = ""
    description: str = ""
    species: str = "human"


@dataclass(frozen=True)
class Settings:
    """The tag of the user's compounds, the prefix of their nodes, and how many targets of a compound become edges."""

    tag: str = "UserLibrary:"
    prefix: str = "mol:user:"
    top_targets: int = 5

    def check(self, disease: Disease) -> None:
        if disease.species != "human":
            raise ValueError(f"unsupported species {disease.species}")
        if not 1 <= self.top_targets <= 10:
            raise ValueError("between 1 and 10 targets of a compound become edges")
        if not all(x.strip() for x in (self.tag, self.prefix, disease.name, disease.slug, disease.custom_node_id, disease.source_tag)):
            raise ValueError("names of the disease, tags and prefixes must not be empty")


@dataclass
class Graph:
    """The tables of a construction, and its counters by name."""

    nodes: DataFrame
    edges: DataFrame
    graph: DataFrame
    matches: DataFrame
    invalid: DataFrame
    unmapped: DataFrame
    metrics: dict[str, object]


def numbered(df: DataFrame, order: str, form: str, out: str) -> DataFrame:
    """Adds ids by ``form`` (such as edge:%09d), from 1 on in the order of a numeric column."""
    placed = global_position(df, order, [F.col(order)], "_p")
    return placed.withColumn(out, F.format_string(form, F.col("_p"))).drop("_p")


def matched_compounds(compounds: DataFrame, base_structures: DataFrame, base_nodes: DataFrame, settings: Settings) -> DataFrame:
    """compounds (_ord, ID, SMILES, canonical, ...) with node_id, is_new, match_type and the matched node.

    A structure that exactly one base drug has gives that drug's node; one that several have, or that cannot be read,
    gives a new node. New ids are numbered in input order; ids that the base has already are stepped over.
    base_structures: (node_id, canonical).
    """
    drugs = base_nodes.where("node_type = 'drug'").select("node_id")
    one = base_structures.where(F.coalesce("canonical", F.lit("")) != "").join(drugs, "node_id", "left_semi").groupBy("canonical").agg(F.count_distinct("node_id").alias("_n"), F.min("node_id").alias("_matched"))
    rows = compounds.join(one, "canonical", "left").withColumn("matched", F.when(F.col("_n") == 1, F.col("_matched")))
    kind = F.when(F.col("matched").isNotNull(), "base_canonical_smiles").when(F.col("_n") > 1, "ambiguous_base_canonical_smiles_kept_new").when(F.coalesce("canonical", F.lit("")) == "", "invalid_smiles_kept_new").otherwise("new_user_node")
    rows = written(rows.withColumn("match_type", kind).drop("_n", "_matched"), "matched")
    new = global_position(rows.where("matched IS NULL").select("_ord", "ID"), "_ord", [F.col("_ord"), F.col("ID")], "_p")
    # numbers that the base uses shift the following ones
    taken = base_nodes.where(F.col("node_id").startswith(settings.prefix)).select(F.substring("node_id", F.lit(len(settings.prefix) + 1), F.lit(20)).cast("long").alias("_taken")).where("_taken IS NOT NULL").distinct()
    n_taken = taken.count()
    if n_taken:
        free = new.sparkSession.range(1, new.count() + n_taken + 1).select(F.col("id").alias("_taken")).join(taken, "_taken", "left_anti")
        new = new.join(global_position(free, "_taken", [F.col("_taken")], "_p"), "_p").select("ID", F.col("_taken").alias("_p"))
    fresh = new.select("ID", F.format_string(f"{settings.prefix}%08d", "_p").alias("_node"))
    out = rows.join(fresh, "ID", "left")
    return out.withColumn("node_id", F.coalesce("matched", "_node")).withColumn("is_new", F.col("matched").isNull()).drop("_node")


def construct(
    base_nodes: DataFrame, base_edges: DataFrame, base_structures: DataFrame, compounds: DataFrame, targets: DataFrame, mapping: DataFrame, genes: DataFrame, disease: Disease,
    settings: Settings = Settings(), positives: DataFrame | None = None, links: DataFrame | None = None, fingerprints: DataFrame | None = None, rejects: DataFrame | None = None,
) -> Graph:
    """The whole graph of a run.

    base_nodes: the node table with _ord; base_edges: the edge table with _ord; base_structures: (node_id, canonical);
    compounds: (_ord, ID, SMILES, canonical[, name, CAS, Formula, MolWt]); targets: (compound_id, position, gene_symbol,
    uniprot_id, evidence, score, prediction_rank) in their order; mapping: (gene_symbol, entrez_id) in upper case, unique;
    genes: (_ord, symbol, entrez_id); positives and links: (_ord, input_type, value); fingerprints: a function's edges
    (node_id, sub_id, bit) are made by the caller from ``matched_compounds``, with its rejects.

    Nodes: the base in its order, then new drugs, proteins of targets, proteins of genes, and the disease. Edges: of each
    (x, relation, y) the first of the six sources, in their order; empty and looping ones go, as do those with an end
    that is no node, which are counted.
    """
    settings.check(disease)
    spark = base_nodes.sparkSession
    clean = lambda c: text.blank_to_empty(F.col(c).cast("string"))
    optional = lambda df, c: clean(c) if c in df.columns else F.lit("")
    base = written(base_nodes.select(*[clean(c).alias(c) for c in NODE_COLUMNS if c != "node_index"], "_ord"), "base")
    if base.where("node_id = ''").limit(1).count() or base.groupBy("node_id").count().where("count > 1").limit(1).count():
        raise ValueError("base nodes have an empty or repeated id")
    if base.where(F.col("node_id") == disease.custom_node_id).limit(1).count():
        raise ValueError("the disease's node is in the base already")
    matches = written(matched_compounds(compounds, base_structures, base, settings), "matches")

    # nodes
    tags = matches.where("NOT is_new").groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "ID"))), lambda x: F.concat(F.lit(settings.tag), x["ID"])), ";").alias("_tags"))
    old = base.join(tags, "node_id", "left").withColumn("source_ids", F.when(F.col("_tags").isNotNull(), text.union_of_tags(F.col("source_ids"), F.col("_tags"))).otherwise(F.col("source_ids"))).drop("_tags")
    name = F.coalesce(F.nullif(optional(matches, "name"), F.lit("")), F.nullif(optional(matches, "Name"), F.lit("")), F.col("ID"))
    cas, formula, weight = (optional(matches, c) for c in ("CAS", "Formula", "MolWt"))
    label = lambda k, v: F.when(v != "", F.concat(F.lit(k), v))
    drugs = matches.where("is_new").select(
        "node_id", F.lit("drug").alias("node_type"), name.alias("node_name"), F.lit(settings.tag.rstrip(":") or settings.tag).alias("node_source"), F.concat_ws(";", F.concat(F.lit(settings.tag), F.col("ID")), label("CAS:", cas)).alias("source_ids"),
        F.concat_ws(";", F.lit("UserLibrary"), label("Formula=", formula), label("MolWt=", weight)).alias("description"), F.lit("small_molecule").alias("node_type_raw"), F.lit(0).alias("_kind"), F.col("_ord").cast("long").alias("_ord"), F.lit(0).alias("_at"),
    )
    known = targets.withColumn("gene_symbol", F.upper(text.stripped(F.col("gene_symbol")))).where("gene_symbol <> ''")
    own = known.join(matches.select(F.col("ID").alias("compound_id"), F.col("node_id").alias("drug"), F.col("_ord").alias("_compound")), "compound_id")
    own = first_wins(own, ["compound_id", "gene_symbol"], F.col("position"))
    placed = global_place(own)
    own = written(placed.where(F.col("place") <= settings.top_targets).join(mapping, "gene_symbol", "left"), "targets")
    protein = lambda c: text.protein_key(text.first_token(F.col(c).cast("string")))
    gene = genes.select("_ord", F.upper(clean("symbol")).alias("symbol"), text.first_token(clean("entrez_id")).alias("entrez_id")).where("entrez_id <> ''")
    gene = written(first_wins(gene, ["entrez_id"], F.col("_ord"), F.col("symbol")), "genes")
    of_targets = own.where("entrez_id IS NOT NULL").select(protein("entrez_id").alias("node_id"), F.coalesce(F.nullif(F.col("gene_symbol"), F.lit("")), F.col("entrez_id")).alias("node_name"), F.col("entrez_id").alias("_entrez"), F.lit("NetInfer").alias("description"), F.lit(1).alias("_kind"), F.col("_compound").cast("long").alias("_ord"), F.col("place").cast("int").alias("_at"))
    of_genes = gene.select(protein("entrez_id").alias("node_id"), F.coalesce(F.nullif(F.col("symbol"), F.lit("")), F.col("entrez_id")).alias("node_name"), F.col("entrez_id").alias("_entrez"), F.lit("DiseaseGeneSet").alias("description"), F.lit(2).alias("_kind"), F.col("_ord").cast("long").alias("_ord"), F.lit(0).alias("_at"))
    proteins = of_targets.unionByName(of_genes).where("node_id IS NOT NULL")
    clash = base.where("node_type <> 'gene/protein'").join(proteins, "node_id", "left_semi").limit(1).count()
    if clash:
        raise ValueError("a protein's node id is another kind of node in the base")
    proteins = first_wins(proteins.join(base.select("node_id"), "node_id", "left_anti"), ["node_id"], F.col("_kind"), F.col("_ord"), F.col("_at"), F.col("node_name"))
    proteins = proteins.select("node_id", F.lit("gene/protein").alias("node_type"), "node_name", F.lit("NCBI").alias("node_source"), F.concat(F.lit("NCBI:"), F.col("_entrez")).alias("source_ids"), "description", F.lit("protein").alias("node_type_raw"), "_kind", "_ord", "_at")
    ids = ";".join(dict.fromkeys(x for x in (disease.identifier.strip(), f"{disease.source_tag}:{disease.slug}") if x))
    last = spark.createDataFrame([(disease.custom_node_id, "disease", disease.name, disease.source_tag, ids, disease.description or disease.name, "disease", 3, 0, 0)], "node_id string, node_type string, node_name string, node_source string, source_ids string, description string, node_type_raw string, _kind int, _ord long, _at int")
    new = written(drugs.unionByName(proteins).unionByName(last), "new-nodes")
    n_base = base.count()
    old = global_position(old, "_ord", [F.col("_ord"), F.col("node_id")], "_p").withColumn("node_index", F.col("_p") - 1)
    order = F.col("_kind").cast("double") * F.lit(1e15) + F.col("_ord") * 16.0 + F.col("_at")
    new = global_position(new.withColumn("_lead", order), "_lead", [F.col("_lead"), F.col("node_id")], "_p").withColumn("node_index", F.col("_p") - 1 + n_base)
    nodes = written(old.select(*NODE_COLUMNS).unionByName(new.select(*NODE_COLUMNS)), "nodes")

    # edges
    def edges_of(df: DataFrame, category: int, order_by, **columns) -> DataFrame:
        filled = [(columns[c] if c in columns else F.lit("")).alias(c) for c in CANDIDATE]
        return df.select(*filled, F.lit(category).alias("_category"), order_by.cast("double").alias("_ord"))

    lit = F.lit
    sources = [edges_of(base_edges, 0, F.col("_ord"), **{c: optional(base_edges, c) for c in CANDIDATE})]
    rank = F.when(F.col("evidence") == "known", "Known").otherwise(F.col("prediction_rank").cast("string"))
    sources.append(edges_of(own.where("entrez_id IS NOT NULL"), 1, F.col("_compound") * 16.0 + F.col("place"), x_id=F.col("drug"), y_id=protein("entrez_id"), relation=lit("drug_protein"), relation_raw=lit("target"), edge_type=lit("small_molecule_protein"), source_db=lit("NetInfer"), evidence=F.col("evidence"), score=F.coalesce(F.col("score").cast("string"), lit("")), rank=rank, original_relation=lit(f"NetInfer_top{settings.top_targets}_known_first")))
    if fingerprints is not None:
        bits = fingerprints.join(matches.select("node_id", "_ord"), "node_id")
        sources.append(edges_of(bits, 2, F.col("_ord") * 1024.0 + F.col("bit"), x_id=F.col("node_id"), y_id=F.col("sub_id"), relation=lit("drug_substructure"), relation_raw=lit("has_substructure"), edge_type=lit("small_molecule_substructure"), source_db=lit("PubChemFP_scikit-fingerprints"), evidence=lit("bit_1"), original_relation=F.format_string("PubchemFP%d", "bit")))
    sources.append(edges_of(gene, 3, F.col("_ord"), x_id=protein("entrez_id"), y_id=lit(disease.custom_node_id), relation=lit("disease_protein"), relation_raw=lit("associated_with"), edge_type=lit("protein_disease"), source_db=lit("disease_gene_file"), evidence=lit("custom_gene_set"), original_relation=lit("disease_gene_set")))
    if positives is not None:
        found = resolved(positives, base, {"library_id": matches.select(F.col("ID").alias("value"), "node_id"), "base_drug_id": "drug", "base_drug_name": "drug"})
        sources.append(edges_of(found, 4, F.col("_ord"), x_id=F.col("node_id"), y_id=lit(disease.custom_node_id), relation=lit("drug_disease"), relation_raw=lit("drug_disease"), edge_type=lit("small_molecule_disease"), source_db=lit("custom_positive"), evidence=lit("custom_positive_drug"), original_relation=lit("drug_disease")))
    if links is not None:
        found = resolved(links, base, {"base_disease_id": "disease", "base_disease_name": "disease"})
        sources.append(edges_of(found, 5, F.col("_ord"), x_id=lit(disease.custom_node_id), y_id=F.col("node_id"), relation=lit("disease_disease"), relation_raw=lit("parent-child"), edge_type=lit("disease_disease"), source_db=lit("custom_disease_link"), evidence=lit("custom_disease_link"), original_relation=lit("parent-child")))
    ends = nodes.select("node_id", "node_index", "node_type", "node_name", "node_source")
    side = lambda e: ends.select(*[F.col(f"node_{c}").alias(f"{e}_{c}") for c in ("id", "index", "type", "name", "source")])
    rows = reduce(DataFrame.unionByName, sources).withColumn("_fit", (F.col("x_id") != "") & (F.col("y_id") != "") & (F.col("x_id") != F.col("y_id")))
    rows = rows.join(side("x"), "x_id", "left").join(side("y"), "y_id", "left").withColumn("_whole", F.col("x_index").isNotNull() & F.col("y_index").isNotNull())
    rows = written(rows, "candidates")
    kept = first_wins(rows.where("_fit AND _whole").drop("_fit", "_whole"), ["x_id", "relation", "y_id"], F.col("_category"), F.col("_ord"), *[F.col(c) for c in ("relation_raw", "edge_type", "source_db", "evidence", "score", "rank", "original_relation")])
    kept = numbered(written(kept.withColumn("_lead", F.col("_category") * F.lit(1e16) + F.col("_ord")), "kept"), "_lead", "edge:%09d", "edge_id")
    kept = written(kept, "edges")

    counts = rows.groupBy("_category").agg(F.count("*").alias("n")).collect()  # one row per source
    by = {CATEGORIES[r._category]: r.n for r in counts}
    before, lost = rows.agg(F.sum((F.col("_fit") & F.col("_whole")).cast("long")), F.sum((F.col("_fit") & ~F.col("_whole")).cast("long"))).first()
    after = kept.count()
    no_id = own.where("entrez_id IS NULL")
    unmapped = no_id.groupBy("gene_symbol").agg(F.count("*").alias("occurrence_count"), F.array_join(F.sort_array(F.collect_set("compound_id")), ";").alias("compound_ids")).withColumn("reason", F.lit("missing_symbol_to_entrez_mapping"))
    invalid = matches.where(F.coalesce("canonical", F.lit("")) == "").select("ID", "SMILES", F.lit("invalid_smiles").alias("reason"))
    if rejects is not None:
        invalid = invalid.unionByName(rejects.select("ID", "SMILES", "reason")).distinct()
    n_new, n_compounds = matches.agg(F.coalesce(F.sum(F.col("is_new").cast("long")), F.lit(0)), F.count("*")).first()
    metrics = {
        "num_base_nodes": n_base, "num_base_edges": by.get("base", 0), "num_user_library_compounds": n_compounds, "num_user_drugs_matched_to_base_by_smiles": n_compounds - n_new, "num_new_user_drug_nodes": n_new,
        "num_nodes": nodes.count(), "node_type_counts": {r.node_type: r["count"] for r in nodes.groupBy("node_type").count().collect()},  # one row per type
        "num_edges_before_dedup": before or 0, "num_edges_after_dedup": after, "num_edges_deduplicated": (before or 0) - after, "num_edges_with_missing_endpoints": lost or 0,
        "relation_counts": {r.relation: r["count"] for r in kept.groupBy("relation").count().collect()},  # one row per relation
        "edge_candidate_counts": by, "num_unmapped_target_symbols": unmapped.count(),
        "num_drugs_without_netinfer_records": matches.join(own.select(F.col("compound_id").alias("ID")).distinct(), "ID", "left_anti").count(),
    }
    report = matches.join(base.select(F.col("node_id").alias("matched"), F.col("node_name").alias("_name")), "matched", "left").select(
        F.col("ID").alias("library_id"), F.col("SMILES").alias("input_smiles"), F.coalesce("canonical", F.lit("")).alias("canonical_smiles"), F.col("node_id").alias("output_node_id"), F.col("is_new").cast("int").cast("string").alias("is_new_node"), "match_type",
        F.coalesce("matched", F.lit("")).alias("matched_base_node_id"), F.coalesce("_name", F.lit("")).alias("matched_base_node_name"),
    )
    return Graph(nodes, kept.select(*EDGE_COLUMNS), kept.select(*GRAPH_COLUMNS), report, invalid, unmapped, metrics)


def global_place(targets: DataFrame) -> DataFrame:
    """Adds a target's place in its compound: known ones in their order, then predictions by rank and order."""
    from pyspark.sql import Window

    known = F.col("evidence") == "known"
    order = [(~known).cast("int"), F.when(known, 0).otherwise(F.col("prediction_rank")), F.col("position")]
    return targets.withColumn("place", F.row_number().over(Window.partitionBy("compound_id").orderBy(*order)))


def resolved(rows: DataFrame, base: DataFrame, kinds: dict[str, str | DataFrame]) -> DataFrame:
    """(_ord, node_id) of optional inputs (_ord, input_type, value): a table of ids by value, or a node type for ids and names of the base.

    Rows that are blank in both columns are left out; half-blank ones, other types, and values without exactly one node are errors.
    """
    own = rows.select("_ord", text.blank_to_empty(F.col("input_type")).alias("input_type"), text.blank_to_empty(F.col("value")).alias("value")).where("input_type <> '' OR value <> ''")
    if own.where((F.col("input_type") == "") | (F.col("value") == "") | ~F.col("input_type").isin(*kinds)).limit(1).count():
        raise ValueError(f"an optional input is incomplete or no {sorted(kinds)}")
    out = []
    for kind, source in kinds.items():
        asked = own.where(F.col("input_type") == kind)
        if isinstance(source, DataFrame):
            found = asked.join(source, "value", "left")
        elif kind.endswith("_name"):
            found = asked.join(unique_by_name(asked, base, source), "value", "left")
        else:
            found = asked.join(base.where(F.col("node_type") == source).select(F.col("node_id").alias("value"), "node_id"), "value", "left")
        if found.where("node_id IS NULL").limit(1).count():
            raise ValueError(f"a {kind} is not there")
        out.append(found.select("_ord", "node_id"))
    return reduce(DataFrame.union, out)
