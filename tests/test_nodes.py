"""Readers, settings, chemistry, training and the run's steps on small files."""

import dataclasses
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia import nodes
from evidentia.functions import chem, text
from evidentia.operators import construct, training
from evidentia.plans import config, report
from evidentia.sources import delimited, resources

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{cells}</sheetData></worksheet>")


def test_gene_lists_of_all_shapes(spark, tmp_path):
    def read(content):
        path = tmp_path / f"g{random.random()}.txt"
        path.write_text(content)
        return [(r.symbol, r.given_id) for r in resources.gene_list(spark, str(path)).orderBy("_ord").collect()]

    assert read("TP53\nP53\n\n") == [("TP53", ""), ("P53", "")]
    assert read("7157\n1\n") == [("", "7157"), ("", "1")]
    assert read("TP53,7157\nA,\n") == [("TP53", "7157"), ("A", "")]
    assert read("﻿GeneID\n7157\n") == [("", "7157")]
    assert read("x\thgnc_symbol\tncbi_gene_id\n1\tTP53\t7157\n2\t\t\n") == [("TP53", "7157")]
    for wrong in ("", "a,b,c\n", "symbol,gene_id\nA\n", "symbol,gene\nA,B\n"):
        with pytest.raises(delimited.ContractError):
            read(wrong)


def test_sniffing_and_strict_rows(spark, tmp_path):
    path = tmp_path / "lib.csv"
    path.write_text('ID;x\tSMILES\nc1\tCC\n')
    assert delimited.sniffed(spark, str(path)) == "\t"
    one = tmp_path / "one.csv"
    one.write_text('"a,b"\n1\n')
    with pytest.raises(delimited.ContractError):
        delimited.sniffed(spark, str(one))
    short = tmp_path / "short.csv"
    short.write_text("a,b\n1,2\n3\n")
    with pytest.raises(delimited.ContractError):
        delimited.strict(delimited.read_table(spark, str(short)))
    dup = tmp_path / "dup.csv"
    dup.write_text("Compound ID,smile\nc1,CC\nc1,CO\n")
    with pytest.raises(delimited.ContractError):
        resources.compound_library(spark, str(dup))


def test_pairs_of_expression_files():
    names = ["TPM_matrix_b.tsv", "metadata_b.tsv", "TPM_matrix_10.tsv", "metadata_10.tsv", "TPM_matrix_2.tsv", "metadata_2.tsv", "TPM_matrix.tsv", "metadata.tsv", "other.tsv"]
    assert [p[0] for p in resources.expression_pairs(names)] == ["comparison_1", "comparison_2", "comparison_10", "comparison_b"]
    for wrong in (["TPM_matrix_1.tsv"], [], ["TPM_matrix.tsv", "metadata.tsv", "TPM_matrix_1.tsv", "metadata_1.tsv"]):
        with pytest.raises(delimited.ContractError):
            resources.expression_pairs(wrong)


def test_given_targets_keep_their_rules(spark, tmp_path):
    compounds = spark.createDataFrame([("c1", "CC")], "ID string, SMILES string")
    own = spark.createDataFrame([("A", "1"), ("B", "2")], "gene_symbol string, entrez_id string")

    def read(targets, smiles="CC", name="c1"):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({name: {"smiles": smiles, "targets": targets}}))
        return delimited.provided_targets(spark, str(path), compounds, own).collect()

    known = {"gene_symbol": "a", "uniprot_id": "P1", "evidence": "known", "score": 2}
    guess = {"gene_symbol": "B", "uniprot_id": "P2", "evidence": "predicted", "prediction_rank": 3}
    assert [(r.gene_symbol, r.score, r.prediction_rank) for r in read([known, guess])] == [("A", 2.0, None), ("B", None, 3)]
    for wrong in ([guess, known], [known, known], [{**guess, "prediction_rank": 11}], [{**guess, "prediction_rank": 1.5}], [{**known, "score": "x"}], [{**known, "uniprot_id": ""}], [{**known, "gene_symbol": "C"}], [{**known, "evidence": "maybe"}], []):
        with pytest.raises(delimited.ContractError):
            read(wrong)
    with pytest.raises(delimited.ContractError):
        read([known], smiles="CO")
    with pytest.raises(delimited.ContractError):
        read([known], name="c2")


def test_settings_are_strict():
    plain = config.document(config.Config())
    assert config.converted(json.loads(json.dumps(plain))) == config.Config()
    for path, value in ((("batch",), True), (("batch",), "5"), (("graph", "seeds"), 3), (("extra",), 1), (("signature", "fdr"), "x")):
        wrong = json.loads(json.dumps(plain))
        at = wrong
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(config.ConfigError):
            config.converted(wrong)
    r = dataclasses.replace
    for wrong in (r(config.Config(), species="mouse"), r(config.Config(), graph=r(config.Graph(), seeds=(1, 1))), r(config.Config(), graph=r(config.Graph(), valid=0.6, test=0.5)), r(config.Config(), ranking=r(config.Ranking(), gps=config.Stream(operator="eq"))), r(config.Config(), resources={"a": "../b"})):
        with pytest.raises(config.ConfigError):
            config.checked(wrong)
    with pytest.raises(config.ConfigError):
        config.frozen(config.Inference(alpha=0.5))
    assert config.frozen(config.Inference()) and config.smoke(config.Config()).graph.seeds == (5,)
    assert len(config.source_digest(".")) == 64


def test_text_forms(spark):
    values = [4.0, 1 / 3, 123456789.0, 1234567890.5, 0.00001234, 0.0001, -2.5, 0.0, None, 1e300, 99999999.96]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", text.significant(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [None if v is None else "%.9g" % v for v in values]
    with pytest.raises(ValueError):
        text.slug("../x")
    with pytest.raises(ValueError):
        text.slug("!!")
    assert text.without_keys({"a": [{"Toxicity_x": 1, "b": 2}], "toxicity": 3}, "toxicity") == {"a": [{"b": 2}]}
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'toxicity', 3) AS s, 4 AS my_toxicity")
    assert text.without_fields(df, "toxicity").first().asDict(True) == {"a": 1, "s": {"x": 2}}
    assert text.artifact_id({"a": 1}).startswith("a-") and len(text.artifact_id({"a": 1})) == 34


def test_structures(spark):
    own = chem.Lexical()
    assert own.match_key("CCO.[Na+]") == "CCO" and own.canonical("C1CC") is None and own.canonical("C(C") is None and own.match_key("") is None
    assert own.properties("CCO")["molecular_weight"] == pytest.approx(46.069, abs=0.01) and own.properties("C[NH2+]C")["hydrogen_bond_donors"] == 1
    rows = spark.createDataFrame([("c1", "CCO", "CCO", "n1"), ("c2", "C(", "", "n2")], "ID string, SMILES string, canonical string, node_id string")
    edges, rejects = chem.fingerprint_edges(rows, chem.Lexical)
    assert {r.node_id for r in edges.collect()} == {"n1"} and [(r.ID, r.reason) for r in rejects.collect()] == [("c2", "invalid_smiles")]
    subs = chem.substructure_edges(rows.withColumn("match_key", F.col("canonical")), chem.Lexical)
    assert {r.compound for r in subs.collect()} == {"c1"}
    chem.registered(spark, chem.Lexical)
    assert spark.sql("SELECT structure_key('CCO.[Na+]') AS k, size(structure_bits('CCO')) AS n").first() == ("CCO", 1024)


def planted(seed):
    """Two groups of drugs and diseases: edges lie within groups; proteins tell the groups."""
    rng = random.Random(seed)
    rows = []
    for d in range(30):
        for s in rng.sample(range(d % 2, 12, 2), 4):
            rows.append(("drug", f"d{d}", d, "drug_disease", "disease", f"s{s}", s))
        for p in rng.sample(range(d % 2, 16, 2), 4):
            rows.append(("drug", f"d{d}", d, "drug_protein", "gene/protein", f"p{p}", p))
    for s in range(12):
        for p in rng.sample(range(s % 2, 16, 2), 4):
            rows.append(("gene/protein", f"p{p}", p, "disease_protein", "disease", f"s{s}", s))
    frame = pd.DataFrame(rows, columns=["x_type", "x_id", "x_idx", "relation", "y_type", "y_id", "y_idx"])
    frame["split"] = [("test", "valid", *["train"] * 8)[i % 10] if y != "s0" else "train" for i, y in enumerate(frame.y_id)]
    back = frame.rename(columns={"x_type": "y_type", "x_id": "y_id", "x_idx": "y_idx", "y_type": "x_type", "y_id": "x_id", "y_idx": "x_idx"})
    back["relation"] = "rev_" + back.relation
    return pd.concat([frame, back[frame.columns]], ignore_index=True)


def test_training_gradients_and_planted_structure(spark):
    directed = planted(1)
    graph = training.Graph.of(directed[directed.split == "train"], directed)
    model, x = training.Model(graph, 4, 3), graph.inputs(4, 3)
    positive = {k: v for k, v in graph.edges.items() if k[1] == "drug_disease"}
    negative = {k: (s, (d + 1) % 12) for k, (s, d) in positive.items()}
    loss, grad = training.loss_and_gradient(model, graph, x, positive, negative)
    rng = np.random.default_rng(0)
    for k in ("w1.drug_protein", "b2.rev_drug_disease", "d.drug_disease", "w2.disease_protein"):
        at = tuple(int(rng.integers(0, n)) for n in model.p[k].shape)
        values = []
        for step in (1e-6, -1e-6):
            model.p[k][at] += step
            values.append(training.loss_and_gradient(model, graph, x, positive, negative)[0])
            model.p[k][at] -= step
        assert (values[0] - values[1]) / 2e-6 == pytest.approx(grad[k][at], abs=1e-7)
    state, history, summary = training.pretrain(directed, training.Pretraining(dimension=16, epochs=25, batch=64, rate=0.01), 7)
    assert summary["test"]["macro_auroc"] > 0.7 and history[0]["train_loss_mean"] > history[-1]["train_loss_mean"]
    settings = training.Finetuning(seeds=(1, 2), epochs=60, rate=0.01, every=10)
    scores, summaries = training.seeds_trained(spark.createDataFrame(directed), state, 16, settings, "s0", 7)
    own = scores.toPandas()
    even, odd = own[own.type_index % 2 == 0].score.mean(), own[own.type_index % 2 == 1].score.mean()
    assert summaries.count() == 2 and even > odd + 0.2
    leaked = directed.copy()
    leaked.loc[(leaked.relation == "drug_disease") & (leaked.y_id == "s0"), "split"] = ["test"] + ["train"] * (((leaked.relation == "drug_disease") & (leaked.y_id == "s0")).sum() - 1)
    with pytest.raises(ValueError):
        training.finetune(leaked, None, 4, settings, 1, "s0", 7)
    assert len(training.configuration_hash(settings, "a", "b")) == 16
    attention = training.Model(graph, 4, 3, True)
    assert all(np.isfinite(v).all() for v in attention.forward(graph, x)[0].values())


def run_files(folder, rng):
    """Input and resource files of a small run; the paths by key."""
    files = {}

    def put(key, name, content):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
        files[key] = str(path)

    smiles = {f"c{i}": "C" * (i + 1) + "O" for i in range(6)} | {"c6": "N(" , "c7": "CCN.[Na+]"}
    put("compound_library", "in/library.tsv", "Compound ID\tCanonical SMILES\tname\n" + "".join(f"{i}\t{s}\tname {i}\n" for i, s in smiles.items()))
    put("disease_genes", "in/genes.txt", "G1\nALIAS2\nnone\nG3\n")
    genes = [f"G{i}" for i in range(1, 31)]
    put("gene_info", "res/gene_info.tsv", "#tax_id\tGeneID\tSymbol\tSynonyms\n" + "".join(f"9606\t{i}\t{g}\tALIAS{i}|-\n" for i, g in enumerate(genes, 1)))
    workbook(folder / "res" / "book.xlsx", {"Drug information": [["Drug ID", "SMILES (standardized)"], ["D1", "CO"], ["D2", "CCCO"], ["D3", "CCN"]], "Target information": [["UniProt AC", "Gene symbol", "Gene ID"], *[[f"P{i}", g, f"{i}"] for i, g in enumerate(genes, 1)], ["P99", "", ""]]})
    files["workbook"] = str(folder / "res" / "book.xlsx")
    own = chem.Lexical()
    ds = [("D1", s) for s in own.features("CO")] + [("D2", s) for s in own.features("CCCO")] + [("D3", s) for s in own.features("CCN")]
    put("drug_substructures", "res/ds.tsv", "".join(f"DRUG\t{d}\tSUB\t{s}\t1\n" for d, s in ds))
    put("drug_targets_network", "res/dt.tsv", "".join(f"DRUG\tD{1 + i % 3}\tTARGET\tP{1 + i}\t{1 + i % 4}\n" for i in range(12)))
    edges = {tuple(sorted(rng.sample(range(1, 31), 2))) for _ in range(80)} | {(i, i + 1) for i in range(1, 30)}
    put("interactions", "res/ppi.tsv", "#Protein A\tProtein B\tSource\n" + "".join(f"{a}\t{b}\ts\n" for a, b in sorted(edges)) + "5\t5\ts\nnan\t3\ts\n98\t99\ts\n")
    base = [("drug:1", "drug", "Methanol"), ("drug:2", "drug", "Other"), ("protein:ncbi:1", "gene/protein", "G1"), ("protein:ncbi:5", "gene/protein", "G5"), ("disease:1", "disease", "Cold"), ("disease:2", "disease", "Flu"), *[(f"substructure:pubchemfp:{b:03d}", "substructure", f"bit {b}") for b in sorted({b for s in smiles.values() for b in own.fingerprint(s) or []})]]
    put("base_nodes", "res/node.tsv", "\t".join(construct.NODE_COLUMNS) + "\n" + "".join(f"{i}\t{n}\t{t}\t{name}\tbase\tB:{n}\t\t{t}\n" for i, (n, t, name) in enumerate(base)))
    raw = [("drug:1", "drug_disease", "disease:1"), ("drug:2", "drug_disease", "disease:1"), ("drug:2", "drug_disease", "disease:2"), ("drug:1", "drug_disease", "disease:2"), ("drug:1", "drug_disease", "disease:2"), ("drug:2", "drug_protein", "protein:ncbi:5"), ("protein:ncbi:1", "disease_protein", "disease:1"), ("protein:ncbi:5", "disease_protein", "disease:2"), ("disease:2", "disease_disease", "disease:1"), ("drug:1", "drug_protein", "gone")]
    put("base_edges", "res/edges.csv", ",".join(construct.EDGE_COLUMNS) + "\n" + "".join(f"e{i},,,{x},{y},,,{r},{r},{r},base,,,,{r}\n" for i, (x, r, y) in enumerate(raw)))
    put("base_structures", "res/smiles.tsv", "node_id\tnode_name\tsmiles\ndrug:1\tMethanol\tCO\n")
    put("positive_drugs", "in/positive.tsv", "input_type\tvalue\nlibrary_id\tc1\nlibrary_id\tc2\nbase_drug_name\tother\nlibrary_id\tc3\nlibrary_id\tc4\n")
    put("disease_links", "in/links.tsv", "input_type\tvalue\nbase_disease_name\tFLU\n")
    samples = [f"s{i}" for i in range(8)]
    put("expression_tpm", "in/TPM_matrix_1.tsv", "GeneID\t" + "\t".join(samples) + "\tunused\n" + "".join(f"{g}\t" + "\t".join(str(v) for v in ([5 + k % 2 for k in range(4)] + [40 + k for k in range(4)] if g % 3 == 0 else [50 + k for k in range(4)] + [4 + k % 2 for k in range(4)] if g % 3 == 1 else [7] * 8)) + "\t1\n" for g in range(1, 31)))
    put("expression_metadata", "in/metadata_1.tsv", "sample_id\tgroup\n" + "".join(f"{s}\t{'Control' if i < 4 else 'disease'}\n" for i, s in enumerate(samples)))
    valid = [c for c in smiles if c != "c6"]
    put("profiles", "res/profiles.csv", "GeneSymbol," + ",".join(valid) + "\n" + "".join(f"G{g}," + ",".join(str(rng.choice((-1, 0, 1))) for _ in valid) + "\n" for g in range(1, 31)) + "NOPE," + ",".join("0" for _ in valid) + "\n")
    return files


def test_a_run_from_files_to_candidates(spark, tmp_path):
    files = run_files(tmp_path, random.Random(5))
    keys = ("compound_library", "disease_genes", "positive_drugs", "disease_links", "expression_tpm", "expression_metadata")
    r = dataclasses.replace
    small = config.Config(batch=3, proximity=config.Proximity(draws=8, least_bin=4), signature=r(config.Signature(), null_draws=40), graph=r(config.Graph(), dimension=6, pretrain_epochs=1, finetune_epochs=2, seeds=(1, 2), test=0.2, valid=0.2), ranking=config.Ranking(most=20, proximity=config.Stream(threshold=50.0), gps=config.Stream(threshold=50.0)))
    c = nodes.Context(spark, str(tmp_path / "run"), {k: files[k] for k in keys}, {**{k: v for k, v in files.items() if k not in keys}, "drug_targets": files["drug_targets_network"]}, small, construct.Disease("Test disease", "test", "disease:custom"), chem.Lexical)
    plan = nodes.run(c)
    assert plan.mode == "enhanced" and ("netinfer_predict_batch", "batch_0002") in plan.keys()
    read = lambda p: delimited.read_table(spark, c.at(p)).drop("_broken").collect()
    assert [(x.ID, x.reason) for x in read("input_prepare/invalid_smiles.tsv")] == [("c6", "rdkit_parse_failed")]
    assert [(x.symbol, x.entrez_id) for x in read("input_prepare/disease_genes.normalized.tsv")] == [("G1", "1"), ("G2", "2"), ("G3", "3")]
    assert [(x.input_value, x.reason) for x in read("input_prepare/unmapped_genes.tsv")] == [("none", "unknown_symbol")]
    own = {x.ID: x for x in read("netinfer/input_mapping.tsv")}
    assert (own["c0"].netinfer_input_type, own["c0"].official_drug_id) == ("DRUG", "D1") and own["c7"].official_drug_id == "D3" and own["c1"].batch_id == "batch_0001" and own["c2"].netinfer_input_id == "D2"
    targets = spark.read.parquet(c.at("netinfer/drug_targets.parquet")).where("compound_id = 'c0'").orderBy("place").collect()
    assert [t.evidence for t in targets[:4]] == ["known"] * 4 and {t.evidence for t in targets[4:]} == {"predicted"} and [t.gene_symbol for t in targets[:2]] == ["G4", "G7"]
    graph_nodes = {x.node_id: x for x in spark.read.parquet(c.at("kg/construction/node.parquet")).collect()}
    assert graph_nodes["drug:1"].source_ids == "B:drug:1;UserLibrary:c0" and graph_nodes["mol:user:00000001"].source_ids == "UserLibrary:c1" and graph_nodes["disease:custom"].node_index == len(graph_nodes) - 1
    assert sorted(int(x.node_index) for x in graph_nodes.values()) == list(range(len(graph_nodes)))
    edges = spark.read.parquet(c.at("kg/construction/edges.parquet")).orderBy("edge_id").collect()
    assert edges[0].edge_id == "edge:000000001" and len({(e.x_id, e.relation, e.y_id) for e in edges}) == len(edges)
    assert {(e.x_id, e.y_id) for e in edges if e.source_db == "custom_positive"} == {("mol:user:00000001", "disease:custom"), ("mol:user:00000002", "disease:custom"), ("mol:user:00000003", "disease:custom"), ("mol:user:00000004", "disease:custom"), ("drug:2", "disease:custom")}
    assert {(e.x_id, e.y_id) for e in edges if e.source_db == "custom_disease_link"} == {("disease:custom", "disease:2")} and not any(e.y_id == "gone" for e in edges)
    made = json.loads((tmp_path / "run/artifacts/kg/construction/manifest.json").read_text())["metrics"]
    assert made["num_edges_with_missing_endpoints"] == 1 and made["num_edges_deduplicated"] >= 1 and made["edge_candidate_counts"]["base"] == 10
    final = read("final/final_candidates.tsv")
    assert final and {x.compound_id for x in final} <= {f"c{i}" for i in range(8)} and final[0].evidence_mode == "kg_proximity_gps" and [int(x.final_rank) for x in final] == list(range(1, len(final) + 1))
    told = json.loads((tmp_path / "run/artifacts/final/run_report.json").read_text())
    assert told["final_candidates"] == len(final) and len(told["nodes"]) == len([n for n in plan.nodes if n.state != "SKIPPED"]) - 1 and "## Funnel" in (tmp_path / "run/artifacts/final/run_report.md").read_text()
    manifest = next((tmp_path / "run/artifacts/manifests/rank_candidates/main").glob("a-*.json"))
    found = json.loads(manifest.read_text())
    assert report.resolved(spark, c.run, found, producers=("rank_candidates",)).startswith(c.run)

    # a second run takes what is there, a change only what hangs on it, and a file that has changed is made again
    took = []
    real = dict(nodes.RUNNERS)
    always = {"create_run_workspace", "register_inputs", "generate_run_report"}
    try:
        for name, f in real.items():
            nodes.RUNNERS[name] = lambda own, task, name=name, f=f: (took.append(name), f(own, task))[1]
        nodes.run(c)
        assert set(took) <= always and read("final/final_candidates.tsv") == final
        status = {(x["node_id"], x["task_id"]): x["status"] for x in map(json.loads, (q.read_text() for q in (tmp_path / "run/artifacts/node_results").rglob("*.json")))}
        assert all(v == ("SUCCEEDED" if n == "generate_run_report" else "CACHED") for (n, _), v in status.items())
        took.clear()
        nodes.run(dataclasses.replace(c, config=r(small, ranking=r(small.ranking, most=19))))
        assert set(took) - always == {"rank_candidates"}
        took.clear()
        (tmp_path / "run/artifacts/proximity/scores.tsv").write_text("ID\tz\n")
        nodes.run(c)
        assert "proximity_score_compounds" in took and set(took) - always <= {"proximity_score_compounds", "rank_candidates"} and read("final/final_candidates.tsv") == final
        took.clear()
        other = dataclasses.replace(c, run=str(tmp_path / "other"), cache=c.remembered)
        nodes.run(other)  # another run with the same cache copies all
        assert set(took) <= always
        assert delimited.read_table(spark, other.at("final/final_candidates.tsv")).drop("_broken").collect() == final
    finally:
        nodes.RUNNERS.update(real)
    delimited.write_text(spark, "changed", f"{c.run}/{found['relative_path']}")
    with pytest.raises(delimited.ContractError):
        report.resolved(spark, c.run, found)
    with pytest.raises(delimited.ContractError):
        nodes.execute(c, "create_run_workspace")
    assert json.loads((tmp_path / "run/artifacts/node_results/create_run_workspace/main.json").read_text())["status"] == "FAILED"


def test_registration_refuses_before_it_copies(spark, tmp_path):
    for n in ("a.tsv", "A.tsv", "b.tsv"):
        (tmp_path / n).write_text(n)
    ask = lambda *names: [{"input_key": n, "path": str(tmp_path / n), "source": "upload"} for n in names]
    rows = delimited.registered(spark, ask("a.tsv"), str(tmp_path / "reg"), "now")
    assert rows[0]["size_bytes"] == 5 and len(rows[0]["sha256"]) == 64
    for wrong in (ask("a.tsv", "A.tsv"), ask("b.tsv", "b.tsv"), ask("b.tsv", "a.tsv"), []):
        with pytest.raises(delimited.ContractError):
            delimited.registered(spark, wrong, str(tmp_path / "reg"), "now")
    assert not (tmp_path / "reg/b.tsv").exists()


def test_sinks_are_whole_and_equal(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    for n in ("one.csv.gz", "two.csv.gz"):
        delimited.write_one_file(df.orderBy("k"), str(tmp_path / n), ("k", "v"), packed=True)
    assert (tmp_path / "one.csv.gz").read_bytes() == (tmp_path / "two.csv.gz").read_bytes()
    delimited.write_one_file(df.limit(1), str(tmp_path / "one.csv.gz"), ("k", "v"), packed=True)
    assert delimited.read_table(spark, str(tmp_path / "one.csv.gz")).count() == 1
    found = delimited.digests(spark, str(tmp_path / "two.csv.gz")).first()
    assert found.sha256 == delimited.streamed_digest(spark, str(tmp_path / "two.csv.gz"))


def test_leases_run_out(spark, tmp_path):
    from evidentia.streaming import events

    (tmp_path / "in").mkdir()
    beats = [("a", 1, "beat", "2024-01-01T00:00:00"), ("a", 1, "end", "2024-01-01T00:01:00"), ("b", 1, "beat", "2024-01-01T00:00:30"), ("c", 2, "beat", "2024-01-01T00:09:00")]
    (tmp_path / "in/1.json").write_text("".join(json.dumps(dict(zip(("node", "attempt", "kind", "ts"), b))) + "\n" for b in beats))
    table = spark.read.schema("node string, attempt long, kind string, ts timestamp").json(str(tmp_path / "in"))
    assert [(r.node, r.attempt) for r in events.expired_leases(table, 300, "2024-01-01T00:10:00").collect()] == [("b", 1)]
    stream = events.interrupted(events.read_log(spark, str(tmp_path / "in"), "node string, attempt long, kind string, ts timestamp"), 300)

    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(90)
    (tmp_path / "in/2.json").write_text(json.dumps({"node": "d", "attempt": 1, "kind": "beat", "ts": "2024-01-01T00:20:00"}) + "\n")
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(90)
    assert {(r.node, r.attempt) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("b", 1), ("c", 2)}
