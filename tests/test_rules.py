"""Rules in one pass, checked writes, membership, uploads, and reuse of committed results."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.sources import rules
from evidentia.sources.delimited import ContractError, exists


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", 2.0), (2, "", None), (3, "b", -1.0), (None, "c", -2.0), (5, None, 3.0)], "id long, name string, v double")


@pytest.fixture(scope="module")
def checks(spark):
    return [rules.Rule("empty name", F.coalesce("name", F.lit("")) == ""), rules.Rule("negative", F.col("v") < 0), rules.Rule("never", F.lit(False))]


def test_all_rules_in_one_pass(spark, rows, checks):
    told = rules.judged(rows, checks, "id")
    assert told.rows == 5 and told.broken == {"empty name": (2, "2"), "negative": (2, "(null)")} and not told
    assert [(r.rule, r.n, r.example) for r in rules.stated(rows, checks, "id").collect()] == [("empty name", 2, "2"), ("negative", 2, "(null)"), ("never", 0, None)]
    empty = rules.judged(rows.limit(0), checks, "id")
    assert empty and empty.rows == 0


def test_a_checked_write_reads_once_and_leaves_nothing_broken(spark, rows, checks, tmp_path):
    with pytest.raises(ContractError, match="empty name: 2 rows.*negative: 2 rows"):
        rules.write_checked(rows, str(tmp_path / "bad"), checks, "id")
    assert list(tmp_path.iterdir()) == []
    good = rows.where("v > 0 AND name <> ''")
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(len(b))
            yield b

    seen = good.mapInPandas(counted, good.schema)
    assert rules.write_checked(seen, str(tmp_path / "good"), checks, "id").rows == 1
    assert scans.value == 1 and spark.read.parquet(str(tmp_path / "good")).count() == 1
    with pytest.raises(ContractError, match="at least"):
        rules.write_checked(good, str(tmp_path / "few"), checks, "id", at_least=2)
    assert not exists(spark, str(tmp_path / "few"))


def test_membership_both_ways(spark):
    df = lambda x: spark.createDataFrame([(a, b) for a, b in x], "batch string, id string")
    left, right = df([("1", "a"), ("1", "b"), ("1", "b"), ("2", "c"), ("2", None)]), df([("1", "a"), ("1", "b"), ("2", "d"), ("2", None)])
    with pytest.raises(ContractError, match="1 missing in input, such as '2/d'; 1 missing in manifest, such as '2/c'; 1 repeated in input, such as '1/b'"):
        rules.same_members(left, right, "batch", "id", names=("input", "manifest"))
    rules.same_members(left.where("id = 'b'"), right.where("id = 'b'"), "batch", "id", repeated=True)
    rules.same_members(right, right, "batch", "id")


UPLOADS = {
    "compounds": [("x.csv", "Compound ID,SMILES\nc1,CC\nc2,\n", {"rows": 2, "usable_rows": 1}), ("x.csv", "Compound ID,SMILES\nc1,\n", None), ("x.csv", "ID,Drug ID,SMILES\na,b,c\n", None), ("x.tsv", "ID\tSMILES\nc1\tCC\textra\n", None), ("x.csv", "ID,SMILES\n", None)],
    "disease_genes": [("g.txt", "Symbol\tx\nTP53\t1\n\nEGFR\t2\n", {"records": 2, "header_detected": True}), ("g.txt", "TP53\n", {"records": 1, "header_detected": False}), ("g.txt", "gene symbol\n", None), ("g.txt", "\n \n", None)],
    "drug_targets": [("t.json", json.dumps({"c1": {"targets": []}, "c2": {"targets": [{"a": 1}]}}), {"compound_count": 2}), ("t.json", json.dumps({"c1": {"targets": {}}}), None), ("t.json", json.dumps({" ": {"targets": []}}), None), ("t.json", "[1]", None), ("t.json", "{}", None)],
    "target_mapping": [("m.tsv", "gene_symbol\tEntrez ID\nA\t1\n", {"rows": 1}), ("m.tsv", "gene\tid\nA\t1\n", None)],
    "positive_drugs": [("p.tsv", "input_type\tvalue\nlibrary_id\tx\n\t\nbase_drug_id\ty\n", {"rows": 2, "input_types": ["base_drug_id", "library_id"]}), ("p.tsv", "input_type\tvalue\nother\tx\n", None), ("p.tsv", "input_type\tvalue\nlibrary_id\t\n", None), ("p.tsv", "value\nx\n", None)],
    "disease_links": [("d.tsv", "input_type\tvalue\nbase_disease_id\tx\n", {"rows": 1, "input_types": ["base_disease_id"]})],
    "expression_tpm": [("e.tsv", "GeneID\ts1\ts2\n1\t0\t0\n", {"sample_column_count": 2}), ("e.tsv", "Gene\ts1\ts2\n", None), ("e.tsv", "GeneID\ts1\ts1\n", None), ("e.tsv", "GeneID\ts1\n", None)],
    "expression_metadata": [("e.tsv", "sample_id\tgroup\na\tControl\nb\tdisease\n", {"sample_count": 2, "groups": {"control": 1, "disease": 1}}), ("e.tsv", "sample_id\tgroup\na\tcontrol\na\tdisease\n", None), ("e.tsv", "sample_id\tgroup\na\tcontrol\n", None), ("e.tsv", "sample_id\tgroup\na\tcontrol\nb\tother\n", None)],
}


@pytest.mark.parametrize("kind", sorted(UPLOADS))
def test_uploads(spark, tmp_path, kind):
    for i, (name, text, details) in enumerate(UPLOADS[kind]):
        path = tmp_path / f"{i}{name}"
        path.write_text(text)
        if details is None:
            with pytest.raises(ContractError):
                rules.validate_upload(spark, kind, str(path))
        else:
            assert rules.validate_upload(spark, kind, str(path)) == {"kind": kind, "status": "passed", "details": details}
    with pytest.raises(ContractError):
        rules.validate_upload(spark, "other", "x")
