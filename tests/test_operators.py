import hashlib
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import stats, text
from evidentia.operators import graph, inference, knowledge, mapping, ranking, signal
from evidentia.plans import workflow
from evidentia.sources import delimited


def test_p_values():
    assert stats.two_sided_p(2.0, 10.0) == pytest.approx(0.0733880348, abs=1e-9)
    assert stats.two_sided_p(58.7338670786347, 3.0) < 1e-4
    assert stats.two_sided_p(float("nan"), 3.0) == 1.0


def test_bh(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.005])], "id int, p double")
    out = [r.q for r in stats.bh_adjusted(rows, "p", "id", "q").orderBy("id").collect()]
    assert out == pytest.approx([0.025, 0.05, 0.05, 0.5, 0.025])


def test_welch_and_flat_gene(spark):
    rows = spark.createDataFrame([("a", "c", 1.0), ("a", "c", 2.0), ("a", "d", 5.0), ("a", "d", 6.5), ("b", "c", 3.0), ("b", "c", 3.0), ("b", "d", 3.0), ("b", "d", 3.0)], "gene string, group string, value double")
    out = {r.gene: r for r in stats.with_p(stats.welch(stats.group_moments(rows, ["gene"], F.col("group"), F.col("value"), "c", "d"))).collect()}
    assert out["a"].t == pytest.approx(4.25 / np.sqrt(0.25 + 0.5625))
    assert out["b"].t is None and out["b"].p == 1.0


def test_es_positions():
    assert signal.es_of(np.array([0, 1]), 4) == 1.0
    assert signal.es_of(np.array([2, 3]), 4) == -1.0
    assert signal.es_of(np.arange(4), 4) == signal.es_of(np.array([], int), 4) == 0.0


def test_es_against_a_running_sum(spark):
    rng = random.Random(3)
    order = list(range(40))
    rng.shuffle(order)
    rows = spark.createDataFrame([("x", i + 1, g) for i, g in enumerate(order)], "profile string, position int, gene int")
    got = signal.enrichment(rows, "profile", "position", F.col("gene") < 7).first()
    total, best = 0.0, 0.0
    for g in order:
        total += 1 / 7 if g < 7 else -1 / 33
        best = total if abs(total) > abs(best) else best
    assert got.es == pytest.approx(best) and got.hits == 7


def test_min_tied_percentiles(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "id string, v int")
    assert {r.id: r.p for r in ranking.percentile(rows, "v", "p").collect()} == pytest.approx({"A": 1 / 3, "B": 1 / 3, "C": 1.0})


def test_degree_bins_join_a_short_tail(spark):
    rows = spark.createDataFrame([(1, 3), (2, 5), (3, 1), (4, 1), (9, 1)], "degree long, nodes long")
    assert [(r.low, r.high, r.members) for r in graph.degree_bins(rows, 4).collect()] == [(1, 9, 11)]


def test_components_and_distances(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "u long, v long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert {r.node for r in graph.largest_component(graph.components(edges)).collect()} == {1, 2, 3, 4}
    steps = graph.distances(edges, spark.createDataFrame([(1,)], "node long"), 10)
    assert {r.node: r.distance for r in steps.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_long_chains_are_followed_to_the_end(spark, monkeypatch):
    from evidentia import queries

    chain = spark.range(34).select(F.col("id").alias("before"), (F.col("id") + 1).alias("after")).union(spark.createDataFrame([(34, 0)], "before long, after long"))
    root = spark.createDataFrame([(0,)], "node long")
    assert {r.node for r in workflow.downstream(chain, root).collect()} == set(range(1, 35))
    monkeypatch.setattr(queries, "edges_of", lambda *_: spark.range(20).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    monkeypatch.setattr(queries, "sources_of", lambda *_: root)
    assert {r.node: r.distance for r in queries.multi_source_bfs(spark, "").collect()} == {i: i for i in range(21)}


def test_first_wins_keeps_the_first(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "c")], "key string, _ord int, v string")
    assert {(r.key, r.v) for r in ranking.first_wins(rows, ["key"], F.col("_ord")).collect()} == {("k", "a"), ("j", "c")}


def test_symbol_mapping_reasons(spark):
    info = spark.createDataFrame([("1", "TP53", "p53|both", 0), ("2", "SHARED", "both", 1), ("3", "shared", "-", 2), ("4", "", "x", 3)], "GeneID string, Symbol string, Synonyms string, _ord long")
    records = [(1, "tp53", ""), (2, "p53", None), (3, "SHARED", None), (4, "both", None), (5, "none", None), (6, "TP53", "2"), (7, "TP53", "x"), (8, None, "99"), (9, None, "2"), (10, " ", ""), (11, "P53", "1"), (12, None, "4")]
    good, bad = mapping.map_symbols(spark.createDataFrame(records, "_ord int, symbol string, given_id string"), *mapping.gene_dictionary(info))
    assert sorted((r.entrez_id, r.symbol, r.source, r._ord) for r in good.collect()) == [("1", "TP53", "symbol", 1), ("2", "SHARED", "entrez", 9)]
    found = {r._ord: (r.reason, r.input_value) for r in bad.collect()}
    assert {k: v[0] for k, v in found.items()} == {3: "ambiguous_symbol", 4: "ambiguous_synonym", 5: "unknown_symbol", 6: "symbol_entrez_mismatch", 7: "invalid_entrez_id", 8: "unknown_entrez_id", 10: "empty_input_value", 12: "unknown_entrez_id"}
    assert found[6][1] == "symbol=TP53;entrez_id=2" and found[8][1] == "99"
    own = {r.symbol: r.entrez_id for r in mapping.first_win_dictionary(info).collect()}
    assert own == {"TP53": "1", "p53": "1", "both": "1", "SHARED": "2", "shared": "3"}


def network(spark):
    target = spark.createDataFrame([("D1", "P1", 2.0), ("D1", "P2", 1.0), ("D2", "P2", 3.0), ("D2", "P3", 4.0)], "drug string, target string, weight double")
    sub = spark.createDataFrame([("D1", "S1"), ("D1", "S2"), ("D2", "S2"), ("D2", "S3"), ("D9", "S3"), ("D9", "S4")], "drug string, sub string")
    return sub, target


def test_propagation_on_a_small_network(spark):
    sub, target = network(spark)
    s = inference.Settings()
    moves = inference.transition(sub, target, s.beta, s.gamma)
    assert {(r.src, round(r.total, 9)) for r in moves.groupBy("src").agg(F.sum("p").alias("total")).collect()} == {(x, 1.0) for x in ("D1", "D2", "S1", "S2", "S3", "P1", "P2", "P3")}  # D9 has no target
    asked = spark.createDataFrame([("query", "S1"), ("query", "S2")], "query string, sub string")
    none = spark.createDataFrame([], "query string, target string")
    out = {r.node: r.mass for r in inference.propagate(inference.seeds(asked, none, s.alpha), moves, 2).collect()}
    assert [out[t] for t in ("P1", "P2", "P3")] == pytest.approx([0.117157288, 0.110456950, 0.039052429], abs=1e-8)
    query, known = inference.official_queries(sub, target, spark.createDataFrame([("D1",), ("D9",)], "drug string"))
    out = {r.node: r.mass for r in inference.propagate(inference.seeds(query, known, s.alpha), moves, 2).collect()}
    assert [out[t] for t in ("P1", "P2", "P3")] == pytest.approx([0.29289322, 0.27614237, 0.09763107], abs=1e-7)


def test_prediction_on_a_small_network(spark):
    sub, target = network(spark)
    asked = spark.createDataFrame([("query", "S1"), ("query", "S2"), ("unknown", "S999")], "query string, sub string")
    got = inference.predict(asked, sub, target, inference.Settings()).collect()
    assert {(r.query, r.target, r.score, r.rank) for r in got} == {("query", "P3", 4.0, 1), ("query", "P1", 2.0, 2), ("query", "P2", 2.0, 3)}
    query, known = inference.official_queries(sub, target, spark.createDataFrame([("D1",)], "drug string"))
    own = inference.predict(query, sub, target, inference.Settings(), known)
    assert [(r.query, r.target, r.score) for r in own.collect()] == [("D1", "P3", 4.0)]
    raw = inference.raw_rows(own, "DRUG", inference.known_rows(target, spark.createDataFrame([("D1",)], "drug string"))).orderBy("_kind", "_place")
    assert [(r.uniprot_id, r.score, r["rank"]) for r in raw.collect()] == [("P3", "4", "1"), ("P1", "2", "-"), ("P2", "1", "-")]


def dense_prediction(sub, target, query, known, s):
    """The method's formulas over dense matrices."""
    drugs = sorted({d for d, _, _ in target})
    targets, subs = sorted({t for _, t, _ in target}), sorted({x for _, x in sub})
    W = np.zeros((len(drugs), len(targets)))
    for d, t, w in target:
        W[drugs.index(d), targets.index(t)] = w
    S = np.zeros((len(drugs), len(subs)))
    for d, x in sub:
        if d in drugs:
            S[drugs.index(d), subs.index(x)] = 1
    T = (W > 0).astype(float)
    nd, ns = len(drugs), len(subs)
    A = np.zeros((nd + ns + len(targets),) * 2)
    A[:nd, nd : nd + ns], A[nd : nd + ns, :nd] = s.beta * S, s.beta * S.T
    A[:nd, nd + ns :], A[nd + ns :, :nd] = (1 - s.beta) * T, (1 - s.beta) * T.T
    c = A.sum(0)
    B = A * np.where(c > 0, np.where(c > 0, c, 1) ** s.gamma, 0)
    r = B.sum(1, keepdims=True)
    M = B / np.where(r > 0, r, 1)
    out = []
    for q, own in query.items():
        inside = [x for x in own if x in subs]
        if not inside:
            continue
        m = np.zeros(len(A))
        for x in inside:
            m[nd + subs.index(x)] = s.alpha / len(own)
        held = known.get(q, [])
        for t in held:
            m[nd + ns + targets.index(t)] = (1 - s.alpha) / len(held)
        for _ in range(s.steps):
            m = m @ M
        score = m[nd + ns :]
        order = sorted(range(len(targets)), key=lambda i: (-score[i], targets[i]))
        edge = min(s.delta + len(held) + 1, len(targets))
        last = score[order[edge - 1]]
        normal = np.zeros(len(targets))
        for k, i in enumerate(order):
            normal[i] = 1 if k < edge else score[i] / last if last > 0 else 0
        common = np.array([sum(S[d, subs.index(x)] for x in inside) for d in range(nd)])
        like = common / (len(own) + S.sum(1) - common)
        best = []
        for i, t in enumerate(targets):
            near = sorted(np.flatnonzero(T[:, i]), key=lambda d: (-like[d], drugs[d]))[: s.epsilon]
            value = normal[i] * np.mean([W[d, i] for d in near])
            if value > 0 and t not in held:
                best.append((-value, t))
        out += [(q, t, -v, k + 1) for k, (v, t) in enumerate(sorted(best)[: s.most])]
    return out


def test_prediction_equals_dense_formulas(spark):
    rng = random.Random(12)
    drugs, targets, subs = [f"D{i:02d}" for i in range(14)], [f"P{i:02d}" for i in range(18)], [f"S{i:02d}" for i in range(12)]
    target = sorted({(d, t): (d, t, float(rng.randrange(1, 6))) for d in drugs[:11] for t in rng.sample(targets, 3)}.values())
    sub = sorted({(d, x) for d in drugs for x in rng.sample(subs, 3)})
    query = {f"Q{i}": sorted(rng.sample([*subs, "S98", "S99"], 2 + i % 4)) for i in range(8)} | {"Qx": ["S98"]}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    for delta in (0, 3, 20):
        s = inference.Settings(delta=delta, epsilon=2, most=5)
        known = {"Q0": [targets[0], targets[5]]}
        known = {q: [t for t in ts if any(t == x for _, x, _ in target)] for q, ts in known.items()}
        got = inference.predict(df([(q, x) for q, xs in query.items() for x in xs], "query string, sub string"), df(sub, "drug string, sub string"), df(target, "drug string, target string, weight double"), s, df([(q, t) for q, ts in known.items() for t in ts], "query string, target string"))
        rows = sorted((r.query, r["rank"], r.target, round(r.score, 9)) for r in got.collect())
        assert rows == sorted((q, k, t, round(v, 9)) for q, t, v, k in dense_prediction(sub, target, query, known, s)), delta


@pytest.mark.parametrize("alpha, steps, blocks", [(0.4, 2, 1), (1e-13, 2, 40), (0.4, 4, 40), (0.4, 3, 1)])
def test_prediction_to_twelve_digits(spark, monkeypatch, alpha, steps, blocks):
    """Masses of 1e-15 count as any others; blocks and joins give what one block and broadcasts give."""
    if blocks > 1:
        monkeypatch.setattr(inference, "BLOCK_EDGES", blocks)
        monkeypatch.setattr(inference, "BLOCK_QUERIES", 3)
        monkeypatch.setattr(inference, "TWO_STEP_ROWS", 0)
        monkeypatch.setattr(inference, "BROADCAST_ROWS", 0)
    rng = random.Random(21)
    drugs, targets, subs = [f"D{i:02d}" for i in range(16)], [f"P{i:02d}" for i in range(20)], [f"S{i:02d}" for i in range(14)]
    target = sorted({(d, t): (d, t, rng.randrange(1, 50) / 7) for d in drugs[:13] for t in rng.sample(targets, 4)}.values())
    sub = sorted({(d, x) for d in drugs for x in [*rng.sample(subs[1:], 3), "S00"]})  # S00 is in every drug
    query = {f"Q{i}": sorted(rng.sample([*subs, "S98", "S99"], 2 + i % 5)) for i in range(9)}
    s = inference.Settings(alpha=alpha, delta=2, epsilon=3, most=4, steps=steps)
    known = {"Q0": [t for t in (targets[0], targets[5]) if any(t == x for _, x, _ in target)]}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = inference.predict(df([(q, x) for q, xs in query.items() for x in xs], "query string, sub string"), df(sub, "drug string, sub string"), df(target, "drug string, target string, weight double"), s, df([(q, t) for q, ts in known.items() for t in ts], "query string, target string")).collect()
    want = {(q, k): (t, v) for q, t, v, k in dense_prediction(sub, target, query, known, s)}
    assert {(r.query, r["rank"]): (r.target, pytest.approx(r.score, rel=1e-12)) for r in got} == want and len(got) == len(want)


def test_two_steps_have_no_pair_of_query_and_drug(spark):
    sub, target = network(spark)
    s = inference.Settings()
    moves = inference.transition(sub, target, s.beta, s.gamma)
    asked = spark.createDataFrame([("query", "S1"), ("query", "S2")], "query string, sub string")
    for steps, want in ((2, {"P1": 0.117157288, "P2": 0.110456950, "P3": 0.039052429}), (4, None)):
        got = [inference.reached(inference.seeds(asked, spark.createDataFrame([], "query string, target string"), s.alpha), moves, target.select("drug").distinct(), target.select("target").distinct(), steps, table=way).collect() for way in (True, False, None)]
        one, *others = [{r.target: r.score for r in rows} for rows in got]
        assert want is None or one == pytest.approx(want, abs=1e-8)
        assert all(one == pytest.approx(x, rel=1e-12) for x in others) and len(one) == 3


def test_split_pins_and_shares(spark):
    edges = spark.createDataFrame([("r", i) for i in range(40)], "relation string, x int")
    out = knowledge.split(edges, F.col("x").cast("string"), F.col("x") < 4, 42, 0.1, 0.25).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"test": 4, "valid": 9, "train": 27}


def test_holdout_sizes(spark):
    def sizes(n, valid, test):
        r = spark.range(1).select(*[c.alias(k) for c, k in zip(stats.holdout(F.lit(n), valid, test), ("v", "t"))]).first()
        return r.v, r.t

    assert [sizes(n, 0.1, 0.05) for n in (0, 1, 2, 3, 5, 20, 100)] == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (10, 5)]
    assert sizes(50, 0.0, 0.0) == (0, 0) and sizes(3, 0.9, 0.9) == (0, 2) and sizes(10, 0.25, 0.25) == (2, 2)


def test_products_of_matrices_equal_joins_and_lists(spark, monkeypatch):
    """Two steps, their use by queries and the nearest drugs come out alike as matrices and by joins and lists; many drugs of one likeness are taken by id."""
    rng = random.Random(5)
    subs = [(f"D{d:03}", f"S{s}") for d in range(90) for s in (rng.sample(range(12), 6) if d % 3 else range(5))]
    targets = [(f"D{d:03}", f"T{t}", float(rng.randrange(1, 50))) for d in range(90) for t in rng.sample(range(20), 7)] + [("D089", "T99", 3.0)]
    drug_sub, drug_target = spark.createDataFrame(subs, "drug string, sub string"), spark.createDataFrame(targets, "drug string, target string, weight double")
    asked, known = inference.official_queries(drug_sub, drug_target, drug_sub.select("drug"))
    run = lambda: sorted((r.query, r["rank"], r.target, round(r.score, 9)) for r in inference.predict(asked, drug_sub, drug_target, inference.Settings(), known).collect())
    calls, own = [], inference.product
    monkeypatch.setattr(inference, "product", lambda *a: calls.append(a[6]) or own(*a))
    monkeypatch.setattr(inference, "TWO_STEP_ROWS", 1000)
    dense = run()
    assert calls == ["drug", "query"] and len(dense) > 500
    monkeypatch.setattr(inference, "CELLS", 0)
    assert run() == dense and len(calls) == 2


def test_training_frames_write_each_stage_once(spark, monkeypatch):
    """The frames are read from the last stage's files, not made from the edges again."""
    labels, own = [], knowledge.written
    monkeypatch.setattr(knowledge, "written", lambda df, label: labels.append(label) or own(df, label))
    nodes = spark.createDataFrame([("a", "drug", 0), ("b", "protein", 1), ("c", "protein", 2)], "node_id string, node_type string, node_index long")
    edges = spark.createDataFrame([("drug", "a", 0, "r", "protein", "b", 1), ("protein", "c", 2, "ppi", "protein", "b", 1)], "x_type string, x_id string, x_index long, relation string, y_type string, y_id string, y_index long")
    _, base, directed = knowledge.training_frames(nodes, edges, "none", 42, 0.05, 0.1)
    assert labels == ["ends", "canonical", "base-edges"]
    assert all("/base-edges-" in f for df in (base, directed) for f in df.inputFiles())
    assert {(r.x_id, r.relation, r.y_id) for r in directed.collect()} == {("a", "r", "b"), ("b", "rev_r", "a"), ("b", "ppi", "c"), ("c", "ppi", "b")}


def test_training_frames(spark):
    nodes = [(10, "drug:1", "drug"), (12, "disease:custom", "disease"), (15, "drug:2", "drug"), (18, "disease:other", "disease"), (20, "drug:3", "drug"), (21, "drug:4", "drug"), (22, "drug:5", "drug"), (23, "drug:6", "drug")]
    at = {n: i for i, n, _ in nodes}
    rows = [("drug", d, at[d], "drug_disease", "disease", "disease:custom" if i == 0 else "disease:other", 12 if i == 0 else 18) for i, d in enumerate([f"drug:{k}" for k in range(1, 7)])]
    rows += [rows[0], ("disease", "disease:other", 18, "disease_disease", "disease", "disease:custom", 12), ("disease", "disease:custom", 12, "disease_disease", "disease", "disease:other", 18)]
    schema = "x_type string, x_id string, x_index long, relation string, y_type string, y_id string, y_index long"
    typed, base, directed = knowledge.training_frames(spark.createDataFrame(nodes, "node_index long, node_id string, node_type string"), spark.createDataFrame(rows, schema), "disease:custom", 11, 0.2, 0.2)
    assert [r.type_index for r in typed.where("node_type = 'drug'").orderBy("node_index").collect()] == list(range(6))
    got = base.collect()
    assert len(got) == len(rows) - 2
    assert [r.split for r in got if r.relation == "drug_disease" and r.y_id == "disease:custom"] == ["train"]
    assert sorted(r.split for r in got if r.relation == "drug_disease") == ["test", "train", "train", "train", "train", "valid"]
    both = directed.collect()
    assert {(r.x_id, r.x_index, r.y_id, r.y_index) for r in both if r.relation == "disease_disease"} == {("disease:custom", 12, "disease:other", 18), ("disease:other", 18, "disease:custom", 12)}
    reverse = {(r.x_id, r.y_id, r.split) for r in both if r.relation == "rev_drug_disease"}
    assert reverse == {(r.y_id, r.x_id, r.split) for r in got if r.relation == "drug_disease"} and len(both) == 2 * len(got)
    with pytest.raises(ValueError):
        knowledge.checked_ends(spark.createDataFrame([("drug", "disease:other", 1, "r", "drug", "drug:1", 2)], schema), typed)


def test_canonical_moves_all_columns(spark):
    edges = spark.createDataFrame([("protein", "P5", 5, "five", "ppi", "protein", "P2", 2, "two"), ("protein", "P2", 2, "two", "ppi", "protein", "P5", 5, "five")], "x_type string, x_id string, x_index int, x_name string, relation string, y_type string, y_id string, y_index int, y_name string")
    assert [(r.x_id, r.x_index, r.x_name, r.y_id) for r in knowledge.canonical(edges).collect()] == [("P2", 2, "two", "P5")]


def test_negatives(spark):
    edges = spark.createDataFrame([(i, "r", i % 7) for i in range(60)] + [(i, "s", 100) for i in range(5)], "src long, relation string, dst long")
    for method in ("fix_dst", "multinomial_dst"):
        got = knowledge.negatives(edges, 3, method, 2).collect()
        assert len(got) == 130 and {r.negative for r in got if r.relation == "s"} == {100} and {r.negative for r in got if r.relation == "r"} == set(range(7))
    assert {r.negative for r in knowledge.negatives(edges, 3, "fix_src").where("relation = 's'").collect()} <= set(range(5))
    every = knowledge.negatives(edges, 3, "corrupt_dst", ends=spark.createDataFrame([("r", 500), ("s", 501)], "relation string, node long"))
    assert {(r.relation, r.negative) for r in every.collect()} == {("r", 500), ("s", 501)}


def test_relation_layer_equals_matrices(spark):
    rng = np.random.default_rng(2)
    x = {i: rng.normal(size=3) for i in range(6)}
    edges = [(0, "a", 1), (2, "a", 1), (3, "b", 1), (1, "b", 0), (4, "a", 0)]
    w = {r: (rng.normal(size=(2, 3)), rng.normal(size=2)) for r in "ab"}
    got = knowledge.relation_layer(spark.createDataFrame(edges, "src long, relation string, dst long"), spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "node long, vec array<double>"), spark.createDataFrame([(r, m.tolist(), b.tolist()) for r, (m, b) in w.items()], "relation string, matrix array<array<double>>, bias array<double>"), 0.01)
    for r in got.collect():
        total = sum(w[k][0] @ np.mean([x[s] for s, q, d in edges if q == k and d == r.node], axis=0) + w[k][1] for k in {q for _, q, d in edges if d == r.node})
        assert r.vec == pytest.approx(np.where(total > 0, total, 0.01 * total).tolist())
    assert got.count() == 2


def test_attention_layer_equals_matrices(spark):
    rng = np.random.default_rng(3)
    x = {i: rng.normal(size=3) for i in range(7)}
    edges = [(0, "a", 1), (2, "a", 1), (2, "a", 1), (3, "b", 1), (1, "rev_b", 3), (4, "b", 1), (4, "a", 0), (5, "a", 99), (98, "a", 1), (None, "a", 1)]
    other = {"a": "a", "b": "rev_b", "rev_b": "b"}
    w = {r: (rng.normal(size=(2, 3)), rng.normal(size=2), rng.normal(size=2), 50 * rng.normal(size=2)) for r in other}
    weights = spark.createDataFrame([(r, other[r], *(v.tolist() for v in w[r])) for r in w], "relation string, other string, matrix array<array<double>>, bias array<double>, from_source array<double>, from_destination array<double>")
    args = spark.createDataFrame(edges, "src long, relation string, dst long"), spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "node long, vec array<double>"), weights
    wh = lambda r, i: w[r][0] @ x[i] + w[r][1]
    whole = [e for e in edges if e[0] in x and e[2] in x]
    for node in (0, 1, 3):
        total = np.zeros(2)
        for r in {q for _, q, d in whole if d == node}:
            own = [s for s, q, d in whole if d == node and q == r]
            e = np.array([w[r][2] @ wh(r, s) + w[r][3] @ wh(other[r], node) for s in own])
            e = np.where(e > 0, e, 0.2 * e)
            a = np.exp(e - e.max())
            total += (a / a.sum()) @ np.array([wh(r, s) for s in own])
        got = {r.node: r.vec for r in knowledge.attention_layer(*args, 0.2).collect()}
        assert got.keys() == {0, 1, 3} and got[node] == pytest.approx(total.tolist())
    sums = knowledge.attention_shares(*args, 0.2).groupBy("dst", "relation").agg(F.sum(F.col("share") * F.col("n")).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums) and len(sums) == 4


def test_ranks_with_nulls_and_few_values(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 2.0)], "id int, v double")
    assert {r.id: r.p for r in ranking.percentile(rows, "v", "p").collect()} == pytest.approx({3: 1 / 3, 1: 2 / 3, 2: 1.0})
    assert {r.id: r.p for r in ranking.percentile(rows, "v", "p", False).collect()} == pytest.approx({1: 1 / 3, 3: 2 / 3, 2: 1.0})


def test_candidates_and_funnel(spark):
    ensemble = spark.createDataFrame([("n1", "one", '["c1","c2"]', 1.0, 1.0, 0.0, 0.9), ("n2", "two", '["c2","c3"]', 2.0, 2.0, 0.0, 0.8), ("n3", "three", "[]", 3.0, 3.0, 0.0, 0.7), ("n4", "four", '["c4"]', 3.0, 3.0, 0.0, 0.6)], "node_id string, node_name string, compound_ids string, rank_mean double, rank_median double, rank_std double, score_mean double")
    z = ranking.Evidence(spark.createDataFrame([("c1", -1.0), ("c2", -2.0), ("c3", 0.0), ("c4", -1.0)], "compound_id string, z double"), "z")
    g = ranking.Evidence(spark.createDataFrame([("c1", -3.0), ("c2", 1.0), ("c4", -3.0)], "compound_id string, gps double"), "gps")
    two = ranking.candidates(ensemble, z).orderBy("final_rank").collect()
    assert tuple(two[0].asDict()) == ranking.FINAL_COLUMNS
    assert [(r.compound_id, r.compound_name, round(r.consensus_rank_percentile_mean, 6)) for r in two] == [("c2", "one", round((1 / 3 + 1 / 3) / 2, 6)), ("c1", "one", round((1 / 3 + 2 / 3) / 2, 6)), ("c4", "four", round((1 + 2 / 3) / 2, 6))]
    three = ranking.candidates(ensemble, z, g).orderBy("final_rank").collect()
    assert [(r.compound_id, r.gps_score, r.evidence_count) for r in three] == [("c1", -3.0, 3), ("c4", -3.0, 3)]
    f = ranking.funnel(ensemble, z, g, 3).first().asDict()
    assert f == {"kg_input_nodes": 4, "kg_top_n_requested": 3, "kg_top_n_nodes": 3, "kg_expanded_rows": 4, "kg_top_n_unique_compounds": 3, "kg_duplicate_compound_mappings_resolved": 1, "proximity_input_compounds": 4, "proximity_threshold_pass": 3, "gps_input_compounds": 3, "gps_threshold_pass": 2, "intersection_candidates": 1, "final_candidates": 1}


def test_each_set_size_draws_its_own_sets(spark):
    """The digest of a draw holds the size, so that sizes of one length are not prefixes of one order."""
    sizes = [(9, 2), (9, 4), (12, 4), (5, 0), (5, 5), (1, 1)]
    out = {(r.n, r.hits): r for r in signal.digest_nulls(spark.createDataFrame(sizes + sizes[:2], "n long, hits long"), 6).collect()}
    assert sorted(out) == sorted(sizes)
    for n, h in sizes:
        orders = [sorted(range(1, n + 1), key=lambda p, d=d: (hashlib.md5(f"{d}:{n}:{h}:{p}".encode()).hexdigest(), p)) for d in range(6)]
        es = [signal.es_of(np.array(o[:h], dtype=int) - 1, n) for o in orders]
        assert out[n, h].mean == pytest.approx(np.mean(es), abs=1e-12) and out[n, h].sd == pytest.approx(np.std(es, ddof=1), abs=1e-12)


def test_differential_and_reversal(spark):
    values = {"1": [0, 0, 0, 0, 30, 35, 40, 32], "2": [30, 35, 40, 32, 0, 0, 0, 0], "3": [5, 6, 5, 6, 5, 6, 5, 6], "4": [0.1] * 8}
    rows = spark.createDataFrame([(g, "control" if i < 4 else "disease", float(v)) for g, vs in values.items() for i, v in enumerate(vs)], "GeneID string, group string, value double")
    out = {r.GeneID: r for r in signal.differential(rows, "GeneID", "control", "disease", 1.0, 0.5, 0.05, 0.5).collect()}
    assert out["1"].log2fc == pytest.approx(5.131516858951431) and out["1"].t == pytest.approx(58.7338670786347) and out["1"].p == pytest.approx(1.087306346609069e-05, rel=1e-9)
    assert [out[g].regulation for g in "1234"] == ["up", "down", "not_sig", "not_sig"] and out["4"].padj is None and not out["4"].pass_filter
    assert out["3"].p == 1.0 and out["1"].padj == pytest.approx(1.5 * out["1"].p)
    flat = spark.createDataFrame([("a", g, v) for g, v in (("c", 1.0), ("c", 1.0), ("d", 2.0), ("d", 2.0))], "gene string, group string, value double")
    assert stats.with_p(stats.welch(stats.group_moments(flat, ["gene"], F.col("group"), F.col("value"), "c", "d"))).first().p == 0.0
    profiles = spark.createDataFrame([("cmp-reverse", "1", -1), ("cmp-reverse", "2", 1), ("cmp-reverse", "3", 0), ("cmp-mimic", "1", 1), ("cmp-mimic", "2", -1), ("cmp-mimic", "3", 1), ("cmp-none", "1", 0), ("cmp-none", "2", 0), ("cmp-none", "3", 0)], "compound string, GeneID string, effect int")
    change = spark.createDataFrame([("1", 2.0), ("2", -2.0), ("3", 0.5)], "GeneID string, disease_log2FC_mean double")
    got = {r.ID: r.score for r in signal.scored_profiles(profiles.where("compound <> 'cmp-none'"), change, 1500, 42, True).collect()}
    assert got == pytest.approx({"cmp-reverse": -2.3450728869673148, "cmp-mimic": 2.3900756943990102})
    free = {r.ID: r.score for r in signal.scored_profiles(profiles, change, 1500, 42).collect()}
    assert free["cmp-none"] == 0.0 and free["cmp-reverse"] < -1 and free["cmp-mimic"] > 1


def test_profile_ids_first_row_wins(spark):
    rows = spark.createDataFrame([("a", "GENEA", 1, 0), ("b", "GENEA", 0, 0), ("a", "ALIASA", -1, 1), ("b", "ALIASA", 1, 1), ("a", "UNKNOWN", 0, 2), ("b", "UNKNOWN", -1, 2)], "compound string, gene string, effect int, _ord int")
    out, counts = signal.profile_ids(rows, spark.createDataFrame([("GENEA", "1"), ("ALIASA", "1")], "symbol string, entrez_id string"))
    assert {(r.compound, r.GeneID, r.effect) for r in out.collect()} == {("a", "1", 1), ("b", "1", 0)}
    assert counts == {"input_gene_count": 3, "mapped_gene_count": 2, "unmapped_gene_count": 1, "duplicate_entrez_row_count": 2, "entrez_gene_count": 1}


def test_plan_closes_over_the_inputs():
    plan = workflow.build_plan(workflow.Inputs(compounds=True, genes=True, comparisons=1, batches=("batch_0001", "batch_0002")), (1, 2))
    assert plan.mode == "enhanced" and plan.evidence == "kg_proximity_gps" and ("netinfer_predict_batch", "batch_0002", "netinfer_merge_targets", "main") in plan.edges()
    seen = set()
    for n in plan.nodes:
        assert set(n.waits) <= seen
        seen.add((n.node, n.task))
    given = workflow.build_plan(workflow.Inputs(compounds=True, genes=True, targets=True, mapping=True), (1,))
    state = {n.node: n.state for n in given.nodes}
    assert given.mode == "provided_targets_core" and state["netinfer_merge_targets"] == state["gps_score_compounds"] == "SKIPPED" and state["import_drug_targets"] == "PENDING"
    for wrong in (workflow.Inputs(genes=True), workflow.Inputs(compounds=True, genes=True, targets=True), workflow.Inputs(compounds=True, genes=True, species="mouse")):
        with pytest.raises(ValueError):
            workflow.build_plan(wrong, (1,))
    open_plan = workflow.build_plan(workflow.Inputs(compounds=True, genes=True), (1,))
    made = workflow.fan_out(open_plan, "netinfer_predict_batch", ("b1", "b2"), "netinfer_prepare_inputs", "netinfer")
    assert ("netinfer_predict_batch", "b2", "netinfer_merge_targets", "main") in made.edges() and workflow.fan_out(made, "netinfer_predict_batch", ("b1", "b2"), "netinfer_prepare_inputs", "netinfer") is made
    with pytest.raises(ValueError):
        workflow.fan_out(made, "netinfer_predict_batch", ("b3",), "netinfer_prepare_inputs", "netinfer")


def test_readiness_reaches_its_fixpoint(spark):
    nodes = spark.createDataFrame([("a", "SUCCEEDED"), ("b", "FAILED"), ("c", "PENDING"), ("d", "PENDING"), ("e", "PENDING"), ("f", "PENDING"), ("g", "PENDING")], "node string, state string")
    edges = spark.createDataFrame([("a", "c"), ("b", "d"), ("d", "e"), ("e", "f"), ("gone", "g")], "before string, after string")
    assert {r.node: r.verdict for r in workflow.ready(nodes, edges).collect()} == {"c": "READY", "d": "BLOCKED", "e": "BLOCKED", "f": "BLOCKED", "g": "PENDING"}
    tasks = spark.createDataFrame([("batch", "b1"), ("batch", "b2")], "node string, task string")
    wild = spark.createDataFrame([("batch", "*", "merge", "main"), ("in", "main", "batch", "b1")], "before string, before_task string, after string, after_task string")
    made = {(r.before, r.after) for r in workflow.task_edges(wild, tasks, spark.createDataFrame([("batch",)], "node string")).collect()}
    assert made == {("in:main", "batch:b1"), ("batch:b1", "merge:main"), ("batch:b2", "merge:main")}
    assert ("batch:*", "merge:main") in {(r.before, r.after) for r in workflow.task_edges(wild, tasks, spark.createDataFrame([], "node string")).collect()}
    after = {r.node: r.state for r in workflow.retry_scope(spark.createDataFrame([("b", "FAILED"), ("d", "BLOCKED"), ("e", "SKIPPED"), ("a", "SUCCEEDED")], "node string, state string"), edges).collect()}
    assert after == {"b": "READY", "d": "PENDING", "e": "SKIPPED", "a": "SUCCEEDED"}


def test_estimates_and_status(spark):
    history = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", 10.0)], "task string, seconds double")
    one = workflow.eta(history, spark.createDataFrame([("a",), ("b",)], "task string")).first()
    assert (one.status, one.low, one.high) == ("estimated", pytest.approx(1.8 + 7), pytest.approx(4.2 + 15))
    missing = spark.createDataFrame([("a",), ("c",)], "task string")
    none = workflow.eta(history, missing).first()
    assert none.status == "unknown" and none.low is None and none.unknown == 1
    told = workflow.eta(history, missing, reference=spark.createDataFrame([("c", 2.0, 4.0)], "task string, low double, high double")).first()
    assert told.status == "estimated" and told.low == pytest.approx(3.8)
    runs = spark.createDataFrame([(1, "SUCCEEDED"), (1, "FAILED"), (1, "RUNNING"), (2, "FAILED"), (2, "READY"), (3, "SKIPPED"), (3, "CACHED"), (4, "BLOCKED"), (4, "SUCCEEDED"), (5, "READY"), (6, "RUNNING")], "run int, state string")
    asked = spark.createDataFrame([(5,), (6,)], "run int")
    assert {r.run: r.status for r in workflow.run_status(runs, cancelled=asked).collect()} == {1: "RUNNING", 2: "FAILED", 3: "SUCCEEDED", 4: "BLOCKED", 5: "CANCELLED", 6: "RUNNING"}
    assert workflow.allowed("RUNNING", "SUCCEEDED") and not workflow.allowed("SUCCEEDED", "READY") and workflow.allowed("SUCCEEDED", "PENDING", True) and not workflow.allowed("RUNNING", "PENDING", True)
    need = workflow.checklist({"compound_library", "drug_targets"}, {"1": {"tpm"}})
    assert need["next_required"] == "disease_genes" and not need["ready"]
    need = workflow.checklist({"compound_library", "disease_genes"}, {"1": {"tpm", "metadata"}})
    assert need["ready"] and need["evidence_mode"] == "kg_proximity_gps" and need["target_source"] == "inferred"


def test_text_helpers(spark):
    assert text.slug("Non–alcoholic Fätty  liver!") == "nonalcoholic_fatty_liver"
    assert text.digest({"b": 1, "a": 2}) == text.digest({"a": 2, "b": 1})
    row = spark.createDataFrame([("\tUserLibrary:a;x;UserLibrary:b;UserLibrary:a ",)], "s string").select(text.tagged(F.col("s"), "UserLibrary").alias("t"), text.stripped(F.col("s")).alias("u")).first()
    assert row.t == ["a", "b", "a "] and row.u.startswith("User")


def test_delimited_sources(spark, tmp_path):
    good = tmp_path / "g.tsv"
    good.write_text("﻿Compound ID\tCanonical SMILES\tname\nc1\tCC\tx\n\nc2\tCO\t\n")
    rows = delimited.by_alias(delimited.read_table(spark, str(good)).drop("_broken"), {"ID": ("compoundid",), "SMILES": ("canonicalsmiles",)})
    assert rows.columns == ["ID", "SMILES", "name"] and [r.ID for r in rows.orderBy("ID").collect()] == ["c1", "c2"]
    bad = tmp_path / "b.csv"
    bad.write_text("a,a\n1,2\n")
    with pytest.raises(delimited.ContractError):
        delimited.read_table(spark, str(bad))
    with pytest.raises(delimited.ContractError):
        delimited.require(rows.union(rows), unique=("ID",))
    out = tmp_path / "out.csv"
    delimited.write_table(rows, str(out), ("ID", "name"))
    assert delimited.read_table(spark, str(out)).count() == 2


def test_json_targets_and_predictions(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"c1": {"smiles": "C", "targets": [{"gene_symbol": "A", "uniprot_id": "P1", "evidence": "known"}, {"gene_symbol": "B", "uniprot_id": "P2", "evidence": "predicted", "score": 0.5, "prediction_rank": 1}]}}))
    assert [(r.place, r.gene_symbol) for r in delimited.drug_targets(spark, str(path)).orderBy("place").collect()] == [(0, "A"), (1, "B")]
    raw = tmp_path / "raw.tsv"
    raw.write_text("DRUG\td1\tTARGET\tP1\t0.5\t1\nDRUG\td1\tTARGET\tP2\t1\t-\n")
    assert [(r.evidence, r.prediction_rank) for r in delimited.raw_predictions(spark, str(raw)).orderBy("uniprot_id").collect()] == [("predicted", 1), ("known", None)]


def test_workbook_sheet(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(delimited.SheetSource)
    assert [tuple(r) for r in spark.read.format("evidentia-sheet").option("sheet", "S").load(str(path)).collect()] == [("7", None)]


def test_stream_of_statuses(spark, tmp_path):
    from evidentia.streaming import events

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"node": "a", "status": "RUNNING", "ts": "2024-01-01T00:00:00"}\n{"node": "a", "status": "DONE", "ts": "2024-01-01T00:05:00"}\n')
    rows = events.latest_status(events.read_log(spark, str(tmp_path / "in"), "node string, status string, ts timestamp"))
    run = rows.writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.node, r.status, r.n_events) for r in spark.table("latest").collect()] == [("a", "DONE", 2)]


def test_interactions_leave_blanks_out(spark):
    rows = spark.createDataFrame([("b", "a", "x"), ("a", "b", "y"), ("a", "a", "z"), ("nan", "c", "z"), (" ", "d", "z"), (None, "e", "z")], "`#Protein A` string, `Protein B` string, Source string")
    assert [(r.u, r.v) for r in graph.interactions(rows).collect()] == [("a", "b")]
