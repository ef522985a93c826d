"""Degree-matched draws, walks of many modules at once, stored distances and z scores, against plain Python."""

import hashlib
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.operators import graph, proximity


def place(seed, purpose, draw, node, attempt, position, members):
    at = int(hashlib.md5(f"{seed}|{purpose}|{draw}|{node}|{attempt}".encode()).hexdigest()[:13], 16) % (members - 1)
    return at + (at >= position)


def draws_by_rule(sets, bins, draws, seed, purpose, redraws=20):
    """sets: name to nodes; bins: lists of nodes in order."""
    of = {n: (b, i, len(own)) for b, own in enumerate(bins) for i, n in enumerate(own)}
    out = {}
    for name, nodes in sets.items():
        for d in range(1, draws + 1):
            left, taken = sorted(n for n in nodes if n in of), set()
            for k in range(redraws + 1):
                again, fresh = [], set()
                for n in left:
                    b, i, size = of[n]
                    x = (b, place(seed, purpose, d, n, k, i, size))
                    if x in taken or x in fresh:
                        again.append(n)
                    fresh.add(x)
                taken |= fresh
                left = again
            out[name, d] = {bins[b][i] for b, i in taken}
    return out


def far_by_rule(pairs, sources):
    near = defaultdict(set)
    for u, v in pairs:
        near[u].add(v)
        near[v].add(u)
    out, frontier = {n: 0 for n in sources}, list(sources)
    while frontier:
        frontier = [m for n in frontier for m in near[n] if m not in out and not out.update({m: out[n] + 1})]
    return out


def bins_by_rule(pairs, least):
    degree = Counter(n for e in pairs for n in e)
    out = [[]]
    for d in sorted(set(degree.values())):
        if len(out[-1]) >= least:
            out.append([])
        out[-1] += [n for n in degree if degree[n] == d]
    if len(out) > 1 and len(out[-1]) < least:
        tail = out.pop()
        out[-1] += tail
    return [sorted(b) for b in out]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(8)
    return sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)} | {(i, i + 1) for i in range(79)})


def placed_of(spark, pairs, least):
    own = graph.degrees(spark.createDataFrame(pairs, "u long, v long"))
    bins = graph.degree_bins(own.groupBy("degree").agg(F.count("*").alias("nodes")), least)
    return proximity.places(own, bins)


def test_places_count_each_bin_from_zero(spark, pairs):
    placed = placed_of(spark, pairs, 10).collect()
    want = {(n, b, i, len(own)) for b, own in enumerate(bins_by_rule(pairs, 10)) for i, n in enumerate(own)}
    assert {(r.node, r.bin, r.position, r.members) for r in placed} == want and len(placed) == 80


def test_draws_equal_the_rule_and_need_no_lists(spark, pairs):
    placed = placed_of(spark, pairs, 10)
    sets = {1: [3, 4, 5, 6, 7, 8, 9, 70], 2: [3], 3: list(range(40))}
    chosen = spark.createDataFrame([(s, n) for s, ns in sets.items() for n in [*ns, 999]], "set_id long, node long")
    got = defaultdict(set)
    rows = proximity.matched_draws(chosen, placed, 15, 7, "set").collect()
    for r in rows:
        got[r.set_id, r.draw].add(r.node)
    assert got == draws_by_rule(sets, bins_by_rule(pairs, 10), 15, 7, "set")
    assert len(rows) == sum(map(len, got.values()))
    # a bin of a million nodes costs nothing: only its number of nodes is used, and the few places that were drawn
    huge = spark.createDataFrame([(1, 0, 5, 1_000_000), (2, 0, 77, 1_000_000)], "node long, bin int, position long, members long")
    places = proximity.matched_draws(spark.createDataFrame([(0, 1), (0, 2)], "set_id int, node long"), huge, 3, 1, "set")
    assert places.count() == 0  # the drawn places belong to nodes that this table leaves out
    with pytest.raises(ValueError, match="no other node"):
        proximity.matched_draws(spark.createDataFrame([(0, 1)], "set_id int, node long"), huge.withColumn("members", F.lit(1)), 3, 1, "set")
    assert proximity.matched_draws(chosen.limit(0), placed, 3, 1, "set").count() == 0


def test_draws_are_even(spark):
    """Moments: each other node of a bin of 21 stands in equally often, the own node never."""
    placed = spark.createDataFrame([(i, 0, i, 21) for i in range(21)], "node long, bin int, position long, members long")
    got = Counter(r.node for r in proximity.matched_draws(spark.createDataFrame([(0, 4)], "set_id int, node long"), placed, 4000, 11, "set").collect())
    assert 4 not in got and sum(got.values()) == 4000 and len(got) == 20
    assert sum((n - 200) ** 2 / 200 for n in got.values()) < 45  # chi square with 19 degrees of freedom, beyond the 0.1 % tail
    two = defaultdict(set)
    for r in proximity.matched_draws(spark.createDataFrame([(0, 4), (0, 5), (0, 6)], "set_id int, node long"), placed, 1000, 11, "set").collect():
        two[r.draw].add(r.node)
    assert all(len(x) == 3 for x in two.values())


@pytest.mark.parametrize("modules", [1, 64, 130])
def test_walk_equals_one_search_for_each_module(spark, pairs, modules, monkeypatch):
    monkeypatch.setattr(proximity, "WORDS", 1)  # blocks
    rng = random.Random(modules)
    sources = {m: rng.sample(range(80), rng.randrange(1, 4)) for m in range(modules)}
    levels, words = proximity.walk(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(m, n) for m, ns in sources.items() for n in ns], "module long, node long"), modules)
    got = {}
    for r in levels.collect():
        for k, w in enumerate(r.bits):
            for b in range(64):
                if w >> b & 1:
                    assert (key := (r.block * 64 * words + 64 * k + b, r.node)) not in got
                    got[key] = r.distance
    assert got == {(m, n): d for m, ns in sources.items() for n, d in far_by_rule(pairs, ns).items()}


def z_by_rule(pairs, module, sets, least, draws, seed):
    bins = bins_by_rule(pairs, least)
    nodes = {n for e in pairs for n in e}
    modules = draws_by_rule({0: module}, bins, draws, seed, "module")
    far = [far_by_rule(pairs, [n for n in module if n in nodes])] + [far_by_rule(pairs, modules[0, d]) for d in range(1, draws + 1)]
    others = draws_by_rule(sets, bins, draws, seed, "set")
    out = {}
    for name, ns in sets.items():
        ns = [n for n in set(ns) if n in nodes]
        if not ns:
            out[name] = (None, None)
            continue
        mean = statistics.fmean(far[0][n] for n in ns)
        null = [statistics.fmean(far[d][n] for n in others[name, d]) for d in range(1, draws + 1)]
        sd = statistics.pstdev(null)
        out[name] = (mean, 0.0 if sd == 0 else (mean - statistics.fmean(null)) / sd)
    return out


def test_z_and_stored_distances(spark, pairs, tmp_path, monkeypatch):
    rng = random.Random(3)
    sets = {s: rng.sample(range(80), 5) for s in range(4)} | {5: [999], 6: [1, 2, 999]}
    sets[7] = sets[2]
    edges, module = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(1,), (5,), (9,), (999,), (9,)], "node long")
    asked = spark.createDataFrame([(s, n) for s, ns in sets.items() for n in ns] * 2, "set_id long, node long")
    want = z_by_rule(pairs, [1, 5, 9, 999], sets, 10, 12, 3)
    run = lambda e=edges, m=module, seed=3: {r.set_id: (r.mean_distance, r.z) for r in proximity.proximity_z(e, m, asked, 10, 12, seed, str(tmp_path)).collect()}
    first = run()
    assert first.keys() == want.keys() and all(first[s] == pytest.approx(want[s]) for s in want)
    with monkeypatch.context() as m:
        m.setattr(proximity, "walk", lambda *a: pytest.fail("a second run walks"))
        for again in (run(), run(edges.repartition(5))):  # the same rows in another order
            assert again.keys() == first.keys() and all(again[s] == (pytest.approx(first[s], rel=1e-12) if first[s][0] is not None else first[s]) for s in first)
        with pytest.raises(BaseException, match="second run walks"):
            run(seed=4)
    for f in tmp_path.glob("*/levels/part*"):  # a lost part is found out
        f.unlink()
        break
    with pytest.raises(ValueError, match="description"):
        run()


def test_graph_in_pieces_and_empty_module_are_errors(spark, pairs):
    sets = spark.createDataFrame([(1, 3)], "set_id long, node long")
    apart = spark.createDataFrame([*pairs, (100, 101), (102, 103)], "u long, v long")
    with pytest.raises(ValueError, match="not connected"):
        proximity.proximity_z(apart, spark.createDataFrame([(1,)], "node long"), sets, 10, 4, 3)
    with pytest.raises(ValueError, match="no node"):
        proximity.proximity_z(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(999,)], "node long"), sets, 10, 4, 3)


def test_sets_meet_distances_without_a_row_for_each_draw(spark, pairs, monkeypatch):
    """Sums by set and draw over several words and blocks equal those by the rule; no stand-in of a set becomes a row."""
    monkeypatch.setattr(proximity, "WORDS", 1)
    sets = {1: [3, 4, 5, 6, 7, 8, 9, 70], 2: list(range(40))}
    chosen = spark.createDataFrame([(s, n) for s, ns in sets.items() for n in [*ns, 999]], "set_id long, node long")
    placed, bins = placed_of(spark, pairs, 10), bins_by_rule(pairs, 10)
    modules = draws_by_rule({0: [1, 5, 9]}, bins, 70, 7, "module")
    sources = [(m, n) for m in range(71) for n in ([1, 5, 9] if m == 0 else modules[0, m])]
    levels, words = proximity.walk(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(sources, "module long, node long"), 71)
    got = {(r.set_id, r.module): (r.total, r.n) for r in proximity.drawn_distances(chosen, placed, levels, words, 70, 7, "set").collect()}
    others = draws_by_rule(sets, bins, 70, 7, "set")
    far = {d: far_by_rule(pairs, modules[0, d]) for d in range(1, 71)}
    assert got == {(s, d): (sum(far[d][n] for n in others[s, d]), len(others[s, d])) for s in sets for d in range(1, 71)}
    own = proximity.matched_draws
    monkeypatch.setattr(proximity, "matched_draws", lambda c, p, n, s, purpose: own(c, p, n, s, purpose) if purpose == "module" else pytest.fail("rows of stand-ins"))
    proximity.proximity_z(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(1,), (5,)], "node long"), chosen, 10, 4, 3)
