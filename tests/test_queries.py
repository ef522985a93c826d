"""Each query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from evidentia.oracle import ORACLE_SQL
from evidentia.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    keys = sorted(names)
    ours = sorted((tuple(plain(r[k]) for k in keys) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(k)]) for k in keys) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_queries_without_sql():
    """These have tests of their own here."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"welch_p", "differential_table"}


def test_components_equal_a_union_find(spark, duck):
    edges = duck.execute("SELECT DISTINCT -1 - l_suppkey, l_partkey FROM lineitem").fetchall()
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in QUERIES["connected_components"](spark, DATA).collect()} == {x: find(x) for x in parent}
    of = [find(x) for x in parent]
    top = min(set(of), key=lambda c: (-of.count(c), c))
    assert {r.node for r in QUERIES["largest_component"](spark, DATA).collect()} == {x for x in parent if find(x) == top}


def t_tail(t, dof, steps=4000):
    """The two-sided tail of the t distribution by Simpson's rule over the angle whose tangent is t / sqrt(dof)."""
    top = math.atan(abs(t) / math.sqrt(dof))
    h = top / steps
    f = [math.cos(i * h) ** (dof - 1) for i in range(steps + 1)]
    area = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return 1 - 2 * area * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)


def test_welch_p_equals_an_integral(spark, duck):
    rows = {r.gene: r for r in QUERIES["welch_p"](spark, DATA).collect()}
    dof = {r.gene: r.dof for r in QUERIES["welch_t_df"](spark, DATA).collect()}
    assert len(rows) == duck.execute("SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag IN ('R', 'N')").fetchone()[0]
    for g, r in rows.items():
        assert r.p == pytest.approx(1.0 if r.t is None else 0.0 if math.isinf(r.t) else t_tail(r.t, dof[g]), abs=2e-6)
    table = {r.GeneID: r for r in QUERIES["differential_table"](spark, DATA).collect()}
    assert all(table[g].p == pytest.approx(rows[g].p, abs=1e-8) for g in rows)
    kept = sorted((r.p, g) for g, r in table.items() if r.pass_filter)
    low = 1.0
    for k, (p, g) in reversed(list(enumerate(kept, 1))):
        low = min(low, p * len(kept) / k)
        assert table[g].padj == pytest.approx(low, abs=1e-7)
    assert all(r.padj is None and r.regulation == "not_sig" for r in table.values() if not r.pass_filter)
