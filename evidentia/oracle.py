"""DuckDB SQL of the queries, from shared table expressions."""

from __future__ import annotations

from . import file_queries
from .plans.workflow import NODE_TRANSITIONS

ENSEMBLE = """
    seeds AS (
        SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, node_id) AS rank
        FROM (SELECT l_orderkey % 5 AS seed, l_suppkey AS node_id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS score FROM lineitem GROUP BY ALL)
    ), ensemble AS (
        SELECT node_id, count(DISTINCT seed) AS n_seeds, round(avg(rank), 6) AS rank_mean, round(median(rank), 6) AS rank_median,
               round(coalesce(stddev_samp(rank), 0), 6) AS rank_std, CAST(min(rank) AS INTEGER) AS rank_min, CAST(max(rank) AS INTEGER) AS rank_max,
               round(avg(score), 6) AS score_mean, round(coalesce(stddev_samp(score), 0), 6) AS score_std,
               round(avg(CAST(rank <= 20 AS DOUBLE)), 6) AS top20_freq, round(avg(CAST(rank <= 50 AS DOUBLE)), 6) AS top50_freq
        FROM seeds GROUP BY node_id
    ), selected AS (
        SELECT node_id AS compound_id, CAST(row_number() OVER (ORDER BY rank_mean, rank_median, rank_std, score_mean DESC, node_id) AS INTEGER) AS position
        FROM ensemble QUALIFY position <= 200
    )"""
STREAMS = """
    own AS (SELECT l_suppkey AS compound_id, avg(l_discount) AS m FROM lineitem GROUP BY ALL),
    proximity AS (SELECT compound_id, round(CASE WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (m - mean) / sd END, 6) AS z FROM own, (SELECT avg(m) AS mean, stddev_pop(m) AS sd FROM own)),
    signature AS (
        SELECT l_suppkey AS compound_id, round(avg(log2(l_quantity + 1)) FILTER (l_returnflag = 'R') - avg(log2(l_quantity + 1)) FILTER (l_returnflag = 'N'), 6) AS gps
        FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY ALL
    )"""
EDGES = """
    edges AS (SELECT DISTINCT least(-1 - l_suppkey, l_partkey) AS u, greatest(-1 - l_suppkey, l_partkey) AS v FROM lineitem),
    arcs AS (SELECT u AS src, v AS dst FROM edges UNION ALL SELECT v, u FROM edges)"""
BFS = EDGES + """,
    steps AS (SELECT DISTINCT src AS node, 0 AS distance FROM arcs WHERE src IN (SELECT -1 - s_suppkey FROM supplier WHERE s_suppkey % 50 = 1)
              UNION SELECT a.dst, s.distance + 1 FROM steps s JOIN arcs a ON a.src = s.node WHERE s.distance < 12),
    nearest AS (SELECT node, min(distance) AS distance FROM steps GROUP BY node)"""
#: Components: each has a supplier, and its smallest node is one.
PARTS = EDGES + """,
    reach AS (SELECT DISTINCT src AS root, src AS node FROM arcs WHERE src < 0 UNION SELECT r.root, a.dst FROM reach r JOIN arcs a ON a.src = r.node),
    labels AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
    inside AS (SELECT node FROM labels WHERE component = (SELECT component FROM labels GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))"""


def bins(own: str, name: str, least: int = 100) -> str:
    """Bins of ``least`` nodes at least, from (node, degree)."""
    return f"""
    {name}_hist AS (SELECT degree, count(*) AS nodes, row_number() OVER (ORDER BY degree) AS k FROM {own} GROUP BY degree),
    {name}_walk AS (
        SELECT k, degree, nodes AS held, 0 AS bin FROM {name}_hist WHERE k = 1
        UNION ALL SELECT h.k, h.degree, CASE WHEN w.held >= {least} THEN h.nodes ELSE w.held + h.nodes END, CASE WHEN w.held >= {least} THEN w.bin + 1 ELSE w.bin END FROM {name}_walk w JOIN {name}_hist h ON h.k = w.k + 1
    ),
    {name}_final AS (SELECT max(bin) AS last, (SELECT held FROM {name}_walk ORDER BY k DESC LIMIT 1) AS held FROM {name}_walk),
    {name}_placed AS (SELECT w.degree, CASE WHEN f.held < {least} AND f.last > 0 AND w.bin = f.last THEN w.bin - 1 ELSE w.bin END AS bin FROM {name}_walk w, {name}_final f),
    {name} AS (SELECT o.node, p.bin, row_number() OVER (PARTITION BY p.bin ORDER BY o.node) - 1 AS position, count(*) OVER (PARTITION BY p.bin) AS members FROM {own} o JOIN {name}_placed p USING (degree))"""


def draws(chosen: str, placed: str, name: str, seed: int, purpose: str, n: int, redraws: int = 20) -> str:
    """(set_id, draw, node) in a CTE ``name``: stand-ins from (set_id, node), drawn again where an earlier or smaller node has the place."""
    parts, held = [f"{name}_r0 AS (SELECT set_id, draw, node, bin, position, members FROM {chosen} JOIN {placed} USING (node), range(1, {n + 1}) d(draw))"], []
    for k in range(redraws + 1):
        place = f"CAST('0x' || substr(md5('{seed}|{purpose}|' || draw || '|' || node || '|{k}'), 1, 13) AS BIGINT) % (members - 1)"
        taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM {name}_h{j} h WHERE h.wins AND h.set_id = a.set_id AND h.draw = a.draw AND h.bin = a.bin AND h.place = a.place)" for j in range(k))
        parts.append(f"{name}_a{k} AS (SELECT *, {place} + CAST({place} >= position AS BIGINT) AS place FROM {name}_r{k})")
        parts.append(f"{name}_h{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY set_id, draw, bin, place ORDER BY node) = 1{taken} AS wins FROM {name}_a{k} a)")
        parts.append(f"{name}_r{k + 1} AS (SELECT set_id, draw, node, bin, position, members FROM {name}_h{k} WHERE NOT wins)")
        held.append(f"SELECT set_id, draw, bin, place FROM {name}_h{k} WHERE wins")
    parts.append(f"{name} AS MATERIALIZED (SELECT h.set_id, h.draw, p.node FROM ({' UNION ALL '.join(held)}) h JOIN {placed} p ON p.bin = h.bin AND p.position = h.place)")
    return ", ".join(parts)


def walks(sources: str, edges: str, name: str, most: int = 14) -> str:
    """(module, node, distance) in a CTE ``name`` from (module, node): a level's neighbours that neither it nor the level before has."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT module, node FROM {sources})"]
    for k in range(1, most + 1):
        older = "".join(f" ANTI JOIN {name}{j} USING (module, node)" for j in (k - 1, k - 2) if j >= 0)
        parts.append(f"{name}{k} AS MATERIALIZED (SELECT module, node FROM (SELECT DISTINCT w.module, a.dst AS node FROM {name}{k - 1} w JOIN {edges} a ON a.src = w.node){older})")
    return ", ".join(parts) + f", {name} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT module, node, {k} AS distance FROM {name}{k}' for k in range(most + 1))})"


def matched_z(least: int = 100, n: int = 1000, seed: int = 452456) -> str:
    return f"""WITH RECURSIVE {PARTS},
    kept AS (SELECT src, dst FROM arcs WHERE src IN (SELECT node FROM inside)),
    own AS (SELECT src AS node, count(*) AS degree FROM kept GROUP BY src), {bins("own", "placed", least)},
    module AS (SELECT 0 AS set_id, -1 - s_suppkey AS node FROM supplier WHERE s_suppkey % 50 = 1 AND -1 - s_suppkey IN (SELECT node FROM inside)),
    sets AS (SELECT p_size AS set_id, p_partkey AS node FROM part WHERE p_partkey IN (SELECT node FROM inside)),
    {draws("module", "placed", "modules", seed, "module", n)}, {draws("sets", "placed", "others", seed, "set", n)},
    sources AS (SELECT draw AS module, node FROM modules UNION ALL SELECT 0, node FROM module), {walks("sources", "kept", "far")},
    means AS (SELECT set_id, module, avg(distance) AS m FROM (SELECT set_id, draw AS module, node FROM others UNION ALL SELECT set_id, 0, node FROM sets) JOIN far USING (module, node) GROUP BY ALL),
    scored AS (SELECT set_id, max(m) FILTER (module = 0) AS mean_distance, avg(m) FILTER (module > 0) AS mean, stddev_pop(m) FILTER (module > 0) AS sd FROM means GROUP BY set_id)
    SELECT set_id, round(mean_distance, 6) AS mean_distance, round(CASE WHEN sd = 0 THEN 0 ELSE (mean_distance - mean) / sd END, 6) AS z FROM (SELECT DISTINCT p_size AS set_id FROM part) LEFT JOIN scored USING (set_id)"""


BINS = """
    own AS (SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY ALL),
    hist AS (SELECT degree, count(*) AS nodes, row_number() OVER (ORDER BY degree) AS k FROM own GROUP BY degree),
    walk AS (
        SELECT k, degree, nodes AS held, 0 AS bin FROM hist WHERE k = 1
        UNION ALL SELECT h.k, h.degree, CASE WHEN w.held >= 100 THEN h.nodes ELSE w.held + h.nodes END, CASE WHEN w.held >= 100 THEN w.bin + 1 ELSE w.bin END FROM walk w JOIN hist h ON h.k = w.k + 1
    ),
    final AS (SELECT max(bin) AS last, (SELECT held FROM walk ORDER BY k DESC LIMIT 1) AS held FROM walk),
    placed AS (SELECT w.degree, h.nodes, CASE WHEN f.held < 100 AND f.last > 0 AND w.bin = f.last THEN w.bin - 1 ELSE w.bin END AS bin FROM walk w JOIN hist h USING (k), final f),
    bins AS (SELECT CAST(bin AS INTEGER) AS bin, min(degree) AS low, max(degree) AS high, CAST(sum(nodes) AS BIGINT) AS members FROM placed GROUP BY bin)"""
NBI = """
    drug_sub AS (SELECT DISTINCT 'D' || l_suppkey AS drug, 'S' || p_brand || '|' || p_size AS sub FROM lineitem JOIN part ON l_partkey = p_partkey),
    drug_target AS (
        SELECT 'D' || l_suppkey AS drug, 'T' || c_nationkey || '|' || o_orderpriority || '|' || l_returnflag AS target, sum(l_quantity) AS weight
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
    ),
    query_sub AS (SELECT DISTINCT 'Q' || p_type AS query, 'S' || p_brand || '|' || p_size AS sub FROM part UNION SELECT DISTINCT 'Q' || p_type, 'none' FROM part),
    targets AS (SELECT DISTINCT target FROM drug_target),
    one_way AS (SELECT drug, sub AS other, CAST(0.2 AS DOUBLE) AS w FROM drug_sub WHERE drug IN (SELECT drug FROM drug_target) UNION ALL SELECT drug, target, CAST(0.8 AS DOUBLE) FROM drug_target),
    both_ways AS (SELECT drug AS src, other AS dst, w FROM one_way UNION ALL SELECT other, drug, w FROM one_way),
    scaled AS (SELECT src, dst, w * pow(sum(w) OVER (PARTITION BY dst), -0.5) AS w FROM both_ways),
    moves AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM scaled)"""


def prediction(queries: str, known: str) -> str:
    """Table expressions of the whole prediction, over all targets of each query. queries: (query, sub); known: (query, target)."""
    return f"""
    asked AS ({queries}), held AS ({known}),
    inside AS (SELECT * FROM asked WHERE sub IN (SELECT sub FROM drug_sub)),
    degree AS (SELECT query, count(*) AS n FROM asked GROUP BY query),
    nheld AS (SELECT query, count(*) AS n FROM held GROUP BY query),
    mass0 AS (SELECT query, sub AS node, 0.4::DOUBLE / n AS mass FROM inside JOIN degree USING (query) UNION ALL SELECT query, target, 0.6::DOUBLE / n FROM held JOIN nheld USING (query)),
    mass1 AS (SELECT query, dst AS node, sum(mass * p) AS mass FROM mass0 JOIN moves ON node = src GROUP BY ALL),
    mass2 AS (SELECT query, dst AS node, sum(mass * p) AS mass FROM mass1 JOIN moves ON node = src GROUP BY ALL),
    scores AS (SELECT q.query, t.target, coalesce(m.mass, 0) AS score, coalesce(CAST(printf('%.11e', m.mass) AS DOUBLE), 0) AS tied FROM (SELECT DISTINCT query FROM inside) q CROSS JOIN targets t LEFT JOIN mass2 m ON m.query = q.query AND m.node = t.target),
    placed AS (SELECT s.*, row_number() OVER (PARTITION BY s.query ORDER BY tied DESC, s.target) AS place, least(21 + coalesce(h.n, 0), (SELECT count(*) FROM targets)) AS edge FROM scores s LEFT JOIN nheld h USING (query)),
    edges_at AS (SELECT *, max(CASE WHEN place = edge THEN score END) OVER (PARTITION BY query) AS last FROM placed),
    normal AS (SELECT query, target, CASE WHEN place <= edge THEN 1 WHEN last > 0 THEN score / last ELSE 0 END AS normalised FROM edges_at),
    pairs AS (
        SELECT i.query, s.drug, count(*) / (any_value(d.n) + any_value(z.n) - count(*)) AS similarity, count(*) AS common
        FROM inside i JOIN drug_sub s USING (sub) JOIN degree d ON d.query = i.query JOIN (SELECT drug, count(*) AS n FROM drug_sub GROUP BY drug) z ON z.drug = s.drug GROUP BY i.query, s.drug
    ),
    near AS (
        SELECT q.query, t.target, t.weight, row_number() OVER (PARTITION BY q.query, t.target ORDER BY coalesce(p.similarity, 0) DESC, t.drug) AS place
        FROM (SELECT DISTINCT query FROM inside) q CROSS JOIN drug_target t LEFT JOIN pairs p ON p.query = q.query AND p.drug = t.drug
    ),
    weights AS (SELECT query, target, avg(weight) AS weight FROM near WHERE place <= 4 GROUP BY ALL),
    final AS (SELECT query, target, normalised * weight AS score FROM normal JOIN weights USING (query, target) ANTI JOIN held USING (query, target)),
    predicted AS (SELECT query, target, score, CAST(row_number() OVER (PARTITION BY query ORDER BY CAST(printf('%.11e', score) AS DOUBLE) DESC, target) AS INTEGER) AS rank FROM final WHERE score > 0 QUALIFY rank <= 10)"""


NOVEL = NBI + "," + prediction("SELECT query, sub FROM query_sub", "SELECT query, sub AS target FROM query_sub WHERE false")
OFFICIAL = NBI + "," + prediction("SELECT drug AS query, sub FROM drug_sub WHERE drug IN (SELECT drug FROM drug_target)", "SELECT drug AS query, target FROM drug_target")
WELCH = """
    samples AS (SELECT l_partkey AS gene, l_returnflag AS g, l_quantity AS value, log2(l_quantity + 1) AS x FROM lineitem WHERE l_returnflag IN ('R', 'N')),
    moments AS (
        SELECT gene, count(x) FILTER (g = 'N') AS n_control, count(x) FILTER (g = 'R') AS n_disease, avg(x) FILTER (g = 'N') AS mean_control, avg(x) FILTER (g = 'R') AS mean_disease,
               var_samp(x) FILTER (g = 'N') AS var_control, var_samp(x) FILTER (g = 'R') AS var_disease FROM samples GROUP BY gene
    ),
    parts AS (SELECT *, var_disease / n_disease AS a, var_control / n_control AS b FROM moments),
    welch AS (
        SELECT *, CASE WHEN n_disease > 1 AND n_control > 1 THEN CASE WHEN a + b > 0 THEN (mean_disease - mean_control) / sqrt(a + b) WHEN mean_disease <> mean_control THEN sign(mean_disease - mean_control) * CAST('inf' AS DOUBLE) END END AS t,
               CASE WHEN n_disease > 1 AND n_control > 1 THEN CASE WHEN a + b > 0 THEN pow(a + b, 2) / (pow(a, 2) / (n_disease - 1) + pow(b, 2) / (n_control - 1)) WHEN mean_disease <> mean_control THEN 1 END END AS dof FROM parts
    ),
    surrogate AS (SELECT *, round(exp(-abs(coalesce(t, 0)) * 2), 6) AS p, round(mean_disease - mean_control, 6) AS log2fc FROM welch)"""
PROFILES = """
    sums AS (SELECT l_suppkey AS profile, l_partkey AS gene, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY q DESC, gene) AS position FROM sums)"""


def es(name: str, rows: str, profile: str, position: str, hit: str) -> str:
    """Table expression with the enrichment of hits; every profile has a row."""
    return f"""
    {name}_w AS (SELECT {profile} AS profile, {position} AS position, coalesce({hit}, false) AS hit FROM {rows}),
    {name}_c AS (SELECT profile, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, count(*) AS n FROM {name}_w GROUP BY profile),
    {name}_h AS (SELECT w.profile, w.position, c.hits AS h, c.n, row_number() OVER (PARTITION BY w.profile ORDER BY w.position) AS k FROM {name}_w w JOIN {name}_c c USING (profile) WHERE w.hit AND c.hits < c.n),
    {name}_m AS (SELECT profile, greatest(0, max(k / h - (position - k) / (n - h))) AS top, least(0, min((k - 1) / h - (position - k) / (n - h))) AS lowest FROM {name}_h GROUP BY profile),
    {name} AS (SELECT c.profile, coalesce(CASE WHEN top >= -lowest THEN top ELSE lowest END, 0) AS es, hits, n FROM {name}_c c LEFT JOIN {name}_m m USING (profile))"""


TYPED = """
    typed AS (
        SELECT 'drug' AS x_type, l_suppkey AS x_index, 'rel' || l_returnflag AS relation, 'protein' AS y_type, l_partkey AS y_index FROM lineitem
        UNION ALL SELECT 'protein', l_partkey, 'ppi', 'protein', l_partkey * 7 % 1000 FROM lineitem
    ),
    canonical AS (
        SELECT DISTINCT x_type, CASE WHEN x_type = y_type AND x_index > y_index THEN y_index ELSE x_index END AS x_index, relation, y_type,
               CASE WHEN x_type = y_type AND x_index > y_index THEN x_index ELSE y_index END AS y_index FROM typed
    )"""
NODES = """
    nodes AS (SELECT 's' || s_suppkey AS node_id, 'drug' AS node_type, s_suppkey AS ord FROM supplier WHERE s_acctbal > 0
              UNION ALL SELECT 'p' || p_partkey, 'protein', p_partkey + 10000000 FROM part WHERE p_size > 5)"""
SYMBOLS = """
    official AS (SELECT upper(p_name) AS key, p_name AS symbol, CAST(p_partkey AS VARCHAR) AS id FROM part),
    synonym AS (SELECT DISTINCT upper(unnest(string_split(p_type, ' '))) AS key, CAST(p_partkey AS VARCHAR) AS id FROM part),
    records AS (
        SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber = 7 THEN '' ELSE CASE l_orderkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand ELSE lower(string_split(p_type, ' ')[1]) END END AS symbol,
               CASE WHEN l_orderkey % 4 = 0 THEN CAST(p_partkey + l_orderkey % 8 AS VARCHAR) ELSE '' END AS given
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ),
    o AS (SELECT key, count(DISTINCT id) AS n, min(id) AS id FROM official GROUP BY key),
    s AS (SELECT key, count(DISTINCT id) AS n, min(id) AS id FROM synonym WHERE key NOT IN ('', '-') GROUP BY key),
    tried AS (
        SELECT r.*, coalesce(o.n, 0) AS no, coalesce(s.n, 0) AS ns, CASE WHEN o.n = 1 THEN o.id WHEN o.n IS NULL AND s.n = 1 THEN s.id END AS found, g.symbol AS given_symbol
        FROM records r LEFT JOIN o ON o.key = upper(r.symbol) LEFT JOIN s ON s.key = upper(r.symbol) LEFT JOIN official g ON g.id = r.given
    ),
    judged AS (
        SELECT *, CASE WHEN given <> '' AND NOT regexp_full_match(given, '[0-9]+') THEN 'invalid_entrez_id' WHEN given <> '' AND given_symbol IS NULL THEN 'unknown_entrez_id'
                       WHEN given = '' AND symbol = '' THEN 'empty_input_value' WHEN symbol = '' THEN NULL
                       WHEN no > 1 THEN 'ambiguous_symbol' WHEN no = 0 AND ns > 1 THEN 'ambiguous_synonym' WHEN no + ns = 0 THEN 'unknown_symbol'
                       WHEN given <> '' AND found <> given THEN 'symbol_entrez_mismatch' END AS reason,
               CASE WHEN symbol = '' THEN 'entrez' WHEN no = 1 THEN 'symbol' ELSE 'synonym' END AS source,
               CASE WHEN symbol <> '' AND given <> '' THEN 'symbol=' || symbol || ';entrez_id=' || given WHEN symbol <> '' THEN symbol ELSE given END AS input_value,
               coalesce(found, given) AS entrez FROM tried
    )"""
DAG = """
    nodes AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 5 = 0 THEN 'PENDING' WHEN o_orderkey % 31 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state FROM orders),
    edges AS (SELECT DISTINCT before, after FROM (SELECT CAST(floor(node / 2) AS BIGINT) AS before, node AS after FROM nodes UNION ALL SELECT CAST(floor(node / 3) AS BIGINT), node FROM nodes) WHERE before > 0)"""
SPLIT = """
    k AS (SELECT *, concat_ws('|', x_type, x_index, relation, y_type, y_index) AS key, x_index % 17 = 0 AS pinned FROM canonical),
    p AS (SELECT *, count(*) OVER (PARTITION BY relation, pinned) AS n, row_number() OVER (PARTITION BY relation, pinned ORDER BY substr(md5('42:' || key), 1, 13), key) AS place FROM k),
    q AS (SELECT *, least(greatest(CAST(round_even(n * 0.05, 0) AS BIGINT), CASE WHEN n >= 3 THEN 1 ELSE 0 END), n - 1) AS n_test, greatest(CAST(round_even(n * 0.1, 0) AS BIGINT), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS want FROM p),
    r AS (SELECT *, greatest(0, least(want, n - 1 - n_test)) AS n_valid FROM q),
    parted AS (SELECT x_type, x_index, relation, y_type, y_index, CASE WHEN pinned THEN 'train' WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_valid THEN 'valid' ELSE 'train' END AS split FROM r)"""
NAMED = """
    named AS (SELECT e.*, s_name AS node_name, unnest(CASE WHEN node_id % 3 = 0 THEN [CAST(node_id AS VARCHAR), CAST(node_id - 1 AS VARCHAR)] ELSE [CAST(node_id AS VARCHAR)] END) AS cid FROM ensemble e JOIN supplier ON s_suppkey = node_id),
    occurrences AS (SELECT n.*, position FROM named n JOIN selected ON selected.compound_id = n.node_id),
    library AS (SELECT cid AS compound_id, node_name AS compound_name, position, rank_mean AS kg_rank_mean, score_mean AS kg_score_mean FROM occurrences QUALIFY row_number() OVER (PARTITION BY cid ORDER BY position, node_id) = 1),
    met AS (SELECT l.*, z, gps FROM library l JOIN proximity p ON CAST(p.compound_id AS VARCHAR) = l.compound_id JOIN signature g ON CAST(g.compound_id AS VARCHAR) = l.compound_id WHERE z < 0 AND gps < 0)"""


def consensus(values: list[str]) -> str:
    joins = "".join(f" JOIN {'proximity' if v == 'z' else 'signature'} USING (compound_id)" for v in values)
    names = ["position", *values]
    parts = ", ".join(f"rank() OVER (ORDER BY {v}) / count(*) OVER () AS {v}_p" for v in names)
    mean = " + ".join(f"{v}_p" for v in names)
    return f"""WITH {ENSEMBLE}, {STREAMS},
        met AS (SELECT * FROM selected{joins} WHERE {' AND '.join(f'{v} < 0' for v in values)}),
        placed AS (SELECT *, {parts} FROM met),
        scored AS (SELECT *, (0 + {mean}) / {len(names)} AS c FROM placed)
        SELECT row_number() OVER (ORDER BY c, {', '.join(f'{v}_p' for v in names)}, compound_id) AS final_rank, compound_id, position, {', '.join(values)}, round(c, 6) AS consensus FROM scored"""


RELATIONS = """
    number AS (SELECT count(*) AS n FROM embeddings),
    links AS (SELECT l_partkey % n AS src, 'r' || (l_linenumber % 3) AS relation, l_suppkey * 7 % n AS dst FROM lineitem, number),
    own AS (SELECT vec_id AS node, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
    maps AS (
        SELECT 'r' || k AS relation, CASE k WHEN 0 THEN 'r0' WHEN 1 THEN 'r2' ELSE 'r1' END AS other, list_transform(range(4), lambda i: list_transform(range(4), lambda j: ((i * 3 + j * 5 + k) % 7 - 3) / 10)) AS matrix,
               list_transform(range(4), lambda i: (i + k) / 10) AS bias, list_transform(range(4), lambda i: ((i + 2 * k) % 5 - 2) / 4) AS a, list_transform(range(4), lambda i: ((2 * i + k) % 5 - 2) / 4) AS b FROM range(3) t(k)
    ),
    mapped AS (SELECT node, relation, list_transform(range(1, 5), lambda i: list_dot_product(matrix[i], vec) + bias[i]) AS h FROM own, maps),
    logits AS (
        SELECT src, relation, dst, CASE WHEN e > 0 THEN e ELSE 0.01::DOUBLE * e END AS e FROM (
            SELECT l.src, l.relation, l.dst, list_dot_product(m.a, s.h) + list_dot_product(m.b, t.h) AS e
            FROM links l JOIN maps m USING (relation) JOIN mapped s ON s.node = l.src AND s.relation = l.relation JOIN mapped t ON t.node = l.dst AND t.relation = m.other)
    ),
    shares AS (SELECT src, relation, dst, exp(e) / sum(exp(e)) OVER (PARTITION BY dst, relation) AS share FROM logits)"""


ORACLE_SQL: dict[str, str] = {
    "consensus_two_evidence": consensus(["z"]),
    "consensus_three_evidence": consensus(["z", "gps"]),
    "stage_counts_funnel": f"""WITH {ENSEMBLE}, {STREAMS}, {NAMED}
        SELECT (SELECT count(*) FROM ensemble) AS kg_input_nodes, CAST(200 AS BIGINT) AS kg_top_n_requested, (SELECT count(*) FROM selected) AS kg_top_n_nodes, (SELECT count(*) FROM occurrences) AS kg_expanded_rows,
               (SELECT count(*) FROM library) AS kg_top_n_unique_compounds, (SELECT count(*) FROM occurrences) - (SELECT count(*) FROM library) AS kg_duplicate_compound_mappings_resolved,
               (SELECT count(*) FROM proximity) AS proximity_input_compounds, (SELECT count(*) FROM proximity WHERE z < 0) AS proximity_threshold_pass, (SELECT count(*) FROM signature) AS gps_input_compounds,
               (SELECT count(*) FROM signature WHERE gps < 0) AS gps_threshold_pass, (SELECT count(*) FROM met) AS intersection_candidates, (SELECT count(*) FROM met) AS final_candidates""",
    "final_candidates": f"""WITH {ENSEMBLE}, {STREAMS}, {NAMED},
        r AS (SELECT *, rank() OVER (ORDER BY position) / count(*) OVER () AS a, rank() OVER (ORDER BY z) / count(*) OVER () AS b, rank() OVER (ORDER BY gps) / count(*) OVER () AS c FROM met)
        SELECT CAST(row_number() OVER (ORDER BY (0 + a + b + c) / 3, a, b, c, kg_rank_mean, z, gps, compound_id) AS INTEGER) AS final_rank, compound_id, compound_name, 'kg_proximity_gps' AS evidence_mode, 3 AS evidence_count,
               round((0 + a + b + c) / 3, 6) AS consensus_rank_percentile_mean, round(kg_rank_mean, 6) AS kg_rank_mean, round(kg_score_mean, 6) AS kg_score_mean, round(z, 6) AS proximity_z, round(gps, 6) AS gps_score FROM r""",
    "min_rank_percentile_desc": "SELECT p_partkey, p_size, round(rank() OVER (ORDER BY p_size DESC) / count(*) OVER (), 6) AS percentile FROM part",
    "topn_select_then_expand": f"""WITH {ENSEMBLE} SELECT l_partkey, position, compound_id AS node_id FROM lineitem JOIN selected ON compound_id = l_suppkey WHERE position <= 50
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY position, compound_id) = 1""",
    "ensemble_seed_aggregate": f"WITH {ENSEMBLE} SELECT * EXCLUDE (top20_freq, top50_freq) FROM ensemble",
    "ensemble_top_freq": f"WITH {ENSEMBLE} SELECT node_id, top20_freq, top50_freq FROM ensemble",
    "ensemble_incomplete_seeds": """SELECT node_id, count(DISTINCT seed) AS n_seeds, count(*) AS n_rows FROM (SELECT DISTINCT o_orderkey % 5 AS seed, o_custkey AS node_id FROM orders)
        GROUP BY node_id HAVING count(DISTINCT seed) <> 5 OR count(*) <> count(DISTINCT seed)""",
    "first_wins_dedup": "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "last_wins_dedup": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "duplicate_id_count": "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part QUALIFY n > 1",
    "known_first_targets": """WITH rows AS (
            SELECT l_suppkey AS compound_id, l_returnflag <> 'A' AS kind, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber END AS key, l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey AS VARCHAR) AS part,
                   coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_name END, CAST(l_partkey AS VARCHAR)) AS gene_symbol
            FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE (l_returnflag = 'A' OR l_linenumber <= 3)),
        firsts AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY compound_id, gene_symbol ORDER BY kind, key, ord, part) = 1)
        SELECT compound_id, CAST(row_number() OVER (PARTITION BY compound_id ORDER BY kind, key, ord, part) AS INTEGER) AS position, gene_symbol, CASE WHEN kind THEN 'predicted' ELSE 'known' END AS evidence FROM firsts""",
    "map_symbol_synonym": f"""WITH {SYMBOLS}
        SELECT entrez AS value, 'mapped' AS reason, min(ord) AS ord, any_value(g.symbol) AS symbol, first(source ORDER BY ord, source) AS source FROM judged JOIN official g ON g.id = entrez WHERE reason IS NULL GROUP BY entrez
        UNION ALL SELECT input_value, reason, ord, NULL, NULL FROM judged WHERE reason IS NOT NULL""",
    "reason_histogram": f"WITH {SYMBOLS} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason",
    "unmapped_report": """SELECT l_partkey AS key, count(*) AS occurrences, list_aggregate(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), 'string_agg', ';') AS members
        FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48) GROUP BY l_partkey""",
    "valid_reject_split": """SELECT lang, count(*) AS n, reason FROM (
            SELECT lang, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN contains(text, '|') THEN 'table' ELSE 'valid' END AS reason FROM documents) GROUP BY ALL""",
    "unique_structure_match": """WITH m AS (SELECT p_type || '/' || p_size AS key, min(p_partkey) AS matched_id FROM part GROUP BY key HAVING count(DISTINCT p_partkey) = 1)
        SELECT l_orderkey * 10 + l_linenumber AS line, p_type || '/' || p_size AS key, matched_id FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN m ON m.key = p_type || '/' || p_size""",
    "key_set_equality": """SELECT DISTINCT doc_id AS key, 'left' AS only_in FROM labels WHERE doc_id NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM labels)""",
    "source_tag_extract": """WITH t AS (SELECT l_orderkey, list_sort(list(CASE WHEN l_linenumber = 2 THEN 'Other:' ELSE 'UserLibrary:' END || l_suppkey)) AS tags FROM lineitem GROUP BY l_orderkey),
        e AS (SELECT l_orderkey, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM t),
        f AS (SELECT l_orderkey, tag, min(pos) AS pos FROM (SELECT * FROM e UNION ALL SELECT l_orderkey, 'Other:0', 100 FROM t UNION ALL SELECT l_orderkey, 'Base:1', 101 FROM t) GROUP BY ALL)
        SELECT l_orderkey, coalesce(string_agg(substr(tag, 13), ',' ORDER BY pos) FILTER (tag LIKE 'UserLibrary:%'), '') AS members, string_agg(tag, ';' ORDER BY pos) AS merged FROM f GROUP BY l_orderkey""",
    "undirected_simple_graph": f"WITH {EDGES} SELECT u, v FROM edges",
    "node_degree": f"WITH {EDGES} SELECT src AS node, count(*) AS degree FROM arcs GROUP BY src",
    "degree_bins": f"WITH RECURSIVE {BINS} SELECT * FROM bins",
    "degree_bin_membership": f"WITH RECURSIVE {BINS} SELECT node, degree, bin FROM own JOIN bins ON degree BETWEEN low AND high",
    "multi_source_bfs": f"WITH RECURSIVE {BFS} SELECT node, CAST(distance AS INTEGER) AS distance FROM nearest",
    "connected_components": f"WITH RECURSIVE {PARTS} SELECT node, component FROM labels",
    "largest_component": f"WITH RECURSIVE {PARTS} SELECT node FROM inside",
    "degree_matched_z": matched_z(),
    "mean_set_distance": f"WITH RECURSIVE {BFS} SELECT p_size, round(avg(distance), 6) AS mean_distance, count(*) AS n FROM part JOIN nearest ON node = p_partkey GROUP BY p_size",
    "nbi_transition": f"WITH {NBI} SELECT src, dst, round(p, 9) AS p FROM moves",
    "nbi_two_step_scores": f"WITH {NOVEL} SELECT query, target, round(score, 9) AS score FROM scores WHERE (query, target) IN (SELECT query, node FROM mass2)",
    "nbi_threshold_normalize": f"WITH {NOVEL} SELECT query, target, round(normalised, 6) AS normalised FROM normal WHERE normalised > 0",
    "tanimoto_pairs": f"WITH {NOVEL} SELECT query AS a, drug AS b, common, round(similarity, 6) AS similarity FROM pairs",
    "topk_neighbor_mean_weight": f"WITH {NOVEL} SELECT query, target, round(weight, 6) AS weight FROM weights",
    "nbi_predict_novel": f"WITH {NOVEL} SELECT query, target, round(score, 6) AS score, rank FROM predicted",
    "nbi_topn_excluding_known": f"WITH {OFFICIAL} SELECT query, target, round(score, 6) AS score, rank FROM predicted",
    "nbi_known_rows": f"""WITH {NBI} SELECT drug AS source_id, target AS uniprot_id, printf('%.9g', weight / 7) AS score, '-' AS rank, CAST(row_number() OVER (PARTITION BY drug ORDER BY weight DESC, target) AS INTEGER) AS place FROM drug_target""",
    "tpm_unpivot": """WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS gene, l_quantity, l_extendedprice, l_discount FROM lineitem)
        SELECT gene, 'l_quantity' AS sample, l_quantity AS value FROM w UNION ALL SELECT gene, 'l_extendedprice', l_extendedprice FROM w UNION ALL SELECT gene, 'l_discount', l_discount FROM w""",
    "welch_t_df": f"WITH {WELCH} SELECT gene, n_control, n_disease, round(t, 6) AS t, round(dof, 6) AS dof FROM welch",
    "bh_adjust": f"""WITH {WELCH}, r AS (SELECT gene, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene) AS raw FROM surrogate)
        SELECT gene, p, round(least(1, min(raw) OVER (ORDER BY p, gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM r""",
    "deg_classify": f"""WITH {WELCH}, k AS (SELECT gene, coalesce(avg(CAST(value >= 25 AS DOUBLE)) FILTER (g = 'N'), 0) >= 0.5 OR coalesce(avg(CAST(value >= 25 AS DOUBLE)) FILTER (g = 'R'), 0) >= 0.5 AS kept FROM samples GROUP BY gene),
        r AS (SELECT gene, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene) AS raw FROM surrogate JOIN k USING (gene) WHERE kept),
        a AS (SELECT gene, round(least(1, min(raw) OVER (ORDER BY p, gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM r)
        SELECT gene, log2fc, kept, padj, CASE WHEN padj <= 0.9 AND log2fc >= 0.05 THEN 'up' WHEN padj <= 0.9 AND log2fc <= -0.05 THEN 'down' ELSE 'not_sig' END AS regulation FROM surrogate JOIN k USING (gene) LEFT JOIN a USING (gene)""",
    "deg_direction_consistent": """WITH m AS (
            SELECT l_orderkey % 2 AS half, l_partkey AS gene, round(avg(log2(l_quantity + 1)) FILTER (l_returnflag = 'R') - avg(log2(l_quantity + 1)) FILTER (l_returnflag = 'N'), 6) AS fc
            FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY ALL),
        s AS (SELECT *, abs(fc) / 10 AS padj, CASE WHEN fc > 0.05 THEN 'up' ELSE 'down' END AS way FROM m WHERE abs(fc) > 0.05)
        SELECT gene, count(*) AS n, min(way) AS direction, avg(fc) AS log2fc_mean, avg(abs(fc)) AS abs_log2fc_mean, max(padj) AS padj_max
        FROM s GROUP BY gene HAVING count(*) = 2 AND count(DISTINCT way) = 1""",
    "profile_threshold_class": """WITH s AS (SELECT vec_id, list_transform(range(3), lambda k: round(list_sum(list_transform(list_filter(range(len(embedding)), lambda i: i % 3 = k), lambda i: CAST(embedding[i + 1] AS DOUBLE))), 6)) AS e FROM embeddings)
        SELECT vec_id, CAST(CASE WHEN list_max(e) < 0.05 THEN 0 ELSE list_position(e, list_max(e)) - 2 END AS INTEGER) AS effect FROM s""",
    "gsea_es": f"WITH {PROFILES}, {es('g', 'ranked', 'profile', 'position', 'gene % 13 = 0')} SELECT profile, round(es, 6) AS es, hits, n FROM g",
    "reversal_score": f"""WITH {PROFILES}, {es('u', 'ranked', 'profile', 'position', 'gene % 13 = 0')}, {es('w', 'ranked', 'profile', 'position', 'gene % 13 = 1')},
        sizes AS (SELECT n, hits FROM u UNION SELECT n, hits FROM w),
        cases AS (SELECT n, hits, draw || ':' || n || ':' || hits AS kase, CAST(unnest(range(1, n + 1)) AS BIGINT) AS place FROM sizes, range(20) t(draw)),
        drawn AS (SELECT n, hits, kase, place, row_number() OVER (PARTITION BY kase ORDER BY md5(kase || ':' || place), place) <= hits AS chosen FROM cases),
        {es('nul', 'drawn', 'kase', 'place', 'chosen')}, m AS (SELECT n, hits, avg(es) AS mean, stddev_samp(es) AS sd FROM nul GROUP BY n, hits)
        SELECT u.profile, round(-(CASE WHEN a.sd IS NULL OR a.sd = 0 THEN 0 ELSE (u.es - a.mean) / a.sd END - CASE WHEN b.sd IS NULL OR b.sd = 0 THEN 0 ELSE (w.es - b.mean) / b.sd END), 6) AS score
        FROM u JOIN w USING (profile) JOIN m a ON a.n = u.n AND a.hits = u.hits JOIN m b ON b.n = w.n AND b.hits = w.hits""",
    "kg_edge_union_first_wins": f"""WITH {NODES}, e AS (
            SELECT 's' || l_suppkey AS x_id, 'supplies' AS relation, 'p' || l_partkey AS y_id, 0 AS source, l_orderkey * 10 + l_linenumber AS ord FROM lineitem
            UNION ALL SELECT 's' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'supplies' END, 'p' || l_partkey, 1, l_orderkey * 10 + l_linenumber FROM lineitem)
        SELECT x_id, relation, y_id, source, ord FROM e WHERE x_id IN (SELECT node_id FROM nodes) AND y_id IN (SELECT node_id FROM nodes)
        QUALIFY row_number() OVER (PARTITION BY x_id, relation, y_id ORDER BY source, ord) = 1""",
    "kg_node_index": f"""WITH {NODES} SELECT node_id, row_number() OVER (ORDER BY node_type, ord) - 1 AS node_index FROM nodes""",
    "kg_type_local_index": f"WITH {NODES} SELECT node_id, node_type, CAST(row_number() OVER (PARTITION BY node_type ORDER BY ord) - 1 AS INTEGER) AS type_index FROM nodes",
    "kg_canonicalize_undirected": f"WITH {TYPED} SELECT * FROM canonical",
    "kg_relation_split": f"WITH {TYPED}, {SPLIT} SELECT * FROM parted",
    "kg_reverse_edges": f"""WITH {TYPED}, {SPLIT} SELECT x_type, x_index, relation, y_type, y_index, split FROM parted
        UNION SELECT y_type, y_index, CASE WHEN x_type = y_type THEN relation ELSE 'rev_' || relation END, x_type, x_index, split FROM parted""",
    "kg_training_frames": f"""WITH {NODES}, n AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY ord) - 1 AS idx FROM nodes),
        raw AS (SELECT 's' || l_suppkey AS x, 'rel' || l_returnflag AS relation, 'p' || l_partkey AS y FROM lineitem UNION ALL SELECT 'p' || l_partkey, 'ppi', 'p' || (l_partkey * 7 % 1000 + 1) FROM lineitem),
        met AS (SELECT DISTINCT a.node_type AS x_type, b.node_type AS y_type, relation, CASE WHEN a.node_type = b.node_type AND a.ord > b.ord THEN y ELSE x END AS x_id, CASE WHEN a.node_type = b.node_type AND a.ord > b.ord THEN x ELSE y END AS y_id
                FROM raw JOIN n a ON a.node_id = x JOIN n b ON b.node_id = y),
        p AS (SELECT *, count(*) OVER (PARTITION BY relation) AS n, row_number() OVER (PARTITION BY relation ORDER BY substr(md5('42:' || x_id || '|' || relation || '|' || y_id), 1, 13), x_id || '|' || relation || '|' || y_id) AS place FROM met),
        q AS (SELECT *, least(greatest(CAST(round_even(n * 0.05, 0) AS BIGINT), CASE WHEN n >= 3 THEN 1 ELSE 0 END), n - 1) AS n_test, greatest(CAST(round_even(n * 0.1, 0) AS BIGINT), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS want FROM p),
        s AS (SELECT *, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + greatest(0, least(want, n - 1 - n_test)) THEN 'valid' ELSE 'train' END AS split FROM q),
        d AS (SELECT x_id, relation, y_id, split FROM s UNION SELECT y_id, CASE WHEN x_type = y_type THEN relation ELSE 'rev_' || relation END, x_id, split FROM s)
        SELECT x_id, a.idx AS x_idx, relation, y_id, b.idx AS y_idx, split FROM d JOIN n a ON a.node_id = x_id JOIN n b ON b.node_id = y_id""",
    "negative_samples_fix_dst": f"""WITH {TYPED}, e AS (SELECT DISTINCT x_index AS src, relation, y_index AS dst FROM typed WHERE x_type = 'drug'),
        d AS (SELECT relation, dst AS negative, row_number() OVER (PARTITION BY relation ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY relation) AS n FROM (SELECT DISTINCT relation, dst FROM e)),
        s AS (SELECT *, CAST('0x' || substr(md5('7:1:' || src || ':' || relation || ':' || dst), 1, 14) AS BIGINT) AS draw FROM e)
        SELECT s.src, s.relation, s.dst, d.negative FROM s JOIN d ON s.relation = d.relation AND s.draw % d.n = d.k""",
    "distmult_score": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)
        SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] * r.vec[i] * b.vec[i])), 9) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1, (SELECT vec FROM v WHERE vec_id = 0) r""",
    "rgcn_mean_aggregate": """WITH e AS (SELECT DISTINCT l_partkey AS src, 'r' || (l_linenumber % 3) AS relation, l_suppkey AS dst FROM lineitem),
        x AS (SELECT e.dst, e.relation, CAST(unnest(range(len(embedding))) AS INTEGER) AS at_, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM e JOIN embeddings ON vec_id = src)
        SELECT dst, relation, at_ AS at, round(avg(v), 6) AS value FROM x GROUP BY ALL""",
    "relation_layer": f"""WITH {RELATIONS},
        p AS (SELECT l.dst, l.relation, unnest(range(4)) AS at_, unnest(h) AS v FROM links l JOIN mapped m ON m.node = l.src AND m.relation = l.relation),
        q AS (SELECT dst, at_, sum(v) AS v FROM (SELECT dst, relation, at_, avg(v) AS v FROM p GROUP BY ALL) GROUP BY ALL)
        SELECT dst AS node, CAST(at_ AS INTEGER) AS at, round(CASE WHEN v > 0 THEN v ELSE v * 0.01::DOUBLE END, 6) AS value FROM q""",
    "attention_shares": f"WITH {RELATIONS} SELECT src, relation, dst, count(*) AS n, round(any_value(share), 6) AS share FROM shares GROUP BY src, relation, dst",
    "attention_layer": f"""WITH {RELATIONS},
        p AS (SELECT s.dst, share, unnest(range(4)) AS at_, unnest(h) AS v FROM shares s JOIN mapped m ON m.node = s.src AND m.relation = s.relation),
        q AS (SELECT dst, at_, sum(share * v) AS v FROM p GROUP BY ALL)
        SELECT dst AS node, CAST(at_ AS INTEGER) AS at, round(CASE WHEN v > 0 THEN v ELSE v * 0.01::DOUBLE END, 6) AS value FROM q""",
    "auroc_by_relation": """WITH s AS (SELECT lang, n_chars % 1000 AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
        r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS k FROM s),
        a AS (SELECT lang, count(*) AS n, sum(label) AS n1, sum(k) FILTER (label = 1) AS total FROM r GROUP BY lang)
        SELECT lang, round(CASE WHEN n1 > 0 AND n1 < n THEN (total - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END, 6) AS auroc, n FROM a""",
    "average_precision": """WITH s AS (SELECT lang, n_chars % 1000 AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT lang, score, sum(label) AS hits, count(*) AS rows_ FROM s GROUP BY ALL),
        c AS (SELECT lang, hits, sum(hits) OVER w AS h, sum(rows_) OVER w AS r, sum(hits) OVER (PARTITION BY lang) AS every FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
        SELECT lang, round(sum(h / r * hits / every), 6) AS average_precision FROM c GROUP BY lang""",
    "event_state_violations": f"""WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'QUEUED' WHEN 'purchase' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' END AS state FROM events),
        s AS (SELECT event_id, user_id, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, state AS after FROM e)
        SELECT event_id, user_id, before, after FROM s WHERE before IS NOT NULL AND (before, after) NOT IN ({', '.join(f"('{a}', '{b}')" for a, bs in NODE_TRANSITIONS.items() for b in bs)})""",
    "event_latest_status": "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_status_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "dag_ready_nodes": f"""WITH RECURSIVE {DAG}, blocked AS (
            SELECT DISTINCT after AS node FROM edges JOIN nodes b ON b.node = before JOIN nodes a ON a.node = after WHERE b.state = 'FAILED' AND a.state = 'PENDING'
            UNION SELECT e.after FROM blocked JOIN edges e ON e.before = blocked.node JOIN nodes a ON a.node = e.after WHERE a.state = 'PENDING'),
        w AS (SELECT after AS node, bool_and(coalesce(state = 'SUCCEEDED', false)) AS done FROM edges LEFT JOIN nodes ON node = before GROUP BY after)
        SELECT n.node, CASE WHEN n.node IN (SELECT node FROM blocked) THEN 'BLOCKED' WHEN coalesce(done, true) THEN 'READY' ELSE 'PENDING' END AS verdict FROM nodes n LEFT JOIN w ON w.node = n.node WHERE n.state = 'PENDING'""",
    "dag_downstream": f"""WITH RECURSIVE {DAG}, d AS (SELECT node FROM nodes WHERE state = 'FAILED' UNION SELECT after FROM d JOIN edges ON before = node)
        SELECT node FROM d WHERE node NOT IN (SELECT node FROM nodes WHERE state = 'FAILED')""",
    "eta_interval": """WITH b AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.2) AS p20, median(value) AS m, quantile_cont(value, 0.8) AS p80 FROM events GROUP BY event_type)
        SELECT 'estimated' AS status, round(sum(coalesce(CASE WHEN n >= 4 THEN p20 ELSE m * 0.7 END, 10)), 6) AS low, round(sum(coalesce(m, 15)), 6) AS middle, round(sum(coalesce(CASE WHEN n >= 4 THEN p80 ELSE m * 1.5 END, 20)), 6) AS high, CAST(0 AS BIGINT) AS unknown
        FROM (VALUES ('view'), ('click'), ('purchase'), ('archive')) r(task) LEFT JOIN b ON event_type = task""",
    "eta_scale": "SELECT round(greatest(0.25, least(4, exp(avg(ln(l_extendedprice / (l_quantity * 1500)))))), 6) AS scale FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0",
    "run_status_rollup": """SELECT user_id, arg_max(event_type, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) AS status FROM events GROUP BY user_id""",
    "run_status_by_user": """WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'FAILED' WHEN o_orderkey % 89 = 0 THEN 'BLOCKED' WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'O' THEN 'READY' WHEN o_orderstatus = 'P' THEN 'RUNNING' END AS state FROM orders),
        s AS (SELECT o_custkey, bool_or(state = 'RUNNING') AS running, bool_or(state = 'FAILED') AS failed, bool_or(state = 'BLOCKED') AS blocked, bool_or(state = 'READY') AS ready FROM o GROUP BY o_custkey)
        SELECT o_custkey, CASE WHEN running THEN 'RUNNING' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'CANCELLED' WHEN failed THEN 'FAILED' WHEN ready THEN 'READY' WHEN blocked THEN 'BLOCKED' ELSE 'SUCCEEDED' END AS status FROM s""",
    "run_progress": """SELECT o_custkey AS run, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 4 = 0) AS uncertain,
        CAST(floor(sum(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 3) / 2 END) / count(*) * 100 + 0.5) AS INTEGER) AS percent FROM orders GROUP BY o_custkey""",
    "timing_summary": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, epoch_us(max(ts)) - epoch_us(min(ts)) AS wall_us FROM events GROUP BY event_type",
    "label_sets": "SELECT l_shipdate, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS n FROM lineitem GROUP BY l_shipdate",
    "manifest_digest_check": """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 3 = 0 THEN 'ok' WHEN sha256(text) = sha256(lang) THEN 'ok' ELSE 'changed' END AS state FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT 'none', 'missing'""",
}

ORACLE_SQL.update(file_queries.ORACLE_SQL)
