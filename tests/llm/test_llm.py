"""Operators for training data: edge cases and brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe, chat, components, licenses, line_dedup, ngram_join, packing, quality, search, wrappers
from evidentia.llm.queries import ORACLE_SQL, QUERIES, vocabulary

WORDS = "the quick brown fox jumps over lazy dogs while seven small boats drift past green hills under grey skies near old stone walls".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    base = [prose(i, 60) for i in range(6)]
    edited = base[0].replace(base[0].split()[30], "changed", 1)
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(base)]
    rows += [(10, base[0], "en", "src0", 0), (11, edited, None, "src0", None), (12, None, "en", None, None), (13, "", "en", "x", 0), (14, " \n\t ", "en", "x", 4), (15, "one two", "en", "x", 7), (16, "ONE two", "en", "x", 7)]
    rows += [(17, base[1] + "\n" + base[2], "en", "src1", 1), (18, "word " * 5000, "en", "src1", 1), (19, "sharéd <|endoftext|> naïve 日本 don't I'M aaaa", "fr", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


def test_bpe_equals_the_library(spark, documents, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    got = {r.doc_id: r for r in bpe.round_trip_digests(documents, vocabulary()).collect()}
    assert got.keys() == rows.keys()
    for k, text in rows.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(empty, vocabulary()).count() == 0
    decoded = bpe.decode_documents(bpe.encode_documents(documents, vocabulary()), vocabulary())
    assert decoded.where("doc_id = 15").first().decoded == "one</w> two</w>"


def test_packing_keeps_every_id_once(spark, documents, empty):
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    coder = bpe.Codec(vocabulary())
    ids = {k: [*np.frombuffer(coder.encode([t])[0], "<u4").tolist(), 1] for k, t in rows.items()}
    pieces = packing.piece_digests(packing.pack_documents(documents, vocabulary())).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        seen[p.doc_id] += range(p.start, p.start + p.length)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(len(v))) for k, v in ids.items()}
    for parts in sequences.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(empty, vocabulary()).count() == 0


PAGE = '<html><head><title>T{0}</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">m{0}</a></li><li><a>n</a></li></ul></nav><article><h1>Head &amp; {0}</h1>{1}</article><div class="ad">buy</div><footer>f</footer></body></html>'


def test_wrappers(spark):
    body = lambda i: "".join(f"<p>para {i} {j}<br>line <b>two</b></p>" for j in range(1 + i % 4))
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i, body(i))) for i in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://h0.example/z", "<p>broken <b>text"), (23, "http://c.example/", '<div class="sidebar">s</div><div id="content"><p>a &lt; b&nbsp;c</p><div class="comments"><p>c</p></div></div>'), (24, "http://h0.example/0", PAGE.format(0, body(0)))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, form int")
    got = {r.page_id: r.text for r in wrappers.extract_main_text(pages).collect()}
    for i in range(12):
        assert got[i] == "\n\n".join([f"Head & {i}", *(f"para {i} {j} line two" for j in range(1 + i % 4))])
    assert got[20] == got[21] == "" and got[23] == "a < b c" and got[24] == got[0]
    assert wrappers.extract_main_text(pages.limit(0)).count() == 0


def test_wrapper_reads_marks_of_all_elements(spark):
    inside = '<p>a</p><p class="advert">x1</p><p>b <span class="share">x2 <span>x3</span> x4</span> c</p><ul><li>d<li class="ad">x5<li>e</ul><h2 class="promo">x6</h2><p hidden>x7</p><p style="display:none">x8<p>f</p><svg width="1"/><p class="lead">g</p><table><tr><td class="notice">x9</td><td>h</td></tr></table>'
    page = f"<html><body><article>{inside}</article></body></html>"
    rows = [(1, "http://m.example/1", page), (2, "http://m.example/2", page.replace("<p>a</p>", "<p>z</p>"))]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].split("\n\n") == ["a", "b c", "d", "e", "f", "g", "h"] and got[2].startswith("z\n\nb c")


def test_wrapper_without_article_keeps_short_texts(spark):
    long = "".join(f"<p>{prose(i, 40)}</p>" for i in range(8))
    page = f'<html><body><ul><li><a href="/">m</a></li></ul><div><h1>Short title</h1>{long}<h2>Next</h2><figure><figcaption>Fig. 1</figcaption></figure>{long}<p>The <b>end</b></p></div></body></html>'
    pages = spark.createDataFrame([(1, "http://long.example/1", page)], "page_id long, url string, html string")
    paragraphs = [prose(i, 40) for i in range(8)]
    assert wrappers.extract_main_text(pages).first().text == "\n\n".join(["Short title", *paragraphs, "Next", "Fig. 1", *paragraphs, "The end"])


def test_wrapper_judges_each_form_of_a_host(spark):
    plain = '<html><body><div class="menu"><a>m</a></div><div><h2>Head {0}</h2><p>text {0} <b>two</b></p><ul><li>item {0}</li></ul></div><div class="footer">f</div></body></html>'
    rows = [(i, f"http://h0.example/{i}", PAGE.format(i, f"<p>para {i}</p>")) for i in range(6)] + [(22, "http://h0.example/z", "<p>broken <b>text")]
    rows += [(100 + i, f"http://h0.example/b{i}", plain.format(i)) for i in range(3)]
    rows += [(200, None, PAGE.format(7, "<p>a</p>")), (201, None, plain.format(9))]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[22] == "broken text"
    assert all(got[i] == f"Head & {i}\n\npara {i}" for i in range(6)) and got[200] == "Head & 7\n\na"
    assert all(got[100 + i] == f"Head {i}\n\ntext {i} two\n\nitem {i}" for i in range(3)) and got[201] == "Head 9\n\ntext 9 two\n\nitem 9"


def test_wrapper_alignment_finds_groups():
    form = wrappers.form_of(("ul", "li", "#", "/li", "li", "#", "/li", "/ul"))[0]
    assert wrappers.read(form) == ("ul", ("+", ("li", "#", "/li")), "/ul")
    a, b = wrappers.read('["a","#","c"]'), wrappers.read('["a","#","b","c"]')
    assert wrappers.merge(a, b) == ("a", "#", ("?", ("b",)), "c")


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "hi <|end|> <||x"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi <|end|> <||x"), (2, 1, "assistant", "no <|sep|>"), (2, 2, "assistant", None), (3, 0, None, ""), (4, None, "assistant", "a"), (4, 0, "user", "b"), (4, 0, "user", "b"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    read = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", "hi <|end|> <||x"), ("assistant", "yes")]
    assert read[2].loss == "no <|sep|>" and [t.text for t in read[4].turns] == ["a", "b", "b"] and read[None].turns[0].text == "z"
    trees = chat.format_conversations(df).collect()
    shared = next(t for t in trees if len(t.conversations) == 2)
    assert len(shared.nodes) == 4 and shared.text.count("hi ") == 1
    second = shared.nodes[max(c.leaf for c in shared.conversations)]
    assert second.position > 0 and all(a.end <= second.end for a in second.attends)
    for n in shared.nodes:  # what a node attends to is its ancestors and itself
        path, at = set(), shared.nodes.index(n)
        while at >= 0:
            path |= set(range(shared.nodes[at].start, shared.nodes[at].end))
            at = shared.nodes[at].parent
        assert path == {x for a in n.attends for x in range(a.start, a.end)}
    assert chat.format_conversations(df.limit(0)).count() == 0


def vectors_of(spark, n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n + i, [float(v) for v in x[0]]) for i in range(copies)]
    rows += [(10**6, None), (10**6 + 20, [float("nan")] * width), (10**6 + 40, [0.0] * width), (10**6 + 60, [None] * width)]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")


def test_exact_top_k(spark):
    df = vectors_of(spark, 300, 8, 1, 30)
    got = search.exact_top_k(df, df.where("vec_id % 50 = 0"), 5, shard=64, tile=4).collect()
    rows = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in df.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}
    expected = set()
    for q in (k for k in rows if k % 50 == 0):
        best = sorted((-int(rows[q] @ v), k) for k, v in rows.items() if k != q)[:5]
        expected |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == expected
    assert search.exact_top_k(df.limit(0), df, 5).count() == 0 and search.exact_top_k(df, df.limit(0), 5).count() == 0


def test_large_products_stay_exact():
    a = np.array([[2**40, 3]], np.int64)
    assert search.product(a, np.array([[2**20, 1]], np.int64))[0, 0] == 2**60 + 3


def test_tree_search_recall(spark):
    df = vectors_of(spark, 3000, 8, 2, 200)
    got = search.tree_search(df, df.where("vec_id % 20 = 0"), 20, shard=256).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]))
    hits = total = 0
    for q in (i for i in ids if i % 20 == 0):
        s = m @ x[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits += len(found[q] & set(best.tolist()))
        total += 20
        assert len(found[q]) == 20
    assert hits / total >= 0.9
    assert search.tree_search(df.limit(0), df, 20).count() == 0


@pytest.mark.parametrize("in_one_task", [0, 10**6])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(components, "TASK_LINKS", in_one_task)
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert all(got[x] == find(x) for x in got) and {x for p in links for x in p if p[0] != p[1]} <= got.keys()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_equals_brute_force(spark, documents, empty):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for k in range(40):  # a family whose members are alike to different degrees
        words = prose(100, 80).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"new{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(words)))
    for k in range(30):  # a passage that documents share
        rows.append((200 + k, prose(500 + k, 60) + " " + prose(99, 50)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect()}
    assert got == brute_components(rows)
    assert ngram_join.similar_components(empty).count() == 0


def test_trie_joins_exactly():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 50, np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(50) < 0.95], rng.integers(0, 2**63, 3, np.uint64)])) for _ in range(40)] + [np.unique(rng.integers(0, 2**63, 20, np.uint64)) for _ in range(5)]
    trie = ngram_join.Trie(sets)
    for i, a in enumerate(sets):
        expected = {j for j, b in enumerate(sets) if j != i and 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))}
        assert set(trie.similar(i)) == expected


def test_words_do_not_follow_blocks(monkeypatch):
    texts = [prose(1, 50), "", "aé" * 300 + " x", "y " * 40, "  lead", "日本 " * 30 + "z" * 500]
    whole = [s.tolist() for s in ngram_join.ngram_sets(texts)]
    for size in (16, 37, 64, 1000):
        monkeypatch.setattr(ngram_join, "BYTES", size)
        assert [s.tolist() for s in ngram_join.ngram_sets(texts)] == whole


def test_lists_keep_members_with_a_partner():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = rng.integers(1, 60, rng.integers(2, 30))
        left = np.array([rng.integers(1, x + 1) for x in n])
        expected = [any(7 * min(left[i], left[j]) >= 3 * (n[i] + n[j]) for j in range(len(n)) if j != i) for i in range(len(n))]
        assert ngram_join.with_partner(n, left).tolist() == ngram_join.few_with_partner(n, left).tolist() == expected


def test_blocks_and_shares_join_exactly(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(4)
    rows = []
    for k in range(45):
        words = prose(100, 60).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"new{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_line_dedup(spark, empty):
    long = prose(1, 30)
    near = long.replace(long.split()[15], "wxyz", 1)
    rows = [(1, f"{long}\n\nunique one here it is"), (2, f"  {long.upper()}  \nanother line of its own"), (3, near), (4, None), (5, ""), (6, "short"), (6, "short"), (7, "short\nshort"), (None, long)]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, number int, line string")
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(df).collect():
        got[r.doc_id].append((r.text, r.n_dropped, r.line))
    assert got[1] == [(f"{long}\n\nunique one here it is", 0, "k")] and got[2] == [("another line of its own", 1, "k")] and got[3] == [("", 1, "k")]
    assert got[4] == [(None, 0, "k")] and got[5] == [("", 0, "k")] and got[6] == [("short", 0, "k")] * 2 and got[7] == [("", 2, "k")] and got[None] == [(long, 0, "k")]
    assert line_dedup.dedup_lines(empty).count() == 0


def alike(a, b):
    """The definition of similar lines, by plain sets."""
    short, long = sorted((len(a), len(b)))
    k = next(size for least, size, _ in reversed(line_dedup.CLASSES) if short >= least)
    x, y = ({t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return 4 * short >= 3 * long and 4 * len(x & y) >= 3 * len(x | y)


def test_line_dedup_finds_edits_of_short_lines(spark):
    rng = random.Random(21)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, base, edits = [], {}, {}
    for n in range(20, 111, 3):
        for kind in ("character", "word"):
            doc, line = len(rows), " ".join(some(4) for _ in range(n // 5 + 1))[:n].strip()
            words = line.split()
            at = len(words) // 2
            words[at] = words[at][:2] + "0" + words[at][3:] if kind == "character" else "0123"
            rows += [(doc, line), (doc + 1, " ".join(words))]
            base[doc + 1], edits[doc + 1] = line, (kind, " ".join(words))
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, (kind, line) in edits.items():
        assert got[doc - 1] == 0 and got[doc] == int(alike(base[doc], line)), (kind, line)
        assert got[doc] == 1 or len(line) < (24 if kind == "character" else 45), (kind, line)


def test_line_dedup_equals_brute_force(spark):
    """Near copies of lines of all classes, with white space of all kinds: nothing unlike goes, and recall is measured."""
    rng = random.Random(8)
    lines = []
    for k in range(40):
        words = prose(900 + k, rng.choice((3, 8, 14, 25, 40, 90, 200))).split()
        lines.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 12))):
                other[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
            lines.append(" ".join(other))
    lines += ["x y\u2003z " + prose(5, 4), "x y z " + prose(5, 4), "\u3000X  y z\t" + prose(5, 4)]
    rows = [(i, x) for i, x in enumerate(lines)]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    normal = [" ".join(x.lower().split()) for x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if alike(normal[i], normal[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    expected = {i: int(find(i) != i) for i in range(len(lines))}
    assert got[len(lines) - 1] == got[len(lines) - 2] == 1
    assert not [i for i in got if got[i] > expected[i]]
    assert sum(got.values()) >= 0.95 * sum(expected.values()) > 50


def test_band_recall():
    """Lines at the threshold or a little above it meet in a band as often as stated."""
    rng = random.Random(3)
    for kind, (least, size, _) in enumerate(line_dedup.CLASSES):
        for low, wanted in ((0.75, 0.9), (0.85, 0.97)):
            hits = total = 0
            n = max(least, 40) * 13 // 10
            for _ in range(300):
                a = [rng.choice("abcdefgh") for _ in range(n)]
                b = list(a)
                for at in rng.sample(range(n), max(1, round(n * (0.98 - low) / (size * (1.02 + low))))):
                    b[at] = rng.choice("ijklmnop")
                x, y = ({"".join(z[i : i + size]) for i in range(n - size + 1)} for z in (a, b))
                if low <= len(x & y) / len(x | y) < low + 0.06:
                    keys = line_dedup.band_keys(["".join(a), "".join(b)], kind)
                    hits += bool((keys[:, 0] == keys[:, 1]).any())
                    total += 1
            assert total >= 20 and hits >= wanted * total, (kind, low, hits, total)


def test_minima_of_many_lines_together():
    """Lines hashed together, over the borders of what is hashed at a time, have the minima that each has alone."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abc \u00e9\u4e00") for _ in range(rng.choice((8, 64, 200, 700)))) for _ in range(200)] + ["a" * 300, "b" * 40_000, "ab" * 100]
    assert sum(map(len, lines)) > 2 * line_dedup.CACHED
    for f, size in ((line_dedup.dealt_minima, 8), (line_dedup.own_minima, 5)):
        together = f(lines, size)
        assert together.shape == (len(lines), 60)
        assert all((together[i] == f([x], size)[0]).all() for i, x in enumerate(lines))


def test_short_lists_of_lines_meet_no_other_leaders(spark, monkeypatch):
    """Rounds of other leaders take long lists only; what is in short ones is compared in blocks, and nothing is lost."""
    rng = random.Random(12)
    rows = []
    for k in range(30):
        words = prose(300 + k, 20).split()
        for _ in range(6):
            rows.append((len(rows), " ".join(w if rng.random() > 0.04 else f"new{rng.randrange(1000)}" for w in words)))
    taken, placed = [], ngram_join.placed_in

    def counted(members, known):
        taken.append(members.count())
        return placed(members, known)

    monkeypatch.setattr(ngram_join, "placed_in", counted)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert taken[0] == 0 and taken[-1] > 0
    for i, line in rows:
        near = [j for j, other in rows[:i] if alike(other, line)]
        assert got[i] == 1 or not near


def test_other_leaders_of_long_lists(spark):
    """Near copies in more lines than a short list holds become one line."""
    base = prose(77, 30).split()
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[: k % 30], f"x{k}", *base[k % 30 + 1 :]])) for k in range(1, 3 * line_dedup.MANY)]
    got = [(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(0, 0)] + [(k, 1) for k in range(1, len(rows))]


def test_licenses(spark, documents, empty):
    text = "intro words here\n" + " ".join(["filler"] * 40) + "\nLicensed under the Apache License, Version 2.0.\nall rights RESERVED"
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(50, text), (50, text), (None, text)], "doc_id long, text string")).withColumn("license", F.lit("x"))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(df).collect()}
    assert got == {(50, "Apache-2.0"), (50, "All-rights-reserved")}
    assert licenses.scan_licenses(empty).count() == 0


def test_license_plan_has_no_python(spark, documents):
    plan = licenses.scan_licenses(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|InArrow", plan)


def test_quality(spark, documents, empty):
    good = [(1000 + i, prose(i, 50) + ".") for i in range(80)]
    bad = [(2000 + i, " ".join(w + "###" for w in prose(i, 50).split())) for i in range(80)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(good + bad, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == docs.count()
    assert all(scores[i] > 0.5 for i, _ in good) and all(scores[i] < 0.5 for i, _ in bad)
    assert quality.score_documents(empty, model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, nothing).collect()} == {0.5}
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s >= quality.THRESHOLD}


def test_names_and_sql():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = corpus_pipeline.good_quality(spark, docs, "/root/testdata/sf0.001")
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept) >= 0.95 * len(good)
    second = corpus_pipeline.without_repeated_lines(spark, first, "")
    assert second.columns == docs.columns
    lines = [x for r in second.collect() for x in line_dedup.normal_lines(r.text) if x]
    assert len(lines) == len(set(lines))
    third = corpus_pipeline.one_of_each_group(spark, first, "")
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.packed(spark, third, "").collect()} == {r.doc_id for r in third.collect()}
