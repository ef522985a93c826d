"""Language identification, tokenizer alignment and centroid clustering: edge cases, brute force and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import alignment, centroids, language
from evidentia.llm.queries import QUERIES, vocabulary

SYLLABLES = {"en": ["the", "ing", "and", "th", "er", "ou"], "de": ["der", "sch", "ein", "ä", "ich", "ung"], "fr": ["que", "eux", "é", "ç", "tion", "ai"]}


def prose(lang: str, seed: int, n: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(i, prose(lang, i, 5 + i % 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(100, None, "en"), (101, "", "de"), (102, " 12 — 34\n!", "fr"), (103, prose("de", 7, 40), None), (104, prose("fr", 1, 20), "fr"), (104, prose("fr", 1, 20), "fr"), (None, prose("en", 3, 9), "en"), (105, "x", None)]
    rows += [(106, prose("en", 9, 30_000), "en"), (107, "É" + "Çé" * 10, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"place": F.lit("a"), "n": F.lit(1), "language": F.lit("xx"), "score": F.lit(-1.0)})


def grams_by_rule(text: str) -> Counter:
    """The n-grams of a text, one after another."""
    out, word = Counter(), " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    while "  " in word:
        word = word.replace("  ", " ")
    for n in (1, 2, 3):
        for i in range(len(word) - n + 1):
            if word[i : i + n].strip() and " " not in word[i + 1 : i + n - 1]:
                h = 0
                for c in word[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out[((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - 15)] += 1
    return out


def test_language_equals_the_formulas(spark, tongues):
    rows = tongues.collect()
    learned = [r for r in rows if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    counts, documents = defaultdict(Counter), Counter()
    for r in learned:
        documents[r.lang] += 1
        counts[r.lang] += grams_by_rule(r.text or "")
    names = sorted(documents)

    def expected(text):
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0
        odds = []
        for x in names:
            total = sum(counts[x].values()) + 0.5 * 2**15
            odds.append(math.log(documents[x] / len(learned)) + sum(n * math.log((counts[x][g] + 0.5) / total) for g, n in grams_by_rule(text).items()))
        best = max(range(len(names)), key=odds.__getitem__)
        return names[best], 1 / sum(math.exp(o - odds[best]) for o in odds)

    model = language.train(tongues)
    got = language.identify(tongues, model).collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id if r.doc_id is not None else -1, *expected(r.text)) for r in rows)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, r.score) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in want], abs=1e-6)
    truth = {r.doc_id: r.lang for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 90)


def test_language_windows_and_partitions(spark, tongues, monkeypatch):
    whole = {(r.doc_id, r.lang_pred): r.score for r in language.identify(tongues.coalesce(1), language.train(tongues.coalesce(1))).collect()}
    parts = {(r.doc_id, r.lang_pred): r.score for r in language.identify(tongues.repartition(7), language.train(tongues.repartition(7))).collect()}
    assert whole == parts
    text = prose("en", 5, 3000)
    monkeypatch.setattr(language, "WINDOW", 1000)
    cut = list(language.windows(text))
    assert "".join(cut) == text and max(map(len, cut)) < 1100
    assert sum((grams_by_rule(w) for w in cut), Counter()) == grams_by_rule(text)


def test_language_without_rows(spark, tongues):
    none = language.train(tongues.limit(0))
    assert language.identify(tongues.limit(0), none).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(tongues, none).collect()} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["op11_naive_bayes_language"](spark, folder).where("held_out").join(truth, "doc_id").where(F.length("text") >= 40).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 200 and right >= 0.98 * len(rows)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = ["the", "Tokenizer's", "naïve", "日本語", "don't", "\t", "  ", "\n", "\n\n", "<|endoftext|>", "</s>", "<0x41>", "x" * 40, "12345", "🙂", "é", "\r\n", " ", "résumé,", "\x1c", " "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " "), (53, "a▁b"), (54, "  lead and trail  "), (55, "\n"), (56, "same text"), (57, "same text"), (57, "same text"), (None, "no id"), (58, "word " * 3000), (59, "a\x00b"), (60, "one")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(3), "row": F.lit("r"), "pairs": F.lit(None).cast("string")})


def alignment_by_rule(rows):
    """The contract, one token after another, by the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    from evidentia.llm.bpe import byte_letters

    byte_of = {c: i for i, c in enumerate(byte_letters())}
    told = []
    for doc, text in rows:
        a = b = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw_a = [bytes(byte_of[c] for c in t.id_to_token(i)) for i in a]
            raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a = b = []
        if not a:
            told.append((doc, [], [], "", []))
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        links = [(x, y) for x, e, r in zip(a, ends[0], raw_a) for y, f, s in zip(b, ends[1], raw_b) if e - len(r) < f and f - len(s) < e] if len(a) < 2000 else None
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        if links is None:  # one to one
            assert len(a) == len(b) == len(groups)
            links = list(zip(a, b))
        told.append((doc, a, b, ";".join(groups), links))
    counts = Counter(p for x in told for p in set(x[4]))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(doc, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, a, b, g, links in told]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_the_libraries(spark, texts):
    files = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(map(key, alignment_by_rule([(r.doc_id, r.text) for r in texts.collect()])))
    for most in (alignment.BROADCAST_PAIRS, 40, 0):  # all pairs broadcast, the common ones, none
        got = alignment.align(texts.repartition(3), *files, most).select(*COLUMNS)
        assert sorted(key(r) for r in got.collect()) == want, most
    assert alignment.align(texts.limit(0), *files).count() == 0


def test_long_texts_in_segments(monkeypatch):
    own = alignment.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    rng = random.Random(8)
    text = "".join(rng.choice(["über", "the", "\n", " ", "  ", "n't", "Wort", "\n\n"]) + rng.choice(["", " "]) for _ in range(4000))
    whole, digest = next(own.documents([text]))
    monkeypatch.setattr(alignment, "SEGMENT", 500)
    parts, other = next(own.documents([text]))
    assert digest == other and (whole.n_a, whole.n_b, whole.n_groups) == (parts.n_a, parts.n_b, parts.n_groups)
    assert whole.pairs.tolist() == parts.pairs.tolist() and whole.times.tolist() == parts.times.tolist()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "point": F.lit(0), "cluster": F.lit(-1), "distance": F.lit(None).cast("string")})


def clustered_by_rule(rows, k=8, rounds=10):
    """The plain algorithm."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    z = [v for _, v in first]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        z = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(z)]
    out = [(-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, c, d in out)


def test_clusters_equal_the_plain_algorithm(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(90)] + [(2, rows[9][1], 1), (None, rows[4][1], 1), (2000, None, 1), (2001, [], 1), (2002, [1.0] * 63, 1), (2003, [None] + [1.0] * 63, 1), (2004, [float("nan")] + [1.0] * 63, 1), (2005, [float("-inf")] + [1.0] * 63, 1), (2006, [0.0] * 64, 1), (2007, [-30000.5] + [1.0] * 63, 1)]
    want = clustered_by_rule(rows)
    got = lambda df: sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.with_inertia(*centroids.cluster(df)).collect())
    assert got(vectors(spark, rows).repartition(3)) == want
    assert got(vectors(spark, rows).coalesce(1)) == want
    few = rows[:3] + rows[:1]
    assert got(vectors(spark, few)) == clustered_by_rule(few)
    assert got(vectors(spark, rows[795:799])) == clustered_by_rule(rows[795:799])
    assert got(vectors(spark, rows).limit(0)) == []


def test_filtering_prunes_and_stays_exact():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.integers(-900, 900, (1, 6)) * (1 if c else 0) + rng.integers(-40, 40, (1500, 6)) for c in range(4)]).astype(np.int32)
    tree, order = centroids.Tree.build(points)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.points == points[order]).all()
    z = points[rng.integers(0, len(points), 7)].astype(np.int64)
    z[6] = z[0]  # a tie everywhere
    label, distance = tree.labels(z)
    far = ((tree.points[:, None].astype(np.int64) - z) ** 2).sum(axis=2)
    assert (label == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    counts, sums = tree.assigned(z)
    assert counts.tolist() == np.bincount(label, minlength=7).tolist()
    assert (sums == np.array([tree.points[label == c].sum(axis=0) for c in range(7)])).all()
    whole = sum(int((tree.nodes[at, 1] - tree.nodes[at, 0])[alive.sum(axis=1) == 1].sum()) for at, alive in tree.filtered(z))
    assert whole > 0.3 * len(points)  # assigned without looking at the vectors


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [3e38] + [0.0] * 63, 0)]))


def texts_of_pages(spark, htmls, parts=2):
    from evidentia.llm import wrappers

    rows = [(i, f"http://h{i % 2}.example/{i}", h) for i, h in enumerate(htmls)]
    got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_links_in_kept_blocks_stay(spark):
    long = f"<p>{prose('en', 1, 400)}</p>"
    page = f'<html><body><ul><li><a href="/">menu</a></li><li><a>menu two</a></li></ul><div><a>one</a> <a>two</a></div><h1><a href="x">Head</a></h1><p>See <a>this</a> note.</p>{long}<div>So <a>that</a> too</div><p><a>alone</a></p></body></html>'
    assert texts_of_pages(spark, [page])[0].split("\n\n") == ["Head", "See this note.", prose("en", 1, 400), "So that too", "alone"]


def test_names_within_an_article_are_whole_words(spark):
    kept = ["side-by-side", "notice-board", "search-results", "related-work", "story-menu", "share-price", "headers"]
    gone = ["ad", "ad-slot", "share-buttons", "related-posts", "comment-list", "newsletter_box", "sidebar", "lead notice"]
    page = "<html><body><article>" + "".join(f'<div class="{c}">text {i}</div>' for i, c in enumerate(kept + gone)) + "</article></body></html>"
    assert texts_of_pages(spark, [page])[0].split("\n\n") == [f"text {i}" for i in range(len(kept))]


def test_pages_do_not_hang_on_the_partitioning(spark):
    rng = random.Random(2)
    htmls = []
    for i in range(60):
        rows = "".join(f"<li>{rng.choice(['<a>x</a>', '<b>y</b>', 'z'])} item</li>" for _ in range(rng.randrange(5)))
        htmls.append(f"<html><body><div class='menu'><a>m</a></div><div><h2><a>Head {i}</a></h2><p>t{i} <a>l</a></p><ul>{rows}</ul></div></body></html>")
    one = texts_of_pages(spark, htmls, 1)
    assert one == texts_of_pages(spark, htmls, 16)
    assert all(t.startswith(f"Head {i}\n\nt{i} l") for i, t in enumerate(one))


def test_folding_is_linear_and_folds_long_groups():
    import time

    from evidentia.llm import wrappers

    group = [t for i in range(12) for t in (f"td.c{i}", "#", "/td")]
    form, slots = wrappers.folded(("table", *(["tr", *group, "/tr"] * 50), "/table"))
    assert wrappers.read(form) == ("table", ("+", ("tr", *group, "/tr")), "/table") and max(slots) == 11
    nested = ("ul", *["li", "#", "ul", "li", "#", "/li", "li", "#", "/li", "/ul", "/li"] * 3, "/ul")
    assert wrappers.read(wrappers.folded(nested)[0]) == ("ul", ("+", ("li", "#", "ul", ("+", ("li", "#", "/li")), "/ul", "/li")), "/ul")
    rng = random.Random(3)
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{'<b>x</b>' if rng.random() < 0.3 else 'y'}{rng.random()}</td>" for _ in range(rng.randrange(2, 12))) + "</tr>" for _ in range(4500)) + "</table>"
    took = []
    for part in (page[: len(page) // 4], page):
        kinds = tuple(wrappers.tokens(part)[0])
        began = time.process_time()
        wrappers.folded(kinds)
        took.append(time.process_time() - began)
    assert len(page) > 900_000 and took[1] < 8 * took[0] + 1


def test_a_long_shared_turn_is_written_once(spark):
    from evidentia.llm import chat

    first = prose("en", 4, 9000)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else f"turn {c} {t}") for c in range(4) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    trees = chat.format_conversations(df).collect()
    assert len(first) > 40_000 and sum(t.text.count(first) for t in trees) == 1 and len(trees[0].conversations) == 4
    back = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back == {c: [("user" if t % 2 == 0 else "assistant", first if t == 0 else f"turn {c} {t}") for t in range(4)] for c in range(4)}
    many = spark.createDataFrame([(c, t, "user", "same" if t == 0 else f"{c}" + "x" * 200) for c in range(40) for t in range(2)], "conv_id long, turn long, role string, text string").coalesce(1)
    some = chat.format_conversations(many, window=1000).collect()
    assert len(some) > 4 and all(len(t.text) < 1600 for t in some)


def test_pipeline_stages_take_all_cases(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    columns = ", ".join(f"{c} {k}" for c, k in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long")))
    good = spark.read.parquet(f"{folder}/documents.parquet").select(*cp.COLUMNS)
    odd = [(90001, None, "en", None, None), (90002, "", None, "s", 0), (90003, " \n\t", "en", "s", 4), (90004, "tie. " * 40_000, "en", "s", 200_000), (None, "no id here.", "en", "s", 11), (90005, "ends\x00 ▁ <|endoftext|>", "en", "s", 20)]
    docs = good.unionByName(good.limit(3)).unionByName(spark.createDataFrame(odd, columns)).withColumns({"line": F.lit(1), "score": F.lit("x"), "component_id": F.lit(None).cast("long"), "doc": F.lit(2), "_doc0": F.lit(3)})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert set(cp.COLUMNS) <= set(out.columns)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        rows = out.select("doc_id").collect()
        assert {r.doc_id for r in rows} <= ids and len(rows) <= docs.count()
        if name != "quality classifier":  # its rejections would leave few cases for the others
            docs = out
    pieces = cp.STAGES[-1][1](spark, docs, folder).collect()
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    own = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert total.keys() == own.keys()
    size = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(total[d] == n * size[d] for d, n in own.items()) and size[90001] == size[90002] == 1
    assert cp.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
