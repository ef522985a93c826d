"""Main text of web pages by union-free wrapper inference.

Each page is a stream of tag tokens and text slots. A page's immediately repeated groups of tokens are folded first,
which gives its form; pages of a host differ in few forms. The forms of a host are then aligned one after another with
the wrapper so far: tokens of one side only become optional groups, a group that either side repeats becomes a
repeated one, and texts are slots. A host's forms are aligned in buckets first and the buckets' wrappers after that, so
neither a large host nor one with many forms meets in one task whole. Slots of the wrapper get a label from the
elements around them (article or not, menus, adverts, forms, comments and the like). Each page is read with the labels
of its form. Where a form has no article element, link text stays in paragraphs, headings and blocks with other text;
a block of links alone is a menu. Texts that all pages of a host share count as any others: hosts hold near copies of
pages, which share their articles.

Cases: null html is the empty page; a page without article text gives the empty text; null urls form one host; broken
markup is read as far as it goes; pages of any length are read whole; repeated rows give repeated results; an empty
table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

MARKUP = re.compile(
    r"<svg\b[^<>]*/>"
    r"|<(script|style|template|noscript|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role|hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p dt dd li option h1 h2 h3 h4 h5 h6 hr tr td th".split()) | {"button", "textarea", "label", "a"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and name words whose texts are not the article's.
ASIDE = frozenset("head title nav footer aside form button select textarea menu dialog fieldset".split())
ASIDE_WORD = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|sidebar|side|widget|aside|"
    r"cookies?|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|respond|reply|"
    r"disqus|search|toolbar|pagination|pager|copyright|disclaimer|hidden|complementary|contentinfo)(?:$|[^a-z])"
)
#: Whole name words that take an element within a text out of it, such as a paragraph, an item, a cell or a span.
OUT_WORD = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu|nav|breadcrumbs?|footer|sidebar|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|"
    r"share|sharing|social|related|recommended|comments?|respond|reply|hidden"
)
#: Words that join a word of ASIDE_WORD in the name of something that is no article text; within an article a name counts if it has only such words.
HELPER = frozenset(
    "area bar block body bottom box btn button buttons col column container content count counter cta form group holder icon icons inline inner item items left link links list "
    "main module outer panel panels part posts articles stories right row section slot space strip text title top unit wrap wrapper zone".split()
)
#: Blocks whose text may be links alone.
LINKED = frozenset("p h1 h2 h3 h4 h5 h6 dd blockquote figcaption caption".split())
#: Labels of slots.
DROP, KEEP, LINK = 0, 1, 2
#: Elements that another one of their name ends.
IMPLIED = frozenset("p li dt dd tr td th option".split())
MAIN = frozenset(["article", "main"])
MAIN_WORD = re.compile(r"(?:^|[^a-z])(?:main|article|post|entry|story|content|maincontent)(?:$|[^a-z])")
#: Tokens of a repeated group at most, wrappers' buckets, and bytes of labels that may be broadcast.
GROUP, BUCKETS, BROADCAST = 64, 32, 32_000_000
#: Tokens of pages whose forms a worker remembers.
REMEMBERED = 1_000_000
#: Characters of different forms that a task holds before it hands them on.
HELD_FORMS = 16_000_000

#: A token, or a group: ("+" or "?", its items).
Item = str | tuple[str, tuple]


def tokens(page: str) -> tuple[list[str], list[str]]:
    """(tokens, texts): "#" stands for a text, whose content is at the same place; other places hold no text."""
    kinds, texts, at = [], [], 0

    def text(end: int) -> None:
        if end > at and not page[at:end].isspace():
            kinds.append("#")
            texts.append(page[at:end])
        elif end > at:
            kinds.append(" ")
            texts.append(" ")

    for m in MARKUP.finditer(page):
        text(m.start())
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        close = "/" if (m[2] or m[5]) else ""
        attributes = m[4] or m[7] or ""
        label = ""
        if not close and attributes and name not in VOID:
            words = []
            for kind, value in NAMES.findall(attributes):
                value = value.strip("\"'").lower()
                kind = kind.lower()
                if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    words.append("hidden")
                elif kind != "style":
                    words += [re.sub(r"[^a-z_-]", "", w) for w in value.split()]
            label = "".join("." + w for w in sorted(set(filter(None, words))) if name in CONTAINERS or OUT_WORD.fullmatch(w))
        kinds.append(f"{close}{name}{label}")
        texts.append("")
    text(len(page))
    return kinds, texts


class Folder:
    """A token stream with its repeated groups folded, built from left to right.

    Each shape of a token or group has a number. When the last tokens repeat those before them, or the items of the group
    before them, they go into one group; that may complete a repetition around it. Each token is compared with at most
    GROUP places before it, so time grows with the page.
    """

    def __init__(self) -> None:
        self.numbers: dict = {}
        self.shapes: list[tuple[int, ...] | None] = []
        self.names: list[tuple[str, int] | None] = []
        self.ids: list[int] = []
        self.nodes: list[tuple] = []

    def number(self, shape: str | tuple[int, ...]) -> int:
        found = self.numbers.get(shape)
        if found is None:
            found = self.numbers[shape] = len(self.shapes)
            self.shapes.append(shape if isinstance(shape, tuple) else None)
            name = None if isinstance(shape, tuple) or shape == "#" else (shape.lstrip("/").partition(".")[0], -1 if shape[0] == "/" else 1)
            self.names.append(name)
        return found

    def closed(self, group: list[int]) -> bool:
        """Whether a group ends just the elements that it begins, but for those that need no end, so that it may stand for its repetitions."""
        begun: dict[str, int] = {}
        for i in group:
            if (name := self.names[i]) is not None:
                begun[name[0]] = begun.get(name[0], 0) + name[1]
                if begun[name[0]] < 0:
                    return False
        return all(n == 0 or name in VOID or name in IMPLIED for name, n in begun.items())

    def push(self, kind: str, at: int) -> None:
        self.ids.append(self.number(kind))
        self.nodes.append((kind, [at]))
        while self.fold():
            pass

    def fold(self) -> bool:
        ids, last, n = self.ids, self.ids[-1], len(self.ids)
        for size in range(1, min(GROUP, n - 1) + 1):
            group = self.shapes[ids[-size - 1]]
            if group is not None and len(group) == size and group[-1] == last and tuple(ids[-size:]) == group:
                own = self.nodes[-size:]
                kind, items = self.nodes[-size - 1]
                self.nodes[-size - 1 :] = [(kind, [joined(x, y) for x, y in zip(items, own)])]
                del ids[-size:]
                return True
            if 2 * size <= n and ids[-size - 1] == last and ids[-size:] == ids[-2 * size : -size] and self.closed(ids[-size:]):
                one, two = self.nodes[-2 * size : -size], self.nodes[-size:]
                items = [joined(x, y) for x, y in zip(one, two)]
                if size == 1 and self.shapes[last] is not None:  # two equal groups are one
                    self.nodes[-2:] = items
                    del ids[-1:]
                else:
                    self.nodes[-2 * size :] = [("+", items)]
                    ids[-2 * size :] = [self.number(tuple(ids[-size:]))]
                return True
        return False


def joined(a: tuple, b: tuple) -> tuple:
    """Two nodes of one shape as one that stands for both; the first takes in the second."""
    if a[0] == "+":
        for x, y in zip(a[1], b[1]):
            joined(x, y)
    else:
        a[1].extend(b[1])
    return a


def folded(kinds: tuple[str, ...]) -> tuple[str, tuple[int, ...]]:
    """(form, slot of each token): the stream with repeated groups folded, as JSON; -1 where a token is no text."""
    folder = Folder()
    for i, k in enumerate(kinds):
        if k != " ":
            folder.push(k, i)
    slots = [-1] * len(kinds)
    count = 0

    def walk(items: list) -> tuple:
        nonlocal count
        out = []
        for kind, under in items:
            if kind == "+":
                out.append(("+", walk(under)))
            else:
                if kind == "#":
                    for i in under:
                        slots[i] = count
                    count += 1
                out.append(kind)
        return tuple(out)

    return json.dumps(walk(folder.nodes), separators=(",", ":"), ensure_ascii=False), tuple(slots)


_forms: dict[tuple[str, ...], tuple[str, tuple[int, ...]]] = {}
_held = 0


def form_of(kinds: tuple[str, ...]) -> tuple[str, tuple[int, ...]]:
    """``folded``, remembered for pages of REMEMBERED tokens together."""
    global _held
    found = _forms.get(kinds)
    if found is None:
        found = folded(kinds)
        if _held + len(kinds) > REMEMBERED:
            forget()
        if len(kinds) <= REMEMBERED:
            _forms[kinds] = found
            _held += len(kinds)
    return found


def forget() -> None:
    global _held
    _forms.clear()
    _held = 0


def read(form: str) -> tuple[Item, ...]:
    """A form or wrapper from its JSON."""
    as_items = lambda x: tuple((i[0], as_items(i[1])) if isinstance(i, list) else i for i in x)
    return as_items(json.loads(form))


def bare(item: Item) -> tuple[Item, ...]:
    """An item without the mark that it is optional."""
    return item[1] if isinstance(item, tuple) and item[0] == "?" else (item,)


def regrouped(items: tuple[Item, ...], groups: set[tuple]) -> tuple[Item, ...]:
    """The items with single occurrences of the other side's repeated groups folded too."""
    for group in sorted(groups, key=len, reverse=True):
        out, i = [], 0
        while i < len(items):
            if items[i : i + len(group)] == group:
                out.append(("+", group))
                i += len(group)
            else:
                out.append(items[i])
                i += 1
        items = tuple(out)
    return items


def repeated(items: tuple[Item, ...]) -> set[tuple]:
    return {x[1] for i in items for x in bare(i) if isinstance(x, tuple) and x[0] == "+"}


def flat(items: tuple[Item, ...]) -> list[tuple[Item, bool]]:
    """The items and whether each is optional, optional groups taken apart."""
    return [(x, isinstance(i, tuple) and i[0] == "?") for i in items for x in bare(i)]


def aligned(a: tuple[Item, ...], b: tuple[Item, ...]) -> tuple[list[tuple[Item, bool]], list[tuple[Item, bool]], list]:
    left, right = flat(regrouped(a, repeated(b) - repeated(a))), flat(regrouped(b, repeated(a) - repeated(b)))
    return left, right, SequenceMatcher(None, [x for x, _ in left], [x for x, _ in right], autojunk=False).get_opcodes()


def merge(a: tuple[Item, ...], b: tuple[Item, ...]) -> tuple[Item, ...]:
    """The wrapper that takes what either takes."""
    if a == b:
        return a
    left, right, steps = aligned(a, b)
    out: list[tuple[Item, bool]] = []
    for step, i, j, k, m in steps:
        if step == "equal":
            out += [(x, one or other) for (x, one), (_, other) in zip(left[i:j], right[k:m])]
        else:
            out += [(x, True) for x, _ in left[i:j]] + [(x, True) for x, _ in right[k:m]]
    return tuple(("?", (x,)) if optional else x for x, optional in out)


def wrapper_of(forms: list[tuple[Item, ...]]) -> tuple[Item, ...]:
    out = forms[0]
    for x in forms[1:]:
        out = merge(out, x)
    return out


def names_aside(label: str) -> bool:
    """Whether one of an element's names has just words for what is no article text, such as ad-slot or related-posts, but not related-work."""
    for name in label.split("."):
        words = [w for w in re.split(r"[-_]", name) if w]
        if words and all(w in HELPER or ASIDE_WORD.fullmatch(w) for w in words) and any(ASIDE_WORD.fullmatch(w) for w in words):
            return True
    return False


def surroundings(items: tuple[Item, ...]) -> list[tuple[bool, bool, bool]]:
    """For each slot in order: inside an article, beside the article, inside a link."""
    out: list[tuple[bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []

    def walk(some: tuple[Item, ...]) -> None:
        for x in some:
            if isinstance(x, tuple):
                walk(x[1])
            elif x == "#":
                out.append((any(m for _, m, _ in stack), any(a for _, _, a in stack), any(n == "a" for n, _, _ in stack)))
            elif x[0] == "/":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == x[1:]:
                        del stack[k:]
                        break
            else:
                name, _, label = x.partition(".")
                if stack and (name in IMPLIED and stack[-1][0] == name or name in BLOCKS and stack[-1][0] == "p"):
                    stack.pop()
                if name not in CONTAINERS and name not in VOID:
                    # elements within a text matter if they are out of it, and then those of their name inside them
                    if label:
                        stack.append((name, False, True))
                    elif name not in IMPLIED and any(n == name and a for n, _, a in stack):
                        stack.append((name, False, False))
                elif name not in VOID:
                    inside = any(m for _, m, _ in stack)
                    aside = name in ASIDE or name == "header" and not inside or bool(label and name not in ("html", "body") and (names_aside(label) if inside else ASIDE_WORD.search(label)))
                    if aside and name in MAIN and not re.search(r"comment|reply|respond|related|promo|sponsor|advert|teaser", label):
                        aside = False
                    stack.append((name, not aside and (name in MAIN or bool(label and name in ("div", "section", "td") and MAIN_WORD.search(label))), aside))

    walk(items)
    return out


def labels(around: list[tuple[bool, bool, bool]]) -> list[int]:
    """For each slot whether it holds main text, or link text that may be a menu's; where nothing is marked as the article, all but asides count."""
    if any(main and not aside for main, aside, _ in around):
        return [KEEP if main and not aside else DROP for main, aside, _ in around]
    return [DROP if aside else LINK if link else KEEP for _, aside, link in around]


def slots(item: Item) -> int:
    return sum(map(slots, item[1])) if isinstance(item, tuple) else int(item == "#")


def labels_of_form(form: tuple[Item, ...], wrapper: tuple[Item, ...]) -> list[int]:
    """The label of each slot of a form: those of the wrapper's slots that it is aligned with, its own for other slots.

    A form without an article, whose host has one on other pages, has its own labels only.
    """
    around, inside = surroundings(wrapper), surroundings(form)
    own = labels(inside)
    main = lambda some: any(m and not aside for m, aside, _ in some)
    if main(around) and not main(inside):
        return own
    left, right, steps = aligned(form, wrapper)
    starts = [0]
    for x, _ in right:
        starts.append(starts[-1] + slots(x))
    marked = labels(around)
    out: list[int] = []
    for step, i, j, k, _ in steps:
        for at in range(i, j):
            n = slots(left[at][0])
            place = starts[k + at - i] if step == "equal" else -1
            out += marked[place : place + n] if step == "equal" else own[len(out) : len(out) + n]
    return out


def main_text(kinds: list[str], texts: list[str], place: tuple[int, ...], marked: list[int]) -> str:
    """The blocks of kept texts; link texts stay in blocks of LINKED and where other text is kept."""
    blocks: list[str] = []
    now: list[str] = []
    kept, links, element = False, False, ""

    def ended(name: str) -> None:
        nonlocal kept, links, element
        if kept or links and element in LINKED:
            blocks.append("".join(now))
        now.clear()
        kept, links, element = False, False, name

    for kind, text, slot in zip(kinds, texts, place):
        if kind == "#":
            if marked[slot] != DROP:
                now.append(text)
                kept, links = kept or marked[slot] == KEEP, links or marked[slot] == LINK
        elif kind == " ":
            now.append(" ")
        else:
            name = kind.lstrip("/").partition(".")[0]
            if name in BLOCKS:
                ended("" if kind[0] == "/" else name)
            elif name == "br":
                now.append(" ")
    ended("")
    clean = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n\n".join(x for x in clean if x)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page; text is its main text, blocks joined by an empty line."""

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        held = 0

        def told() -> pa.RecordBatch:
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["host", "form", "pages"])

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                form = form_of(tuple(tokens(page)[0]))[0]
                key = host_of(url), form
                if key not in seen:
                    held += len(form)
                seen[key] = seen.get(key, 0) + 1
            if held > HELD_FORMS:
                held = 0
                yield told()
        if seen:
            yield told()
        forget()

    def summed(batch: pa.Table) -> dict[str, int]:
        out: dict[str, int] = {}
        for form, count in zip(batch["form"].to_pylist(), batch["pages"].to_pylist()):
            out[form] = out.get(form, 0) + count
        return out

    def in_bucket(key, batch):
        found = summed(batch)
        order = sorted(found, key=lambda f: (-found[f], f))
        wrapper = wrapper_of([read(f) for f in order])
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(wrapper)], "bucket": pa.array([key[1].as_py()], pa.int32()), "pages": pa.array([sum(found.values())], pa.int64())})

    def of_host(key, batch):
        rows = sorted(zip(batch["pages"].to_pylist(), batch["bucket"].to_pylist(), batch["wrapper"].to_pylist()), key=lambda r: (-r[0], r[1]))
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(wrapper_of([read(w) for _, _, w in rows]))]})

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for form, wrapper in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(labels_of_form(read(form), read(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int8()))], ["host", "form", "marked"])

    named = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    forms = named.select("url", "html").mapInArrow(formed, "host string, form string, pages long")
    forms = written(forms, "forms")
    bucket = F.pmod(F.xxhash64("form"), F.lit(BUCKETS)).cast("int").alias("bucket")
    partial = forms.select("host", bucket, "form", "pages").groupBy("host", "bucket").applyInArrow(in_bucket, "host string, wrapper string, bucket int, pages long")
    wrappers = partial.groupBy("host").applyInArrow(of_host, "host string, wrapper string")
    distinct = forms.select("host", "form").distinct()
    known = written(distinct.join(wrappers, "host").select("host", "form", "wrapper").mapInArrow(labelled, "host string, form string, marked array<tinyint>"), "labels")
    known = known.select(F.xxhash64("host", "form").alias("key"), "marked")
    size = known.agg(F.coalesce(F.sum(F.size("marked") + 16), F.lit(0)).alias("size"))

    schema = f"page_id {dict(named.dtypes)['page_id']}, url string, text string"
    small = size.first()["size"] <= BROADCAST

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(host_of(u), form_of(tuple(tokens(p)[0]))[0]) for u, p in zip(batch.column(1).to_pylist(), texts_of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], ["page_id", "url", "html", "host", "form"])

    def texted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, marked in zip(texts_of(batch.column(2)), batch.column(3).to_pylist()):
                kinds, texts = tokens(page)
                out.append(main_text(kinds, texts, form_of(tuple(kinds))[1], marked))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = named.mapInArrow(keyed, f"page_id {dict(named.dtypes)['page_id']}, url string, html string, host string, form string")
    rows = rows.select("page_id", "url", "html", F.xxhash64("host", "form").alias("key"))
    # labels are broadcast below a checked size; above it the rows meet by key, whose hot values Spark splits
    met = rows.join(F.broadcast(known) if small else known, "key", "left")
    return met.select("page_id", "url", "html", "marked").mapInArrow(texted, schema)
