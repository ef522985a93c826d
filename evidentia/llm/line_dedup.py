"""Fuzzy line dedup: MinHash over character shingles, bands, exact Jaccard verification and distributed union-find.

A line is lower-cased and its white space made single. Two lines are alike if the shorter one has 3/4 of the longer
one's characters at least, and their sets of character shingles a Jaccard similarity of 0.75 or more. The shingles are
runs of 3, 5 or 8 characters by the shorter line's length (CLASSES), so that one changed word leaves a short line alike
and a long line does not meet every other one by its common syllables; a line with fewer characters is one shingle.

1. One pass over the documents gives each line's id and place and, for the different lines of a batch, its band keys:
   12 bands of 5 minima each, over all shingles. A line takes part in the classes in which a line alike may be the
   shorter one. Up to 191 characters each minimum has a hash function of its own; from there on one hash deals the
   shingles over as many bins as there are minima, an empty bin takes over from the next one that is not, and each bin
   gives its minimum. A pair at a similarity of 0.75 meets in a band with a probability of 0.96, at 0.85 of 0.998.
2. Lines with an equal key are candidates; their texts are fetched from the documents and compared by whole shingle
   sets, in lists of a leader and a block of members first, then block by block what is still apart, so that a group of
   similar lines, however large, never becomes all its pairs and never lies in one task.
3. Links become components by distributed union-find. Of each component the first line stays (by document id and line
   number); all others go.

Cases: a null text stays null; empty lines and lines of white space always stay; a document all of whose lines go has
the empty text; long lines are read whole; rows that repeat an id are copies of one document and lose the same lines;
rows without an id stay as they are; an empty table gives an empty table; other columns pass through unchanged, but for
the names ``text``, ``n_lines`` and ``n_dropped``, which the result defines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_filter, mapped, maybe_in, mix, pieces, steps, texts_of, tidied, written
from .components import looked_up
from .ngram_join import LISTS, linked

BANDS, ROWS = 12, 5
#: Least length, characters of a shingle, and whether one hash deals the shingles over bins, by class.
CLASSES = ((0, 3, False), (64, 5, False), (192, 8, True))
#: White space other than the blank and the line feed.
ODD_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Numbers of a dropped line that may be broadcast (8 MB).
BROADCAST_DROPS = 1_000_000
_seeds = np.random.default_rng(13).integers(1, 2**32, (2, BANDS * ROWS), np.uint32)
FACTORS, OFFSETS = _seeds[0] | np.uint32(1), _seeds[1]
STEPS = np.random.default_rng(11).integers(1, 2**63, 3, np.uint64) | np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are hashed at a time, so that the arrays of one step stay in a core's cache; a longer line is taken whole.
CACHED = 32_000
#: Members of a list from which other leaders are tried before all its pairs are compared.
MANY = 32
STARTS = np.array([c[0] for c in CLASSES])


def code_points(text: str) -> np.ndarray:
    """The characters as integers: bytes if all are ASCII, else of 32 bits."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: The lower case of each Latin-1 character, all of which are Latin-1 too.
LATIN = "".join(chr(i).lower() for i in range(256)).encode("latin-1")


def lowered(text: str) -> str:
    """``text.lower()``, by a table where all characters are Latin-1."""
    if text.isascii():
        return text.lower()
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1")
    except UnicodeEncodeError:
        return text.lower()


def spaced(texts: list[str]) -> bool:
    """Whether a blank stands beside another one or at an end of a line."""
    code = code_points("\n".join(["", *texts, ""]))
    blank = code == 32
    beside = blank | (code == 10)
    return bool((blank[1:] & beside[:-1]).any() or (beside[1:] & blank[:-1]).any())


def normal_lines(text: str, plain: bool = False) -> list[str]:
    """The lines, lower-cased and with single spaces in place of any white space. plain: the text is known not to be ``spaced``."""
    text = lowered(text)
    if not plain and spaced([text]) or any(c in text for c in ODD_SPACE):
        return [" ".join(x.split()) for x in text.split("\n")]
    return text.split("\n")


def line_ids(lines: list[str]) -> np.ndarray:
    """A 64-bit hash of each whole line."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines)).view(np.int64)


def shingles(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, the first one's place of each line and their number) of non-empty lines."""
    padded = [x if len(x) >= size else x + "\0" * (size - len(x)) for x in lines]
    length = np.fromiter(map(len, padded), np.int64, len(padded))
    first = np.append(0, np.cumsum(length - size + 1))
    out = np.empty(int(first[-1]), np.uint64)
    for a, b in chunks(padded, CACHED):
        code = code_points("".join(padded[a:b])).astype(np.uint64)
        # runs of one, two and four characters, and longer ones put together from two of them
        runs, span, step = code, 1, 0
        while span * 2 <= size:
            runs = runs[:-span] * STEPS[step] + runs[span:]
            runs ^= runs >> np.uint64(29)
            span, step = span * 2, step + 1
        if span < size:
            runs = runs[: len(code) - size + 1] * GOLDEN + runs[size - span :]
        inside = np.ones(len(code), bool)  # where a shingle of one line begins
        end = np.cumsum(length[a:b])
        for k in range(1, size):
            inside[end - k] = False
        out[first[a] : first[b]] = mix(runs[inside[: len(runs)]])
    return out, first


def dealt_minima(lines: list[str], size: int) -> np.ndarray:
    """The least hash in each of BANDS * ROWS bins that one hash deals each line's shingles over; lines have ``size`` characters at least.

    A bin that gets none takes the value of the next bin that has one, moved on by their distance.
    """
    bins = BANDS * ROWS
    out = np.empty((len(lines), bins), np.uint32)
    empty = np.uint32(0xFFFFFFFF)
    for a, b in chunks(lines, CACHED):
        code = code_points("".join(lines[a:b])).astype(np.uint32)
        runs, span = code, 1
        while span * 2 <= size:
            runs = runs[:-span] * np.uint32(0x9E3779B1) + runs[span:]
            runs ^= runs >> np.uint32(15)
            span *= 2
        if span < size:
            runs = runs[: len(code) - size + 1] * np.uint32(0x85EBCA6B) + runs[size - span :]
        runs = runs * np.uint32(0xC2B2AE35)
        runs ^= runs >> np.uint32(16)
        value = (runs ^ np.uint32(0x5BD1E995)) * np.uint32(0x27D4EB2F)
        value ^= value >> np.uint32(15)
        # a row of bins for each line, and a last one for the runs that reach into the next line
        n = b - a
        row = np.full((n, 2), n * bins)
        row[:, 0] = np.arange(n) * bins
        times = np.full((n, 2), size - 1)
        times[:, 0] = np.fromiter(map(len, lines[a:b]), np.int64, n) - (size - 1)
        place = np.repeat(row.ravel(), times.ravel())[: len(runs)]
        place += (runs >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
        own = np.full((n + 1) * bins, empty, np.uint32)
        np.minimum.at(own, place, value)
        out[a:b] = own[:-bins].reshape(n, bins)
    at = np.flatnonzero((out == empty).any(axis=1))
    while len(at):
        own = out[at]
        gaps = own == empty
        own = np.where(gaps, np.where(np.roll(gaps, -1, axis=1), empty, np.roll(own, -1, axis=1) + np.uint32(0x01000193)), own)
        out[at] = own
        at = at[(own == empty).any(axis=1)]
    return out


def own_minima(lines: list[str], size: int) -> np.ndarray:
    """The least hash of each line's shingles by each of BANDS * ROWS hash functions."""
    out = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    for a, b in chunks(lines, CACHED):
        every, first = shingles(lines[a:b], size)
        low = (every >> np.uint64(32)).astype(np.uint32)
        moved = np.empty_like(low)
        for k in range(BANDS * ROWS):
            np.multiply(low, FACTORS[k], out=moved)
            np.add(moved, OFFSETS[k], out=moved)
            np.minimum.reduceat(moved, first[:-1], out=out[k, a:b])
    return out.T


def band_keys(lines: list[str], kind: int) -> np.ndarray:
    """A key per band and line of one class from the line's MinHash signature."""
    _, size, dealt = CLASSES[kind]
    out = np.zeros((BANDS, len(lines)), np.uint64)
    band = np.arange(BANDS, dtype=np.uint64)[:, None]
    for a, b in chunks(lines, 100_000):
        minima = (dealt_minima if dealt else own_minima)(lines[a:b], size).T.reshape(BANDS, ROWS, b - a)
        own = np.full((BANDS, b - a), np.uint64(kind + 1))
        for k in range(ROWS):
            own = mix(own * GOLDEN + minima[:, k] + band)
        out[:, a:b] = own
    return out


def classes_of(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(STARTS, length, side="right") - 1


def keys_and_owners(lines: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, line ids) of different non-empty lines, over all classes that they take part in."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    own, below = classes_of(length), classes_of(-(-3 * length // 4))  # the shortest line alike
    keys, owners = [], []
    for kind in range(len(CLASSES)):
        at = np.flatnonzero((below <= kind) & (kind <= own))
        if len(at):
            keys.append(band_keys([lines[i] for i in at.tolist()], kind).ravel())
            owners.append(np.tile(ids[at], BANDS))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def lists_of_lines(keys: np.ndarray, lines: np.ndarray) -> pa.Table:
    """Rows of LISTS for lines with equal keys: a pair of each line with its list's leader, and lists of the others.

    A leader meets all the others as pairs; so of lists of three or more what is left holds the others only.
    """
    # most keys belong to one line and give no list; keys of 32 bits are put in order together with their places
    packed = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    edge = np.concatenate([[True], np.diff(packed >> np.uint64(32)) != 0, [True]])
    order = (packed[~(edge[1:] & edge[:-1])] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys, lines = keys[order], lines[order]
    order = np.lexsort((mix(lines.view(np.uint64)), keys))
    keys, lines = keys[order], lines[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])) if len(keys) else np.zeros(0, bool)
    keys, lines = keys[once], lines[once]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(keys)))
    pairs = np.unique(np.stack([np.repeat(lines[start], count)[~first], lines[~first]], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    # the lists without their leaders, each membership once
    start, count = start[count > 2] + 1, count[count > 2] - 1
    member = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    rank = mix(lines[member].view(np.uint64) + GOLDEN)
    cuts = np.cumsum(count) - count
    names = (mix(np.add.reduceat(rank, cuts)) if len(cuts) else np.zeros(0, np.uint64)) & np.uint64((1 << 63) - 1)
    names, which = np.unique(names, return_index=True)
    size = count[which]
    member = np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ends = np.concatenate([np.arange(len(pairs)), len(pairs) + np.append(0, np.cumsum(size))]).astype(np.int32)
    docs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([pairs[:, 1], lines[member]])))
    kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(size)])
    key = np.concatenate([pairs[:, 0], names.view(np.int64)])
    return pa.table({"kind": pa.array(kind), "key": pa.array(key), "docs": docs, "sizes": pa.nulls(len(kind), pa.list_(pa.int64()))})


class LineJudge:
    """Compares lines by their whole shingle sets."""

    BITS = np.uint64((1 << 16) - 1)
    SIZES = np.array([c[1] for c in CLASSES])

    def __init__(self) -> None:
        self.seen: np.ndarray | None = None

    def prepare(self, texts: list[bytes]) -> list[tuple[int, dict[int, np.ndarray]]]:
        """(length, shingle set by shingle size) of each stored line."""
        lines = [x.decode("utf-8", "surrogatepass") for x in texts]
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        low, high = self.SIZES[classes_of(-(-3 * length // 4))], self.SIZES[classes_of(length)]
        sets: list[dict[int, np.ndarray]] = [{} for _ in lines]
        for size in np.unique(self.SIZES).tolist():  # the sizes rise with the classes
            at = np.flatnonzero((low <= size) & (size <= high)).tolist()
            some = [lines[i] for i in at]
            for a, b in chunks(some, 100_000):
                every, first = shingles(some[a:b], size)
                for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                    every[x:y].sort()
                once = np.append(True, every[1:] != every[:-1])
                once[first[:-1]] = True
                every, first = every[once], np.append(0, np.cumsum(once))[first].tolist()
                for i, x, y in zip(at[a:b], first, first[1:]):
                    sets[i][size] = every[x:y]
        return list(zip(length.tolist(), sets))

    @staticmethod
    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sets reach the similarity."""
        if len(a) > len(b):
            a, b = b, a
        n = len(a) + len(b)
        if 7 * len(a) < 3 * n:
            return False
        return 7 * int(np.count_nonzero(b.take(b.searchsorted(a), mode="clip") == a)) >= 3 * n

    def links(self, lines: list, probe: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
        """(probe, member) of lines alike in different parts."""
        out: list[tuple[int, int]] = []
        length = [x[0] for x in lines]
        asking = np.flatnonzero(probe).tolist()
        if len(lines) <= 8:
            asked, parts = probe.tolist(), part.tolist()
            for i in asking:
                for j in range(len(lines)):
                    short, long = (length[i], length[j]) if length[i] < length[j] else (length[j], length[i])
                    if 4 * short >= 3 * long and parts[i] != parts[j] and not (asked[j] and j < i):
                        size = next(c[1] for c in reversed(CLASSES) if short >= c[0])
                        if self.alike(lines[i][1][size], lines[j][1][size]):
                            out.append((i, j))
            return out
        if self.seen is None:
            self.seen = np.zeros(int(self.BITS) + 1, np.uint32)
        # by length, so that those that fit a probe under one size of shingles lie side by side
        order = np.argsort(np.array(length), kind="stable")
        ranked = np.array(length)[order]
        stored: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for size in self.SIZES.tolist():
            having = [k for k, j in enumerate(order.tolist()) if size in lines[j][1]]
            if having:
                sets = [lines[order[k]][1][size] for k in having]
                stored[size] = having[0], np.append(0, np.cumsum([len(x) for x in sets])), (np.concatenate(sets) & self.BITS).astype(np.int64)
        for i in asking:
            n = length[i]
            x, y = int(ranked.searchsorted(-(-3 * n // 4))), int(ranked.searchsorted(4 * n // 3, side="right"))
            kinds = classes_of(np.minimum(ranked[x:y], n))
            for kind in range(int(kinds[0]), int(kinds[-1]) + 1):
                a, b = x + int(kinds.searchsorted(kind)), x + int(kinds.searchsorted(kind, side="right"))
                if a == b:
                    continue
                size = CLASSES[kind][1]
                mine, (base, first, places) = lines[i][1][size], stored[size]
                cuts = first[a - base : b - base + 1]
                # no more shingles are shared than meet in a table of bits
                place = (mine & self.BITS).astype(np.int64)
                self.seen[place] = 1
                most = np.add.reduceat(self.seen[places[cuts[0] : cuts[-1]]], cuts[:-1] - cuts[0]).astype(np.int64)
                self.seen[place] = 0
                some = order[a:b]
                may = (7 * most >= 3 * (np.diff(cuts) + len(mine))) & (part[some] != part[i])
                out += [(i, j) for j in some[may].tolist() if self.alike(mine, lines[j][1][size])]
        return out


def lines_of(batches: Iterator[pa.RecordBatch], size: int = 1_000_000):
    """(ids of documents, line numbers, lines) of the non-empty lines of bounded chunks."""
    for batch in pieces(batches):
        texts, ids = texts_of(batch.column(1)), batch.column(0).to_pylist()
        for a, b in chunks(texts, size):
            docs: list[int] = []
            numbers: list[int] = []
            lines: list[str] = []
            plain = not spaced(texts[a:b])
            for doc, text in zip(ids[a:b], texts[a:b]):
                for number, line in enumerate(normal_lines(text, plain)):
                    if line:
                        docs.append(doc)
                        numbers.append(number)
                        lines.append(line)
            if lines:
                yield docs, numbers, lines


def decisions(documents: DataFrame) -> DataFrame:
    """(doc, numbers) of the lines that go, by document, as a written table."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())

    def read(batches):
        for docs, numbers, lines in lines_of(batches):
            ids = line_ids(lines)
            n = len(ids)
            columns = [pa.array(ids), pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["line", "doc", "number", "keys", "owners"])
            _, first = np.unique(ids, return_index=True)
            keys, owners = keys_and_owners([lines[i] for i in first.tolist()], ids[first])
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([owners.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["line", "doc", "number", "keys", "owners"])

    with steps() as keep:
        both = written(mapped(rows, ["doc_id", "text"], "line long, doc long, number int, keys binary, owners binary", read), "lines")
        places = both.where("line is not null").select("line", "doc", "number")
        total = both.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // 8
        ranges = max(32, math.ceil(total / 1_000_000))

        def dealt(batches):
            for batch in batches:
                for k, o in zip(batch.column(0), batch.column(1)):
                    keys, owners = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(o.as_py(), np.int64)
                    place = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    order = np.argsort(place.astype(np.uint16) if ranges < 1 << 16 else place, kind="stable")
                    cuts = np.append(0, np.cumsum(np.bincount(place, minlength=ranges)))
                    # the range has a key's upper bits already; 32 more leave one chance match in some 10**11 pairs
                    low = (mix(keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    low, owners = low[order], owners[order]
                    some = np.flatnonzero(np.diff(cuts)).tolist()
                    columns = [pa.array(some, pa.int32()), *(pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()) for x in (low, owners))]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "keys", "lines"])

        @tidied
        def group(key, batch):
            keys = np.concatenate([np.frombuffer(x, np.uint32) for x in batch["keys"].to_pylist()])
            lines = np.concatenate([np.frombuffer(x, np.int64) for x in batch["lines"].to_pylist()])
            return lists_of_lines(keys, lines)

        keyed = both.where("keys is not null")
        found = mapped(keyed, ["keys", "owners"], "range int, keys binary, lines binary", dealt).groupBy("range").applyInArrow(group, LISTS)

        def texts_of_ids(involved: DataFrame) -> DataFrame:
            asked, width = id_filter(involved, "doc_id")
            told = spark.sparkContext.broadcast(asked)  # 2**FILTER_BITS bits at most

            def kept(batches):
                for _, _, lines in lines_of(batches):
                    ids = line_ids(lines)
                    ids, first = np.unique(ids, return_index=True)
                    at = np.flatnonzero(maybe_in(told.value, width, ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([lines[i].encode("utf-8", "surrogatepass") for i in first[at].tolist()], pa.binary())], ["doc_id", "grams"])

            return mapped(rows, ["doc_id", "text"], "doc_id long, grams binary", kept).dropDuplicates(["doc_id"])

        similar = linked(written(found, "bands"), texts_of_ids, LineJudge(), False, MANY)
        first = written(places.groupBy("line").agg(F.min(F.struct("doc", "number")).alias("first"), F.count("*").alias("n")), "places")
        # a line that is there once and is like no other one stays
        grouped = looked_up(first, similar.withColumnRenamed("node", "line"), "line").where("component is not null or n > 1").withColumn("component", F.coalesce("component", "line"))
        grouped = written(grouped, "grouped")
        keepers = written(grouped.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("n").alias("total")).where("total > 1").select("component", "keeper"), "keepers")
        decided = written(looked_up(grouped.select("line", "component"), keepers, "component", "inner").select("line", "keeper"), "decided")
        met = looked_up(places, decided, "line", "inner").where((F.col("doc") != F.col("keeper.doc")) | (F.col("number") != F.col("keeper.number")))
        return keep(written(met.groupBy("doc").agg(F.array_sort(F.collect_set("number")).alias("numbers")), "drops"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with near-duplicate lines taken out of ``text``, and n_lines and n_dropped of each document."""
    doc, dropped, lines, edges = (next(x for k in range(len(documents.columns) + 1) if (x := f"_{name}{k}") not in documents.columns) for name in ("doc", "dropped", "lines", "edges"))
    drops = decisions(documents).select(F.col("doc").alias(doc), F.col("numbers").alias(dropped))
    total = drops.agg(F.coalesce(F.sum(F.size(dropped) + 2), F.lit(0))).first()[0]
    out = documents.join(F.broadcast(drops) if total <= BROADCAST_DROPS else drops, documents["doc_id"] == F.col(doc), "left")
    # lines are taken apart only where some go
    out = out.withColumn(lines, F.when(F.col(dropped).isNotNull(), F.split("text", "\n", -1)))
    out = out.withColumn(edges, F.when(F.col(dropped).isNotNull(), F.concat(F.array(F.lit(-1)), F.col(dropped), F.array(F.size(lines)))))
    # the runs of lines between those that go: steps follow the number of lines
    runs = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.slice(lines, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1))
    ends = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = out.withColumns({"n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(ends + 1).cast("long"), "n_dropped": F.when(F.col(dropped).isNull(), F.lit(0)).otherwise(F.size(dropped)).cast("long")})
    return out.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))).drop(doc, dropped, lines, edges)
