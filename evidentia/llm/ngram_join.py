"""N-gram Jaccard join with prefix trees: components of documents whose word 5-gram sets are similar.

1. Every whole text becomes a set of 64-bit n-gram hashes; equal sets are one class, and its smallest id stands for it.
2. All n-grams are counted in a sketch whose size follows the corpus. It gives one global order, rare n-grams first.
3. Two sets that reach the threshold share one of their first n - ceil(t n) + 1 n-grams. These prefixes are dealt out
   by ranges of n-gram hashes, so a hot n-gram is a small part of a task, and the order keeps common ones out of them.
4. Sets under a shared n-gram are first compared with one leader of a similar size, which joins the groups of near
   copies, however large, with a few comparisons each. Then every list of sets under one n-gram that still holds
   several components is joined whole: its sets are stored in a prefix tree in a common order, and each set outside the
   list's largest component goes down the tree, with the overlap of shared beginnings counted once, and leaves a
   subtree as soon as its remaining length cannot bring the overlap needed.
5. Links become components by distributed union-find.

Similarities are those of sets of 64-bit hashes, made anew from the whole texts of the candidates wherever two are
compared; no candidate is dropped. A list larger than a block is compared block by block, so no task holds a whole hot
list. The sketch that gives the order has 2**LARGEST counters at most: beyond some 2**(LARGEST + 3) n-grams more of them
share a counter, which makes lists longer and loses no link.

Cases: a null or empty text, or one of white space only, has no n-grams and links with nothing; fewer words than n make
one n-gram; long texts are read whole; repeated rows of an id count as one document with the n-grams of its first set
in hash order; rows without an id are left out; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BASE, powers
from .common import chunks, id_filter, mapped, maybe_in, mix, pieces, steps, texts_of, tidied, written
from .components import BROADCAST_ROWS, components, looked_up, union_find

WORDS = 5
#: The similarity that links, as numerator and denominator.
SIMILAR = (3, 4)
#: Counters of the sketch: about an eighth of the n-grams, 2**LARGEST at most (one byte each where it is used).
SMALLEST, LARGEST, PIECES = 16, 25, 256
#: Members of a list, and probes of it, that one comparison holds.
BLOCK = 500
#: Parts of a set's sketch, and rounds of other leaders.
BUCKETS, LEADER_ROUNDS = 256, 2
#: Bytes that are hashed at a time, so that memory does not follow the length of a text.
BYTES = 1 << 19

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, the first word's place of each text and the number of words).

    The texts are one stream of bytes, hashed block by block; a word that a block cuts is carried on.
    """
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    power, inverse = powers(BYTES + 1)
    prefix = np.zeros(BYTES + 1, np.uint64)
    starts, hashes = [], []
    carried, begun, length = 0, -1, 0  # the sum of a cut word so far, its first byte and its length
    for at in range(0, len(data), BYTES):
        own = data[at : at + BYTES]
        gap = SEPARATOR[own]
        edge = np.diff(gap.view(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        np.cumsum(LETTERS[LOWER[own]] * power[: len(own)], out=prefix[1 : len(own) + 1])
        sums = (prefix[end] - prefix[start]) * inverse[start]
        start = start + at
        if begun >= 0:
            if len(sums) and start[0] == at:
                carried = (carried + int(sums[0]) * pow(BASE, length, 1 << 64)) & MASK
                sums[0], start[0] = np.uint64(carried), begun
            else:
                sums, start = np.append(np.uint64(carried), sums), np.append(begun, start)
            begun = -1
        if len(sums) and not gap[-1]:
            carried, begun = int(sums[-1]), int(start[-1])
            length = at + len(own) - begun
            sums, start = sums[:-1], start[:-1]
        starts.append(start)
        hashes.append(mix(sums))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(start, np.cumsum([0, *map(len, raw)]))


def ngram_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted set of n-gram hashes."""
    words, first = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mix(grams * GOLDEN + words[k : k + len(grams)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix(one * GOLDEN + words[k : k + 1])
            out.append(one + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int) -> int:
    p, q = SIMILAR
    return n - -(-p * n // q) + 1 if n else 0


def needed(a: int, b: int) -> int:
    """The smallest overlap with which sets of these sizes link."""
    p, q = SIMILAR
    return -(-p * (a + b) // (p + q))


def documents_in(batches: Iterator[pa.RecordBatch], keep=None, size: int = 1_000_000):
    """(ids, sets) of a stream of (id, text) batches, in bounded chunks; keep: which ids to read, as a mask."""
    for batch in pieces(batches):
        if keep is not None:
            batch = batch.filter(pa.array(keep(np.asarray(batch.column(0)))))
        texts, ids = texts_of(batch.column(1)), batch.column(0).to_pylist()
        for a, b in chunks(texts, size):
            yield ids[a:b], ngram_sets(texts[a:b])


def set_name(grams: np.ndarray) -> str:
    """Two sums over mixed hashes, which tell sets apart."""
    return f"{int(mix(grams).sum(dtype=np.uint64)) ^ len(grams):016x}{int(mix(grams ^ GOLDEN).sum(dtype=np.uint64)):016x}"


def class_table(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id) of each document; equal sets have equal set ids."""

    def over(batches):
        for ids, sets in documents_in(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.string())], ["doc_id", "n_shingles", "set_id"])

    return mapped(documents, ["doc_id", "text"], "doc_id long, n_shingles long, set_id string", over)


def frequency_classes(documents: DataFrame, keep, bits: int) -> np.ndarray:
    """For each of 2**bits hash slots eight times the logarithm of the n-grams counted there, as a byte."""
    width = 1 << bits
    piece = width // PIECES

    def count(batches):
        seen, n = np.zeros(width, np.uint16), 0

        def told():
            for k in range(PIECES):
                own = seen[k * piece : (k + 1) * piece]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["piece", "counts"])
            seen[:] = 0

        for _, sets in documents_in(batches, keep):
            if n + len(sets) > 30_000:  # a set counts once, so no n-gram overflows its counter
                yield from told()
                n = 0
            if sets:
                slot = (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(seen, slot, np.uint16(1))
                n += len(sets)
        yield from told()

    @tidied
    def add(key, batch):
        total = np.zeros(piece)
        for x in batch["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint16)
        level = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([level.tobytes()], pa.binary())})

    found = mapped(documents, ["doc_id", "text"], "piece int, counts binary", count).groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    out = np.zeros(width, np.uint8)
    for r in found:
        out[r.piece * piece : (r.piece + 1) * piece] = np.frombuffer(r.counts, np.uint8)
    return out


def size_class(n: np.ndarray) -> np.ndarray:
    """Sets that link lie in one class or in neighbouring ones."""
    p, q = SIMILAR
    return np.floor(np.log(np.maximum(n, 1)) / math.log(q / p)).astype(np.int64)


LISTS = "kind int, key long, docs array<long>, sizes array<long>"


def may_link(n: np.ndarray, left: np.ndarray, i: int) -> np.ndarray:
    """Which sets may link with set i if this is the first n-gram that they share: what is left of both must hold the overlap needed."""
    p, q = SIMILAR
    return (p + q) * np.minimum(left, left[i]) >= p * (n + n[i])


def few_with_partner(n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The same for a short list, pair by pair."""
    p, q = SIMILAR
    both = (p + q) * np.minimum(left[:, None], left) >= p * (n[:, None] + n)
    return both.sum(axis=1) - both.diagonal() > 0


def with_partner(n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which members of a list have another one in it that they may link with, as ``may_link`` says, in n log n steps."""
    p, q = SIMILAR
    room = (p + q) * left - p * n  # a partner's n-grams, p times, are no more than this
    order = np.argsort(n, kind="stable")
    best = np.maximum.accumulate(room[order])
    first = np.flatnonzero(np.diff(best, prepend=best[:1] - 1) > 0)
    who = np.repeat(first, np.diff(np.append(first, len(n))))  # whose room is the largest so far
    before = np.append(np.iinfo(np.int64).min, best[:-1])
    second = np.maximum.accumulate(np.minimum(room[order], before))
    to = np.searchsorted(n[order], room // p, side="right") - 1  # the last that is small enough
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    at = np.maximum(to, 0)
    most = np.where(who[at] == place, second[at], best[at])
    return (to >= 0) & (most >= p * n)


def shared_lists(keys_in: np.ndarray, ids_in: np.ndarray, sizes_in: np.ndarray, left_in: np.ndarray) -> pa.Table:
    """Rows of LISTS for ids that stand under equal keys. left: a set's n-grams from this one on.

    The first n-gram that two linking sets share has enough n-grams after it in both; so a list needs only members
    that have such a partner in it.
    """
    p, q = SIMILAR
    sizes_in, left_in = np.asarray(sizes_in, np.int64), np.asarray(left_in, np.int64)
    order = np.lexsort((ids_in, keys_in))
    k, every = keys_in[order], ids_in[order]
    once = np.append(True, (k[1:] != k[:-1]) | (every[1:] != every[:-1])) if len(k) else np.zeros(0, bool)
    order, k, every = order[once], k[once], every[once]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(k)))
    sizes, lefts = sizes_in[order], left_in[order]
    a, b = start[count == 2], start[count == 2] + 1
    fit = (p + q) * np.minimum(lefts[a], lefts[b]) >= p * (sizes[a] + sizes[b])
    pairs: set[tuple[int, int]] = set(zip(every[a[fit]].tolist(), every[b[fit]].tolist()))
    kinds, keys, lists, lengths = [], [], [], []
    seen: set[int] = set()
    for x, c in zip(start[count > 2].tolist(), count[count > 2].tolist()):
        ids, n, left = every[x : x + c], sizes[x : x + c], lefts[x : x + c]
        kept = with_partner(n, left) if len(ids) > 64 else few_with_partner(n, left)
        ids, n, left = ids[kept], n[kept], left[kept]
        if len(ids) < 2:
            continue
        if len(ids) == 2:
            pairs.add((int(ids[0]), int(ids[1])))
            continue
        rank = mix(ids.view(np.uint64))
        name = int(mix(rank * (2 * np.arange(len(ids), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64)) & ((1 << 63) - 1)
        if name in seen:
            continue
        seen.add(name)
        level = size_class(n)
        for own in np.unique(level).tolist():
            members = np.flatnonzero(level == own)
            leader = int(members[np.argmin(rank[members])])
            for m in np.flatnonzero(may_link(n, left, leader) & ((level == own) | (level == own + 1))).tolist():
                if m != leader:
                    pairs.add((int(ids[leader]), int(ids[m])))
        kinds.append(1)
        keys.append(name)
        lists.append(ids)
        lengths.append(n)
    kinds += [0] * len(pairs)
    keys += [x for x, _ in pairs]
    lists += [[y] for _, y in pairs]
    lengths += [[0]] * len(pairs)
    return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()), "docs": pa.array(lists, pa.list_(pa.int64())), "sizes": pa.array(lengths, pa.list_(pa.int64()))})


def candidates(documents: DataFrame, keep, classes, bits: int, ranges: int) -> DataFrame:
    """(kind, key, docs, sizes): lists of documents that share an n-gram of their prefixes, and pairs with a leader.

    kind 0 is (leader, [document]); kind 1 is (hash of the list, the list) for lists of three or more.
    """

    def emit(batches):
        for ids, sets in documents_in(batches, keep):
            grams, owners, places = [], [], []
            level = classes.value
            for k, s in enumerate(sets):
                m = prefix_length(len(s))
                if m:
                    own = level[s >> np.uint64(64 - bits)]
                    edge = np.partition(own, m - 1)[m - 1]
                    low = np.flatnonzero(own < edge)
                    low = low[np.argsort(own[low], kind="stable")]
                    at_edge = np.flatnonzero(own == edge)  # equal levels are in the order of their hashes
                    grams.append(s[np.concatenate([low, at_edge[: m - len(low)]])])
                    owners.append(np.full(m, k, np.int64))
                    places.append(np.arange(m, dtype=np.uint32))
            if not grams:
                continue
            grams, owners, places = np.concatenate(grams), np.concatenate(owners), np.concatenate(places)
            # another part of the hash than the sketch's slot, so that levels and ranges are independent
            part = ((grams & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            # the range has a hash's lower bits; 32 others leave one chance match in some 10**11 pairs of n-grams
            short = (mix(grams) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(ranges + 1))
            doc, n = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
            for r in range(ranges):
                at = order[cuts[r] : cuts[r + 1]]
                if len(at):
                    who, count = np.unique(owners[at], return_counts=True)
                    columns = [pa.array([r], pa.int32())]
                    columns += [pa.array([x.tobytes()], pa.binary()) for x in (short[at], places[at], doc[who], n[who].astype(np.int32), count.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "grams", "places", "docs", "sizes", "counts"])

    @tidied
    def group(key, batch):
        types = (("grams", np.uint32), ("places", np.uint32), ("docs", np.int64), ("sizes", np.int32), ("counts", np.int32))
        grams, places, docs, sizes, counts = (np.concatenate([np.frombuffer(x, t) for x in batch[c].to_pylist()]) for c, t in types)
        owner = np.repeat(np.arange(len(docs)), counts)
        n = sizes[owner].astype(np.int64)
        return shared_lists(grams, docs[owner], n, n - places)

    parts = mapped(documents, ["doc_id", "text"], "range int, grams binary, places binary, docs binary, sizes binary, counts binary", emit)
    return parts.groupBy("range").applyInArrow(group, LISTS)


class Trie:
    """Sets in one global order, stored with shared beginnings once.

    The prefix index reads the order from its rare end, the trie from its frequent end, where sets share their
    beginnings. level: how frequent each n-gram of an array is in the corpus (all alike where it is not given).
    """

    def __init__(self, sets: list[np.ndarray], level: Callable[[np.ndarray], np.ndarray] | None = None):
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, -level(every).astype(np.int64))) if level else np.arange(len(every))] = np.arange(len(every))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        self.rows = [np.sort(x) for x in np.split(rank[at], cuts)]
        self.width = len(every)
        order = sorted(range(len(sets)), key=lambda i: self.rows[i].astype(">u4").tobytes())
        #: Per node: its n-grams, children, sets that end here, and the least and greatest length of sets below.
        self.grams: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.children: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        path = [(0, 0)]  # (node, depth of its end)
        last = np.zeros(0, np.int64)
        for i in order:
            row = self.rows[i]
            m = min(len(row), len(last))
            differ = np.flatnonzero(row[:m] != last[:m])
            shared = int(differ[0]) if len(differ) else m
            while path[-1][1] > shared:
                node, depth = path.pop()
                above = path[-1][1]
                if above < shared:  # the node splits where the sets part
                    lower = self._node(self.grams[node][shared - above :], self.children[node], self.ends[node])
                    self.grams[node], self.children[node], self.ends[node] = self.grams[node][: shared - above], [lower], []
                    path.append((node, shared))
            if len(row) > shared:
                node = self._node(row[shared:], [], [i])
                self.children[path[-1][0]].append(node)
                path.append((node, len(row)))
            else:
                self.ends[path[-1][0]].append(i)
            last = row
        self.least, self.most = [0] * len(self.grams), [0] * len(self.grams)
        todo, visit = [0], []
        while todo:
            node = todo.pop()
            visit.append(node)
            todo += self.children[node]
        for node in reversed(visit):
            sizes = [len(self.rows[i]) for i in self.ends[node]]
            self.least[node] = min(sizes + [self.least[c] for c in self.children[node]])
            self.most[node] = max(sizes + [self.most[c] for c in self.children[node]])

    def _node(self, grams: np.ndarray, children: list[int], ends: list[int]) -> int:
        self.grams.append(grams)
        self.children.append(children)
        self.ends.append(ends)
        return len(self.grams) - 1

    def similar(self, i: int) -> list[int]:
        """The stored sets that link with stored set ``i``, itself left out."""
        p, q = SIMILAR
        own = np.zeros(self.width, bool)
        own[self.rows[i]] = True
        size, out, todo = len(self.rows[i]), [], [(0, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            if q * self.most[node] < p * size or p * self.least[node] > q * size:
                continue
            overlap += int(np.count_nonzero(own[self.grams[node]]))
            depth += len(self.grams[node])
            if overlap + min(size - overlap, self.most[node] - depth) < needed(size, max(self.least[node], -(-p * size // q))):
                continue
            out += [j for j in self.ends[node] if j != i and overlap >= needed(size, len(self.rows[j]))]
            todo += [(c, overlap, depth) for c in self.children[node]]
        return out


def decoded(texts: list[bytes], size: int = 500_000) -> list[np.ndarray]:
    """The n-gram sets of stored texts."""
    own = [x.decode("utf-8", "surrogatepass") for x in texts]
    return [s for a, b in chunks(own, size) for s in ngram_sets(own[a:b])]


class TrieJudge:
    """Compares n-gram sets in a prefix tree. level: a broadcast of the sketch's levels, in 2**bits slots."""

    def __init__(self, level=None, bits: int = 0):
        self.level, self.bits = level, bits

    def prepare(self, texts: list[bytes]) -> list[np.ndarray]:
        return decoded(texts)

    def links(self, sets: list[np.ndarray], probe: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
        """(probe, member) of similar sets in different parts."""
        of = (lambda g: self.level.value[g >> np.uint64(64 - self.bits)]) if self.level is not None else None
        trie = Trie(sets, of)
        return [(i, j) for i in np.flatnonzero(probe).tolist() for j in trie.similar(i) if part[i] != part[j]]


def verified(rows: DataFrame, store: DataFrame, tasks: int, judge) -> DataFrame:
    """(a, b) links between probes and members of other components of each list. rows: (list, doc_id, component, probe)."""
    met = rows.join(store.select("doc_id", "grams"), "doc_id").select(F.pmod(F.xxhash64("list"), F.lit(tasks)).alias("task"), "list", "doc_id", "component", "probe", "grams")

    @tidied
    def compare(key, batch):
        a: list[int] = []
        b: list[int] = []
        names, docs, probe, part = (np.asarray(batch[c]) for c in ("list", "doc_id", "probe", "component"))
        grams = batch["grams"].combine_chunks()
        length = np.asarray(pc.binary_length(grams))
        order = np.lexsort((~probe, docs, names))
        once = np.append(True, (np.diff(names[order]) != 0) | (np.diff(docs[order]) != 0))  # as a probe where it is both
        order = order[once]
        cuts = [*np.flatnonzero(np.append(True, np.diff(names[order]) != 0)).tolist(), len(order)]
        done = 0
        while done < len(cuts) - 1:  # lists are taken together up to some text
            upto, size = done, 0
            while upto < len(cuts) - 1 and (upto == done or size < 4_000_000):
                size += int(length[order[cuts[upto] : cuts[upto + 1]]].sum())
                upto += 1
            at = order[cuts[done] : cuts[upto]]
            who, which = np.unique(docs[at], return_inverse=True)
            place = np.empty(len(who), np.int64)
            place[which] = at
            ready = judge.prepare(grams.take(pa.array(place)).to_pylist())
            for x, y in zip(cuts[done:upto], cuts[done + 1 : upto + 1]):
                if y - x > 1:
                    own, base = order[x:y], which[x - cuts[done] : y - cuts[done]]
                    found = judge.links([ready[i] for i in base.tolist()], probe[own], part[own])
                    a += [int(docs[own[i]]) for i, _ in found]
                    b += [int(docs[own[j]]) for _, j in found]
            done = upto
        # a task's links as stars: their number follows the members, not the pairs
        node, top = union_find(np.array(a, np.int64), np.array(b, np.int64))
        own = node != top
        return pa.table({"a": pa.array(node[own], pa.int64()), "b": pa.array(top[own], pa.int64())})

    return met.groupBy("task").applyInArrow(compare, "a long, b long")


def similar_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    spark = documents.sparkSession
    stats = written(class_table(documents).groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "set_id"), "set_id").alias("s")).select("doc_id", "s.n_shingles", "s.set_id"), "sets")
    classes = written(stats.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1").select("set_id", "class_id"), "classes")
    placed = looked_up(stats, classes, "set_id").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"))
    placed = written(placed, "placed")
    alone = placed.where("doc_id = class_id and n_shingles > 0")
    unique = placed.select("doc_id").count() == documents.count()
    total, count = alone.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    if not count:
        return placed.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # copies that are not their class's smallest id need no index: a filter that may let a few through
    wanted, width = id_filter(alone, "doc_id")
    told = spark.sparkContext.broadcast(wanted)  # 2**FILTER_BITS bits at most
    keep = lambda ids: maybe_in(told.value, width, ids)
    bits = int(min(LARGEST, max(SMALLEST, math.ceil(math.log2(max(2, total) / 8)))))
    level = spark.sparkContext.broadcast(frequency_classes(documents, keep, bits))  # 2**LARGEST bytes at most
    ranges = max(32, math.ceil(total / 4_000_000))
    found = written(candidates(documents, keep, level, bits, ranges), "candidates")


    def texts_of_ids(involved: DataFrame) -> DataFrame:
        asked, asked_width = id_filter(involved, "doc_id")
        asked_told = spark.sparkContext.broadcast(asked)
        both = lambda ids: maybe_in(asked_told.value, asked_width, ids) & keep(ids)

        def stored(batches):
            for batch in pieces(batches):
                batch = batch.filter(pa.array(both(np.asarray(batch.column(0)))))
                texts = texts_of(batch.column(1))
                for a, b in chunks(texts, 1_000_000):
                    own = ngram_sets(texts[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([set_name(s) for s in own], pa.string()), pa.array([t.encode("utf-8", "surrogatepass") for t in texts[a:b]], pa.binary()), pa.array([sketch_of(s) for s in own], pa.binary())], ["doc_id", "set_id", "grams", "sketch"])

        kept = mapped(documents, ["doc_id", "text"], "doc_id long, set_id string, grams binary, sketch binary", stored)
        return kept if unique else kept.groupBy("doc_id").agg(F.min_by(F.struct("grams", "sketch"), "set_id").alias("s")).select("doc_id", "s.*")

    final = linked(found, texts_of_ids, TrieJudge(level, bits), True).select(F.col("node").alias("class_id"), "component")
    return looked_up(placed, final, "class_id").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))


def heads_of(now: DataFrame, turn: int) -> DataFrame:
    """(list, largest, leader, parts) of lists with several components: the largest one and a member of it. now: (list, doc_id, component)."""
    of = F.max_by("doc_id", F.xxhash64("doc_id", F.lit(turn)))
    parts = now.groupBy("list", "component").agg(F.count("*").alias("n"), of.alias("leader"))
    top = parts.groupBy("list").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), F.max_by(F.struct("component", "leader", "n"), F.struct("n", "component")).alias("top")).where("parts > 1")
    return written(top.select("list", "members", F.col("top.component").alias("largest"), "top.leader", (F.col("members") - F.col("top.n")).alias("probes")), "heads")


def linked(found: DataFrame, texts_of_ids: Callable[[DataFrame], DataFrame], judge, sifting: bool, many: int = 0) -> DataFrame:
    """(node, component) over all links among candidates.

    found: as ``candidates`` gives them; texts_of_ids: (doc_id, grams[, sketch]) of the ids in a table; judge: prepares
    stored texts and finds the links of a list; sifting: whether sketches are there to leave what cannot link; many: members
    of a list from which other leaders are tried before its blocks, as shorter ones are soon compared whole.
    """
    with steps() as keep:
        pairs = written(found.where("kind = 0").select(F.col("key").alias("leader"), F.col("docs")[0].alias("doc_id")).distinct(), "pairs")
        lists = found.where("kind = 1").dropDuplicates(["key"]).select(F.col("key").alias("list"), "docs")
        members = written(lists.select("list", F.explode("docs").alias("doc_id")), "members")
        involved = written(pairs.select("doc_id").union(pairs.select("leader")).union(members.select("doc_id")).distinct(), "involved")
        store = written(texts_of_ids(involved), "texts")
        tasks = max(32, math.ceil((pairs.count() + members.count()) / 2_000))
        meet = compared if sifting else verified

        # leaders first: lists of a leader and a share of its members
        links = written(meet(led(pairs), store, tasks, judge), "links")
        known = components(links)
        # other leaders, from each list's largest component, for what is outside it: a few rounds join the groups of near copies
        long = members
        if many:
            long = written(looked_up(members, written(lists.where(F.size("docs") >= many).select("list"), "long"), "list", "inner"), "members")
        for turn in range(LEADER_ROUNDS):
            now = placed_in(long, known)
            top = heads_of(now, turn).select("list", "largest", "leader")
            more = written(looked_up(now, top, "list", "inner").where("component <> largest").select("leader", "doc_id").distinct(), "pairs")
            if more.isEmpty():
                if many:
                    break
                return keep(known)
            fresh = written(meet(led(more), store, tasks, judge), "links")
            if fresh.isEmpty():
                break
            links = links.union(fresh)
            known = components(links)

        # then the lists that still hold several components: what is outside the largest one meets all members, block by block
        now = placed_in(members, known)
        top = heads_of(now, LEADER_ROUNDS).select("list", "largest", F.ceil(F.col("members") / BLOCK).cast("int").alias("across"), F.ceil(F.col("probes") / BLOCK).cast("int").alias("down"))
        rest = looked_up(now, top, "list", "inner").withColumn("mine", F.xxhash64("doc_id"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        stored = rest.select("list", "doc_id", "component", F.lit(False).alias("probe"), each("down").alias("row"), F.pmod("mine", "across").alias("column"))
        asking = rest.where("component <> largest").select("list", "doc_id", "component", F.lit(True).alias("probe"), F.pmod("mine", "down").cast("int").alias("row"), each("across").alias("column"))
        blocks = stored.union(asking.withColumn("column", F.col("column").cast("long"))).select(F.xxhash64("list", "row", "column").alias("list"), "doc_id", "component", "probe")
        last = written(meet(written(blocks, "blocks"), store, tasks, judge), "links")
        return keep(known if last.isEmpty() else components(links.union(last)))


def placed_in(members: DataFrame, known: DataFrame) -> DataFrame:
    """(list, doc_id, component) of the lists' members, as a written table."""
    now = looked_up(members.select("list", "doc_id"), known.withColumnRenamed("node", "doc_id"), "doc_id").withColumn("component", F.coalesce("component", "doc_id"))
    return written(now.select("list", "doc_id", "component"), "placed")


def led(pairs: DataFrame) -> DataFrame:
    """Lists of a leader, which is the probe, and a share of its members, BLOCK or so. pairs: a written table of (leader, doc_id)."""
    many = written(pairs.groupBy("leader").count().where(F.col("count") > BLOCK).select("leader", F.ceil(F.col("count") / BLOCK).cast("int").alias("shares")), "shares")
    share = looked_up(pairs, many, "leader").select("doc_id", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("doc_id"), F.coalesce("shares", F.lit(1)))).alias("list"))
    heads = share.select("list", F.col("leader").alias("doc_id")).distinct()
    rows = share.select("list", "doc_id", F.lit(False).alias("probe")).union(heads.withColumn("probe", F.lit(True)))
    return rows.select("list", "doc_id", F.col("doc_id").alias("component"), "probe")


def sketch_of(grams: np.ndarray) -> bytes:
    """How many of a set's n-grams fall in each of BUCKETS parts; all zero where a count is too large for a byte."""
    counts = np.bincount((grams >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return (counts if counts.max() < 256 else counts * 0).astype(np.uint8).tobytes()


def compared(rows: DataFrame, store: DataFrame, tasks: int, judge) -> DataFrame:
    """(a, b) links of probes with members of other components of their lists. rows: (list, doc_id, component, probe).

    Two sets overlap in no more n-grams than the lesser counts of their sketches' parts add up to. What cannot reach
    the overlap needed is left before the texts themselves are brought together.
    """
    met = rows.join(store.select("doc_id", "sketch"), "doc_id").select(F.pmod(F.xxhash64("list"), F.lit(tasks)).alias("task"), "list", "doc_id", "component", "probe", "sketch")

    @tidied
    def sift(key, batch):
        names, docs, parts, probe = (np.asarray(batch[c]) for c in ("list", "doc_id", "component", "probe"))
        sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
        size = sketch.sum(axis=1, dtype=np.int64)
        order = np.lexsort((docs, names))
        cuts = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] - 1))
        kept = np.zeros(len(names), bool)
        p, q = SIMILAR
        for x, y in zip(cuts, [*cuts[1:], len(order)]):
            at = order[x:y]
            own, n = sketch[at], size[at]
            for i in np.flatnonzero(probe[at]).tolist():
                most = np.minimum(own, own[i]).sum(axis=1, dtype=np.int64)
                may = ((p + q) * most >= p * (n + n[i])) | (n == 0) | (n[i] == 0)
                may &= parts[at] != parts[at[i]]
                if may.any():
                    kept[at[may]] = True
                    kept[at[i]] = True
        return pa.table({"list": pa.array(names[kept]), "doc_id": pa.array(docs[kept]), "component": pa.array(parts[kept]), "probe": pa.array(probe[kept])})

    sifted = written(met.groupBy("task").applyInArrow(sift, "list long, doc_id long, component long, probe boolean"), "sifted")
    return verified(sifted, store, tasks, judge)


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not in the written table ``ids``; rows without an id stay."""
    return documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti")
