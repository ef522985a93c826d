"""BPE encoding and decoding with a pair occurrence index.

The words that a partition has not met before are encoded together: their symbols lie in one array of linked
positions, an index maps each mergeable pair to all its positions, a heap hands out the active ranks in ascending
order, and every merge updates the lists of the two neighbouring pairs only. Words met before come from a bounded
table that lives as long as the worker.

Cases: a null text is the empty text and has no ids; a text of any length is encoded whole; repeated rows give
repeated results; an empty table gives an empty table; other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import LET_GO, chunks, mapped, mix, pieces, texts_of

#: Fixed values of the vocabulary file: its splitting pattern, and the marker at a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters outside ASCII and the letters of Latin-1, and control characters: their texts go the general way.
NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
#: Words that a worker remembers; then it starts afresh, so memory is bounded.
REMEMBERED = 2_000_000
#: Characters that are encoded at a time.
CHUNK = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in told["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.size = np.int64(size)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*pairs))
        keys = self.left.astype(np.int64) * self.size + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split = regex.compile(SPLIT)
        self.lefts, self.rights, self.mades = self.left.tolist(), self.right.tolist(), self.made.tolist()
        self.by_pair = {a * size + b: r for r, (a, b) in enumerate(zip(self.lefts, self.rights))}
        self.known: dict[str, bytes] = {}
        one_byte = [chr(i) for i in range(256)]
        self.kinds = np.array([0 if c in " \t\n\r\x0b\x0c" else 1 if c.isalpha() else 2 if c in "0123456789" else 3 for c in one_byte], np.uint8)
        self.letters = np.random.default_rng(1).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
        self.forget()

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens in it."""
        text = unicodedata.normalize("NFC", text)
        return self.split.findall("".join(c.lower() for c in text) if "Σ" in text else text.lower())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 where the pair never merges."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        first = self.inner[data]
        first[ends - 1] = self.last[data[ends - 1]]
        n = len(first)
        rank = np.append(self.ranks(first[:-1], first[1:]), -1)
        rank[ends - 1] = -1  # a word's last symbol has no right neighbour
        # places in the order of their ranks: the first entry of each list of the index
        order = np.flatnonzero(rank >= 0)
        order = order[np.argsort(rank[order], kind="stable")]
        ranks = rank[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)) if len(ranks) else np.zeros(1, np.int64)
        places = order.tolist()
        cuts = cuts.tolist()
        index = {r: places[x:y] for r, x, y in zip(ranks[cuts[:-1]].tolist() if len(ranks) else [], cuts, cuts[1:])}
        sym, nxt, prv = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        sym.append(-1)
        for e in ends.tolist():
            nxt[e - 1] = n
            if e < n:
                prv[e] = -1
        active, left, right, made, by_pair, size = list(index), self.lefts, self.rights, self.mades, self.by_pair, int(self.size)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, ab = left[r], right[r], made[r]
            at = index.pop(r)
            at.sort()  # of overlapping places the leftmost merges
            for p in at:
                q = nxt[p]
                if sym[p] != a or sym[q] != b:
                    continue
                sym[p], sym[q] = ab, -1
                nxt[p] = q = nxt[q]
                if q != n:
                    prv[q] = p
                    other = by_pair.get(ab * size + sym[q])
                    if other is not None:
                        if other in index:
                            index[other].append(p)
                        else:
                            index[other] = [p]
                            heapq.heappush(active, other)
                q = prv[p]
                if q >= 0:
                    other = by_pair.get(sym[q] * size + ab)
                    if other is not None:
                        if other in index:
                            index[other].append(q)
                        else:
                            index[other] = [q]
                            heapq.heappush(active, other)
        out = np.array(sym[:-1], np.int32)
        keep = out >= 0
        ids = out[keep].astype("<u4").tobytes()
        cuts = (4 * np.append(0, np.cumsum(keep))[np.append(0, ends)]).tolist()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]

    def starts(self, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the words of normalised one-byte text start. kind: 0 white space, 1 letter, 2 digit, 3 other."""
        fresh = np.empty(len(data), bool)
        fresh[:1] = True
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        fresh &= kind > 0
        for i in np.flatnonzero(fresh[:-1] & (data[:-1] == 39) & (kind[1:] == 1)).tolist():
            # an apostrophe alone before letters: the pattern's contractions come first
            after = data[i + 1 : i + 3].tobytes()
            size = 1 if after[:1] in (b"s", b"t", b"m", b"d") else 2 if after in (b"re", b"ve", b"ll") else 0
            if size:
                fresh[i + 1] = False
                if i + 1 + size < len(data) and kind[i + 1 + size] == 1:
                    fresh[i + 1 + size] = True
        return np.flatnonzero(fresh)

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of ASCII and Latin-1 letters, all at once.

        Words are told apart by 64-bit polynomial hashes of their bytes, whose collisions are left to chance
        (under one in a million for ten million different words).
        """
        raw = [t.lower().encode("latin-1") + b" " for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        kind = self.kinds[data]
        start = self.starts(data, kind)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        # a word ends where the next one starts, or at the first white space
        gap = np.append(start, len(data))
        blank = np.cumsum(kind == 0, dtype=np.int64)
        size = np.diff(gap) - (blank[gap[1:] - 1] - blank[gap[:-1]]) if len(start) else np.zeros(0, np.int64)
        power, inverse = powers(len(data) + 1)
        prefix = np.empty(len(data) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(self.letters[data] * power[: len(data)], out=prefix[1:])
        word = mix((prefix[start + size] - prefix[start]) * inverse[start])
        distinct, where, which = np.unique(word, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        found = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        if not found.all():
            new = where[~found]
            own = [data[x:y].tobytes().decode("latin-1") for x, y in zip(start[new].tolist(), (start[new] + size[new]).tolist())]
            self.remember(distinct[~found], self.merge(own), at[~found])
            at = np.searchsorted(self.hashes, distinct)
        entry = self.entry[at][which]
        count, begin = self.count[entry], self.begin[entry]
        total = np.cumsum(count, dtype=np.int64)
        flat = self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - count), count)]
        words_before = np.searchsorted(start, np.cumsum([0, *map(len, raw)]))
        cuts = np.append(0, total)[words_before].tolist()
        return [flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.begin, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def remember(self, hashes: np.ndarray, ids: list[bytes], at: np.ndarray) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.hashes = np.insert(self.hashes, at, hashes)
        self.entry = np.insert(self.entry, at, np.arange(len(ids)) + len(self.count))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))

    def other(self, text: str) -> bytes:
        """The ids of a text with other characters or special tokens."""
        own, at = [], 0
        for m in self.special.finditer(text) if self.special is not None else ():
            own += [self.words(text[at : m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        own.append(self.words(text[at:]))
        new = list({w for x in own if isinstance(x, list) for w in x} - self.known.keys())
        if len(self.known) > REMEMBERED // 10:
            self.known.clear()
            new = list({w for x in own if isinstance(x, list) for w in x})
        if new:
            self.known.update(zip(new, self.merge(new)))
        return b"".join(b"".join(map(self.known.__getitem__, x)) if isinstance(x, list) else x for x in own)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each whole text's ids, little-endian unsigned 32-bit, as one string of bytes."""
        is_plain = [not NOT_PLAIN.search(t) and not (self.special is not None and self.special.search(t)) for t in texts]
        quick = iter(self.plain([t for t, x in zip(texts, is_plain) if x]))
        return [next(quick) if x else self.other(t) for t, x in zip(texts, is_plain)]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids, special ones too, with a space between them: the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


#: The odd number whose powers weigh the places of a rolling hash.
BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        out = np.full(size, np.uint64(x))
        out[0] = 1
        both.append(np.cumprod(out))
    return both[0], both[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, ``size`` of each at least."""
    return powers_to(1 << max(20, int(size - 1).bit_length()))


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


_used: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    _used[path] = _codec(path)
    return _used[path]


def _let_go() -> None:
    """Words that a partition has met, and long tables of powers, go; the vocabulary stays."""
    for c in _used.values():
        if len(c.hashes) > REMEMBERED // 20:
            c.forget()
        c.known.clear()
    powers_to.cache_clear()


LET_GO.append(_let_go)


def encode_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row of ``df``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in pieces(batches):
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts, CHUNK):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode(texts[a:b])]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], [key, "ids"])

    return mapped(df, [key, text], f"{key} {dict(df.dtypes)[key]}, ids array<int>", over)


def decode_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded string) of each row of ``df``; null ids decode to the empty text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [key, "decoded"])

    return mapped(df, [key, ids], f"{key} {dict(df.dtypes)[key]}, decoded string", over)


def round_trip_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        decimal = [str(i) for i in range(len(coder.tokens))].__getitem__
        for batch in pieces(batches):
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts, CHUNK):
                sizes, first, second = [], [], []
                for x in coder.encode(texts[a:b]):
                    ids = np.frombuffer(x, "<u4").tolist()
                    sizes.append(len(ids))
                    first.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    second.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(df, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", over)
