"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

The bytes of a text get a label each: no token ends here, a token of A ends, one of B ends, or both. A regular expression
scans the labels for spans up to each "both"; a span is a token group, and its labels count the tokens of A and B in it.
Between two labelled bytes lies a piece of exactly one token of A and one of B, so the labels also give all links, the
pairs of tokens whose byte ranges overlap.

A pair of ids counts the documents that hold it linked. Each task counts its own documents' pairs before the shuffle.
Pairs from a frequency on that lets at most ``BROADCAST_PAIRS`` through are broadcast; rows join the table of the rarer
ones, none of which is held by many documents.

Tokens come from the public libraries, for each new unit of text once: a unit is a run of blanks and line feeds with what
follows up to the next one, which no token of either vocabulary crosses (checked in the vocabularies). Texts with other
white space are encoded whole.

Cases: null and empty texts, and texts whose tokens' bytes are not those of a blank and the text, have zeros and an empty
digest; long texts go in segments, since units end at group borders; repeated rows count as documents of their own; an
empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import chunks, mapped, pieces, texts_of, written

#: Rows of the table of pairs that may be broadcast (34 MB).
BROADCAST_PAIRS = 2_000_000
#: Characters that are aligned at a time, and units that a worker remembers.
SEGMENT, REMEMBERED = 1_000_000, 1_000_000
#: Pairs that a task holds before it hands their counts on.
HELD_PAIRS = 2_000_000

#: Labels of a byte: no token ends, one of A, one of B, both; and spans up to each "both".
A_ENDS, B_ENDS, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
ODD_SPACE = re.compile(r"[^\S \n]")


def union_of(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


@dataclass
class Aligned:
    """A document's counts, its groups as text, and its linked pairs with how often each is linked."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: np.ndarray
    times: np.ndarray


NOTHING = Aligned(0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


class Aligner:
    """Encodes with both tokenizers and aligns their tokens."""

    def __init__(self, byte_level: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        self.a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a_size)]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # whether no token that a text without odd white space can have holds a blank or line feed behind another character
        inner = re.compile(rb"[^ \n][ \n]")
        usual = [x for x in self.a_bytes if not ODD_SPACE.search(x.decode("utf-8", "replace"))]
        self.by_unit = not any(map(inner.search, usual)) and not any(inner.search(x) or (b"\n" in x and len(x) > 1) for x in self.b_bytes)
        self.table = np.array([f"{i}," for i in range(self.a_size)] + [f"{i}|" for i in range(self.a_size)] + [f"{i}," for i in range(self.b_size)] + [f"{i};" for i in range(self.b_size)], object)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32)] * 2
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)] * 2
        self.exact = np.zeros(0, bool)

    def whole(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of A and B of each text behind a blank."""
        a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(a, self.b.encode(texts, num_threads=1))]

    def equal(self, ids: tuple[list[int], list[int]], raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, ids[0])) == raw == b"".join(map(self.b_bytes.__getitem__, ids[1]))

    def learn(self, units: list[str]) -> None:
        """Encodes new units; each begins with a blank or a line feed. B adds a blank, which takes the place of the unit's own or goes again."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        b = [x if u[0] == " " else x[1:] for x, u in zip(b, units)]
        for x, u in zip(b, units):
            if not x and u == " ":  # B adds no blank to an empty text
                x.append(self.b.piece_to_id("▁"))
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        raw = [u.encode() for u in units]
        joined, size = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        same = True
        for k, (own, told, length) in enumerate(((a, self.a_bytes, self.a_length), (b, self.b_bytes, self.b_length))):
            flat = list(itertools.chain.from_iterable(own))
            ids, ends = np.array(flat, np.int32), np.append(0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own))))
            reached = np.append(0, np.cumsum(length[ids]))[ends]
            same = same and (np.diff(reached) == size).all() and b"".join(map(told.__getitem__, flat)) == joined
            self.ids[k] = np.append(self.ids[k], ids)
            self.ends[k] = np.append(self.ends[k], self.ends[k][-1] + ends[1:])
        self.exact = np.append(self.exact, np.ones(len(raw), bool) if same else [self.equal(x, u) for x, u in zip(zip(a, b), raw)])

    def streams(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and B of each text, None where there are none by rule. A text begins with the blank before it, or with a line feed or blank of its own inside a document."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        units: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if "▁" in t:  # B tells it as a blank
                continue
            if self.by_unit and not ODD_SPACE.search(t):
                units[i] = UNIT.findall(t)
                continue
            own = self.whole([t[1:]])[0]
            if self.equal(own, t.encode()):
                out[i] = np.array(own[0], np.int32), np.array(own[1], np.int32)
        if len(self.number) > REMEMBERED:
            self.forget()
        new = list(set().union(*units.values()).difference(self.number))
        if new:
            self.learn(new)
        number = self.number
        for i, own in units.items():
            at = np.array(list(map(number.__getitem__, own)), np.int64)
            if self.exact[at].all():
                out[i] = tuple(self.gathered(k, at) for k in (0, 1))
            else:
                ids = self.whole([texts[i][1:]])[0] if texts[i][0] == " " else ([], [])
                if self.equal(ids, texts[i].encode()):
                    out[i] = np.array(ids[0], np.int32), np.array(ids[1], np.int32)
        return out

    def gathered(self, k: int, at: np.ndarray) -> np.ndarray:
        """The ids of units one behind the other."""
        first = self.ends[k][at]
        size = self.ends[k][at + 1] - first
        return self.ids[k][np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """The alignment of each text, which includes the blank before it."""
        streams = self.streams(texts)
        kept = [i for i, s in enumerate(streams) if s is not None and len(s[0])]
        out: list[Aligned | None] = [None] * len(texts)
        if not kept:
            return out
        a, b = (np.concatenate([streams[i][k] for i in kept]) for k in (0, 1))
        n_a, n_b = (np.array([len(streams[i][k]) for i in kept]) for k in (0, 1))
        labels = np.zeros(int(self.a_length[a].sum()), np.uint8)
        labels[np.cumsum(self.a_length[a]) - 1] |= A_ENDS
        labels[np.cumsum(self.b_length[b]) - 1] |= B_ENDS
        spans = SPAN.findall(labels.tobytes())
        stop = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        of_a, of_b = np.cumsum(labels & A_ENDS, dtype=np.int64), np.cumsum(labels >> 1, dtype=np.int64)
        a_through, b_through = of_a[stop - 1], of_b[stop - 1]  # tokens up to each group's end
        groups = np.diff(np.searchsorted(a_through, np.append(0, np.cumsum(n_a)), side="right"))
        # the groups as text: the tokens of A, then those of B, each with what follows it
        sizes = np.diff(a_through, prepend=0), np.diff(b_through, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(np.append(0, b_through[:-1]), sizes[0])
        place_b = np.arange(len(b)) + np.repeat(a_through, sizes[1])
        codes = np.zeros(len(a) + len(b), np.int32)
        last_a, last_b = np.zeros(len(a), np.int32), np.zeros(len(b), np.int32)
        last_a[a_through - 1] = self.a_size
        last_b[b_through - 1] = self.b_size
        codes[place_a], codes[place_b] = a + last_a, b + last_b + 2 * self.a_size
        told = self.table[codes].tolist()
        # one link for each labelled byte
        at = np.flatnonzero(labels)
        left, right = of_a[at] - (labels[at] & A_ENDS), of_b[at] - (labels[at] >> 1)
        document = np.searchsorted(np.cumsum(n_a), left, side="right")
        pair = a[left].astype(np.int64) * self.b_size + b[right]
        span = self.a_size * self.b_size
        if len(kept) > np.iinfo(np.int64).max // span:
            raise ValueError("too many texts at a time")
        keys = np.sort(document * span + pair)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        cuts = np.searchsorted(keys, np.arange(len(kept) + 1) * span)
        keys %= span
        ends = np.append(0, np.cumsum(n_a + n_b))
        for k, i in enumerate(kept):
            own = slice(cuts[k], cuts[k + 1])
            out[i] = Aligned(int(n_a[k]), int(n_b[k]), int(groups[k]), "".join(told[ends[k] : ends[k + 1]])[:-1], keys[own], times[own])
        return out

    def documents(self, texts: list[str]) -> Iterator[tuple[Aligned, str]]:
        """The alignment of each document and the digest of its groups."""
        for a, b in chunks(texts, SEGMENT):
            if b - a == 1 and len(texts[a]) > SEGMENT:
                yield self.long(" " + texts[a])
                continue
            for found in self.align([" " + t if t else "" for t in texts[a:b]]):
                found = found or NOTHING
                yield found, hashlib.sha256(found.groups.encode()).hexdigest() if found.groups else ""

    def long(self, text: str) -> tuple[Aligned, str]:
        """A long text in segments of whole units; no two segments share a token or a group."""
        segments, start = [], 0
        if self.by_unit and not ODD_SPACE.search(text):
            border = re.compile(r"(?<=[^ \n])[ \n]")
            while len(text) - start > SEGMENT and (cut := border.search(text, start + SEGMENT)):
                segments.append((start, cut.start()))
                start = cut.start()
        segments.append((start, len(text)))
        n_a = n_b = n_groups = 0
        pairs, times, digest = NOTHING.pairs, NOTHING.times, hashlib.sha256()
        for k, (i, j) in enumerate(segments):
            found = self.align([text[i:j]])[0]
            if found is None:
                return NOTHING, ""
            n_a, n_b, n_groups = n_a + found.n_a, n_b + found.n_b, n_groups + found.n_groups
            digest.update((";" if k else "").encode() + found.groups.encode())
            pairs, times = union_of(np.append(pairs, found.pairs), np.append(times, found.times))
        return Aligned(n_a, n_b, n_groups, "", pairs, times), digest.hexdigest()


@functools.cache
def aligner(byte_level: str, piece_model: str) -> Aligner:
    """One for each worker."""
    return Aligner(byte_level, piece_model)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_pairs long, pairs binary, times binary"
#: Its columns that stay, with the sums over links behind them.
COUNTED = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
LINKS = ["n_pairs", "pairs", "times"]


def packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest of the widths 1, 2, 4 and 8."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def align_documents(documents: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """A written table with a row of its own number for each document: counts, digest of the groups, its pairs as ascending differences and how often each is linked.

    A pair is the id of A times the number of ids of B, plus the id of B.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(byte_level, piece_model), TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            ids = batch.column(0)
            found = list(own.documents(texts_of(batch.column(1))))
            columns = [pa.array(np.arange(number, number + len(found))), ids]
            columns += [pa.array([getattr(x, c) for x, _ in found], pa.int64()) for c in ("n_a", "n_b", "n_groups")]
            columns += [pa.array([d for _, d in found], pa.string()), pa.array([len(x.pairs) for x, _ in found], pa.int64()), pa.array([packed(np.diff(x.pairs, prepend=0)) for x, _ in found], pa.binary()), pa.array([packed(x.times) for x, _ in found], pa.binary())]
            number += len(found)
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    return written(mapped(documents, ["doc_id", "text"], ALIGNED, over), "aligned")


def links_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, times, row of the batch) of all different links of a batch with columns ``n_pairs``, ``pairs`` and ``times``."""
    size = batch.column("n_pairs").to_pylist()
    told = [[unpacked(raw, n) for raw, n in zip(batch.column(c).to_pylist(), size)] for c in ("pairs", "times")]
    join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
    return join(map(np.cumsum, told[0])), join(told[1]), np.repeat(np.arange(len(size)), size)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """A written table (pair, a, n, best): how many documents hold each pair, and whether no other pair of its id of A is held by more."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(links_of(batch)[0])
            if sum(map(len, waiting)) > HELD_PAIRS:
                some = np.concatenate(waiting)
                keys, counts = union_of(np.append(keys, some), np.append(counts, np.ones(len(some), np.int64)))
                waiting = []
            if len(keys) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                keys, counts = keys[:0], counts[:0]
        some = np.concatenate([*waiting, np.zeros(0, np.int64)])
        keys, counts = union_of(np.append(keys, some), np.append(counts, np.ones(len(some), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    return mapped(aligned, LINKS, "pair long, n long", over).groupBy("pair").agg(F.sum("n").alias("n"))


def counted_links(aligned: DataFrame, b_size: int, most: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum in place of their links."""
    counts = written(pair_counts(aligned).withColumn("a", F.expr(f"pair div {b_size}")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = written(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "pairs")
    level = F.floor(F.log2("n")).cast("int")
    least, common = 63, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # 63 levels at most
        if common + r.k > most:
            break
        least, common = r.level, common + r.k
    rest = counts.where(level < least)
    told = counts.where(level >= least).toArrow()  # ``most`` rows at most
    order = np.argsort(told["pair"].to_numpy())
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(told[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs, n, _ = shared.value
        keys, times, owner = links_of(batch)
        at = np.searchsorted(pairs, keys)
        at[at == len(pairs)] = 0
        return keys, times, owner, at, (pairs[at] == keys) if len(pairs) else np.zeros(len(keys), bool)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, best = shared.value
            _, times, owner, at, here = found(batch)
            sums = []
            for x in (best, n):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, owner[here], times[here] * x[at[here]])
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COUNTED), *sums], [*COUNTED, "n_best", "count_sum"])

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times, owner, _, here = found(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[~here])), pa.array(keys[~here]), pa.array(times[~here])], ["row", "pair", "times"])

    kinds = dict(aligned.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in COUNTED)
    out = mapped(aligned, [*COUNTED, *LINKS], f"{schema}, n_best long, count_sum long", summed)
    if rest.isEmpty():
        return out
    rare = mapped(aligned, ["row", *LINKS], "row long, pair long, times long", missing).join(rest, "pair")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    add = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return out.join(more, "row", "left").select(*COUNTED, add("n_best", "more_best"), add("count_sum", "more_sum"))


def align(documents: DataFrame, byte_level: str, piece_model: str, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Each document's counts of tokens, groups and links, the sums over its links, and the digest of its groups."""
    import sentencepiece

    aligned = align_documents(documents, byte_level, piece_model)
    b_size = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return counted_links(aligned, b_size, most).select("doc_id", "n_a", "n_b", "n_groups", links, "n_best", "count_sum", "groups_sha256")
