"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers (powers of two up to the longest window). A document longer than the
longest window first gives full windows; what is left goes to the smallest tier that holds it. Tiers are packed from
the longest to the shortest: each of a tier's documents opens a window, and its gap is filled from shorter tiers,
best fit first; what still does not fit is cut. The short rest of a task closes in windows of falling powers of two,
so no position is padding. Sequences are then dealt over step groups so that all groups of a task hold nearly the same
number of windows of each size, hence of tokens.

Each task packs the rows it reads: nothing is shuffled, no group of rows meets in one task, and a lost task is simply
packed again with the same result. Memory is bounded by a pool of ``pool_tokens``.

Cases: a null or empty text is its end token alone; a document of any length is cut freely and stays whole over its
pieces; repeated rows are packed each; an empty table gives no pieces; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, codec
from .common import chunks, mapped, pieces as slices, texts_of

#: Context sizes, shortest first.
TIERS = (256, 512, 1024, 2048)
#: The id that ends each document.
END = 1
#: A step group's tokens.
STEP_TOKENS = 1 << 16

#: A piece in the pool: document, ids before it in its document, the document's ids, and its own ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Pool:
    """Pieces that wait for a window, by tier and length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.by_length: list[dict[int, list[Piece]]] = [{} for _ in tiers]
        self.lengths: list[np.ndarray] = [np.zeros(t + 1, np.int32) for t in tiers]
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        n = len(piece[3])
        tier = next(k for k, t in enumerate(self.tiers) if n <= t)
        self.by_length[tier].setdefault(n, []).append(piece)
        self.lengths[tier][n] += 1
        self.tokens += n

    def take(self, tier: int, n: int) -> Piece:
        self.lengths[tier][n] -= 1
        self.tokens -= n
        return self.by_length[tier][n].pop()

    def longest(self, tier: int, limit: int) -> int:
        """The longest length in a tier that is ``limit`` at most; 0 if there is none."""
        found = np.flatnonzero(self.lengths[tier][: limit + 1])
        return int(found[-1]) if len(found) else 0

    def fit(self, below: int, gap: int) -> Piece | None:
        """The longest piece for a gap from tiers up to ``below``, cut if none fits whole."""
        for tier in range(below, -1, -1):
            if n := self.longest(tier, gap):
                return self.take(tier, n)
        for tier in range(below + 1):
            if n := self.longest(tier, self.tiers[tier]):
                doc, start, total, ids = self.take(tier, n)
                self.add((doc, start + gap, total, ids[gap:]))
                return doc, start, total, ids[:gap]
        return None


def packed(pool: Pool, last: bool) -> Iterator[tuple[int, list[Piece]]]:
    """(window size, its pieces) until the pool is empty, or, unless ``last``, holds less than a window of each tier."""
    for tier in range(len(pool.tiers) - 1, -1, -1):
        size = pool.tiers[tier]
        while n := pool.longest(tier, size):
            if pool.tokens < size:
                break
            window, gap = [pool.take(tier, n)], size - n
            while gap:
                piece = pool.fit(tier - 1 if tier else 0, gap) or pool.fit(tier, gap)
                if piece is None:
                    break
                window.append(piece)
                gap -= len(piece[3])
            if gap:  # only longer tiers hold tokens, and those are below a window of their own
                for piece in window:
                    pool.add(piece)
                break
            yield size, window
    while last and pool.tokens:  # less than a window of each tier: falling powers of two, which need no padding
        size = min(pool.tiers[-1], 1 << (pool.tokens.bit_length() - 1))
        window, gap = [], size
        while gap:
            piece = pool.fit(len(pool.tiers) - 1, gap)
            window.append(piece)
            gap -= len(piece[3])
        yield size, window


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def pack_documents(df: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = 2_000_000) -> DataFrame:
    """A row per piece: its document, place and ids (little-endian unsigned 32-bit), and its sequence and offset in it.

    ``sequence_id`` is unique over the whole table; ``window`` is the sequence's size; ``step_group`` is the group of
    sequences of ``step_tokens`` tokens in which it is dealt out. A column named like an output column does no harm:
    only ``doc_id`` and ``text`` are read.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pool, task = codec(vocabulary), Pool(tiers), TaskContext.get().partitionId()
        longest, made, first_group = tiers[-1], 0, 0
        end = np.array([END], "<u4").tobytes()
        windows: list[tuple[int, list[Piece]]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, first_group
            total = sum(size for size, _ in windows)
            groups, dealt, rows = max(1, round(total / step_tokens)), 0, []
            for size, pieces in sorted(windows, key=lambda w: -w[0]):  # equal sizes follow each other around the groups
                offset = 0
                for doc, start, tokens, ids in pieces:
                    rows.append((doc, start, len(ids), ids.tobytes(), tokens, task << 33 | made, offset, size, task << 33 | first_group + dealt % groups))
                    offset += len(ids)
                made += 1
                dealt += 1
            first_group += groups
            windows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in slices(batches):
            texts, docs = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in chunks(texts, CHUNK):
                for doc, own in zip(docs[a:b], coder.encode(texts[a:b])):
                    ids = np.frombuffer(own + end, "<u4")
                    full = len(ids) // longest * longest
                    for at in range(0, full, longest):
                        windows.append((longest, [(doc, at, len(ids), ids[at : at + longest])]))
                    if full < len(ids):
                        pool.add((doc, full, len(ids), ids[full:]))
                if pool.tokens >= pool_tokens:
                    windows += packed(pool, False)
                if sum(size for size, _ in windows) >= step_tokens:
                    yield flush()
        windows += packed(pool, True)
        if windows:
            yield flush()

    return mapped(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], SCHEMA, over)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")
