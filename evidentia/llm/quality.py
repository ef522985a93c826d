"""Quality classifier: regularised quadratic discriminant over statistics of a document.

Each class has a mean and a covariance of the transformed statistics. The covariance is shrunk towards the pooled one
and that towards a multiple of the identity. The score is the logistic function of the difference of the two
log densities, each the squared Mahalanobis distance plus the log determinant, from Cholesky factors computed once.

Statistics: mean line length, share of lines that end a sentence, of capitals, digits, symbols and white space, word
length and its spread, distinct shares of words and lines, repeated marks, and so on; all from the whole text and
computed by vector operations over a batch's characters. Neither the id nor the language, source or label is among them.

Cases: a null text is the empty text and has a score too; texts of any length are read whole; repeated rows get equal
scores; without labelled rows, or with one class only, the score is 0.5 or that class; an empty table gives an empty
table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, pieces, released, texts_of

#: Labelled rows that a fit reads at most.
FIT_ROWS = 40_000
#: Weights of the pooled covariance in a class's, and of the identity in the pooled one.
TO_POOLED, TO_IDENTITY = 0.5, 0.05
#: Scores from here on count as good.
THRESHOLD = 0.7

FEATURES = 19


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    out = np.zeros((len(texts), FEATURES))
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
    code = np.frombuffer(b"\n\0\0\0".join(raw) + b"\n\0\0\0", np.uint32)
    kind = KINDS[np.minimum(code, len(KINDS) - 1)]
    start = np.cumsum(size + 1) - size - 1
    total = np.maximum(size, 1).astype(float)
    add = lambda x: np.add.reduceat(np.append(x, 0).astype(np.float64), start) if len(start) else np.zeros(0)
    space, upper, digit, mark, symbol = (kind == k for k in (0, 2, 3, 4, 5))
    newline = code == 10
    word_start = ~space & np.append(True, space[:-1])
    word_start &= ~space
    words = add(word_start)
    lines = add(newline)
    before = np.append(10, code[:-1])
    line_start = before == 10
    first_lower = word_start & (kind == 1)
    ends_sentence = newline & np.isin(before, np.array([33, 46, 63]))
    same = (code == before) & ~space
    symbol_word = symbol & np.append(space[1:], True)
    at = np.flatnonzero(word_start)
    lengths = np.diff(np.append(at, len(code)))
    blanks = np.cumsum(space)
    lengths = lengths - (blanks[np.append(at[1:], len(code)) - 1] - blanks[at]) if len(at) else lengths
    owner = np.searchsorted(start, at, side="right") - 1
    w = np.maximum(words, 1)
    by_word = lambda x: np.bincount(owner, x, len(texts)) if len(at) else np.zeros(len(texts))
    # share of different words: 64-bit hashes of (document, word)
    codes = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    place = np.arange(len(code))
    place -= np.maximum.accumulate(np.where(word_start, place, 0))
    turned = np.where(space, np.uint64(0), codes * (2 * place.astype(np.uint64) + np.uint64(1)))
    hashes = np.add.reduceat(turned, at) if len(at) else np.zeros(0, np.uint64)
    tagged = hashes * np.uint64(0xD6E8FEB86659FD93) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    _, one = np.unique(tagged, return_index=True)
    different = np.bincount(owner[one], minlength=len(texts)) if len(at) else np.zeros(len(texts))
    # log odds of a share, drawn towards a usual share so that a short text says little
    drawn = lambda x, n, usual, by: np.log((x + by * usual) / (np.maximum(n - x, 0) + by * (1 - usual)))
    for k, (count, usual) in enumerate(((add(upper), 0.02), (add(digit), 0.005), (add(mark), 0.025), (add(symbol), 0.005), (add(space) - 1, 0.16), (add(same), 0.03))):
        out[:, k] = drawn(np.clip(count, 0, total), total, usual, 150)
    by_words = (
        (different, 0.7), (add(first_lower), 0.9), (add(symbol_word), 0.005), (add((code == 44) | (code == 59)), 0.05), (add((code == 46) | (code == 63)), 0.1),
        (add(code == 33), 0.005), (add(code == 124), 0.005), (by_word((lengths <= 3).astype(float)), 0.35), (by_word((lengths >= 12).astype(float)), 0.1),
    )
    for k, (count, usual) in enumerate(by_words, 6):
        out[:, k] = drawn(np.minimum(count, w), w, usual, 30)
    out[:, 15] = drawn(np.minimum(add(ends_sentence), lines), lines, 0.95, 4)
    out[:, 16] = np.log((words + 4 * 50) / (lines + 4))
    out[:, 17] = (by_word(lengths.astype(float)) + 30 * 6) / (w + 30)
    out[:, 18] = np.log((by_word(lengths.astype(float) ** 2) + 30 * 50) / (w + 30))
    return out


def _kinds() -> np.ndarray:
    """0 white space, 1 other letter, 2 capital, 3 digit, 4 sentence mark, 5 symbol; the last place stands for rare ones."""
    out = np.full(0x3001, 5, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isnumeric() else 4 if c in ".,;:!?'\"()-" else 5
    out[0x3000] = 1
    return out


KINDS = _kinds()


@dataclass
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constant: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        n, width = x.shape if x.ndim == 2 else (0, FEATURES)
        if n == 0 or len(np.unique(y)) < 2:
            constant = 0.0 if n == 0 else 40.0 if y[0] else -40.0
            return Discriminant(np.zeros(width), np.ones(width), [np.zeros(width)] * 2, [np.eye(width)] * 2, constant)
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - centre) / scale
        own = [z[y == c] for c in (0, 1)]
        means = [some.mean(axis=0) for some in own]
        spreads = [(some - m).T @ (some - m) for some, m in zip(own, means)]
        pooled = sum(spreads) / n
        pooled = (1 - to_identity) * pooled + to_identity * np.trace(pooled) / width * np.eye(width)
        factors, constant = [], 0.0
        for some, spread, sign in zip(own, spreads, (-1, 1)):
            covariance = (1 - to_pooled) * spread / len(some) + to_pooled * pooled
            factor = np.linalg.cholesky(covariance + 1e-9 * np.eye(width))
            factors.append(np.linalg.inv(factor))
            constant += sign * (np.log(len(some) / n) - np.log(np.diag(factor)).sum())
        return Discriminant(centre, scale, means, factors, float(constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        z = (x - self.centre) / self.scale
        distance = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        odds = self.constant + 0.5 * (distance[0] - distance[1])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept back from fitting: crc32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Discriminant:
    """The classifier fitted to the labelled rows that are not held out, ``most`` of them at most, chosen by the hash of their id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, 0.95 * most / max(n, 1))))).limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``most`` pairs of integers at most

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts, 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(statistics(texts[a:b])), pa.list_(pa.float64())), batch.column(1).slice(a, b - a)], ["x", "y"])

    found = rows.select("text", F.col("quality").cast("int").alias("y")).mapInArrow(over, "x array<double>, y int").toArrow()
    x = np.asarray(found["x"].combine_chunks().flatten()).reshape(len(found), -1) if len(found) else np.zeros((0, FEATURES))
    y = np.asarray(found["y"])
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # sums in one order, whatever order the tasks end in
    return Discriminant.fit(x[order], y[order])


def score_documents(documents: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts, 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(statistics(texts[a:b])))], ["doc_id", "score"])

    return mapped(documents, ["doc_id", "text"], "doc_id long, score double", over)


def keep_good(documents: DataFrame, model: Discriminant, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose score is ``least`` or more, all columns unchanged."""
    text = documents.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = texts_of(batch.column(text))
            keep = [model.score(statistics(texts[a:b])) >= least for a, b in chunks(texts, 1_000_000)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
        released()

    return documents.mapInArrow(over, documents.schema)
