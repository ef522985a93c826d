"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case letters with one blank for each run of anything else; every n-gram of ``ORDERS`` characters
within a word and the blanks at its sides goes to one of ``BUCKETS`` places by its hash. Training counts (language, place)
over all rows that are learned from, once per task before the shuffle. The model is the matrix of log probabilities
(places x languages), whose size is fixed by the number of languages (``MOST_LANGUAGES`` at most, checked), so it is
broadcast. Scoring takes the matrix rows of a batch's n-grams and adds them per document: the product of a sparse matrix
with the model.

Cases: a null text and one without a letter are ``und`` with score 0; texts of any length are read whole, in windows of
``WINDOW`` characters; repeated rows get equal results; a language may be any string; without rows to learn from all
texts are ``und``; a row without id counts as held out; an empty table gives an empty table; columns other than doc_id,
text and lang are not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, pieces, texts_of, written

#: Lengths of n-grams, and places that they are hashed to (a power of two).
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Added to each count.
SMOOTHING = 0.5
#: Languages that a model may have: its matrix then has 128 MB at most.
MOST_LANGUAGES = 512
#: Languages whose counts a task holds before it hands them on (8 MB).
HELD_LANGUAGES = 32
#: Characters of a text that are held as numbers at a time.
WINDOW = 1 << 20
UNDETERMINED = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point below 0x40000 that of its lower-case letter, or of the blank; no letter lies above."""
    out = np.full(0x40001, 32, np.uint32)
    for i in range(0x40000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts, each with a blank before and behind and no two blanks in a row, and each one's text."""
    raw = [(" " + unicodedata.normalize("NFC", t) + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in raw])
    code = letters()[np.minimum(np.frombuffer(b"".join(raw), np.uint32), 0x40000)]
    blank = code == 32
    keep = ~(blank & np.append(False, blank[:-1] & (owner[1:] == owner[:-1])))
    return code[keep], owner[keep]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every n-gram of the texts."""
    code, owner = letters_of(texts)
    rolled, places, owners = np.zeros(len(code), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        size = max(len(code) - n + 1, 0)
        rolled = rolled[:size] * np.uint64(0x100000001B3) + code[n - 1 : n - 1 + size] if n > 1 else code.astype(np.uint64)
        if n not in ORDERS or not size:
            continue
        whole = owner[:size] == owner[n - 1 : n - 1 + size]
        if n == 1:
            whole &= code[:size] != 32
        if n == 2:  # two blanks in a row only meet where a text is empty
            whole &= (code[:size] != 32) | (code[1 : 1 + size] != 32)
        for k in range(1, n - 1):
            whole &= code[k : k + size] != 32
        mixed = (rolled[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        places.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        owners.append(owner[:size][whole])
    return (np.concatenate(places), np.concatenate(owners)) if places else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def windows(text: str) -> Iterator[str]:
    """A text in windows that share no n-gram: each but the last ends before the first character after WINDOW that is no letter.

    A run of letters longer than another WINDOW is cut inside.
    """
    start = 0
    while len(text) - start > WINDOW:
        stop = start + WINDOW
        while stop < len(text) and stop < start + 2 * WINDOW and text[stop].isalpha():
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


@dataclass
class NaiveBayes:
    """Log probabilities of the places (rows) and of the languages (columns), and the languages in order."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    @staticmethod
    def fit(languages: list[str], documents: np.ndarray, counts: np.ndarray) -> NaiveBayes:
        """``counts``: a row of BUCKETS counts for each language."""
        smooth = counts.T + SMOOTHING
        prior = np.log(np.maximum(documents, 1) / max(1, documents.sum())) if len(languages) else np.zeros(0)
        return NaiveBayes(languages, prior, np.log(smooth / smooth.sum(axis=0)) if len(languages) else np.zeros((BUCKETS, 0)))

    def sums(self, texts: list[str]) -> np.ndarray:
        """The sum of the log probabilities of each text's n-grams (rows) in each language (columns)."""
        place, owner = grams_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for k, column in enumerate(np.ascontiguousarray(self.matrix.T)):
            out[:, k] = np.bincount(owner, column[place], len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability."""
        found = [any(map(str.isalpha, t)) for t in texts]
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        long = {i for i, t in enumerate(texts) if len(t) > WINDOW}
        odds = self.sums(["" if i in long else t for i, t in enumerate(texts)])
        for i in long:
            odds[i] = sum(self.sums([w])[0] for w in windows(texts[i]))
        odds += self.prior
        best = odds.argmax(axis=1)
        score = 1 / np.exp(odds - odds.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if there else UNDETERMINED for k, there in zip(best.tolist(), found)], np.where(found, score, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept back from learning: crc32 of its id as text leaves 1 when divided by 3, or there is no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(documents: DataFrame) -> NaiveBayes:
    """The model of all rows with a language that are not held out."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for language, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["language", "place", "n"])
            held.clear()

        for batch in pieces(batches, 0):
            texts, tags = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for a, b in chunks(texts, WINDOW):
                names = sorted(set(tags[a:b]))
                rows = np.array([names.index(x) for x in tags[a:b]])
                total = np.zeros((len(names), BUCKETS + 1), np.int64)
                total[:, BUCKETS] = np.bincount(rows, minlength=len(names))
                parts = [(texts[a:b], rows)] if b - a > 1 else [([w], rows) for w in windows(texts[a])]
                for some, own in parts:
                    place, owner = grams_of(some)
                    total[:, :BUCKETS] += np.bincount(own[owner] * BUCKETS + place, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, counts in zip(names, total):
                    held[name] = held[name] + counts if name in held else counts
                if len(held) > HELD_LANGUAGES:
                    yield from handed()
        yield from handed()

    learned = documents.where(F.col("lang").isNotNull() & ~held_out()).select("text", F.col("lang").alias("language"))
    counted = written(mapped(learned, ["text", "language"], "language string, place int, n long", over).groupBy("language", "place").agg(F.sum("n").alias("n")), "language-counts")
    names = sorted(r[0] for r in counted.where(F.col("place") == BUCKETS).select("language").limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    told = counted.toArrow()  # BUCKETS + 1 rows for each language at most
    totals = np.zeros((len(names), BUCKETS + 1))
    number = {x: k for k, x in enumerate(names)}
    totals[[number[x] for x in told["language"].to_pylist()], told["place"].to_numpy()] = told["n"].to_numpy()
    return NaiveBayes.fit(names, totals[:, BUCKETS], totals[:, :BUCKETS])


def identify(documents: DataFrame, model: NaiveBayes) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts, WINDOW):
                names, scores = own.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return mapped(documents, ["doc_id", "text"], "doc_id long, lang_pred string, score double", over)
