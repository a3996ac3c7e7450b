"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Features of a text, hashed to 2**BITS weights, each n-gram weighing its share of its kind in the text:
words and word pairs as they stand, and one to three neighbouring word shapes (letter runs as `a` or `A`, digits as `0`,
other characters kept; a word equal to the one before is marked). A score is the logistic function of the sparse dot
product of shares and weights plus a bias.

Training reads a bounded, seeded sample: the labelled rows in order of a hash of doc_id, MAX_ROWS at most, without
those whose whole text does not fit into what is left of MAX_CHARS. One task reads them in that order, keeps their features (about 60 bytes
a word, so some 400 MB at most) and goes over them EPOCHS times with FTRL-proximal updates (per-coordinate rates, L1 and L2).
The sample does not grow with the corpus; the weights are 2**BITS floats, which bounds what is broadcast. Scoring is one
narrow pass over whole texts.

Defined results: a null or empty text has the bias alone, and so a score; without labels every score is 0.5; an empty
table gives no rows; repeated rows are scored row by row; repeated labels of one doc_id count once each distinct value;
labels, lang, source and doc_id are never inputs of a score, and further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockwire.llm.common import WORD_RE, map_rows, small_batches, text_of

BITS = 18
MAX_ROWS = 6000
MAX_CHARS = 40_000_000
EPOCHS = 4
#: Learning rate, its offset, L1 and L2 of the updates.
ALPHA, BETA, L1, L2 = 0.6, 0.1, 0.002, 0.01
#: Words kept in a task's cache, none of them longer than CACHED.
CACHE, CACHED = 200_000, 256

_LOWER, _UPPER, _DIGITS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(64 - BITS)


def shape(word: str) -> str:
    """Letters and digits of a word by kind, other characters as they are."""
    return _DIGITS.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))


class _Words(dict):
    """A word's 40-bit hash, above its shape's 20-bit hash."""

    def __missing__(self, word: str) -> int:
        n = (xxhash.xxh64_intdigest(word) >> 24 << 20) | (xxhash.xxh64_intdigest(shape(word)) >> 44)
        if len(word) <= CACHED:
            self[word] = n
        return n


def features(text: str, words: _Words) -> list[np.ndarray]:
    """For each kind of n-gram, the weights' numbers of the text's n-grams. words: the task's cache."""
    found = WORD_RE.findall(text)
    if len(words) > CACHE:
        words.clear()
    both = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    word, form = both >> np.uint64(20), both & np.uint64(0xFFFFF)
    form[1:] += (both[1:] == both[:-1]).astype(np.uint64) << np.uint64(20)
    kinds = [word, word[:-1] * _M2 + word[1:], form * _M3 + np.uint64(1), form[:-1] * _M2 + form[1:] * _M3, (form[:-2] * _M2 + form[1:-1]) * _M2 + form[2:] * _M3]
    return [((k * _M1) >> _SHIFT).astype(np.int64) for k in kinds if len(k)]


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def shares(text: str, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """A text's sparse vector: the weights' numbers, ascending, the bias (2**BITS, of share 1) last, and their shares."""
    at, share = [np.array([1 << BITS])], [np.ones(1)]
    for k in features(text, words):
        index, count = np.unique(k, return_counts=True)
        at.append(index)
        share.append(count / len(k))
    index, back = np.unique(np.concatenate(at), return_inverse=True)
    return index.astype(np.int32), np.bincount(back, np.concatenate(share))


def train(rows: Iterable[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over the rows (text, label), in order."""
    size = 1 << BITS
    z, n, words = np.zeros(size + 1), np.zeros(size + 1), _Words()
    sparse = [(*shares(text, words), label) for text, label in rows]

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in sparse:
            w = weights(at)
            g = (logistic(float(w @ x)) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that are never learnt from: crc32 of doc_id as text leaves 2 modulo 4 (a null doc_id: as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from a bounded sample of the labelled rows that are not held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    some = known.dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def within() -> Iterator[tuple[str, int]]:
            chars = 0
            for batch in batches:
                for text, y in zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                    if chars + len(text) <= max_chars:  # a text too long for what is left is passed over, those after it are not
                        chars += len(text)
                        yield text, y

        w, bias = train(within())
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    ordered = small_batches(rows).select("doc_id", "text", "label").coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label")
    got = ordered.mapInArrow(run, "w binary, bias double").first()
    return (np.zeros(1 << BITS, np.float32), 0.0) if got is None else (np.frombuffer(got["w"], np.float32), got["bias"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """docs with a score (double, 0 to 1) in column `name`, in place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].tobytes(), model[1]))
    names = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(text_of("text").alias("_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def make():
        w, bias, words = np.frombuffer(shared.value[0], np.float32), shared.value[1], _Words()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [logistic(bias + sum(float(w[k].mean(dtype=np.float64)) for k in features(t, words))) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"])

        return f

    schema = type(rows.schema)(list(rows.schema.fields)[1:]).add("score", "double")
    return map_rows(rows, make, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("score").alias(name))
