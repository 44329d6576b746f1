"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output, numpy SGD.

Scoring is linear in the average, so each bucket's vector is folded into one number for the executors. Beside words
and n-grams a document has marks of repetition as words (see _SAME): an average can't tell a line that is repeated from
text in the same words. Held-out accuracy with and without them is in the README.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, mix64

BITS, DIM, CHARS = 18, 8, (2, 3, 4)
#: Labelled rows that are learned from at most, the smallest by a hash of doc_id.
SAMPLE = 6000
#: Bytes of their texts that are learned from at most, in the same order, and of one of them; longer texts are passed over.
SAMPLE_BYTES, TEXT_BYTES = 64_000_000, 2_000_000
EPOCHS, RATE, SEED = 6, 40.0, 7
_SHIFT = np.uint64(64 - BITS)
#: Pseudo-words for patterns of words: same as the one before, a pair or word seen before, and how often.
_SAME, _PAIR, _SEEN, _FRESH = (np.uint64(x) for x in (11, 12, 13, 14))


def features(text: bytes | None, hashes: WordHashes) -> list[np.ndarray]:
    """Buckets of all features of a whole text, one array for each kind."""
    text = text or b""
    words = text.split()
    if not words:
        return []
    out = []
    b = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint64)
    for n in CHARS:
        m = len(b) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(257) + b[j : j + m]
            out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT)
    h = hashes.of(words)
    out.append(mix64(h) >> _SHIFT)
    if len(h) > 1:
        pair = mix64(h[:-1] * np.uint64(31) + h[1:])
        out.append(pair >> _SHIFT)
        n, same = len(h), int((h[:-1] == h[1:]).sum())
        seen, again = n - len(np.unique(h)), n - 1 - len(np.unique(pair))
        marks = np.repeat(np.array([_SAME, _PAIR, _SEEN, _FRESH]), [4 * same, 4 * again, seen, n - seen])
        out.append(mix64(marks) >> _SHIFT)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each bucket

    def score(self, text: bytes | None, hashes: WordHashes) -> float:
        """Chance of label 1; of a text without words 0.5."""
        parts = features(text, hashes)
        total = sum(len(p) for p in parts)
        if not total:
            return 0.5
        z = sum(float(self.weights[p].sum()) for p in parts) / total
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _least(values: np.ndarray) -> np.ndarray:
    """In the narrowest type that holds the largest."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _packed(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, str, str, float]:
    """A bag of features without loss, in about two bytes a feature, as the driver holds all of the sample: steps from one id to the
    next and counts."""
    steps, n = _least(np.diff(ids.astype(np.int64), prepend=0)), _least(counts.astype(np.int64))
    return zstandard.compress(steps.tobytes() + n.tobytes(), 1), steps.dtype.char, n.dtype.char, float(counts.sum())


def _unpacked(bag: tuple[bytes, str, str, float]) -> tuple[np.ndarray, np.ndarray, float]:
    raw, steps, counts = zstandard.decompress(bag[0]) if bag[3] else b"", np.dtype(bag[1]), np.dtype(bag[2])
    size = len(raw) // (steps.itemsize + counts.itemsize)
    ids = np.frombuffer(raw, steps, size).cumsum(dtype=np.int64)
    return ids, np.frombuffer(raw, counts, size, size * steps.itemsize), bag[3]


def fit(texts: Iterable[bytes | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent on the log loss, one document at a time, classes weighted alike."""
    rng, hashes = np.random.default_rng(SEED), WordHashes(30_000)  # this runs on the driver
    bags = []
    for t in texts:
        parts = features(t, hashes)
        ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        bags.append(_packed(ids, n))
    y = np.asarray(labels, np.int64)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    weight = 0.5 / np.maximum(share, 1e-9)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (2, DIM)).astype(np.float32)
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, n, total = _unpacked(bags[i])
            lr = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            w = n.astype(np.float32) / total
            hidden = w @ vectors[ids]
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(3.0, float(weight[y[i]]))
            grad = p @ out
            out -= np.float32(0.01 * lr) * np.outer(p, hidden)
            vectors[ids] -= np.float32(lr) * w[:, None] * grad[None, :]
    return Model((vectors @ (out[1] - out[0])).astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """A model of ``labels.quality`` from at most ``rows`` labelled documents of SAMPLE_BYTES in all, the first by a hash
    of doc_id whose texts have at most TEXT_BYTES; without any, one that says 0.5. Of several labels of a document the higher
    counts. Their lengths are looked at first, so that no more texts than are learned from leave their tasks."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sizes = text.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")).where(F.col("size") <= TEXT_BYTES)
    sizes = sizes.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.sum("size").alias("size"))  # at most ``rows``
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sizes.withColumn("bytes", so_far).where(F.col("bytes") <= SAMPLE_BYTES).select("doc_id", "y")
    got = text.where(F.coalesce(F.length("text"), F.lit(0)) <= TEXT_BYTES).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").toArrow()
    # Texts stay in Arrow's memory and are looked at one by one: the driver holds them once.
    first: dict[int, int] = {}
    ids, texts = got.column("doc_id").to_pylist(), got.column("text")
    for i, doc_id in enumerate(ids):
        if doc_id not in first or (texts[i].as_py() or b"") < (texts[first[doc_id]].as_py() or b""):
            first[doc_id] = i
    order = [first[k] for k in sorted(first)]
    labels = got.column("y")
    model = fit((texts[i].as_py() for i in order), [labels[i].as_py() for i in order]) if order else Model(np.zeros(1 << BITS, np.float32))
    del got, texts, labels
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns of ``docs``, from text alone.

    Null, empty and blank texts score 0.5 and are predicted 0. Repeated rows score alike. Columns of ``docs`` named
    like the added ones are replaced; others pass untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([shared.value.score(t, hashes) for t in texts], dtype="float64")

    out = docs.withColumn("score", score(F.col("text").cast("binary")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
