"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words and runs of other marks are hashed singly and in pairs to ``BUCKETS`` features; a feature that a text repeats also
sets a feature of its own. A text's vector holds the square roots of its counts over the square root of their sum, so its
length is one. Training visits a bounded sample of labelled rows (``MAX_ROWS``, the only bound here: those with the smallest
hashes of id, text and label) in the order of the hash, ``EPOCHS`` times, with per-coordinate FTRL-proximal steps. Texts become
features where they are read; the one task that trains holds a batch of rows at a time, as it gets each row once an epoch.
Scoring is a sparse dot product per whole text.

Cases: null and empty texts have no features and get the score of the intercept; null labels and rows without a label
don't train; rows that repeat id, text and label train once; with one class or none every score is that class's, or 0.5;
repeated rows are scored alike; very long texts are read whole; an empty table gives no rows; input columns that have the
names of output columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import cut, fold, map_arrow, owned, parts, without

BUCKETS = 1 << 18
#: Labelled rows that train at most.
MAX_ROWS = 8_000
#: Epochs; step size, smoothing, and penalties of the updates. Epochs and step size were chosen by a fold of the training rows.
EPOCHS = 2
RATE, SMOOTH, L1, L2 = 4.0, 1.0, 1e-4, 1e-6
#: Labels are split in so many folds; fold 1 is held out.
FOLDS, HELD_OUT = 3, 1
_FIND = re.compile(r"\w+|[^\w\s]+").findall
_MASK = np.uint64(BUCKETS - 1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending features of a text and their values."""
    words = _FIND(text)
    h = np.fromiter(map(owned("ngrams", _Hashes).__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    grams, n = np.unique(np.concatenate([h >> np.uint64(40) & _MASK, pairs >> np.uint64(40) & _MASK]).astype(np.int64), return_counts=True)
    again = grams[n > 1]
    again = ((again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) & _MASK).astype(np.int64)
    at, which = np.unique(np.concatenate([grams, again]), return_inverse=True)
    total = np.bincount(which, np.concatenate([n, n[n > 1]]), len(at))
    return at, np.sqrt(total / max(1.0, float(total.sum())))


class Leader:
    """Weights that follow the regularised leader, example by example."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        own = self.z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((SMOOTH + np.sqrt(self.n[at])) / RATE + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, BUCKETS), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / RATE
        self.z[at] += g - step * w
        self.n[at] += g * g

    def result(self) -> tuple[np.ndarray, float]:
        w = self.weights(np.arange(BUCKETS + 1))
        return w[:BUCKETS].astype(np.float32), float(w[BUCKETS])


_WEIGHTS = T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("intercept", T.DoubleType())])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        found = [features(x or "") for x in batch.column("text").to_pylist()]
        at, values = ([x[i].astype(kind).tobytes() for x in found] for i, kind in ((0, "<u4"), (1, "<f8")))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("cls"), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["hash", "cls", "at", "v"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leader, seen = Leader(), set()
    for batch in parts(batches):
        for at, values, cls in zip(*(batch.column(c).to_pylist() for c in ("at", "v", "cls")), strict=True):
            leader.learn(np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(values, "<f8"), cls)
            seen.add(cls)
    w, b = leader.result()
    if len(seen) < 2:
        w, b = np.zeros(BUCKETS, np.float32), {0: -50.0, 1: 50.0}[seen.pop()] if seen else 0.0
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64())], names=_WEIGHTS.names)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(hash, cls, at, v): features of the different labelled rows outside the held-out fold, max_rows of them at most, materialised."""
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    own = own.select("doc_id", F.col(label).cast("int").alias("cls")).distinct()
    # the labels with the smallest hashes, so that few texts are read; then rows, since an id may have many
    own = own.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "cls").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # max_rows of 12 bytes
    rows = rows.select(F.xxhash64("doc_id", "text", "cls", F.lit(17)).alias("hash"), "cls", "text")
    found = map_arrow(rows, _featured, "hash long, cls int, at binary, v binary")
    found = cut(found.groupBy("hash").agg(*(F.first(c).alias(c) for c in ("cls", "at", "v"))))
    last = found.select("hash").orderBy("hash").limit(max_rows).agg(F.max("hash")).first()[0]
    return found.filter(F.col("hash") <= F.lit(last))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept, learned from labelled documents outside the held-out fold."""
    rows = sample(docs, labels, label, max_rows).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    found = map_arrow(rows.repartition(1).sortWithinPartitions("epoch", "hash").select("cls", "at", "v"), _train, _WEIGHTS).collect()
    return (np.frombuffer(bytes(found[0]["weights"]), np.float32), found[0]["intercept"]) if found else (np.zeros(BUCKETS, np.float32), 0.0)


def score(df: DataFrame, fitted: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """df with each whole text's score (double, 0 to 1)."""
    df = without(df, name)
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # of a fixed size: BUCKETS
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in parts(batches):
            found = [features(x or "") for x in batch.column("text").to_pylist()]
            raw = np.clip([float(w[at] @ values) + b for at, values in found], -40, 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-raw)), pa.float64())], names=[*batch.schema.names, name])

    return map_arrow(df, run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
