"""Quality classifier: kernel ridge scores over document statistics, calibrated by isotonic regression.

* Statistics: 16 numbers a document (lengths, shares of character classes, repetition), from one vectorised
  pass over the bytes; they are written to the shared folder, so the text is read once.
* Random Fourier features ``sqrt(2/D) cos(Wx + b)`` approximate a Gaussian kernel over standardised statistics.
* Ridge: each partition sums ``ZtZ`` and ``Zty`` over its labelled rows; only the ``D x (D+1)`` sums reach the
  driver, through a two-level reduction, however many rows there are.  All labelled rows are used.
* Isotonic calibration over all labelled rows, each scored by a fit without its fold: since the sums of the folds
  add up, four folds' fits cost no further pass.  Scores are counted into fixed bins over all partitions and pooled by
  adjacent violators, giving a probability for each score.  Few rows are handled like many.

A document is rejected if its calibrated probability of being of good quality is under ``min_probability``.

Defined results:

* null, empty or blank text: probability 0, rejected;
* ``doc_id`` may have any type; null: scored like any row, never labelled; null labels are not used; repeated rows are scored
  alike, repeated labels each count;
* no labelled row: nothing to reject by, so every document is kept and scores are null;
* texts are read whole; ties in scores get the same probability;
* extra columns: :func:`classify` returns its own columns only, :func:`clean` those of its input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from codestrata.storage import ship, written
from codestrata.llm.sums import partition_sum
from codestrata.llm.textkernel import Words, raw, slices

FEATURES, BINS, LOW, HIGH, FOLDS = 16, 2000, -0.75, 1.75, 4
RIDGE, MIN_PROBABILITY, COMPONENTS, BANDWIDTH = 1e-2, 0.4, 128, 1.0
SCHEMA = "score double, probability double, keep boolean"


def _classes() -> np.ndarray:
    t = np.zeros((8, 256), np.uint8)
    t[0, 97:123] = t[0, 65:91] = 1  # ASCII letters
    t[1, 65:91] = 1  # capitals
    t[2, 48:58] = 1  # digits
    t[3, [32, 9, 13]] = 1
    t[4, 10] = 1
    for c in b".,;:!?'\"()-":
        t[5, c] = 1
    t[6, 33:127] = 1 - (t[0] | t[2] | t[5])[33:127]  # symbols
    t[7, 128:] = 1
    return t


_CLASS = _classes()


def statistics(arr: pa.Array) -> np.ndarray:
    """(n, 16) statistics of texts; rows of blank texts are zero."""
    w = Words(arr)
    buf, off = raw(arr)
    n, size = len(off) - 1, np.diff(off)
    count = np.zeros((8, n))
    full = np.flatnonzero(size)
    if len(full):
        for k in range(8):
            count[k, full] = np.add.reduceat(_CLASS[k][buf], off[full], dtype=np.int64)
    words = w.counts
    doc = w.text_of_word()
    length = np.bincount(doc, weights=(w.end - w.start), minlength=n)
    square = np.bincount(doc, weights=(w.end - w.start).astype(float) ** 2, minlength=n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (w.h >> np.uint64(24)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    own = (key[first] >> np.uint64(40)).astype(np.int64)
    unique = np.bincount(own, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.r_[first, len(key)]))
    again = np.zeros(n)
    if len(w.h) > 1:
        same = (w.h[1:] == w.h[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:][same], minlength=n).astype(float)
    s, m = np.maximum(size, 1), np.maximum(words, 1)
    mean = length / m
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square / m - mean**2, 0)),
        count[0] / s, count[1] / s, count[2] / s, count[3] / s, count[4] / s * 10, count[5] / s, count[6] / s, count[7] / s,
        unique / np.sqrt(m), most / m, again / m, count[6] / m,
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale).clip(-8, 8) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.column_stack([z, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.features(x) @ self.beta, 9)  # the same for a row in any batch

    def probability(self, score: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.edges, score, side="right")]


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in order; empty bins take the value of the nearest bin before, else after."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(total):
        blocks.append([good[k], total[k], k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, _ = blocks.pop()
            blocks[-1][0] += g
            blocks[-1][1] += t
    out = np.zeros(len(total))
    for i, (g, t, k) in enumerate(blocks):
        out[0 if i == 0 else int(k) :] = g / t
    return out


def _stats(docs: DataFrame) -> DataFrame:
    """doc_id, f array<double>, blank of each row."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(off, pa.array(x.ravel().astype(np.float32))), _blank(part.column("text"))], names=["doc_id", "f", "blank"])

    return d.mapInArrow(kernel, StructType([d.schema["doc_id"], *_parse_datatype_string("f array<float>, blank boolean").fields]))


def _blank(arr: pa.Array) -> pa.Array:
    return pc.fill_null(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(arr)), 0), True)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    f = batch.column("f")
    return f.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, FEATURES)


def fit(stats: DataFrame, labels: DataFrame, components: int = COMPONENTS, ridge: float = RIDGE, bandwidth: float = BANDWIDTH, seed: int = 5) -> Model | None:
    """Fit on every labelled row of ``stats``."""
    kind = stats.schema["doc_id"].dataType.simpleString()
    own = labels.select(F.col("doc_id").try_cast(kind).alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = written(stats.where(~F.col("blank")).join(own, "doc_id").select("f", "y", fold), "quality")

    def moments(batch, total):
        x = _matrix(batch)
        total[0] += len(x)
        total[1 : FEATURES + 1] += x.sum(0)
        total[FEATURES + 1 :] += (x * x).sum(0)

    m = partition_sum(rows, 2 * FEATURES + 1, moments)
    if not m[0]:
        return None
    mean = m[1 : FEATURES + 1] / m[0]
    scale = np.sqrt(np.maximum(m[FEATURES + 1 :] / m[0] - mean**2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / (bandwidth * np.sqrt(FEATURES)), (FEATURES, components)), rng.uniform(0, 2 * np.pi, components), np.zeros(components + 1), np.linspace(LOW, HIGH, BINS - 1), np.zeros(BINS))
    D = components + 1

    def normal(batch, total):
        z, y, own = model.features(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for k, sums in enumerate(total.reshape(FOLDS, D * D + D)):
            use = own == k
            sums[: D * D] += (z[use].T @ z[use]).ravel()
            sums[D * D :] += z[use].T @ y[use]

    def solved(sums):
        A = sums[: D * D].reshape(D, D)
        return np.linalg.solve(A + ridge * np.eye(D) * max(1.0, A[-1, -1] / 1000), sums[D * D :])

    folds = partition_sum(rows, FOLDS * (D * D + D), normal).reshape(FOLDS, -1)
    model.beta = solved(folds.sum(0))
    without = np.column_stack([solved(folds.sum(0) - folds[k]) for k in range(FOLDS)])

    def histogram(batch, total):
        z, y, own = model.features(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        score = np.round((z @ without)[np.arange(len(z)), own], 9)
        k = np.searchsorted(model.edges, score, side="right")
        total += np.r_[np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)]

    held = partition_sum(rows, 2 * BINS, histogram)
    model.value = isotonic(held[:BINS], held[BINS:])
    return model


def _decide(model: Model, x: np.ndarray, blank: np.ndarray, min_probability: float):
    score = model.score(x) if len(x) else np.zeros(0)
    probability = np.where(blank, 0.0, model.probability(score))
    return score, probability, ~blank & (probability >= min_probability)


def classify(docs: DataFrame, labels: DataFrame, min_probability: float = MIN_PROBABILITY, **how) -> DataFrame:
    """One row for each document: raw score, calibrated probability, verdict."""
    spark = docs.sparkSession
    ship(spark)
    stats = written(_stats(docs), "statistics")
    model = fit(stats, labels, **how)
    if model is None:
        return stats.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))
    shared = spark.sparkContext.broadcast(model)

    def kernel(batches):
        for batch in batches:
            blank = batch.column("blank").to_numpy(zero_copy_only=False)
            score, probability, keep = _decide(shared.value, _matrix(batch), blank, min_probability)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(probability), pa.array(keep)], names=["doc_id", "score", "probability", "keep"])

    return stats.mapInArrow(kernel, StructType([stats.schema["doc_id"], *_parse_datatype_string(SCHEMA).fields]))


def clean(docs: DataFrame, labels: DataFrame, min_probability: float = MIN_PROBABILITY, **how) -> DataFrame:
    """``docs`` without the documents that are rejected; the same columns."""
    spark = docs.sparkSession
    ship(spark)
    model = fit(written(_stats(docs), "statistics"), labels, **how)
    if model is None:
        return docs
    shared = spark.sparkContext.broadcast(model)

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                blank = _blank(part.column("text")).to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(_decide(shared.value, statistics(part.column("text")).astype(np.float32).astype(float), blank, min_probability)[-1]))

    return docs.mapInArrow(kernel, docs.schema)
