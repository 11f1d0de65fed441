"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time; it labels every byte position of every text and pools the
positions' probabilities into one distribution for a document.  Texts are cut into windows of ``window`` bytes
that are run side by side, both directions, with every byte in exactly one window, so a long text costs no
more a byte than a short one and is read whole.

The network is fitted on the driver on at most ``sample`` documents that carry a label and ``SAMPLE_BYTES`` of each;
that bound is a parameter and the only one.  Scoring is a single pass without a shuffle.

A document is rejected if its best probability is under ``min_probability`` or if it has no byte to label.

Defined results:

* null, empty or blank text: no language, probability 0, rejected;
* null ``lang``: not used for fitting, scored as any other row; ``doc_id`` may have any type, null is a value like any
  other; more than ``MAX_LANGUAGES`` labels are an error;
* repeated rows: scored alike, each by itself; ties between languages go to the first in sorted order;
* no labelled row at all: there is nothing to reject by, so every document is kept with a null language;
* extra columns: :func:`identify` returns its own columns only, :func:`clean` those of its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from codestrata.storage import ship
from codestrata.llm.textkernel import raw, slices

HIDDEN, WINDOW, SAMPLE, SAMPLE_BYTES, STEPS, MIN_PROBABILITY, MAX_LANGUAGES = 8, 64, 1200, 16384, 260, 0.5, 1000
SCHEMA = "language string, probability double, n_positions long, labels array<string>, position_counts array<long>, probabilities array<double>, keep boolean"
_BLOCK = 1024


class Network:
    """Weights; features run along the first axis and windows along the last."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng, self.labels, h = np.random.default_rng(seed), list(labels), hidden
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[-1]), s).astype(np.float32)
        self.p = {"c": np.zeros((len(labels), 1), np.float32)}
        for d in "fb":
            self.p |= {"x" + d: (f(3 * h, 256) * 4).astype(np.float32), "u" + d: f(3 * h, h), "b" + d: np.zeros((h, 1), np.float32), "o" + d: f(len(labels), h)}
        self.h = h

    def direction(self, d: str, data: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States (T, H, B) over ``data`` (T, B); with ``keep`` also what the backward pass needs."""
        T, B = data.shape
        h, x, u, bias = self.h, self.p["x" + d], self.p["u" + d], self.p["b" + d]
        x, u = x.copy(), u.copy()
        x[: 2 * h] *= 0.5  # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
        u[: 2 * h] *= 0.5
        out = np.empty((T, h, B), np.float32)
        state, g, q, kept = np.zeros((h, B), np.float32), np.empty((3 * h, B), np.float32), np.empty((3 * h, B), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            np.take(x, data[t], axis=1, out=g, mode="clip")
            np.matmul(u, state, out=q)
            a = g[: 2 * h]
            a += q[: 2 * h]
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            n, qn = g[2 * h :], q[2 * h :]
            qn += bias
            if keep:
                kept.append((t, state.copy(), a.copy(), qn.copy()))
            qn *= a[h:]
            n += qn
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(state, n, out=new)
            new *= a[:h]
            new += n
            if mask is not None:
                new *= mask[t]
            if keep:
                kept[-1] += (n.copy(),)
            state = new
        return (out, kept) if keep else out

    def logits(self, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        z = np.matmul(self.p["of"], self.direction("f", data, mask))
        z += np.matmul(self.p["ob"], self.direction("b", data, mask))
        z += self.p["c"]
        return z

    def step(self, data: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of the mean cross-entropy over all positions, back through time in both directions."""
        h, T, B = self.h, *data.shape
        runs = {d: self.direction(d, data, mask, keep=True) for d in "fb"}
        z = np.matmul(self.p["of"], runs["f"][0]) + np.matmul(self.p["ob"], runs["b"][0]) + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        e /= e.sum(axis=1, keepdims=True)
        total = max(1.0, float(mask.sum()))
        loss = -float((np.log(e[:, y, np.arange(B)] + 1e-9) * mask).sum()) / total
        e[:, y, np.arange(B)] -= 1
        e *= mask[:, None, :] / np.float32(total)
        grads = {"c": e.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            out, kept = runs[d]
            u = self.p["u" + d]
            grads["o" + d] = np.einsum("tcb,thb->ch", e, out, optimize=True)
            into = np.matmul(self.p["o" + d].T, e)
            du, db, dx, dh = np.zeros_like(u), np.zeros((h, 1), np.float32), np.empty((T, 3 * h, B), np.float32), np.zeros((h, B), np.float32)
            for t, before, a, q, n in reversed(kept):
                dh = (dh + into[t]) * mask[t]
                zt, r = a[:h], a[h:]
                v = dx[t]
                v[2 * h :] = dh * (1 - zt) * (1 - n * n)
                v[:h] = dh * (before - n) * zt * (1 - zt)
                v[h : 2 * h] = v[2 * h :] * q * r * (1 - r)
                w = v.copy()
                w[2 * h :] *= r
                du += w @ before.T
                db += w[2 * h :].sum(axis=1, keepdims=True)
                dh = dh * zt + u.T @ w
            flat = dx.transpose(1, 0, 2).reshape(3 * h, -1)
            grads |= {"u" + d: du, "b" + d: db, "x" + d: np.stack([np.bincount(data.ravel(), weights=row, minlength=256) for row in flat]).astype(np.float32)}
        return loss, grads

    def fit(self, texts: list[bytes], y: list[int], window: int = WINDOW, steps: int = STEPS, batch: int = 192, seed: int = 11) -> float:
        """Adam over random windows of whole texts, languages in equal parts; returns the last losses' mean."""
        rng, m, last = np.random.default_rng(seed), {}, []
        y = np.asarray(y)
        pools = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        for s in range(1, steps + 1):
            rows = [int(rng.choice(pools[k % len(pools)])) for k in range(batch)]
            data, mask = np.zeros((window, batch), np.uint8), np.zeros((window, batch), np.float32)
            for j, i in enumerate(rows):
                at = int(rng.integers(0, max(1, len(texts[i]) - window + 1)))
                piece = np.frombuffer(texts[i][at : at + window], np.uint8)
                data[: len(piece), j], mask[: len(piece), j] = piece, 1
            loss, grads = self.step(data, mask, y[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = 0.03 * min(1.0, s / 20) * (1 - 0.9 * s / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                a, b = m.get(k, (0.0, 0.0))
                a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
                m[k] = (a, b)
                self.p[k] -= (rate * (a / (1 - 0.9**s)) / (np.sqrt(b / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
            last = [*last, loss][-20:]
        return float(np.mean(last))

    def score(self, arr: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: pooled probabilities (n, C), positions by label (n, C), number of positions (n)."""
        buf, off = raw(arr)
        size, C = np.diff(off), len(self.labels)
        cuts = -(-size // window)
        doc = np.repeat(np.arange(len(size)), cuts)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = off[doc] + k * window
        length = np.minimum(window, off[doc + 1] - start)
        order = np.argsort(length < window, kind="stable")  # whole windows first: they need no mask
        pooled, votes = np.zeros((len(doc), C)), np.zeros((len(doc), C), np.int64)
        ahead = np.arange(window)[:, None]
        for at in range(0, len(order), _BLOCK):
            own = order[at : at + _BLOCK]
            data = buf[np.minimum(start[own] + ahead, len(buf) - 1)]
            mask = None if length[own].min() == window else (ahead < length[own]).astype(np.float32)
            z = self.logits(data, mask)
            top = z.max(axis=1, keepdims=True)
            hit = z == top
            z -= top
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            if C > 1:
                hit[:, 1:] &= ~np.logical_or.accumulate(hit, axis=1)[:, :-1]
            if mask is not None:
                z *= mask[:, None, :]
                hit &= mask[:, None, :] > 0
            pooled[own] = z.sum(axis=0).T
            votes[own] = hit.sum(axis=0).T
        probability, counts = np.zeros((len(size), C)), np.zeros((len(size), C), np.int64)
        np.add.at(probability, doc, pooled)
        np.add.at(counts, doc, votes)
        return probability / np.maximum(size, 1)[:, None], counts, size


def sampled(docs: DataFrame, sample: int, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """(language, bytes) of at most ``sample`` labelled documents, in equal parts by language, and of each at most ``sample_bytes``.

    Chosen are the smallest hashes of id and text, by a limit that each task applies before anything is moved; of a longer
    text sixteen stretches, evenly spread.  So what reaches the driver is bounded whatever ids and texts are.
    """
    d = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"), F.col("lang").cast("string").alias("l"), F.col("text").cast("string").alias("t")).where("l IS NOT NULL AND t RLIKE '\\\\S'")
    counts = {r.l: (r.n, r.least) for r in d.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: the label is none")
    if not counts:
        return []
    each = max(1, sample // len(counts))
    # most rows go by a threshold that leaves about twice as many as are needed; the rank makes it exact.  Of a language
    # whose rows repeat a few, those of the smallest hash stay
    share = F.create_map(*[x for k, (n, _) in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * each + 20) / n)))])
    least = F.create_map(*[x for k, (_, h) in counts.items() for x in (F.lit(k), F.lit(h))])
    d = d.where((F.shiftrightunsigned("h", 33) <= share[F.col("l")] * float(1 << 31)) | (F.col("h") == least[F.col("l")]))
    piece, b = sample_bytes // 16, F.encode("t", "utf-8")
    spread = F.concat(*[F.substr(b, F.floor((F.octet_length("t") - piece) * k / 15).cast("int") + 1, F.lit(piece)) for k in range(16)])
    d = d.select("l", "h", F.when(F.octet_length("t") > sample_bytes, spread).otherwise(b).alias("b"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "b"))
    return sorted((r.l, bytes(r.b)) for r in d.withColumn("r", rank).where(F.col("r") <= each).collect())


def train(docs: DataFrame, sample: int = SAMPLE, hidden: int = HIDDEN, window: int = WINDOW, steps: int = STEPS) -> Network | None:
    """Fit on :func:`sampled` documents."""
    rows = sampled(docs, sample)
    if not rows:
        return None
    labels = sorted({k for k, _ in rows})
    net = Network(labels, hidden)
    net.fit([b for _, b in rows], [labels.index(k) for k, _ in rows], window, steps)
    return net


def _decide(net: Network, arr: pa.Array, window: int, min_probability: float):
    probability, counts, size = net.score(arr, window)
    best = probability.argmax(axis=1)
    top = probability[np.arange(len(best)), best] if len(best) else np.zeros(0)
    blank = pc.fill_null(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(arr)), 0), True).to_numpy(zero_copy_only=False)
    top = np.where(blank, 0.0, top)
    return probability, counts, size, best, top, blank, ~blank & (top >= min_probability)


def identify(docs: DataFrame, train_on: DataFrame | None = None, min_probability: float = MIN_PROBABILITY, window: int = WINDOW, **fit) -> DataFrame:
    """One row for each document: ``doc_id``, language, pooled probabilities, positions by label, verdict."""
    spark = docs.sparkSession
    ship(spark)
    net = train(docs if train_on is None else train_on, window=window, **fit)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([d.schema["doc_id"], *_parse_datatype_string(SCHEMA).fields])
    if net is None:
        return d.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_positions"), F.array().cast("array<string>").alias("labels"), F.array().cast("array<long>").alias("position_counts"), F.array().cast("array<double>").alias("probabilities"), F.lit(True).alias("keep"))
    model = spark.sparkContext.broadcast(net)

    def kernel(batches):
        net = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                probability, counts, size, best, top, blank, keep = _decide(net, part.column("text"), window, min_probability)
                n, C = counts.shape
                off = pa.array(np.arange(n + 1, dtype=np.int32) * C)
                name = [None if b else net.labels[k] for b, k in zip(blank, best)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(name, pa.string()), pa.array(top), pa.array(size), pa.ListArray.from_arrays(off, pa.array(net.labels * n, pa.string())), pa.ListArray.from_arrays(off, pa.array(counts.ravel())), pa.ListArray.from_arrays(off, pa.array(probability.ravel())), pa.array(keep)],
                    names=schema.names,
                )

    return d.mapInArrow(kernel, schema)


def clean(docs: DataFrame, train_on: DataFrame | None = None, min_probability: float = MIN_PROBABILITY, window: int = WINDOW, **fit) -> DataFrame:
    """``docs`` without the documents that are rejected; the same columns."""
    spark = docs.sparkSession
    ship(spark)
    net = train(docs if train_on is None else train_on, window=window, **fit)
    if net is None:
        return docs
    model = spark.sparkContext.broadcast(net)

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(_decide(model.value, part.column("text"), window, min_probability)[-1]))

    return docs.mapInArrow(kernel, docs.schema)
