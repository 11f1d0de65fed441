"""Near-duplicate removal by min-max hashing.

Each text's set of word trigrams is hashed under ``PERMUTATIONS`` random functions, and *both* the minimum and
the maximum under each are kept: twice the signature for the same hash evaluations, and since the two extremes
of one function are nearly uncorrelated (slightly negatively), the share of agreeing values stays an unbiased
estimate of the Jaccard similarity with no more variance than as many separate minima.  The 128 values are
banded by four (two minima and two maxima of four functions): texts that agree in a band are candidates.

Exact copies are one node, the 64-bit hash of their text (two different texts share one with a chance of 2**-64 a
pair), so they fold before anything is compared.  Candidates are not enumerated pairwise and no bucket is gathered:

* each task links the members of a bucket that it holds to their smallest, and sends on only that one, so a bucket
  has as many rows in the shuffle as tasks have met it, however many members; those are linked to the smallest again;
* distinct links are verified by whole signatures.  Members that are linked to their bucket's smallest are one
  component.  Those that are not, the odd ones, are compared with every member of the bucket, in cells of about
  ``cell_rows`` odd ones by as many members, so no task holds more of a bucket than a cell and no link is lost.

Groups are connected components of verified links, found by alternating large-star and small-star rounds; the row with
the smallest ``(doc_id, text hash)`` of a group stays.

Shuffled are bucket keys with node numbers, at most 16 bytes by band and text, and signatures of candidates, never
texts but for the final removal: it broadcasts the keys of texts in groups only up to ``broadcast_rows`` and joins
by shuffle beyond.

Defined results:

* null text: in no group, stays; ``doc_id`` may have any type that can be ordered; a null is a value like any other
  and sorts first;
* texts of fewer than three words: the whole text is one shingle; texts without words are copies of each other
  if they are equal byte for byte (so empty texts are copies of the empty text);
* repeated rows (the same ``doc_id`` and text) are copies: one row stays, whichever is met first;
* ties between equal keys go to the lower row number; empty tables give empty results;
* extra columns: :func:`duplicates` returns its own columns only, :func:`clean` those of its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from codestrata.llm.textkernel import Words, gram_mask, grams, mix, slices
from codestrata.storage import ship, written

PERMUTATIONS, ROWS, SHINGLE, THRESHOLD, BROADCAST_ROWS, CELL_ROWS = 64, 4, 3, 0.5, 200_000, 1024
BANDS = 2 * PERMUTATIONS // ROWS
_MULTIPLIERS = np.random.default_rng(42).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(43).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _layout() -> np.ndarray:
    """Places of minima (0..63) and maxima (64..127) in the signature: each band has two minima and two maxima of four functions."""
    p = PERMUTATIONS
    return np.array([x for j in range(BANDS) for x in (2 * j, 2 * j + 1, p + (2 * j + 2) % p, p + (2 * j + 3) % p)])


_LAYOUT = _layout()


def signatures(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 128) uint32 signatures and numbers of shingles; 0 shingles: a text without words."""
    w = Words(arr)
    n = len(w.counts)
    have = np.maximum(w.counts - SHINGLE + 1, 0)
    g = grams(w.h, SHINGLE)[gram_mask(w.ptr, len(w.h), SHINGLE)] if len(w.h) >= SHINGLE else np.zeros(0, np.uint64)
    out = np.zeros((n, 2 * PERMUTATIONS), np.uint32)
    long = np.flatnonzero(have)
    starts = (np.cumsum(have) - have)[long]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    sh = np.array([grams(w.h[w.ptr[i] : w.ptr[i + 1]], int(w.counts[i]))[0] for i in short], np.uint64)
    for k in range(PERMUTATIONS):
        if len(long):
            v = ((g * _MULTIPLIERS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32)
            out[long, k] = np.minimum.reduceat(v, starts)
            out[long, PERMUTATIONS + k] = np.maximum.reduceat(v, starts)
        if len(short):
            out[short, k] = out[short, PERMUTATIONS + k] = ((sh * _MULTIPLIERS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32)
    have[short] = 1
    return out[:, _LAYOUT], have


def sign(docs: DataFrame) -> DataFrame:
    """row, doc_id, node (hash of the text), n, sig of every row with a text."""
    ship(docs.sparkSession)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("node"), "text")
    schema = StructType([*d.schema.fields[:3], *_parse_datatype_string("n long, sig binary").fields])

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sig, have = signatures(part.column("text"))
                data = pa.py_buffer(np.ascontiguousarray(sig).tobytes())
                off = pa.py_buffer(np.arange(len(have) + 1, dtype=np.int32) * (8 * PERMUTATIONS))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("node"), pa.array(have), pa.Array.from_buffers(pa.binary(), len(have), [None, off, data])], names=schema.names)

    return d.mapInArrow(kernel, schema)


def buckets(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of bands."""
    x = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS // 2)
    key = np.full((len(sig), BANDS), np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for k in range(ROWS // 2):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key.view(np.int64)


def _values(arr: pa.Array) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32).reshape(len(arr), -1)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """node, pivot, ok of pairs with their signatures a and b."""

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                alike = (_values(batch.column("a")) == _values(batch.column("b"))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"), pa.array(alike >= threshold)], names=["node", "pivot", "ok"])

    return pairs.mapInArrow(kernel, "node long, pivot long, ok boolean")


def _linked(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Single linkage among the rows of one bucket: a spanning forest of its verified pairs."""
    left, edges = np.arange(len(sig)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = (sig[left] == sig[i]).mean(axis=1) >= threshold
            edges += [(int(j), i) for j in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
    return edges


def _stars(words: DataFrame) -> DataFrame:
    """bucket, node, pivot of each task's buckets: pivot is the smallest node of the bucket that the task holds.

    A node that is its own pivot stands for its bucket in the other tasks.
    """

    def kernel(batches):
        keys, nodes = [], []
        for batch in batches:
            if batch.num_rows:
                keys.append(buckets(_values(batch.column("sig"))))
                nodes.append(batch.column("node").to_numpy())
        if not keys:
            return
        node = np.concatenate(nodes)
        node, first = np.unique(node, return_index=True)
        key = np.concatenate(keys)[first]
        for j in range(BANDS):
            order = np.argsort(key[:, j], kind="stable")  # nodes rise within a bucket
            k, n = key[order, j], node[order]
            start = np.r_[True, k[1:] != k[:-1]]
            pivot = n[start][np.cumsum(start) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(pivot)], names=["bucket", "node", "pivot"])

    return words.select("node", "sig").mapInArrow(kernel, "bucket long, node long, pivot long")


def _cell_links(node: np.ndarray, odd: np.ndarray, sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of the odd rows of a cell: one to the others, which are a component, and those that span them."""
    found, rest, own = [], np.flatnonzero(~odd), np.flatnonzero(odd)
    for i in own.tolist() if len(rest) else ():
        hit = (sig[rest] == sig[i]).mean(axis=1) >= threshold
        if hit.any():
            found.append((int(node[i]), int(node[rest[hit.argmax()]])))
    return found + [(int(node[own[a]]), int(node[own[b]])) for a, b in _linked(sig[own], threshold)]


def links(signed: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(node, pivot) links between near duplicates: every bucket's members are connected as far as they are alike."""
    ship(signed.sparkSession)
    star = written(_stars(signed.where("n > 0")), "stars")
    by = Window.partitionBy("bucket")
    top = star.where("node = pivot").select("bucket", "node", F.min("node").over(by).alias("pivot"))
    top = written(top.where("node <> pivot"), "tops")
    below = star.where("node <> pivot")
    pairs = written(below.select("node", "pivot").union(top.select("node", "pivot")).distinct(), "links")
    needed = pairs.select("node").union(pairs.select(F.col("pivot").alias("node"))).distinct()
    sig = written(signed.select("node", "sig").join(needed.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "candidates")
    # these tables grow with the texts, so neither is broadcast, however small it is
    both = pairs.join(sig.withColumnRenamed("sig", "a").hint("merge"), "node").join(sig.select(F.col("node").alias("pivot"), F.col("sig").alias("b")).hint("merge"), "pivot")
    checked = written(_verified(both.select("node", "pivot", "a", "b"), threshold), "pairs", instead_of=pairs)
    good = checked.where("ok").select("node", "pivot")
    bad = checked.where("NOT ok").select("node", "pivot")
    # of each bucket with a link that failed: its members, and whether they are linked to its smallest node
    lost_top = top.join(bad, ["node", "pivot"], "left_semi").select("bucket", F.col("node").alias("pivot"))
    lost_below = below.join(bad, ["node", "pivot"], "left_semi").select("bucket", "node")
    failed = written(lost_top.select("bucket").union(lost_below.select("bucket")).distinct(), "failed")
    members = star.join(failed, "bucket", "left_semi").select("bucket", "node", "pivot").distinct()
    lost = lost_below.union(members.join(lost_top.distinct(), ["bucket", "pivot"], "left_semi").select("bucket", "node"))
    members = members.groupBy("bucket", "node").agg(F.count(F.lit(1)).alias("c")).join(lost.distinct().withColumn("odd", F.lit(True)), ["bucket", "node"], "left")
    members = written(members.select("bucket", "node", F.coalesce("odd", F.lit(False)).alias("odd")), "members")
    size = members.groupBy("bucket").agg(F.ceil(F.count_if("odd") / cell_rows).alias("o"), F.ceil(F.count_if(~F.col("odd")) / cell_rows).alias("p"))
    m = members.join(size, "bucket")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("odd"), F.col("o")).otherwise(F.col("p")))
    # odd chunks are 0 to o - 1, the others o to o + p - 1; a cell is a pair of chunks of which one at least is odd
    m = m.withColumn("chunk", F.when(F.col("odd"), own).otherwise(own + F.col("o")))
    partners = F.explode(F.when(F.col("odd"), F.sequence(F.lit(0).cast("long"), F.col("o") + F.col("p") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("o") - 1)))
    # the smallest node is not odd, so every odd chunk has a partner, and a cell holds what its chunks have alone
    m = m.select("bucket", "node", "odd", "chunk", partners.alias("partner")).where("chunk <> partner")
    cell = F.xxhash64("bucket", F.least("chunk", "partner"), F.greatest("chunk", "partner")).alias("cell")
    m = m.select(cell, "node", "odd").join(sig, "node").repartition("cell").sortWithinPartitions("cell", "node")

    def kernel(batches):
        held, parts, found = None, [], []

        def flush():
            if parts:
                node, odd, value = (np.concatenate(x) for x in zip(*parts))
                return _cell_links(node, odd, value, threshold)
            return []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["node", "pivot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, node, odd, value = batch.column("cell").to_numpy(), batch.column("node").to_numpy(), batch.column("odd").to_numpy(zero_copy_only=False), _values(batch.column("sig"))
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if cell[a] != held:
                    found += flush()
                    held, parts = cell[a], []
                parts.append((node[a:b].copy(), odd[a:b].copy(), value[a:b].copy()))
            if len(found) > 50_000:
                yield batch_of(found)
                found = []
        found += flush()
        if found:
            yield batch_of(found)

    inside = m.select("cell", "node", "odd", "sig").mapInArrow(kernel, "node long, pivot long")
    return good.union(inside)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is in an edge (node, pivot); root is the smallest node it is connected to."""
    e = written(edges.select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if mark == before or not mark.c:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "edges", instead_of=e)


def _groups(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and node, root, keeper, rows, size of the texts in groups of more than one row."""
    signed = written(sign(docs), "signatures")
    found = components(links(signed, threshold))
    each = signed.groupBy("node", "doc_id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
    each = each.groupBy("node").agg(F.min(F.struct("doc_id", "node", "row", "rows")).alias("least"), F.sum("rows").alias("rows"))
    each = written(each.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "rows"), "texts")
    whole = each.groupBy("root").agg(F.min("least").alias("keeper"), F.sum("rows").alias("size")).where("size > 1")
    return signed, written(each.select("node", "root").join(whole, "root"), "groups", instead_of=each)


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row that would go: its ``doc_id``, the ``doc_id`` that stays for it, and the group's size."""
    signed, groups = _groups(docs, threshold)
    rows = signed.select("row", "doc_id", "node").join(groups, "node").where("row <> keeper.row")
    return rows.select("doc_id", F.col("keeper.doc_id").alias("duplicate_of"), F.col("size").alias("group_size"))


def clean(docs: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates left; the same columns."""
    _, groups = _groups(docs, threshold)
    known = groups.select(F.col("node").alias("__node"), F.when(F.col("node") == F.col("keeper.node"), F.col("keeper")).alias("__keeper"))
    if groups.count() <= broadcast_rows:
        known = F.broadcast(known)
    node = "__" + "_".join(docs.columns)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs["text"].cast("string")).alias(node))
    whole = whole.join(known, F.when(F.col("row.text").isNotNull(), F.col(node)) == F.col("__node"), "left")
    is_keeper = F.col("row.doc_id").eqNullSafe(F.col("__keeper.doc_id")) & F.col("__keeper").isNotNull()
    back = lambda d: d.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    left = back(whole.where(F.col("__node").isNull() | (is_keeper & (F.col("__keeper.rows") == 1))))
    again = groups.where("node = keeper.node AND keeper.rows > 1").select("node")
    if again.isEmpty():
        return left
    # a keeper that occurs several times: one of its rows
    return left.unionByName(back(whole.where(is_keeper & (F.col("__keeper.rows") > 1)).dropDuplicates(["__node"])))
