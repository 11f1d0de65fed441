"""Benchmark decontamination.

The benchmark's normalised word n-grams form a hash set that goes to every executor; each training text is
scanned once, window by window, against a bit table of the set.  A window that hits is verified word for word
against the benchmark item.  Verified windows are merged into spans; a text of which at least
``drop_share`` of the words are covered is dropped, otherwise the covered words go, each with the separators
that follow it.  No shuffle and no sort: one pass over the text.

What is broadcast is the index of at most about ``part_bytes`` of benchmark text (one item more where an item is
longer), some ten times that size.  A larger benchmark is split by item into parts and the texts are scanned once
per part, so memory does not grow with the number of items.  Each part
but the last only notes the words it covers beside the text, which is written to the shared folder between parts;
the last unites them and decides, so the result is that of one part.

Defined results:

* words are runs of letters and digits of any script; null or wordless text: no window, kept as it is;
* ``doc_id`` may have any type and is carried through, null too; repeated rows are treated one by one, alike;
* a benchmark item shorter than ``n`` words is matched whole if it has ``min_words`` words, else ignored;
  null and repeated items are harmless; an empty benchmark hits nothing;
* a text of any length is read whole; ties cannot arise (spans are a union);
* extra columns: :func:`hits` returns its own columns only, :func:`clean` returns the columns of its input
  whatever their names.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from codestrata.storage import ship, written
from codestrata.llm.textkernel import Words, gram_mask, grams, slices

N, MIN_WORDS, DROP_SHARE, PART_BYTES = 8, 4, 0.5, 16 << 20
HITS = "action string, n_tokens long, covered_tokens long, n_spans long, item_ids string, clean_text string"
_BITS = 1 << 22


class Index:
    """Sorted n-gram hashes of one part of the benchmark, with the words to verify by.

    Arrays only: about 50 bytes for each word of the benchmark and the bit tables, on the driver and in each worker.
    """

    def __init__(self, rows: list[tuple], n: int, min_words: int):
        rows = [r for r in rows if r[1]]
        w = Words(pa.array([r[1] for r in rows], pa.large_string()))
        self.items, self.text, self.start, self.end = [r[0] for r in rows], w.buf.tobytes(), w.start, w.end
        size = np.minimum(w.counts, n)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(size[size >= min(n, min_words)].tolist())):
            own = np.zeros(len(w.h), bool)
            for i in np.flatnonzero(size == k):
                own[w.ptr[i] : w.ptr[i + 1] - k + 1] = True
            at = np.flatnonzero(own)
            item = np.searchsorted(w.ptr, at, side="right") - 1
            h = grams(w.h, k)[at]
            order = np.lexsort((at, item, h))
            h, at, item = h[order], at[order], item[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])]
            self.grams[k] = h[fresh], at[fresh], item[fresh]
        self._open: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def table(self, k: int) -> np.ndarray:
        """Bit table of the grams of ``k`` words, made once in each worker."""
        if k not in self._open:
            h = self.grams[k][0]
            bits = np.zeros(max(_BITS, 1 << int(16 * len(h)).bit_length()), bool)
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self._open[k] = bits
        return self._open[k]

    def _words(self, p: int, k: int) -> bytes:
        return b" ".join([self.text[s:e] for s, e in zip(self.start[p : p + k].tolist(), self.end[p : p + k].tolist())])

    def scan(self, arr: pa.Array) -> list[tuple[int, np.ndarray, set]]:
        """(row, covered mask over its words, items) of each text that verifiably hits."""
        w = Words(arr)
        covered: dict[int, np.ndarray] = {}
        items: dict[int, set] = {}
        text = None
        for k, (known, place, item) in self.grams.items():
            bits, g = self.table(k), grams(w.h, k)
            at = np.flatnonzero(bits[(g & np.uint64(len(bits) - 1)).astype(np.int64)] & gram_mask(w.ptr, len(w.h), k))
            lo, hi = np.searchsorted(known, g[at]), np.searchsorted(known, g[at], side="right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            rows = np.searchsorted(w.ptr, at, side="right") - 1
            for p, row, a, b in zip(at.tolist(), rows.tolist(), lo.tolist(), hi.tolist()):
                text = text or w.buf.tobytes()
                words = b" ".join([text[s:e] for s, e in zip(w.start[p : p + k].tolist(), w.end[p : p + k].tolist())])
                for q in range(a, b):
                    if self._words(place[q], k) != words:
                        continue
                    if row not in covered:
                        covered[row] = np.zeros(w.ptr[row + 1] - w.ptr[row], bool)
                        items[row] = set()
                    covered[row][p - w.ptr[row] : p - w.ptr[row] + k] = True
                    items[row].add(self.items[item[q]])
        return [(r, covered[r], items[r]) for r in sorted(covered)]


def _cut(text: str, covered: np.ndarray) -> str:
    """``text`` without the covered words, each removed with the separators after it."""
    own = Words(pa.array([text], pa.large_string()), lower=False, hashes=False)
    data = own.buf.tobytes()
    bounds = [*own.start.tolist(), len(data)]
    kept = [data[: bounds[0]]] + [data[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~covered).tolist()]
    return b"".join(kept).decode("utf-8", "replace")


def _parts(benchmark: DataFrame, n: int, min_words: int, part_bytes: int):
    """Broadcast indexes of at most about ``part_bytes`` of benchmark text each."""
    spark = benchmark.sparkSession
    ship(spark)
    b = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("passage")).where("passage IS NOT NULL")
    size = b.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("s")).first().s
    parts = max(1, math.ceil(size / part_bytes))
    for k in range(parts):
        own = b.where(F.pmod(F.xxhash64("passage"), F.lit(parts)) == k) if parts > 1 else b
        index = Index([tuple(r) for r in own.toLocalIterator()], n, min_words)
        if index.grams:
            yield spark.sparkContext.broadcast(index)


def _covered(index: Index, part: pa.RecordBatch, noted: str | None) -> list[tuple[int, np.ndarray, set]]:
    """(row, covered mask, items) of each text that this part of the benchmark or one before it hits."""
    found = {row: (covered, items) for row, covered, items in index.scan(part.column("text"))}
    for row, x in enumerate(part.column(noted).to_pylist() if noted else ()):
        if x is not None:
            bits, n, items = pickle.loads(x)
            covered = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)
            found[row] = (found[row][0] | covered, found[row][1] | items) if row in found else (covered, items)
    return [(row, *found[row]) for row in sorted(found)]


def _noted(d: DataFrame, benchmark: DataFrame, n: int, min_words: int, part_bytes: int):
    """``d`` with a column of what all parts of the benchmark but the last cover, that column's name, and the last part.

    One part needs no column; an empty benchmark has no last part.
    """
    name, columns, index = None, d.columns, None
    for following in _parts(benchmark, n, min_words, part_bytes):
        if index is not None:
            before, name = name, name or "_" * (1 + max(map(len, columns))) + "covered"

            def kernel(batches, index=index, before=before, name=name):
                ix = index.value
                for batch in batches:
                    for part in slices(batch, "text"):
                        notes: list[bytes | None] = [None] * part.num_rows
                        for row, covered, items in _covered(ix, part, before):
                            notes[row] = pickle.dumps((np.packbits(covered).tobytes(), len(covered), items))
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(notes, pa.binary())], names=[*columns, name])

            schema = StructType([*d.schema.fields[: len(columns)], StructField(name, BinaryType())])
            d = written(d.mapInArrow(kernel, schema), "covered")
            index.unpersist()
        index = following
    return d, name, index


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each contaminated document."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([d.schema["doc_id"], *_parse_datatype_string(HITS).fields])
    d, noted, index = _noted(d, benchmark, n, min_words, part_bytes)
    if index is None:
        return docs.sparkSession.createDataFrame([], schema)

    def kernel(batches):
        ix = index.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for row, covered, items in _covered(ix, part, noted):
                    share = covered.mean()
                    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    drop = share >= drop_share
                    found.append((row, "drop" if drop else "cut", len(covered), int(covered.sum()), spans, ",".join(str(i) for i in sorted(i for i in items if i is not None)), None if drop else _cut(part.column("text")[row].as_py(), covered)))
                if found:
                    rows, *cols = zip(*found)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), *map(pa.array, cols, kinds)], names=schema.names)

    return d.mapInArrow(kernel, schema)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with benchmark spans cut from the texts and mostly-benchmark documents gone; the same columns.

    ``n_chars`` is set anew where a text was cut.
    """
    d, noted, index = _noted(docs, benchmark, n, min_words, part_bytes)
    if index is None:
        return docs

    def kernel(batches):
        ix = index.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = _covered(ix, part, noted)
                if noted:
                    part = part.drop_columns([noted])
                if not found:
                    yield part
                    continue
                keep = np.ones(part.num_rows, bool)
                new: dict[int, str] = {}
                for row, covered, _ in found:
                    if covered.mean() >= drop_share:
                        keep[row] = False
                    else:
                        new[row] = _cut(part.column("text")[row].as_py(), covered)
                if new:
                    text = part.column("text").to_pylist()
                    for row, t in new.items():
                        text[row] = t
                    k = part.schema.get_field_index("text")
                    part = part.set_column(k, part.schema.field(k), pa.array(text, part.schema.field(k).type))
                    k = part.schema.get_field_index("n_chars")
                    if k >= 0 and pa.types.is_integer(part.schema.field(k).type):
                        size = part.column(k).to_pylist()
                        for row, t in new.items():
                            size[row] = len(t)
                        part = part.set_column(k, part.schema.field(k), pa.array(size, part.schema.field(k).type))
                yield part.filter(pa.array(keep))

    return d.mapInArrow(kernel, docs.schema)


#: :func:`hits` of the tables ``documents`` and ``benchmark``.
SQL = r"""
WITH dt AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS pieces,
  regexp_extract(text, '^[^\p{L}\p{N}]*') AS head FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS g, least(8, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, CAST(len(w) - least(8, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) >= 4)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dt, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h),
a AS (SELECT doc_id, list(p) AS ps, count(*) AS covered, count(*) - count(q) AS spans FROM (SELECT c.doc_id, c.p, d.p AS q FROM c LEFT JOIN c d ON c.doc_id = d.doc_id AND c.p = d.p + 1) GROUP BY doc_id),
it AS (SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN covered >= 0.5 * len(w) THEN 'drop' ELSE 'cut' END AS action, CAST(len(w) AS BIGINT) AS n_tokens, CAST(covered AS BIGINT) AS covered_tokens,
  CAST(spans AS BIGINT) AS n_spans, item_ids,
  CASE WHEN covered < 0.5 * len(w) THEN head || array_to_string(list_filter(pieces, lambda x, k: NOT list_contains(ps, k)), '') END AS clean_text
FROM a JOIN dt ON dt.doc_id = a.doc_id JOIN it ON it.doc_id = a.doc_id
"""
