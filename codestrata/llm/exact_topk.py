"""Exact top-k search by vector-approximation files.

Each vector is approximated by a cell of a uniform grid, one byte a dimension, kept with the distance of the
vector from the cell's centre.  A block of queries (``query_rows`` at most, broadcast) is answered in two scans:

1. the cells alone are read.  Each pair's distance is bounded from above and every query's k smallest upper bounds
   over all vectors are agreed on: the k-th is a bound of its k-th distance;
2. cells whose lower bound is within that bound are candidates; only their exact vectors are looked at, in order of
   lower bound, until the k-th exact distance is under the next lower bound.  What is left of each batch, a few rows
   a query, is merged by one shuffle.

The bounds are proven: coordinates are centred on the grid and scaled by a power of two before they become float32,
and the error of the float32 product, ``(dim + 4) * 2**-23 * (|q| + |c|)**2``, is part of every bound.  So the
result is exact wherever the vectors lie; exact distances are computed in float64 from the vectors as they are.

Vectors are shuffled once, to fold repeated rows; neither scan shuffles them.  Work is queries times vectors.

Defined results:

* null vectors, null ``vec_id``, vectors with a null, NaN or infinite element, or of another length than most (the
  shorter, if two are as frequent) are neither queries nor neighbours;
* ``vec_id`` may have any type that can be ordered; a row is never a neighbour of a row with its own ``vec_id``;
  repeated rows (same id and vector) count once;
* ties in distance go to the smaller ``vec_id``; fewer than ``k`` other rows give fewer neighbours;
* an empty table gives an empty result, as does a condition that no row meets; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from codestrata.llm.sums import partition_sum
from codestrata.storage import forget, ship, written

K, QUERY_ROWS, CELLS = 10, 16384, 256
_PART = 512  # queries that are multiplied with a batch at a time


def _vectors(arr: pa.Array, dim: int) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Grid:
    """Cells between the least and the largest value of each dimension, over coordinates scaled to about [-1, 1]."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.mid = low / 2 + high / 2
        half = np.maximum(high - self.mid, self.mid - low)
        self.scale = float(2.0 ** np.ceil(np.log2(half.max()))) if half.max() > 0 else 1.0
        self.half = np.maximum(half / self.scale, 1e-30)
        self.error = (len(low) + 4) * 2.0**-23
        self.convert = np.sqrt(len(low)) * 2.0**-26  # of centring float32 values in float64

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mid) / self.scale

    def centres(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.float64) * 2 + (1 - CELLS)) * (self.half / CELLS)).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = self.scaled(x)
        code = np.clip(np.floor((y + self.half) * (CELLS / 2 / self.half)), 0, CELLS - 1).astype(np.uint8)
        return code, np.sqrt(((y - self.centres(code)) ** 2).sum(1)) * (1 + 1e-12)


class Queries:
    """A block of queries, ready to be multiplied with cells."""

    def __init__(self, grid: Grid, x: np.ndarray, ids: np.ndarray):
        y = grid.scaled(x)
        q = y.astype(np.float32)
        self.x, self.ids, self.grid = x, ids, grid
        self.off = np.sqrt(((y - q) ** 2).sum(1)) * (1 + 1e-12) + 2 * grid.convert
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.left = np.column_stack([q, (self.norm**2).astype(np.float32), np.ones(len(q), np.float32)])
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]

    def __len__(self):
        return len(self.ids)

    def cells(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the queries are multiplied with, and the norms of the centres."""
        c = self.grid.centres(code)
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
        return np.column_stack([-2 * c, np.ones(len(c), np.float32), (norm**2).astype(np.float32)]).T, norm

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of equal ids."""
        lo, hi = np.searchsorted(self.sorted, ids), np.searchsorted(self.sorted, ids, side="right")
        n = hi - lo
        col = np.repeat(np.arange(len(ids)), n)
        return self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], col

    def error(self, row: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return self.grid.error * (self.norm[row] + norm) ** 2


def lowest(best: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``best`` (n, k), sorted by row, after the values have come in."""
    k = best.shape[1]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, value, rank = row[rank < k], value[rank < k], rank[rank < k]
    hit = np.unique(row)
    new = np.full((len(hit), k), np.inf)
    new[np.searchsorted(hit, row), rank] = value
    best[hit] = np.sort(np.concatenate([best[hit], new], 1), 1)[:, :k]
    return best


def upper_bounds(q: Queries, code: np.ndarray, radius: np.ndarray, ids: np.ndarray, best: np.ndarray) -> None:
    """Let the upper bounds of a batch into the k lowest of each query."""
    cells, norm = q.cells(code)
    own_row, own_col = q.own(ids)
    k = best.shape[1]
    for at in range(0, len(q), _PART):
        end = min(at + _PART, len(q))
        d2 = q.left[at:end] @ cells
        mine = (own_row >= at) & (own_row < end)
        d2[own_row[mine] - at, own_col[mine]] = np.inf
        begin = 0
        for stop in (256, d2.shape[1]):  # a few first, to have bounds that most of the rest are not under
            part = d2[:, begin:stop]
            limit = best[at:end, k - 1]
            if begin == 0 and part.shape[1] > k:
                first = np.partition(part, k - 1, axis=1)[:, k - 1].astype(np.float64)
                worst = np.sqrt(np.maximum(first, 0) + q.grid.error * (q.norm[at:end] + norm[:stop].max()) ** 2) + radius[:stop].max() + q.off[at:end]
                limit = np.minimum(limit, worst)
            with np.errstate(over="ignore"):
                near = np.nextafter((np.minimum(limit, 1e18) ** 2 + q.grid.error * (q.norm[at:end] + norm.max()) ** 2).astype(np.float32), np.float32(np.inf))
            row, col = np.nonzero(part <= near[:, None])
            value = part[row, col].astype(np.float64)
            row, col = row + at, col + begin
            bound = np.sqrt(np.maximum(value, 0) + q.error(row, norm[col])) + radius[col] + q.off[row]
            use = np.isfinite(value) & (bound < best[row, k - 1])
            lowest(best, row[use], bound[use])
            begin = stop
            if begin >= d2.shape[1]:
                break


def nearest(q: Queries, code: np.ndarray, radius: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, squared distance) of the k nearest of a batch, if within each query's bound; and the number of exact vectors read."""
    cells, norm = q.cells(code)
    own_row, own_col = q.own(ids)
    out, read = [], 0
    for at in range(0, len(q), _PART):
        end = min(at + _PART, len(q))
        d2 = q.left[at:end] @ cells
        mine = (own_row >= at) & (own_row < end)
        d2[own_row[mine] - at, own_col[mine]] = np.inf
        reach = np.minimum(bound[at:end], 1e18) + radius.max() + q.off[at:end]
        near = np.nextafter((reach**2 + q.grid.error * (q.norm[at:end] + norm.max()) ** 2).astype(np.float32), np.float32(np.inf))
        row, col = np.nonzero(d2 <= near[:, None])
        value = d2[row, col].astype(np.float64)
        row = row + at
        low = np.sqrt(np.maximum(value - q.error(row, norm[col]), 0)) * (1 - 1e-12) - radius[col] - q.off[row]
        use = np.isfinite(value) & (low <= bound[row])
        row, col, low = row[use], col[use], low[use] * q.grid.scale * (1 - 1e-12)
        order = np.lexsort((low, row))
        r, c, d, n = _in_order(q, at, end, row[order], col[order], low[order], ids, x, k)
        out.append((r, c, d))
        read += n
    return *(np.concatenate(o) for o in zip(*out)), read


def _in_order(q: Queries, first: int, last: int, row: np.ndarray, col: np.ndarray, low: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Exact vectors of the candidates of queries ``first`` to ``last``, in order of lower bound, until the k-th is certain."""
    span = np.arange(first, last)
    begin, end = np.searchsorted(row, span), np.searchsorted(row, span, side="right")
    best_d, best_i = np.full((len(span), k), np.inf), np.full((len(span), k), -1, np.int64)
    at, active, width, read = begin.copy(), np.flatnonzero(begin < end), k + 6, 0
    while len(active):
        take = at[active][:, None] + np.arange(width)
        ok = take < end[active][:, None]
        read += int(ok.sum())
        take = np.minimum(take, len(col) - 1)
        c = col[take]
        d2 = ((q.x[first + active].astype(np.float64)[:, None, :] - x[c].astype(np.float64)) ** 2).sum(2)
        d2[~ok] = np.inf
        all_d = np.concatenate([best_d[active], d2], 1)
        all_i = np.concatenate([best_i[active], np.where(ok, c, -1)], 1)
        name = np.where(all_i >= 0, ids[all_i], np.iinfo(np.int64).max)
        pick = np.lexsort((name, all_d), axis=1)[:, :k]
        best_d[active] = np.take_along_axis(all_d, pick, 1)
        best_i[active] = np.take_along_axis(all_i, pick, 1)
        at[active] += width
        more = at[active] < end[active]
        following = low[np.minimum(at[active], len(col) - 1)]
        active = active[more & (following <= np.sqrt(best_d[active, k - 1]) * (1 + 1e-12))]
        width = min(2 * width, 256)
    r, c = np.nonzero(best_i >= 0)
    return first + r, best_i[r, c], best_d[r, c], read


def _numbered(v: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``v`` with ``vid``, a long that sorts as ``vec_id`` does, and for ids that are no integers the table of both."""
    if isinstance(v.schema["vec_id"].dataType, IntegralType):
        return v.withColumn("vid", F.col("vec_id").cast("long")), None
    # numbers of a sorted table rise with its rows, over all of its partitions
    names = written(v.select("vec_id").distinct().orderBy("vec_id").withColumn("vid", F.monotonically_increasing_id()), "ids")
    return v.join(names, "vec_id"), names


def top_k(vectors: DataFrame, k: int = K, queries: Column | str = "true", query_rows: int = QUERY_ROWS) -> DataFrame:
    """vec_id, rank (from 1), neighbor_id, distance of the ``k`` nearest other rows of each row that meets ``queries``."""
    spark = vectors.sparkSession
    ship(spark)
    condition = F.expr(queries) if isinstance(queries, str) else queries
    kind = vectors.schema["vec_id"].dataType.simpleString()
    v = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("x"), F.coalesce(condition, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    v = v.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    sizes = v.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], f"vec_id {kind}, rank int, neighbor_id {kind}, distance double")
    if sizes is None or sizes.dim <= 0:
        return empty
    dim = sizes.dim
    v, names = _numbered(v.where(F.size("x") == dim).groupBy("vec_id", "x").agg(F.bool_or("asks").alias("asks")))

    def extremes(batch, total):
        x = _vectors(batch.column("x"), dim).astype(np.float64)
        np.minimum(total, np.r_[x.min(0), -x.max(0)], out=total)

    v = written(v.select("vid", "asks", "x"), "vectors")
    e = partition_sum(v.select("x"), 2 * dim, extremes, np.minimum, np.inf)
    grid = Grid(e[:dim], -e[dim:])

    def approximate(batches):
        for batch in batches:
            if batch.num_rows:
                code, radius = grid.encode(_vectors(batch.column("x"), dim))
                data = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * dim), pa.py_buffer(np.ascontiguousarray(code).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("asks"), data, pa.array(radius), batch.column("x")], names=["vid", "asks", "code", "radius", "x"])

    file = written(v.mapInArrow(approximate, "vid long, asks boolean, code binary, radius double, x array<float>"), "approximations", instead_of=v)

    def cells(batch):
        arr = batch.column("code")
        off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
        return np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, dim), batch.column("radius").to_numpy(), batch.column("vid").to_numpy()

    def scan(block: DataFrame) -> DataFrame:
        asked = block.toArrow()  # query_rows at most
        q = Queries(grid, _vectors(asked.column("x"), dim), asked.column("vid").to_numpy())
        shared = spark.sparkContext.broadcast(q)

        def bounds(batch, total):
            upper_bounds(shared.value, *cells(batch), total.reshape(-1, k))

        def merge(a, b):
            return np.sort(np.concatenate([a.reshape(-1, k), b.reshape(-1, k)], 1), 1)[:, :k].ravel()

        kth = partition_sum(file.select("vid", "code", "radius"), len(q) * k, bounds, merge, np.inf).reshape(-1, k)[:, k - 1].copy()
        limits = spark.sparkContext.broadcast(kth)

        def exact(batches):
            for batch in batches:
                if batch.num_rows:
                    code, radius, ids = cells(batch)
                    r, c, d2, _ = nearest(shared.value, code, radius, ids, _vectors(batch.column("x"), dim), limits.value, k)
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(shared.value.ids[r]), pa.array(ids[c]), pa.array(d2)], names=["qnode", "qid", "nid", "d2"])

        found = file.select("vid", "code", "radius", "x").mapInArrow(exact, "qnode long, qid long, nid long, d2 double")
        rank = F.row_number().over(Window.partitionBy("qnode").orderBy("d2", "nid"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "nid", F.round(F.sqrt("d2"), 6).alias("distance"))

    asking = file.where("asks").select("vid", "x")
    count = asking.count()
    if not count:
        return empty
    if count <= query_rows:
        found = scan(asking)
    else:
        # blocks are ranges of a number that rises with the rows of a table, so each holds query_rows at most
        asking = written(asking.repartition(-(-count // query_rows) * 4).withColumn("n", F.monotonically_increasing_id()), "queries")
        per = {r.p: r["count"] for r in asking.groupBy(F.shiftright("n", 33).alias("p")).count().collect()}
        parts, starts, held = sorted(per), [], 0
        for p in parts:
            for at in range(0, per[p], query_rows):
                rows = min(query_rows, per[p] - at)
                if not starts or at or held + rows > query_rows:
                    starts.append((p << 33) + at)
                    held = 0
                held += rows
        blocks = []
        for low, high in zip(starts, [*starts[1:], 1 << 62]):
            blocks.append(written(scan(asking.where((F.col("n") >= low) & (F.col("n") < high)).select("vid", "x")), "found"))
        forget(asking)
        found = blocks[0]
        for b in blocks[1:]:
            found = found.unionByName(b)
    if names is None:
        return found.select(F.col("qid").cast(kind).alias("vec_id"), "rank", F.col("nid").cast(kind).alias("neighbor_id"), "distance")
    return found.join(names.toDF("vec_id", "qid"), "qid").join(names.toDF("neighbor_id", "nid"), "nid").select("vec_id", "rank", "neighbor_id", "distance")


#: the queries of op2: every row whose id is divisible by 50, against all rows
ASKED = "vec_id % 50 = 0"
SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT vec_id, neighbor_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(dist, 6) AS distance FROM r WHERE rank <= 10
"""
