"""Shared-folder storage: cutting lineage so that a lost executor costs a re-read, not a wrong or failed job."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_WRITTEN: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but the folder is visible to them."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own, if all runs in one process.

    On a cluster a folder of the driver's machine is no shared folder, so there an unset one is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif context.master == "local" or context.master.startswith("local["):
            where = "file://" + tempfile.mkdtemp(prefix="codestrata-")
            context.setCheckpointDir(where)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


@atexit.register
def _clean() -> None:
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        _delete(spark, path)


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, lineage cut, survives executor loss.

    ``instead_of``: a written table that is needed no more; loops pass that of the round before, so that one round's
    tables are kept and not all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codestrata-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table."""
    path = getattr(df, "_written_at", None)
    if path in _WRITTEN:
        _delete(_WRITTEN.pop(path), path)


def numbered(df: DataFrame, *order: Column | str, name: str = "k") -> DataFrame:
    """``df`` with its rows' numbers from 0 in ``order``, as a long: a sort by ranges and a count of each range.

    A window without a partition would bring all rows into one task.
    """
    d = written(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    first, n = {}, 0
    for p, k in sorted((r.p, r["count"]) for r in d.groupBy(part.alias("p")).count().collect()):  # a row by partition
        first[p], n = n, n + k
    if not first:
        return d
    at = F.create_map(*[F.lit(x) for p in first for x in (p, first[p])])[part]
    return d.withColumn(name, (at + F.col(name).bitwiseAND((1 << 33) - 1)).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
