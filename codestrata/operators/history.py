"""Analyses of commit history: ``commits(pos, sha, subject)`` and ``changes(pos, path, added, deleted)``, pos 0 the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.classify import is_fix, is_production, path_excluded
from codestrata.operators.drift import violation
from codestrata.options import Extras


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and changes from ``lines(n, line)`` of a log: ``sha 0x1f subject`` headers, then added TAB deleted TAB path.

    Rows of binary files (``-``) and renames (``=>``) are skipped.  Lines are numbered within one log, so the
    running header count orders one log in one window.
    """
    header = F.col("line").contains("\x1f")
    d = lines.withColumn("pos", F.sum(F.when(header, 1).otherwise(0)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    commits = d.where(header).select(F.col("pos").cast("int").alias("pos"), F.get(F.split("line", "\x1f"), F.lit(0)).alias("sha"), F.get(F.split("line", "\x1f", 2), F.lit(1)).alias("subject"))
    part = F.split("line", "\t", 3)
    rows = d.where(~header & (F.size(part) == 3)).select(F.col("pos").cast("int").alias("pos"), F.get(part, F.lit(2)).alias("path"), F.expr("try_cast(get(split(line, '\t', 3), 0) AS int)").alias("added"), F.expr("try_cast(get(split(line, '\t', 3), 1) AS int)").alias("deleted"))
    return commits, rows.where("added IS NOT NULL AND deleted IS NOT NULL AND NOT contains(path, ' => ')")


def growth(changes: DataFrame, newest_first: bool = True, shrink: int = 50) -> DataFrame:
    """path, net, streak, shrunk: net growth, growing touches in a row from the recent end, any shrink of ``shrink`` lines.

    ``newest_first=False`` counts the streak from the oldest commit of the window instead.
    """
    order = F.col("pos") if newest_first else -F.col("pos")
    w = Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = changes.groupBy("path", "pos").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max(F.col("deleted") - F.col("added")).alias("drop"))
    d = d.withColumn("stops", F.sum(F.when(F.col("added") <= F.col("deleted"), 1).otherwise(0)).over(w))
    return d.groupBy("path").agg(F.sum(F.col("added") - F.col("deleted")).alias("net"), F.count_if(F.col("stops") == 0).alias("streak"), F.bool_or(F.col("drop") >= shrink).alias("shrunk"))


def god_file_growth(changes: DataFrame, loc: DataFrame, extras: Extras = Extras(), newest_first: bool = True, min_streak: int = 5, percent: int = 30, absolute: int = 300, shrink: int = 50) -> DataFrame:
    """SIZE.1 over ``loc(path, loc)``: in the top quarter by size, grown by much, touch after touch, never shrunk."""
    own = loc.where(~path_excluded(F.col("path"), extras))
    p75 = own.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY loc)").alias("p75"))
    d = own.join(growth(changes, newest_first, shrink), "path").crossJoin(F.broadcast(p75))
    d = d.where((F.col("loc") >= F.col("p75")) & ((F.col("net") >= F.floor(F.col("loc") * percent / 100)) | (F.col("net") >= absolute)) & (F.col("streak") >= min_streak) & ~F.col("shrunk"))
    return violation(d, "SIZE.1.god_file_growth", "path", F.format_string("current %d LOC, net +%d lines, %d consecutive growth commits", "loc", "net", "streak"))


def fix_touches(commits: DataFrame, changes: DataFrame, extras: Extras = Extras(), max_files: int = 30) -> DataFrame:
    """path, touches by fix-like commits; merges and fixes of more than ``max_files`` files are left out."""
    fixes = commits.where(is_fix(F.col("subject")) & ~F.col("subject").startswith("Merge")).select("pos")
    d = changes.join(fixes, "pos", "left_semi")
    size = d.groupBy("pos").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") <= max_files)
    return d.join(size, "pos", "left_semi").where(is_production(F.col("path"), extras)).groupBy("path").agg(F.count(F.lit(1)).alias("touches"))


def defect_attractors(commits: DataFrame, changes: DataFrame, extras: Extras = Extras(), min_touches: int = 5) -> DataFrame:
    """HIST.1: at least ``min_touches`` fixes and in the top decile (the top alone below ten files)."""
    t = fix_touches(commits, changes, extras)
    limit = t.agg(F.when(F.count(F.lit(1)) < 10, F.max("touches")).otherwise(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY touches)")).alias("limit"))
    total = commits.agg(F.count(F.lit(1)).alias("total"))
    d = t.crossJoin(F.broadcast(limit)).crossJoin(F.broadcast(total)).where((F.col("touches") >= min_touches) & (F.col("touches") >= F.col("limit")))
    return violation(d, "HIST.1.defect_attractor", "path", F.format_string("%d fix-like touches in %d commits", F.col("touches").cast("long"), F.col("total")))
