"""Analyses of diff lines and per-file churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.classify import churn_bucket, path_excluded, satd_rule
from codestrata.operators.drift import violation
from codestrata.options import Extras
from codestrata.storage import written


def parse_diff(lines: DataFrame) -> DataFrame:
    """``diff_lines(side, path, line, text)`` from ``lines(n, line)`` of a unified diff without context.

    Added lines carry new-side numbers, deleted lines old-side numbers.  Within a file section everything is a
    window over the section, so sections are numbered in parallel once the section ids are known.
    """
    d = lines.withColumn("section", F.sum(F.when(F.col("line").startswith("diff --git "), 1).otherwise(0)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy("section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^diff --git .* b/(.*)$", 1)
    hunk = F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    out = []
    for side, other, mark, at in (("+", "b/", "+++ ", 3), ("-", "a/", "--- ", 1)):
        override = F.when(F.col("line").startswith(mark + other), F.substr(F.col("line"), F.lit(7)))
        path = F.last(F.coalesce(F.when(head != "", head), override), ignorenulls=True).over(so_far)
        start = F.when(hunk, F.regexp_extract("line", r"^@@ -(\d+)(,\d+)? \+(\d+)", at).cast("int"))
        e = d.withColumn("path", path).withColumn("hunk", F.sum(F.when(hunk, 1).otherwise(0)).over(so_far)).withColumn("start", F.last(start, ignorenulls=True).over(so_far))
        e = e.where((F.col("hunk") > 0) & F.col("line").startswith(side) & ~F.col("line").startswith(side * 3))
        k = F.row_number().over(Window.partitionBy("section", "hunk").orderBy("n"))
        out.append(e.select(F.lit(side).alias("side"), "path", (F.col("start") + k - 1).cast("int").alias("line"), F.substr(F.col("line"), F.lit(2)).alias("text")))
    return out[0].unionByName(out[1])


def parse_numstat(lines: DataFrame) -> DataFrame:
    """``numstat(path, added, removed)``; binary rows (``-``) are skipped."""
    part = F.split("line", "\t", 3)
    d = lines.where(F.size(part) == 3).select(F.get(part, F.lit(2)).alias("path"), F.expr("try_cast(get(split(line, '\t', 3), 0) AS int)").alias("added"), F.expr("try_cast(get(split(line, '\t', 3), 1) AS int)").alias("removed"))
    return d.where("added IS NOT NULL AND removed IS NOT NULL")


#: what precedes the first comment of a line: plain text, string and character literals
_CODE = r"^(?:[^\"'/]|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|/(?![/*]))*+"


def comment_part(text: Column) -> Column:  # T12
    """The first comment of a line, quotes respected; empty if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, _CODE + r"(//.*)$", 1), F.lit("")), F.regexp_extract(text, _CODE + r"(/\*.*?(?:\*/|$))", 1))


def truncated(text: Column, size: int = 120) -> Column:
    """At most ``size`` characters, cut at the last blank within them if there is one."""
    cut = F.regexp_extract(F.substring(text, 1, size + 1), r"^(.*)[ \t]", 1)
    return F.when(F.length(text) <= size, text).when(cut != "", F.rtrim(cut)).otherwise(F.rtrim(F.substring(text, 1, size)))


def satd(added: DataFrame, extras: Extras = Extras()) -> DataFrame:
    """SATD.1, SATD.2 of ``added(path, line, text)``."""
    d = added.withColumn("rule", satd_rule(comment_part(F.col("text")))).where(F.col("rule").isNotNull() & ~path_excluded(F.col("path"), extras))
    return violation(d, F.col("rule"), "path", truncated(F.col("text")), F.col("line"))


def churn(numstat: DataFrame, extras: Extras = Extras()) -> DataFrame:
    """One row: prod_added, prod_removed, prod_files, test_added, test_removed; rows without churn are skipped."""
    d = numstat.where("added + removed > 0").withColumn("bucket", churn_bucket(F.col("path"), extras))
    part = lambda b, c: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col(c))), F.lit(0))
    return d.agg(part("prod", "added").alias("prod_added"), part("prod", "removed").alias("prod_removed"), F.count_if(F.col("bucket") == "prod").alias("prod_files"), part("test", "added").alias("test_added"), part("test", "removed").alias("test_removed"))


def test_co_evolution(numstat: DataFrame, extras: Extras = Extras()) -> DataFrame:
    """TEST.1: much production churn, (nearly) no test churn."""
    d = churn(numstat, extras).withColumns({"p": F.col("prod_added") + F.col("prod_removed"), "t": F.col("test_added") + F.col("test_removed")})
    d = d.where("(p >= 80 AND t = 0) OR (p >= 200 AND t > 0 AND t < p DIV 20)")
    return violation(d, "TEST.1.prod_changed_tests_silent", F.lit("<diff>"), F.format_string("prod +%d/-%d across %d file(s), tests +%d/-%d", "prod_added", "prod_removed", "prod_files", "test_added", "test_removed"))


def touching(spans: DataFrame, lines: DataFrame, width: int = 4096) -> DataFrame:
    """Spans ``(path, start_line, end_line, ...)`` that a line ``(path, line)`` falls into: an interval semi-join.

    A span is touched exactly if the first line at or after its start is no later than its end.  That line is looked for
    among the ``width`` lines around the start, then in the next block of the path that has any, so no pair of a span and a
    line is formed and a path with many lines is spread.
    """
    block = F.floor(F.col("__at") / width).alias("__block")
    points = lines.select("path", F.col("line").cast("long").alias("__at"), F.col("line").cast("long").alias("__line")).distinct()
    points = points.union(spans.select("path", F.col("start_line").cast("long"), F.lit(None).cast("long")).distinct()).where("path IS NOT NULL AND __at IS NOT NULL")
    points = written(points.select("*", block), "points")
    near = F.min("__line").over(Window.partitionBy("path", "__block").orderBy(F.desc("__at")))  # peers count
    after = Window.partitionBy("path").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    later = points.groupBy("path", "__block").agg(F.min("__line").alias("__first")).select("path", "__block", F.min("__first").over(after).alias("__later"))
    found = points.withColumn("__near", near).where("__line IS NULL").join(later, ["path", "__block"])
    found = found.select("path", F.col("__at").alias("__start"), F.coalesce("__near", "__later").alias("__next")).where("__next IS NOT NULL")
    found = found.withColumnRenamed("path", "__path")
    hit = (F.col("path") == F.col("__path")) & (F.col("start_line").cast("long") == F.col("__start")) & (F.col("__next") <= F.col("end_line"))
    return spans.join(found, hit, "left_semi")


def on_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings ``(file, line, ...)`` that sit on one of the lines."""
    return found.join(lines.select(F.col("path").alias("file"), "line").distinct(), ["file", "line"], "left_semi").select(*found.columns)
