"""Include resolution: a prioritised cascade of equi-joins, no driver map and no fan-out.

Quote includes: relative to the including directory, then from the root, then by path suffix.  Angle includes:
system headers are external, then from the root, then by suffix.  Of several suffix hits the mirrors of amalgamated
trees are dropped; one left is the target, else the include is ambiguous.  A file never includes itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.classify import dir_name, is_mirror, is_system_header, lexical_normal, suffixes
from codestrata.operators.graph import merge_edges


#: candidates that are listed for an ambiguous include; all are counted
CANDIDATES = 100


def suffix_index(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """(snapshot, token, n, paths, own) of suffixes that are among ``tokens(snapshot, token)``, folded before any join.

    ``n`` counts the paths that end so and ``own`` those outside mirrors, of which ``one`` is a path; ``paths`` lists the
    first :data:`CANDIDATES` in order, enough to report, so a name that every folder has stays a small row.
    """
    each = files.select("snapshot", "path", F.explode(suffixes(F.col("path"))).alias("token")).join(tokens, ["snapshot", "token"], "left_semi").distinct()
    own = F.when(~is_mirror(F.col("path")), F.col("path"))
    place = F.row_number().over(Window.partitionBy("snapshot", "token").orderBy("path"))
    some = each.withColumn("r", place).where(F.col("r") <= CANDIDATES).groupBy("snapshot", "token").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return each.groupBy("snapshot", "token").agg(F.count("path").alias("n"), F.count(own).alias("own"), F.min(own).alias("one"), F.min("path").alias("least")).join(some, ["snapshot", "token"])


def resolve(directives: DataFrame, files: DataFrame) -> DataFrame:
    """``directives`` with resolution, target and (the first :data:`CANDIDATES`) candidates, against ``files(snapshot, path)``."""
    f = files.select("snapshot", "path").distinct()
    quote, token = F.col("kind") == "quote", F.col("token")
    d = directives.withColumn("relative", F.when(quote, lexical_normal(F.concat(dir_name(F.col("src")), token))))
    d = d.join(f.select("snapshot", F.col("path").alias("relative"), F.col("path").alias("by_dir")), ["snapshot", "relative"], "left")
    d = d.join(f.select("snapshot", F.col("path").alias("token"), F.col("path").alias("by_root")), ["snapshot", "token"], "left")
    d = d.join(suffix_index(f, directives.select("snapshot", "token").distinct()), ["snapshot", "token"], "left")
    by_suffix = F.when(F.col("n") == 1, F.col("least")).when((F.col("n") > 1) & (F.col("own") == 1), F.col("one"))
    system = ~quote & is_system_header(token)
    target = F.when(~system, F.coalesce("by_dir", "by_root", by_suffix))
    miss = F.when(quote, "unresolved").otherwise("external")
    ambiguous = ~system & target.isNull() & (F.col("n") > 1)
    found = target.isNotNull() & (target != F.col("src"))
    kept = [c for c in directives.columns]
    return d.select(*kept, F.when(found, "project").when(ambiguous, "ambiguous").otherwise(miss).alias("resolution"), F.when(found, target).alias("target"), F.when(ambiguous, F.col("paths")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def edges(resolved: DataFrame) -> DataFrame:
    """(snapshot, src, dst, conditional, ordinal) of the includes that stay in the project."""
    return merge_edges(resolved.where("resolution = 'project'").select("snapshot", "src", F.col("target").alias("dst"), "conditional", "ordinal"))


def counters(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))
