"""The lexing stage: ``files(snapshot, path, content)`` to tables, Arrow batches in, rows out, no shuffle.

One function per table, each a single ``mapInArrow`` over the files; a long file is one row and is never split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codestrata import schema
from codestrata.functions import classify as c
from codestrata.functions import lexing
from codestrata.operators.drift import violation
from codestrata.options import CloneOptions, Extras
from codestrata.storage import ship

READ_LIMIT = 64 << 20


def text_of(content: bytes | None) -> str:
    return (content or b"").decode("utf-8", "surrogateescape")


def _clean(v):
    return v.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if isinstance(v, str) else v


def _stage(files: DataFrame, out: str, rows: Callable[[str, str, str], Iterator[tuple]]) -> DataFrame:
    """``rows(snapshot, path, text)`` of every file as a table of schema ``out``."""
    ship(files.sparkSession)
    kind = to_arrow_schema(_parse_datatype_string(out))

    def kernel(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [tuple(map(_clean, r)) for s, p, b in zip(*(part.column(i).to_pylist() for i in range(3))) for r in rows(s, p, text_of(b))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), kind)], schema=kind)

    return files.select("snapshot", "path", F.col("content").cast("binary")).mapInArrow(kernel, out)


def authored(files: DataFrame, extras: Extras = Extras()) -> DataFrame:
    """``files`` with ``authored``: own code, not vendored, generated, minified or test (P17, A13).

    A licence banner marks a file as foreign unless most candidates of its snapshot carry one.
    """
    banner = c.has_license_banner(F.col("content"))
    d = files.withColumn("__clean", ~(c.path_excluded(F.col("path"), extras) | c.has_generated_banner(F.col("content")) | c.is_minified(F.col("content")))).withColumn("__banner", banner)
    share = d.where("__clean").groupBy("snapshot").agg((2 * F.count_if("__banner") > F.count(F.lit(1))).alias("__dominant"))
    d = d.join(share, "snapshot", "left")  # a row by snapshot
    return d.withColumn("authored", F.col("__clean") & (F.coalesce("__dominant", F.lit(False)) | ~F.col("__banner"))).select(*files.columns, "authored")


def includes(files: DataFrame) -> DataFrame:
    return _stage(files, schema.DIRECTIVES, lambda s, p, t: ((s, p, i, *d) for i, d in enumerate(lexing.scan_includes(t)[0])))


def include_diagnostics(files: DataFrame) -> DataFrame:
    return _stage(files, schema.DIAGNOSTICS, lambda s, p, t: ((s, p, *d) for d in lexing.scan_includes(t)[1]))


def functions(files: DataFrame) -> DataFrame:
    return _stage(files, schema.FUNCTIONS, lambda s, p, t: ((s, p, i, f.name, f.params, f.arity, f.start, f.end, k.loc, k.score, k.structural, k.nesting) for i, (f, k) in enumerate(lexing.file_functions(t))))


def unclosed(files: DataFrame) -> DataFrame:
    return _stage(files, "snapshot string, path string", lambda s, p, t: [(s, p)] if lexing.unclosed(t) else [])


def bool_fields(files: DataFrame) -> DataFrame:
    return _stage(files, schema.BOOL_FIELDS, lambda s, p, t: ((s, p, *f) for f in lexing.bool_fields(t)))


def structs(files: DataFrame) -> DataFrame:
    return _stage(files, schema.STRUCTS, lambda s, p, t: ((s, p, n) for n in lexing.struct_names(t)))


def fragments(files: DataFrame, options: CloneOptions = CloneOptions()) -> DataFrame:
    names = [x.split()[0] for x in schema.FRAGMENTS.split(", ")][2:]
    small, large = options.min_tokens, options.max_tokens
    rows = lambda s, p, t: ((0, p, *((list(f[n].items()) if n == "bag" else f[n]) for n in names)) for f in lexing.fragments(t, small, large))
    return _stage(files, schema.FRAGMENTS, rows).withColumn("frag_id", F.xxhash64("file", "start_line", "end_line", F.array_join("raw_seq", "\x1f")))


def flag_arguments(files: DataFrame) -> DataFrame:
    return _stage(files, schema.VIOLATIONS, lambda s, p, t: ((r, p, line, m) for r, line, m in lexing.flag_arguments(t)))


def using_namespace(files: DataFrame) -> DataFrame:
    """SF.7"""
    rows = lambda s, p, t: (("SF.7", p, n, "using namespace in a header at file scope") for n in lexing.using_namespaces(t))
    return _stage(files.where(c.is_header(F.col("path"))), schema.VIOLATIONS, rows)


def include_guard(files: DataFrame) -> DataFrame:
    """SF.8"""
    own = files.where(c.is_header(F.col("path")) & ~F.col("path").endswith(".inc"))
    rows = lambda s, p, t: [] if lexing.is_objc(t) or lexing.has_guard(t) else [("SF.8", p, 1, "header has no include guard")]
    return _stage(own, schema.VIOLATIONS, rows)


def loc(files: DataFrame) -> DataFrame:
    """(snapshot, path, loc): newlines of each file."""
    text: Column = F.decode(F.col("content").cast("binary"), "ISO-8859-1")
    return files.select("snapshot", "path", (F.length(text) - F.length(F.translate(text, "\n", ""))).alias("loc"))


# -- comparisons of two snapshots ------------------------------------------------------------------------------------


def bool_accretion(new_fields: DataFrame, old_fields: DataFrame, old_structs: DataFrame) -> DataFrame:
    """DRIFT.BOOL_FIELD_ACCRETION: a struct that existed has more distinct boolean fields than before."""
    key = ["path", "struct"]
    new = new_fields.groupBy(*key, "field").agg(F.min("line").alias("line")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line", "field"))).alias("fields"))
    old = old_fields.groupBy(*key).agg(F.collect_set("field").alias("known"))
    d = new.join(old_structs.select(*key).distinct(), key, "left_semi").join(old, key, "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    d = d.where(F.size("fields") > F.size(known)).withColumn("gained", F.filter("fields", lambda f: ~F.array_contains(known, f["field"])))
    text = F.format_string("struct '%s' accreted %d bool field(s): %s", F.col("struct"), F.size("gained"), F.array_join(F.transform("gained", lambda f: f["field"]), ", "))
    return violation(d, "DRIFT.BOOL_FIELD_ACCRETION", "path", text, F.array_min(F.transform("gained", lambda f: f["line"])))


def match_functions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Every new function with the score of its old self and whether the match is doubtful.

    Same name and arity (equal parameters preferred), nearest line; else same name with another arity; else same
    short name and arity among old functions that are gone.  Windows over equi-joins on the file and short name.
    """
    n = new.select("path", "ordinal", "qualified_name", "param_fp", "arity", "start_line", "score", c.short_name(F.col("qualified_name")).alias("short"))
    o = old.select("path", F.col("ordinal").alias("o_ordinal"), F.col("qualified_name").alias("o_name"), F.col("param_fp").alias("o_fp"), F.col("arity").alias("o_arity"), F.col("start_line").alias("o_line"), F.col("score").alias("o_score"), c.short_name(F.col("qualified_name")).alias("short"))
    still = new.select("path", F.col("qualified_name").alias("o_name"), F.col("arity").alias("o_arity")).distinct().withColumn("alive", F.lit(True))
    o = o.join(still, ["path", "o_name", "o_arity"], "left")
    same, arity = F.col("qualified_name") == F.col("o_name"), F.col("arity") == F.col("o_arity")
    kind = F.when(same & arity & (F.col("param_fp") == F.col("o_fp")), 1).when(same & arity, 2).when(same, 3).when(arity & F.col("alive").isNull(), 4)
    j = n.join(o, ["path", "short"], "left").withColumn("kind", kind)
    by = ["path", "ordinal"]
    each = Window.partitionBy(*by)
    j = j.withColumn("best", F.min("kind").over(each)).withColumn("twins", F.count_if(F.col("kind") == F.col("best")).over(each))
    j = j.withColumn("r", F.row_number().over(each.orderBy(F.when(F.col("kind") == F.col("best"), 0).otherwise(1), F.abs(F.col("o_line") - F.col("start_line")), "o_ordinal"))).where("r = 1")
    hit = F.col("best").isNotNull()
    doubt = hit & ((F.col("best") > 2) | (F.col("twins") > 1))
    return j.select("path", "ordinal", "qualified_name", "short", "param_fp", "arity", "start_line", "score", F.when(hit, F.col("o_score")).alias("old_score"), doubt.alias("doubtful"))


def moved_pool(new: DataFrame, old: DataFrame, least: int = 5) -> DataFrame:
    """Old functions of some weight whose signature is left nowhere in their file with such weight."""
    key = ["path", "short", "arity", "param_fp"]
    s = lambda d: d.withColumn("short", c.short_name(F.col("qualified_name")))
    alive = s(new).where(F.col("score") >= least).select(*key).distinct()
    return s(old).where(F.col("score") >= least).join(alive, key, "left_anti").select("path", "ordinal", "short", "arity", "score")


def _consume(pdf):
    """Greedy one-to-one matching of grown functions with vanished ones of a key, in file order."""
    import pandas as pd

    pool = pdf[pdf.role == "old"].sort_values(["path", "ordinal"]).score.tolist()
    gone = []
    for r in pdf[pdf.role == "new"].sort_values(["path", "ordinal"]).itertuples():
        for k, score in enumerate(pool):
            if abs(score - r.score) <= max(2, r.score // 10):
                del pool[k]
                gone.append((r.path, r.ordinal))
                break
    return pd.DataFrame(gone, columns=["path", "ordinal"])


def complexity_drift(new: DataFrame, old: DataFrame, broken: DataFrame | None = None, threshold: int = 25, soft: int = 5, above: int = 3) -> DataFrame:
    """DRIFT.LOCAL_COMPLEXITY of ``functions`` tables of two snapshots; ``broken(path)`` lists files with unclosed braces."""
    ship(new.sparkSession)
    own = lambda d: d.where(~c.is_test_macro(F.col("qualified_name")))
    new, old = own(new), own(old)
    if broken is not None:
        new, old = (d.join(broken.select("path").distinct(), "path", "left_anti") for d in (new, old))
    m = match_functions(new, old)
    was = F.coalesce("old_score", F.lit(0))
    grown = m.where((was < soft) & (F.col("score") >= soft)).select("short", "arity", "path", "ordinal", "score", F.lit("new").alias("role"))
    gone = moved_pool(new, old, soft).select("short", "arity", "path", "ordinal", "score", F.lit("old").alias("role"))
    pool = grown.unionByName(gone)
    muted = pool.groupBy("short", "arity").applyInPandas(_consume, "path string, ordinal int")
    d = m.join(muted, ["path", "ordinal"], "left_anti")
    delta, sure = F.col("score") - was, ~F.col("doubtful")
    why = F.when(sure & (was < threshold) & (F.col("score") >= threshold), f", crossed {threshold}").when(sure & (was >= threshold) & (delta >= above), f", already above {threshold}").when(delta >= soft, "")
    fresh = F.col("old_score").isNull()
    text = F.when(fresh & (F.col("score") >= threshold), F.format_string(f"new function '%s' has local complexity %d (threshold {threshold})", "qualified_name", "score"))
    text = text.when(~fresh & why.isNotNull(), F.concat(F.format_string("function '%s' grew local complexity from %d to %d (+%d", F.col("qualified_name"), was, F.col("score"), delta), why, F.lit(")")))
    return violation(d.withColumn("m", text).where("m IS NOT NULL"), "DRIFT.LOCAL_COMPLEXITY", "path", F.col("m"), F.col("start_line"))


def complexity_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: sums of growth and of shrinkage over all matched functions."""
    d = F.col("score") - F.coalesce("old_score", F.lit(0))
    return match_functions(new, old).agg(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("positive_delta"), F.coalesce(F.sum(F.when(d < 0, d)), F.lit(0)).alias("negative_delta"))
