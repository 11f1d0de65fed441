"""Structural rules on one graph and comparisons of two; every rule returns ``violations(rule, file, line, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.classify import component_stem, diff_area_of, dir_name, is_inline_impl, is_pch
from codestrata.operators import graph
from codestrata.options import Extras
from codestrata.schema import VIOLATIONS
from codestrata.storage import written


def violation(df: DataFrame, rule: str | Column, file: str | Column, message: Column, line: Column | None = None) -> DataFrame:
    return df.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), (F.col(file) if isinstance(file, str) else file).alias("file"), (F.lit(0) if line is None else line).cast("int").alias("line"), message.alias("message"))


def no_violations(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], VIOLATIONS)


# -- one graph -------------------------------------------------------------------------------------------------------


def god_headers(edges: DataFrame, threshold: int = 50) -> DataFrame:
    hot = graph.fan_in(edges).where((F.col("fan_in") > threshold) & ~is_pch(F.col("path")))
    return violation(hot, "Lakos.GodHeader", "path", F.format_string("fan-in %d exceeds threshold %d", "fan_in", F.lit(threshold)))


def chain_length(edges: DataFrame, nodes: DataFrame | None = None, threshold: int = 10) -> DataFrame:
    deep = graph.depths(edges, nodes).where(F.col("depth") > threshold)
    return violation(deep, "Lakos.ChainLength", "path", F.format_string("include depth %d exceeds threshold %d", "depth", F.lit(threshold)))


def shortest_cycles(inner: DataFrame) -> DataFrame:
    """(scc, message) of components by all their edges ``(scc, src, dst)``: the shortest cycle through the smallest member, ties by path.

    Distances to the member are found by frontiers backwards, all components at once; then the cycle goes from it to the
    smallest next node that is one nearer, so a component's edges never come together.
    """
    e = inner.select("scc", "src", "dst")
    front = e.where("src = scc").select("scc", F.col("scc").alias("path")).distinct()
    levels, ends, k = None, None, 0
    while True:  # nodes that are k edges away; the member itself when its cycle closes, which ends its component
        k += 1
        step = e.join(front.select(F.col("path").alias("dst")), "dst").select("scc", F.col("src").alias("path")).distinct()
        step = written((step if levels is None else step.join(levels, "path", "left_anti")).select("scc", "path", F.lit(k).alias("k")), "level")
        if step.isEmpty():
            break
        levels = step if levels is None else levels.union(step)
        closed = step.where("path = scc").select("scc", F.col("k").alias("n"))
        ends = closed if ends is None else ends.union(closed)
        front = step.join(closed.select("scc"), "scc", "left_anti")
    if ends is None:
        return inner.select("scc", F.col("scc").alias("message")).limit(0)
    walk = written(ends.select("scc", "n", F.col("scc").alias("at"), F.array("scc").alias("walk")), "walk")
    for k in range(1, k):
        near = walk.where(F.col("n") > k).select("scc", F.col("at").alias("src"), (F.col("n") - k).alias("k"))
        nxt = e.join(near, ["scc", "src"]).join(levels.select(F.col("path").alias("dst"), "k"), ["dst", "k"]).groupBy("scc").agg(F.min("dst").alias("next"))
        walk = written(walk.join(nxt, "scc", "left").select("scc", "n", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNull(), F.col("walk")).otherwise(F.concat("walk", F.array("next"))).alias("walk")), "walk", instead_of=walk)
    return walk.select("scc", F.concat(F.lit("cycle: "), F.array_join(F.concat("walk", F.array("scc")), " → ")).alias("message"))


def cycles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """SF.9: components of two or more, unless all their edges are conditional or they are a header and its inline half."""
    c = graph.scc(edges, nodes).where("scc_size > 1")
    c = written(c, "cyclic")
    inner = edges.select("src", "dst", "conditional").join(c.select(F.col("path").alias("src"), "scc"), "src").join(c.select(F.col("path").alias("dst"), F.col("scc").alias("other")), "dst").where("scc = other")
    inner = written(inner.select("scc", "src", "dst", "conditional"), "inner")  # read in every round
    two = c.where("scc_size = 2").groupBy("scc").agg(F.countDistinct(dir_name(F.col("path"))).alias("dirs"), F.countDistinct(component_stem(F.col("path"))).alias("stems"), F.bool_or(is_inline_impl(F.col("path"))).alias("inline"))
    split = two.where("dirs = 1 AND stems = 1 AND inline").select("scc")
    quiet = inner.groupBy("scc").agg(F.bool_and("conditional").alias("all")).where("all").select("scc").union(split)
    quiet = written(quiet, "quiet")
    real = inner.join(quiet, "scc", "left_anti")
    return violation(shortest_cycles(real), "SF.9", "scc", F.col("message"))


# -- two graphs ------------------------------------------------------------------------------------------------------

EDGE = ["src", "dst"]


def added_edges(base: DataFrame, cur: DataFrame) -> DataFrame:
    return cur.join(base.select(*EDGE), EDGE, "left_anti")


def removed_edges(base: DataFrame, cur: DataFrame, cur_nodes: DataFrame | None = None) -> DataFrame:
    """Edges gone although both ends are still there."""
    alive = (graph.nodes_of(cur) if cur_nodes is None else cur_nodes).select("path")
    return base.join(cur.select(*EDGE), EDGE, "left_anti").join(alive.toDF("src"), "src", "left_semi").join(alive.toDF("dst"), "dst", "left_semi").select(*base.columns)


def shortcut_edges(base: DataFrame, cur: DataFrame, base_nodes: DataFrame | None = None) -> DataFrame:
    """DRIFT.1: an edge is new, both its ends are not."""
    old = (graph.nodes_of(base) if base_nodes is None else base_nodes).select("path")
    new = added_edges(base, cur).select(*EDGE).join(old.toDF("src"), "src", "left_semi").join(old.toDF("dst"), "dst", "left_semi")
    return violation(new, "DRIFT.1", "src", F.format_string("shortcut edge: %s -> %s", "src", "dst"))


def grown_cycles(base: DataFrame, cur: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """scc, members, baseline_size, current_size of components that are larger than the old one they share most with.

    Ties go to the old component with the smallest first member.  ``names(id, path)``: where edges are numbers.
    """
    old = graph.scc(base, names=names).where("scc_size > 1").select("path", F.col("scc").alias("old"), F.col("scc_size").alias("old_size"))
    new = written(graph.scc(cur, names=names).where("scc_size > 1"), "cyclic")
    shared = new.join(old, "path").groupBy("scc", "old", "old_size").agg(F.count(F.lit(1)).alias("n"))
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("scc").orderBy(F.desc("n"), "old"))).where("r = 1").select("scc", "old_size")
    whole = new.groupBy("scc", "scc_size").agg(F.array_sort(F.collect_list("path")).alias("members")).join(best, "scc", "left")
    return whole.select("scc", "members", F.coalesce("old_size", F.lit(0)).alias("baseline_size"), F.col("scc_size").alias("current_size")).where("baseline_size < current_size")


def cycle_growth(base: DataFrame, cur: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """DRIFT.2"""
    g = grown_cycles(base, cur, names)
    text = F.when(F.col("baseline_size") == 0, F.format_string("new cycle (%d members): ", "current_size")).otherwise(F.format_string("cycle grew from %d to %d members: ", "baseline_size", "current_size"))
    return violation(g, "DRIFT.2", "scc", F.concat(text, F.array_join("members", " ")))


def drop_renamed(grown: DataFrame, renamed: DataFrame) -> DataFrame:
    """Without the cycles of which every member was renamed."""
    ren = renamed.select("path").distinct().withColumn("hit", F.lit(True))
    kept = grown.select("scc", F.explode("members").alias("path")).join(ren, "path", "left").groupBy("scc").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all")).where("NOT all")
    return grown.join(kept.select("scc"), "scc", "left_semi")


def bidirectional_coupling(base: DataFrame, cur: DataFrame, extras: Extras = Extras()) -> DataFrame:
    """DRIFT.3: two modules now depend on each other through different files and did not before; once a pair."""
    # an edge's modules are its own, so each graph gets them once and the added edges keep them
    own, old = (written(graph.with_modules(g.select(*EDGE), extras), "crossing") for g in (cur, base))
    now, before = (written(g.select("a", "b").distinct(), "pairs") for g in (own, old))
    mutual = before.join(before.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    d = added_edges(old, own)
    d = d.join(now.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").join(mutual, ["a", "b"], "left_anti")
    d = d.join(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), EDGE, "left_anti")
    first = d.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("src", "dst", "a", "b")).alias("e"))
    text = F.format_string("bidirectional module coupling: '%s' <-> '%s' (modules now depend on each other; was not mutual in baseline)", "e.a", "e.b")
    return violation(first, "DRIFT.3", F.col("e.src"), text)


def lateral_dependencies(base: DataFrame, cur: DataFrame, extras: Extras = Extras(), max_added: int = 150, delta: float = 0.10, added: DataFrame | None = None) -> DataFrame:
    """DRIFT.4: first dependency between two peer modules, graded by what the baseline says; silent after mass changes.

    ``added``: the added edges, where a caller has them written already.
    """
    new = written(added_edges(base, cur).select(*EDGE), "added") if added is None else added
    if new.limit(max_added + 1).count() > max_added:
        return no_violations(base)
    pairs = graph.module_pairs(base, extras)
    measured = written(graph.module_metrics(pairs), "measured")
    d = graph.with_modules(new, extras)
    d = d.join(measured.select(F.col("module").alias("b"), F.col("instability").alias("ib")), "b").join(graph.shared_modules(measured).toDF("b"), "b", "left_anti")
    d = d.join(pairs, ["a", "b"], "left_anti")
    first = d.groupBy("a", "b").agg(F.min(F.struct("src", "dst")).alias("e"), F.first("ib").alias("ib"))
    first = first.join(measured.select(F.col("module").alias("a"), F.col("instability").alias("ia")), "a", "left")
    first = first.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back")), ["a", "b"], "left")
    rule = F.when(F.col("back"), "DRIFT.4.CYCLE").when(F.col("ib") > F.coalesce("ia", F.lit(0.5)) + delta, "DRIFT.4.SDP").otherwise("DRIFT.4.NEW")
    what = F.when(rule == "DRIFT.4.CYCLE", F.format_string("lateral dependency creates module cycle ('%s' already depends on '%s' in baseline)", "b", "a"))
    what = what.when(rule == "DRIFT.4.SDP", "lateral dependency violates stability").otherwise("first lateral dependency between peer modules")
    return violation(first, rule, F.col("e.src"), F.format_string("module '%s' -> '%s': %s (via %s -> %s)", F.col("a"), F.col("b"), what, F.col("e.src"), F.col("e.dst")))


def new_god_headers(base: DataFrame, cur: DataFrame, threshold: int = 50) -> DataFrame:
    """path, fan_in over the threshold now and not before."""
    return graph.fan_in(cur).where(F.col("fan_in") > threshold).join(graph.fan_in(base).where(F.col("fan_in") > threshold), "path", "left_anti")


def cross_area_dependencies(base: DataFrame, cur: DataFrame, base_nodes: DataFrame | None = None, cur_nodes: DataFrame | None = None) -> DataFrame:
    """from_area, to_area, edge_count, sample_from, sample_to of area pairs that are new."""
    nodes = (graph.nodes_of(base) if base_nodes is None else base_nodes).select("path").union((graph.nodes_of(cur) if cur_nodes is None else cur_nodes).select("path"))
    top = nodes.where("path LIKE '%/%'").agg((F.countDistinct(F.substring_index("path", "/", 1)) == 1).alias("second"))

    def areas(edges: DataFrame) -> DataFrame:
        order = F.col("ordinal") if "ordinal" in edges.columns else F.lit(0)
        d = edges.crossJoin(F.broadcast(top)).select(*EDGE, order.alias("o"), diff_area_of(F.col("src"), F.col("second")).alias("from_area"), diff_area_of(F.col("dst"), F.col("second")).alias("to_area")).where("from_area <> to_area")
        return d.groupBy("from_area", "to_area").agg(F.count(F.lit(1)).alias("edge_count"), F.min(F.struct("src", "o", "dst")).alias("s"))

    new = areas(cur).join(areas(base), ["from_area", "to_area"], "left_anti")
    return new.select("from_area", "to_area", "edge_count", F.col("s.src").alias("sample_from"), F.col("s.dst").alias("sample_to"))


def metric_growth(base: DataFrame, cur: DataFrame, base_nodes: DataFrame | None = None, cur_nodes: DataFrame | None = None) -> DataFrame:
    """chain_before, chain_after, nccd_before, nccd_after; null where not strictly greater now."""
    a = graph.metrics(base, base_nodes).select(F.col("max_chain_length").alias("c0"), F.col("nccd").alias("n0"))
    b = graph.metrics(cur, cur_nodes).select(F.col("max_chain_length").alias("c1"), F.col("nccd").alias("n1"))
    chain, nccd = F.col("c1") > F.col("c0"), F.col("n1") > F.col("n0")
    return a.crossJoin(b).select(F.when(chain, F.col("c0")).alias("chain_before"), F.when(chain, F.col("c1")).alias("chain_after"), F.when(nccd, F.col("n0")).alias("nccd_before"), F.when(nccd, F.col("n1")).alias("nccd_after"))


def new_violations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Violations that are not in a baseline, by rule, file and line."""
    return found.join(known.select("rule", "file", "line"), ["rule", "file", "line"], "left_anti").select(*found.columns)


# -- module rules of the configuration (documented semantics; nothing to compare with) ------------------------------


def membership(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module) by glob: ``**`` any path, ``*`` within a segment."""
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"([.+^$(){}|\[\]])", r"\\$1"), r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    m = modules.select(F.col("name").alias("module"), F.concat(F.lit("^"), rx, F.lit("$")).alias("rx"))
    return nodes.join(F.broadcast(m), F.expr("path RLIKE rx")).select("path", "module").distinct()


def module_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    return edges.select(*EDGE).join(members.toDF("src", "ma"), "src").join(members.toDF("dst", "mb"), "dst").where("ma <> mb")


def forbidden(edges: DataFrame, members: DataFrame, frm: list[str], to: list[str], name: str = "forbidden") -> DataFrame:
    bad = module_edges(edges, members).where(F.col("ma").isin(frm) & F.col("mb").isin(to))
    return violation(bad, "MODULE.FORBIDDEN", "src", F.format_string(f"{name}: %s must not depend on %s (via %s)", "ma", "mb", "dst"))


def independence(edges: DataFrame, members: DataFrame, modules: list[str], name: str = "independence") -> DataFrame:
    bad = module_edges(edges, members).where(F.col("ma").isin(modules) & F.col("mb").isin(modules))
    return violation(bad, "MODULE.INDEPENDENCE", "src", F.format_string(f"{name}: %s and %s must be independent (via %s)", "ma", "mb", "dst"))


def layers(edges: DataFrame, members: DataFrame, order: list[str], name: str = "layers") -> DataFrame:
    """A module may depend only on modules after it."""
    at = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    bad = module_edges(edges, members).where((at("ma") > 0) & (at("mb") > 0) & (at("mb") < at("ma")))
    return violation(bad, "MODULE.LAYERS", "src", F.format_string(f"{name}: %s must not depend on %s above it (via %s)", "ma", "mb", "dst"))
