"""The entry points: check, drift, diff, duplication and history over files, and their reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.classify import GATES
from codestrata.operators import clones, code, drift, graph, history, lines, resolve
from codestrata.options import Options
from codestrata.storage import written


@dataclass
class Graph:
    """``own`` and ``resolved``: the files that it was built from and their includes, where it was built from files."""

    nodes: DataFrame
    edges: DataFrame
    own: DataFrame | None = None
    resolved: DataFrame | None = None


def graph_of(files: DataFrame, options: Options = Options()) -> Graph:
    """Include graph of one snapshot's own files."""
    return graph_of_own(code.authored(files, options.extras).where("authored").drop("authored"))


def graph_of_own(own: DataFrame) -> Graph:
    own = written(own.select("snapshot", "path", "content"), "own")
    r = written(resolve.resolve(code.includes(own), own.select("snapshot", "path")), "resolved")
    return Graph(own.select("path").distinct(), written(resolve.edges(r).drop("snapshot"), "edges"), own, r)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Rule:
    """A check: ``find(graph, options, baseline)`` gives violations.  Further ones may be added to :data:`RULES`."""

    ids: tuple[str, ...]
    find: Callable[[Graph, Options, Graph | None], DataFrame]
    needs_baseline: bool = False


#: the rules of one snapshot, then those that compare it with a stored graph, in the order of the report
RULES: list[Rule] = [
    Rule(("SF.9",), lambda g, o, b: drift.cycles(g.edges, g.nodes)),
    Rule(("SF.7",), lambda g, o, b: code.using_namespace(g.own)),
    Rule(("SF.8",), lambda g, o, b: code.include_guard(g.own)),
    Rule(("Lakos.GodHeader",), lambda g, o, b: drift.god_headers(g.edges, o.thresholds.god_header_fan_in)),
    Rule(("Lakos.ChainLength",), lambda g, o, b: drift.chain_length(g.edges, g.nodes, o.thresholds.chain_length)),
    Rule(("DRIFT.1",), lambda g, o, b: drift.shortcut_edges(b.edges, g.edges, b.nodes), True),
    Rule(("DRIFT.2",), lambda g, o, b: drift.cycle_growth(b.edges, g.edges), True),
    Rule(("DRIFT.3",), lambda g, o, b: drift.bidirectional_coupling(b.edges, g.edges, o.extras), True),
    Rule(("DRIFT.4.CYCLE", "DRIFT.4.SDP", "DRIFT.4.NEW"), lambda g, o, b: drift.lateral_dependencies(b.edges, g.edges, o.extras, o.thresholds.lateral_max_added_edges), True),
]


def check(files: DataFrame, options: Options = Options(), baseline: Graph | None = None, graph: Graph | None = None) -> DataFrame:
    """The rules of one snapshot, and with a baseline graph those of drift."""
    g = graph or graph_of(files, options)
    return _all(*(r.find(g, options, baseline) for r in RULES if baseline is not None or not r.needs_baseline))


def module_rules(edges: DataFrame, nodes: DataFrame, config) -> DataFrame | None:
    """The rules between modules of a configuration (documented semantics; advisory)."""
    if not config.rules:
        return None
    globs = edges.sparkSession.createDataFrame([(m, g) for m, paths in config.modules.items() for g in paths], "name string, glob string")
    members = written(drift.membership(nodes, globs), "members")
    how = {"layers": lambda r: drift.layers(edges, members, list(r.members), r.name), "independence": lambda r: drift.independence(edges, members, list(r.members), r.name), "forbidden": lambda r: drift.forbidden(edges, members, list(r.members), list(r.targets), r.name)}
    return _all(*(how[r.type](r) for r in config.rules))


def diff(base: DataFrame, cur: DataFrame, diff_lines: DataFrame, numstat: DataFrame, renamed: DataFrame, options: Options = Options()) -> dict:
    """The regression report of two snapshots: structural parts by name, ``advisory`` violations, and two counts.

    After a bulk import, of more than ``mass_added_lines`` lines, neither graphs nor snapshots are looked at:
    ``skipped_added_lines`` is their number then, else 0.
    """
    t, x, spark = options.thresholds, options.extras, base.sparkSession
    d = written(diff_lines, "diff")
    added, deleted = d.where("side = '+'").select("path", "line", "text"), d.where("side = '-'").select("path", "line")
    found = [lines.satd(added, x), lines.test_co_evolution(numstat, x)]
    total = numstat.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("n")).first().n
    if total > t.mass_added_lines:
        empty = lambda s: spark.createDataFrame([], s)
        return {
            "added_edges": empty("src string, dst string"), "removed_edges": empty("src string, dst string"), "grown_cycles": empty("scc string, members array<string>, baseline_size int, current_size int"),
            "new_god_headers": empty("path string, fan_in long"), "new_cross_area_dependencies": empty("from_area string, to_area string, edge_count long, sample_from string, sample_to string"),
            "metric_growth": empty("chain_before long, chain_after long, nccd_before double, nccd_after double"), "advisory": _all(*found), "skipped_added_lines": total, "rename_suppressed": 0,
        }
    verdict = lambda f, name: written(code.authored(f, x), name)
    all_old, all_new = verdict(base, "old"), verdict(cur, "new")
    old, new = all_old.where("authored"), all_new.where("authored")
    a, b = graph_of_own(old), graph_of_own(new)
    # a file is own code by what it is now; if it is gone, by what it was
    gone = old.join(all_new.select("path"), "path", "left_anti")
    before = all_old.join(new.select("path").union(gone.select("path")), "path", "left_semi").select(*base.columns)
    broken = code.unclosed(before).unionByName(code.unclosed(new))
    found += [
        code.complexity_drift(written(code.functions(new), "functions"), written(code.functions(before), "functions"), broken),
        code.bool_accretion(code.bool_fields(new), code.bool_fields(before), code.structs(before)),
        lines.on_lines(code.flag_arguments(new), added),
    ]
    if new.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).first().n <= t.duplication_max_bytes:
        found.append(clones.new_clones(written(code.fragments(new), "fragments"), written(code.fragments(old), "fragments"), added, deleted, extras=x))
    cycles = written(drift.grown_cycles(a.edges, b.edges), "grown")
    kept = drift.drop_renamed(cycles, renamed)
    return {
        "added_edges": drift.added_edges(a.edges, b.edges), "removed_edges": drift.removed_edges(a.edges, b.edges, b.nodes), "grown_cycles": kept,
        "new_god_headers": drift.new_god_headers(a.edges, b.edges, t.god_header_fan_in), "new_cross_area_dependencies": drift.cross_area_dependencies(a.edges, b.edges, a.nodes, b.nodes),
        "metric_growth": drift.metric_growth(a.edges, b.edges, a.nodes, b.nodes), "advisory": _all(*found), "skipped_added_lines": 0, "rename_suppressed": cycles.count() - kept.count(),
    }


def diff_gates(report: dict[str, DataFrame]) -> bool:
    return not report["grown_cycles"].isEmpty() or not report["new_god_headers"].isEmpty()


def duplication(files: DataFrame, options: Options = Options()) -> DataFrame:
    own = code.authored(files, options.extras).where("authored")
    return clones.report(clones.clone_pairs(written(code.fragments(own, options.clones), "fragments"), options.clones, options.extras))


def history_findings(files: DataFrame, commits: DataFrame, changes: DataFrame, options: Options = Options()) -> DataFrame:
    loc = code.loc(code.authored(files, options.extras).where("authored")).select("path", "loc")
    return _all(history.god_file_growth(changes, loc, options.extras, options.newest_first), history.defect_attractors(commits, changes, options.extras))


def graph_summary(files: DataFrame, options: Options = Options()) -> DataFrame:
    g = graph_of(files, options)
    return graph.metrics(g.edges, g.nodes).crossJoin(graph.scc_stats(g.edges, g.nodes))


# -- reports -----------------------------------------------------------------------------------------------------------


def _rows(found: DataFrame):
    return found.orderBy("rule", "file", "line", "message").toLocalIterator()


def exit_code(found: DataFrame, mode: str = "check") -> int:
    rules = [*GATES["check"], *(GATES["drift"] if mode == "drift" else [])]
    return int(not found.where(F.col("rule").isin(rules)).isEmpty())


def as_text(found: DataFrame):
    """Lines ``file[:line]: [rule] message``, then a count for each rule."""
    for r in _rows(found):
        yield f"{r.file}{f':{r.line}' if r.line else ''}: [{r.rule}] {r.message}"
    for r in found.groupBy("rule").count().orderBy("rule").toLocalIterator():
        yield f"{r.rule}: {r['count']}"


def as_json(found: DataFrame, mode: str = "check"):
    """Pieces of the JSON report, row by row."""
    gating = {*GATES["check"], *(GATES["drift"] if mode == "drift" else [])}
    by_rule = {r.rule: r["count"] for r in found.groupBy("rule").count().orderBy("rule").collect()}  # a row by rule
    yield json.dumps({"version": 1, "gate": "fail" if gating & by_rule.keys() else "pass"})[:-1] + ', "violations": ['
    for k, r in enumerate(_rows(found)):
        yield (", " if k else "") + json.dumps({"rule": r.rule, "file": r.file, "line": r.line, "message": r.message, "disposition": "gate" if r.rule in gating else "advisory"}, ensure_ascii=False)
    yield '], "summary": ' + json.dumps({"total": sum(by_rule.values()), "by_rule": by_rule}) + "}"


def save_violations(found: DataFrame, path: str) -> int:
    """The baseline of known violations, one to a line; their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "version": 1,\n  "violations": [')
        for n, r in enumerate(_rows(found), 1):
            f.write(("," if n > 1 else "") + "\n    " + json.dumps({"rule": r.rule, "file": r.file, "line": r.line, "message": r.message}, ensure_ascii=False))
        f.write("\n  ]\n}\n")
    return n


def _growth(report: dict) -> tuple:
    g = report["metric_growth"].first()
    return (None, None) if g is None else (None if g.chain_before is None else (g.chain_before, g.chain_after), None if g.nccd_before is None else g.nccd_after - g.nccd_before)


def diff_text(report: dict):
    """Lines of the regression report: counts, then each part that has anything."""
    parts = {"added_edges": ["src", "dst"], "removed_edges": ["src", "dst"], "grown_cycles": ["scc"], "new_cross_area_dependencies": ["from_area", "to_area"]}
    held = {k: report[k].orderBy(*order) for k, order in parts.items()}
    for k, d in held.items():
        yield f"{k.replace('new_cross_area_dependencies', 'new_area_deps') + ':':16}{d.count()}"
    for k, sign in (("added_edges", "+"), ("removed_edges", "-")):
        for i, r in enumerate(held[k].toLocalIterator()):
            if not i:
                yield f"\n{k.removesuffix('_edges')} (advisory):"
            yield f"  {sign} {r.src}  ->  {r.dst}"
    for i, r in enumerate(held["grown_cycles"].toLocalIterator()):
        if not i:
            yield "\ngrown_cycles (gating):"
        yield f"  * size {r.baseline_size} -> {r.current_size} ({len(r.members)} members)"
        yield from (f"      {m}" for m in r.members)
    for i, r in enumerate(held["new_cross_area_dependencies"].toLocalIterator()):
        if not i:
            yield "\nnew_cross_area_dependencies (advisory):"
        yield f"  * {r.from_area} -> {r.to_area} ({r.edge_count} edge{'s' if r.edge_count != 1 else ''})"
        yield f"      e.g. {r.sample_from}  ->  {r.sample_to}"
    chain, nccd = _growth(report)
    if chain:
        yield f"\nchain_length_grown (advisory): {chain[0]} -> {chain[1]}"
    for i, r in enumerate(report["new_god_headers"].orderBy("path").toLocalIterator()):
        if not i:
            yield "\nnew_god_headers (gating):"
        yield f"  ! {r.path}"
    if nccd:
        yield f"\nnccd_grown (advisory): +{nccd:g}"
    if report["skipped_added_lines"]:
        yield f"\nbulk import of {report['skipped_added_lines']} added lines: graphs and snapshots were not compared"
    for i, r in enumerate(_rows(report["advisory"])):
        if not i:
            yield "\nfindings on changed code (advisory):"
        yield f"  {r.file}{f':{r.line}' if r.line else ''}: {r.rule} — {r.message}"
    yield f"\ngate: {'fail' if diff_gates(report) else 'ok'} (gating: cycles, god-headers)"


def diff_json(report: dict, base: str, cur: str):
    """Pieces of the regression report as JSON, version 1."""
    def listed(df: DataFrame, order: list[str], row):
        yield "["
        for k, r in enumerate(df.orderBy(*order).toLocalIterator()):
            yield (", " if k else "") + json.dumps(row(r), ensure_ascii=False)
        yield "]"

    edge = lambda r: {"from": r.src, "to": r.dst}
    chain, nccd = _growth(report)
    yield json.dumps({"version": 1, "baseline_ref": base, "current_ref": cur, "gate": "fail" if diff_gates(report) else "ok"}, ensure_ascii=False)[:-1] + ', "gating": {"grown_cycles": '
    yield from listed(report["grown_cycles"], ["scc"], lambda r: {"baseline_size": r.baseline_size, "current_size": r.current_size, "members": r.members})
    yield ', "new_god_headers": '
    yield from listed(report["new_god_headers"], ["path"], lambda r: r.path)
    yield '}, "advisory": {"added_edges": '
    yield from listed(report["added_edges"], ["src", "dst"], edge)
    yield ', "removed_edges": '
    yield from listed(report["removed_edges"], ["src", "dst"], edge)
    yield ', "new_cross_area_dependencies": '
    yield from listed(report["new_cross_area_dependencies"], ["from_area", "to_area"], lambda r: r.asDict())
    yield ', ' + json.dumps({"chain_length_grown": chain and {"baseline": chain[0], "current": chain[1]}, "nccd_delta": nccd, "complexity_skipped_added_lines": report["skipped_added_lines"], "rename_suppressed_cycles": report["rename_suppressed"]})[1:-1] + ', "violations": '
    yield from listed(report["advisory"], ["rule", "file", "line", "message"], lambda r: r.asDict())
    yield "}}"


# -- counters of single stages -----------------------------------------------------------------------------------------


def scan_text(files: DataFrame):
    d = code.includes(files).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "quote").alias("q"), F.count_if(F.col("kind") == "angle").alias("a")).first()
    yield f"files:       {files.count()}"
    yield f"directives:  {d.n} (quote={d.q}, angle={d.a})"
    yield f"diagnostics: {code.include_diagnostics(files).count()}"


def graph_text(files: DataFrame, options: Options = Options()) -> tuple[list[str], int]:
    """Lines, and the number of cycles."""
    g = graph_of(files, options)
    n = {r.resolution: r.n for r in resolve.counters(g.resolved).collect()}
    s, cycles = graph.scc_stats(g.edges, g.nodes).first(), drift.cycles(g.edges, g.nodes).count()
    rows = {"nodes": g.nodes.count(), "edges": g.edges.count(), **{k: n.get(k, 0) for k in ("external", "unresolved", "ambiguous")}, "macro_includes": code.include_diagnostics(g.own).count(), "sccs_total": s.total, "sccs_cyclic": s.cyclic, "sf9_cycles": cycles, "largest_scc": s.largest}
    return [f"{k + ':':16}{v}" for k, v in rows.items()], cycles


def duplication_text(files: DataFrame, options: Options = Options()):
    own = code.authored(files, options.extras).where("authored")
    f = written(code.fragments(own, options.clones), "fragments")
    pairs = written(clones.report(clones.clone_pairs(f, options.clones, options.extras)), "report")
    yield f"scanned {own.count()} files, {f.count()} fragments, {clones.candidates(f, options.clones).count()} candidate pairs"
    yield f"reported {pairs.count()} pairs above threshold"
    for r in pairs.orderBy(F.desc("weighted"), "file_a", "start_a", "file_b", "start_b").toLocalIterator():
        yield f"  {r.file_a}:{r.start_a}-{r.end_a}  <->  {r.file_b}:{r.start_b}-{r.end_b}  ({r.type}, weighted={r.weighted:g}, line={r.line:g})"


def history_text(files: DataFrame, commits: DataFrame, changes: DataFrame, options: Options = Options()):
    found = written(history_findings(files, commits, changes, options), "findings")
    yield f"queried {commits.count()} commits, found {found.where('rule LIKE \'SIZE.1%\'').count()} god-file growth candidate(s)"
    touches = F.regexp_extract("message", r"^(\d+) fix-like", 1).try_cast("int")
    for r in found.orderBy(F.desc("rule"), F.desc_nulls_last(touches), "file").toLocalIterator():
        yield f"{r.file}: [{r.rule}] {r.message}"


def as_markdown(found: DataFrame, link: str = ""):
    """A list item for each violation; ``link`` is the address that ``/path#Lline`` is put behind."""
    for r in _rows(found):
        place = f"{r.file}{f':{r.line}' if r.line else ''}"
        where = f"[`{place}`]({link}/{r.file}{f'#L{r.line}' if r.line else ''})" if link else f"`{place}`"
        yield f"- **{r.rule}** {where}: {r.message}"
