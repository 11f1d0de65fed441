"""Command line.  Exit codes: 0 nothing gates, 1 a gate failed, 2 the input is wrong, 3 an error of the program."""

from __future__ import annotations

import argparse
import os
import sys

MODES = ("scan", "graph", "duplication", "history")


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("codestrata", description="Source-drift analytics; without an option: check the tree at PATH.")
    p.add_argument("path", nargs="?", default=".")
    for mode in MODES:
        p.add_argument(f"--{mode}", action="store_true", help=f"counters of the {mode} stage")
    p.add_argument("--diff", metavar="A..B", help="regression report of two revisions, or of one and the work tree")
    p.add_argument("--drift-baseline", metavar="FILE", help="also compare with a stored graph")
    p.add_argument("--save-graph-baseline", metavar="FILE")
    p.add_argument("--baseline", metavar="FILE", help="leave out known violations")
    p.add_argument("--save-baseline", metavar="FILE")
    p.add_argument("--config", metavar="FILE")
    p.add_argument("--format", choices=("text", "json", "md"), default="text")
    return p.parse_args(argv)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(argv: list[str], spark=None, out=None) -> int:
    a, out = _arguments(argv), out or sys.stdout
    say = lambda *lines: [print(x, file=out) for x in lines]
    from codestrata import config
    from codestrata.operators import drift
    from codestrata.plans import analyses
    from codestrata.sources import disk, git

    try:
        if not os.path.isdir(a.path):
            raise ValueError(f"not a directory: {a.path}")
        conf = config.load(a.config) if a.config else config.discover(a.path)
        spark = spark or _session()
        if a.diff:
            return _diff(a, conf, spark, out)
        files = disk.tree(spark, a.path)
        if a.scan:
            say(*analyses.scan_text(files))
            return 0
        if a.graph:
            text, cycles = analyses.graph_text(files, conf.options)
            say(*text)
            return int(cycles > 0)
        if a.duplication:
            say(*analyses.duplication_text(files, conf.options))
            return 0
        if a.history:
            say(*analyses.history_text(files, *git.history(spark, git.find_root(a.path)), conf.options))
            return 0
        g = analyses.graph_of(files, conf.options)
        if a.save_graph_baseline:
            disk.save_graph(g.nodes, g.edges, a.save_graph_baseline)
            return 0
        baseline = analyses.Graph(*disk.load_graph(spark, a.drift_baseline)) if a.drift_baseline else None
        found = analyses.check(files, conf.options, baseline, g)
        modules = analyses.module_rules(g.edges, g.nodes, conf)
        found = analyses.written(found if modules is None else found.unionByName(modules), "violations")
        if a.save_baseline:
            say(f"saved {analyses.save_violations(found, a.save_baseline)} violation(s)")
            return 0
        mode, total = "drift" if baseline else "check", found.count()
        if a.baseline:
            found = drift.new_violations(found, disk.load_violations(spark, a.baseline))
        if a.format == "json":
            for piece in analyses.as_json(found, mode):
                out.write(piece)
            out.write("\n")
        else:
            say(*(analyses.as_text(found) if a.format == "text" else analyses.as_markdown(found)))
            if a.baseline and total > found.count():
                say(f"suppressed: {total - found.count()} known violation(s)")
        return analyses.exit_code(found, mode)
    except (ValueError, OSError, KeyError) as e:
        print(f"codestrata: {e}", file=sys.stderr)
        return 2


def _diff(a, conf, spark, out) -> int:
    from codestrata.plans import analyses
    from codestrata.sources import disk, git

    base, cur = git.parse_revspec(a.diff)
    root = git.find_root(a.path)
    git.git(root, "rev-parse", "--verify", f"{base}^{{commit}}")
    if git.changed(spark, root, base, cur).isEmpty():  # then no graph can have changed
        if a.format == "json":
            empty = '{"version": 1, "baseline_ref": %s, "current_ref": %s, "gate": "ok", "gating": {"grown_cycles": [], "new_god_headers": []}, "advisory": {"added_edges": [], "removed_edges": [], "new_cross_area_dependencies": [], "chain_length_grown": null, "nccd_delta": null, "complexity_skipped_added_lines": 0, "rename_suppressed_cycles": 0, "violations": []}}'
            import json

            print(empty % (json.dumps(base), json.dumps(cur or "worktree")), file=out)
        else:
            print(f"baseline_ref:   {base}\ncurrent_ref:    {cur or 'worktree'}\nno C/C++ files changed; graphs were not built", file=out)
        return 0
    new = disk.tree(spark, root) if cur is None else git.tree(spark, root, cur)
    r = analyses.diff(git.tree(spark, root, base, "base"), new, git.diff_lines(spark, root, base, cur), git.numstat(spark, root, base, cur), git.renamed(spark, root, base, cur), conf.options)
    if a.format == "json":
        for piece in analyses.diff_json(r, base, cur or "worktree"):
            out.write(piece)
        out.write("\n")
    else:
        for line in analyses.diff_text(r) if a.format == "text" else analyses.as_markdown(r["advisory"]):
            print(line, file=out)
    return int(analyses.diff_gates(r))


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except Exception as e:
        print(f"codestrata: internal error: {e}", file=sys.stderr)
        sys.exit(3)


if __name__ == "__main__":
    main()
