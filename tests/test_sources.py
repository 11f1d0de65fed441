"""Trees from disk and git, the entry points over them, baselines and reports."""

import json
import subprocess

import pytest

from codestrata.__main__ import run
from codestrata.options import Options, Thresholds
from codestrata.plans import analyses
from codestrata.sources import disk, git


def _run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write = lambda p, s: ((root / p).parent.mkdir(parents=True, exist_ok=True), (root / p).write_text(s))
    _run(root, "init", "-q")
    write("src/a/a.h", '#pragma once\n#include "b/b.h"\n')
    write("src/b/b.h", "#pragma once\n")
    write("build/skip.h", "int x;\n")
    write("notes.txt", "no source\n")
    _run(root, "add", "-A", "-f")
    _run(root, "commit", "-qm", "start")
    write("src/b/b.h", '#pragma once\n#include "a/a.h"\nint x; // FIXME soon\n')
    _run(root, "commit", "-qam", "fix crash")
    return str(root)


def test_trees_agree(spark, repo):
    on_disk = {(r.path, bytes(r.content)) for r in disk.tree(spark, repo).collect()}
    in_git = {(r.path, bytes(r.content)) for r in git.tree(spark, repo, "HEAD").collect()}
    assert on_disk == in_git
    assert {p for p, _ in on_disk} == {"src/a/a.h", "src/b/b.h"}


def test_check_drift_and_reports(spark, repo, tmp_path):
    base, cur = git.tree(spark, repo, "HEAD~1", "base"), git.tree(spark, repo, "HEAD")
    g = analyses.graph_of(base)
    disk.save_graph(g.nodes, g.edges, str(tmp_path / "graph.yml"))
    nodes, edges = disk.load_graph(spark, str(tmp_path / "graph.yml"))
    assert [tuple(r) for r in edges.select("src", "dst").collect()] == [("src/a/a.h", "src/b/b.h")]
    found = analyses.check(cur, baseline=analyses.Graph(nodes, edges))
    rules = sorted(r.rule for r in found.collect())
    assert rules[:2] == ["DRIFT.1", "DRIFT.2"] and "SF.9" in rules
    assert analyses.exit_code(found) == 1
    report = "".join(analyses.as_json(found, "drift"))
    assert json.loads(report)["gate"] == "fail"
    (tmp_path / "known.json").write_text(report)
    from codestrata.operators.drift import new_violations

    assert new_violations(found, disk.load_violations(spark, str(tmp_path / "known.json"))).isEmpty()
    assert any("[SF.9]" in x for x in analyses.as_text(found)) and any(x.startswith("- **SF.9**") for x in analyses.as_markdown(found))


def test_diff_and_history(spark, repo):
    a, b = git.parse_revspec("HEAD~1..HEAD")
    report = analyses.diff(git.tree(spark, repo, a, "base"), git.tree(spark, repo, b), git.diff_lines(spark, repo, a, b), git.numstat(spark, repo, a, b), git.renamed(spark, repo, a, b))
    assert analyses.diff_gates(report)
    assert report["added_edges"].count() == 1
    assert [(r.rule, r.file, r.line) for r in report["advisory"].collect()] == [("SATD.2", "src/b/b.h", 3)]
    text = list(analyses.diff_text(report))
    assert text[:4] == ["added_edges:    1", "removed_edges:  0", "grown_cycles:   1", "new_area_deps:  1"] and text[-1].startswith("\ngate: fail")
    assert "  + src/b/b.h  ->  src/a/a.h" in text and "  * size 0 -> 2 (2 members)" in text
    j = json.loads("".join(analyses.diff_json(report, a, b)))
    assert (j["version"], j["gate"], j["baseline_ref"], j["gating"]["grown_cycles"][0]["members"]) == (1, "fail", a, ["src/a/a.h", "src/b/b.h"])
    assert j["advisory"]["added_edges"] == [{"from": "src/b/b.h", "to": "src/a/a.h"}] and [v["rule"] for v in j["advisory"]["violations"]] == ["SATD.2"]
    bulk = analyses.diff(git.tree(spark, repo, a, "base"), git.tree(spark, repo, b), git.diff_lines(spark, repo, a, b), git.numstat(spark, repo, a, b), git.renamed(spark, repo, a, b), Options(thresholds=Thresholds(mass_added_lines=1)))
    assert bulk["skipped_added_lines"] == 2 and not analyses.diff_gates(bulk) and bulk["advisory"].count() == 1
    assert any("bulk import" in x for x in analyses.diff_text(bulk)) and json.loads("".join(analyses.diff_json(bulk, a, b)))["gate"] == "ok"
    commits, changes = git.history(spark, repo)
    assert [r.subject for r in commits.orderBy("pos").collect()] == ["fix crash", "start"]
    assert changes.where("pos = 0").count() == 1


@pytest.mark.parametrize("spec", ["a...b", "..b", "a..", "", "-x"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        git.parse_revspec(spec)


def test_command_line_and_exit_codes(spark, repo, tmp_path):
    import io

    def call(*args):
        out = io.StringIO()
        return run(list(args), spark, out), out.getvalue()

    code, text = call(repo)
    assert code == 1 and "[SF.9]" in text
    known = str(tmp_path / "known.json")
    assert call("--save-baseline", known, repo)[0] == 0
    code, text = call("--baseline", known, repo)
    assert code == 0 and "suppressed: 1 known" in text
    graph = str(tmp_path / "graph.yml")
    assert call("--save-graph-baseline", graph, repo)[0] == 0
    code, text = call("--drift-baseline", graph, "--format", "json", repo)
    assert code == 1 and json.loads(text)["summary"]["by_rule"] == {"SF.9": 1}
    code, text = call("--scan", repo)
    assert code == 0 and "directives:  2 (quote=2, angle=0)" in text
    code, text = call("--graph", repo)
    assert code == 1 and "largest_scc:    2" in text and "nodes:          2" in text
    assert call("--history", repo) == (0, "queried 2 commits, found 0 god-file growth candidate(s)\n")
    assert call("--diff", "HEAD..HEAD", repo)[0] == 0 and "graphs were not built" in call("--diff", "HEAD~1..HEAD~1", repo)[1]
    conf = tmp_path / "c.yml"
    conf.write_text("version: 1\nmodules:\n  a:\n    paths: [src/a/**]\n  b:\n    paths: [src/b/**]\nrules:\n  - {}\n")
    assert call("--config", str(conf), repo)[0] == 2
    conf.write_text(conf.read_text().replace("  - {}\n", "  - type: independence\n    name: apart\n    modules: [a, b]\n"))
    code, text = call("--config", str(conf), "--format", "md", repo)
    assert code == 1 and "MODULE.INDEPENDENCE" in text
    for bad in (["/no/such"], ["--diff", "a...b", repo], ["--diff", "nope..HEAD", repo], ["--drift-baseline", str(conf), repo]):
        assert call(*bad)[0] == 2
    with pytest.raises(SystemExit) as e:
        call("--format", "xml", repo)
    assert e.value.code == 2


@pytest.mark.parametrize("text, kind", [("a\n", "parse_error"), ("format_version: 2\nnodes: []\nedges: []\n", "unknown_version"), ("nodes: []\nedges: []\n", "missing_field"), ("format_version: 1\nnodes: [a, a]\nedges: []\n", "malformed_schema"), ("format_version: 1\nnodes: [a]\nedges:\n  - [0, 1]\n", "malformed_schema")])
def test_broken_graph_baselines(spark, tmp_path, text, kind):
    (tmp_path / "g.yml").write_text(text)
    with pytest.raises(disk.BaselineError) as e:
        disk.load_graph(spark, str(tmp_path / "g.yml"))
    assert e.value.kind == kind


def test_ground_truth(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# repo\nr1\tabc\tTP\tnone\tclone\n\nr2\tdef\tFP\nr3  x  FP\tidiom clone more\n")
    assert [tuple(r) for r in disk.load_ground_truth(spark, str(tmp_path / "t.tsv")).collect()] == [("r1", "abc", "TP", "none", "clone"), ("r3", "x", "FP", "idiom", "clone")]


def test_a_verdict_follows_the_new_tree(spark):
    body = "int f(int a) {\n" + "".join(f"  if (a > {i}) {{ if (a) {{ if (a < {i}) {{ a++; }} }} }}\n" for i in range(6)) + "  return a;\n}\n"
    files = lambda snap, text: spark.createDataFrame([(snap, "src/x/a.cpp", text.encode()), (snap, "src/x/b.cpp", b"int b;\n"), (snap, "src/x/c.cpp", b"int c;\n")], "snapshot string, path string, content binary")
    none = spark.createDataFrame([], "side string, path string, line int, text string")
    r = analyses.diff(files("base", "// Permission is hereby granted\n" + body), files("cur", body), none, spark.createDataFrame([("src/x/a.cpp", 0, 1)], "path string, added int, removed int"), spark.createDataFrame([], "path string"))
    assert r["advisory"].count() == 0  # the function was there before, in a file that did not count as own code
