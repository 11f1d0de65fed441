"""Steps that must not gather all rows in one task, pair what does not match, or lose a row while they avoid it."""

import os
import random
import re

import pytest
from compare import SF_DIR, TABLES, assert_same
from pyspark.sql import functions as F

from codestrata.functions.classify import normalise_path
from codestrata.operators import drift, graph, lines
from codestrata.queries import Q, SQL, edge_table, edges_by_number, history_tables
from codestrata.storage import numbered


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("width", [1, 8, 4096])
def test_spans_meet_no_line_that_they_do_not_need(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice("abc"), s := rng.randrange(-50, 300), s + rng.randrange(-2, 40), i) for i in range(400)] + [("a", -100, 1000, 400), ("z", 0, 9, 401), (None, 0, 9, 402), ("a", None, 9, 403), ("b", 3, None, 404)]
    spans += [spans[0], spans[0]]  # copies stay
    at = [(rng.choice("ab"), rng.randrange(-50, 300)) for _ in range(40)] + [("c", 299), ("c", -50), (None, 3), ("a", None)]
    want = sorted(x for x in spans if None not in x and any(p == x[0] and n is not None and x[1] <= n <= x[2] for p, n in at))
    df = lines.touching(spark.createDataFrame(spans, "path string, start_line int, end_line int, id int"), spark.createDataFrame(at, "path string, line int"), width)
    assert df.columns == ["path", "start_line", "end_line", "id"] and sorted(map(tuple, df.collect())) == want


def test_history_is_numbered_without_a_window_over_all(spark):
    commits, changes = history_tables(spark, SF_DIR)
    assert "Window" not in plan(commits) and "Window" not in plan(changes)
    pos = sorted(r.pos for r in commits.select("pos").collect())
    assert pos == list(range(len(pos))) and len(pos) == changes.count()


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.random(), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "x double, i long").repartition(7)
    assert [r.i for r in sorted(numbered(d, "x").collect(), key=lambda r: r.k)] == [i for _, i in sorted(rows)]
    assert numbered(d.limit(0), "x").collect() == []


def test_edges_are_merged_in_one_aggregation(spark):
    assert edge_table(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_condensation_takes_a_large_component_as_one(spark):
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(200):03}", f"n{rng.randrange(200):03}") for _ in range(900)} | {("a", "n000"), ("n001", "z"), ("z", "zz")}
    e = spark.createDataFrame(sorted(x for x in edges if x[0] != x[1]), "src string, dst string").coalesce(1)
    left, _ = graph.contracted(graph.hashed(e)[0])
    assert left.count() < 60
    want = {r.path: (r.scc, r.scc_size, r.depth, r.reach) for r in graph._kernel(e, None, True).collect()}
    for kernel_edges in (0, e.count() - 1):  # levels and bitmaps, and the kernel over the condensation
        got = graph._measured(e, None, kernel_edges, 1000)
        assert {r.path: (r.depth, r.reach) for r in got.collect()} == {p: w[2:] for p, w in want.items()}
    assert {r.path: (r.scc, r.scc_size) for r in graph.condensed(e, None, 100)[0].collect()} == {p: w[:2] for p, w in want.items()}


def test_a_large_core_is_taken_without_shuffling_edges(spark, monkeypatch):  # F17
    rng = random.Random(17)
    n = 8000  # of 32,768 bits a fifth of the nodes share one, so a second core is left after the first
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(6 * n)} | {(f"t{i}", f"n{i}") for i in range(50)} | {(f"n{i}", f"u{i}") for i in range(50)}
    edges |= {(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)} | {("t0", "r0"), ("r7", "u1"), ("a", "b"), ("b", "a")}
    edges = sorted(x for x in edges if x[0] != x[1])
    e = spark.createDataFrame(edges, "src string, dst string").coalesce(3)
    want = {r.path: (r.scc, r.scc_size) for r in graph._kernel(e, None, False).collect()}
    core, found = graph.core_of, []
    monkeypatch.setattr(graph, "core_of", lambda *a: found.append(core(*a)) or found[-1])
    monkeypatch.setattr(graph, "_coloured", lambda e, rounds, keep=graph._coloured: found.append(e.count()) or keep(e, rounds))
    monkeypatch.setattr(graph.contracted, "__defaults__", (12, None, 1000))
    assert {r.path: (r.scc, r.scc_size) for r in graph.condensed(e, None, graph.KERNEL_EDGES)[0].collect()} == want
    assert len(found) > 2 and found[-1] < 0.1 * len(edges)  # the rounds that shuffle edges have few left


def tables_with(spark, tmp_path, orders, parts):
    """The tables of sf0.01 with these orders ``(key, date, parts...)`` and parts ``(key, brand, size)`` alone."""
    for t in TABLES:
        if t not in ("orders", "lineitem", "part"):
            os.symlink(f"{SF_DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    o = spark.createDataFrame([(k, at) for k, at, *_ in orders], "o_orderkey long, at string").select("o_orderkey", F.col("at").cast("timestamp").alias("o_orderdate"))
    rows = [(k, p, 1, i, 1.0, 1.0, 0.1) for k, _, *ps in orders for i, p in enumerate(ps)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    p = spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int")
    for name, df in (("orders", o), ("lineitem", li), ("part", p)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("case", ["plain", "part without a row", "part with two names"])
@pytest.mark.parametrize("kernel", [graph.KERNEL_EDGES, 0])
def test_cycle_growth_by_part_numbers_is_that_of_the_paths(spark, tmp_path, monkeypatch, case, kernel):  # F17
    monkeypatch.setattr(graph.scc, "__defaults__", (None, kernel, None))
    orders = [(1, "1999-01-01", 1, 2, 1), (2, "2001-01-01", 2, 3, 2), (3, "2001-02-01", 5, 6, 5), (4, "1999-03-01", 7, 8, 7), (5, "2001-03-01", 3, 9, 4), (6, "1999-03-01", 4, 1), (7, None, 10, 11, 10), (8, "1999-04-01", 20, 21), (9, "2002-04-01", 21, 22, 20)]
    parts = [(k, f"B#{k % 3}", 1 + k % 2) for k in (*range(1, 12), 20, 21, 22) if case != "part without a row" or k not in (4, 22)]
    parts += [(3, "Other", 9)] if case == "part with two names" else []
    d = tables_with(spark, tmp_path, orders, parts)
    assert (edges_by_number(spark, d) is None) == (case == "part with two names")
    df = Q["drift2_cycle_growth"](spark, d)
    assert df.count() >= 3
    folder = tmp_path / "one"  # the SQL reads files
    folder.mkdir()
    for t in TABLES:
        at = tmp_path / f"{t}.parquet"
        os.symlink(next(at.glob("*.parquet")) if at.is_dir() else at, folder / f"{t}.parquet")
    assert_same(df, SQL["drift2_cycle_growth"], str(folder))


def test_cycle_growth_moves_no_path_with_an_edge(spark, monkeypatch):  # F17
    from codestrata import queries

    seen = {}
    keep = queries.written
    monkeypatch.setattr(queries, "written", lambda df, name, **k: seen.setdefault(name, (df.columns, plan(df))) and keep(df, name, **k))
    Q["drift2_cycle_growth"](spark, SF_DIR)
    assert seen["numbers"][0] == ["src", "dst", "old"] and "p_brand" not in seen["numbers"][1] and "edges" not in seen


def test_shortest_cycles_are_found_without_gathering_edges(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(130)} | {("x", "y"), ("y", "x")})
    edges = [e for e in edges if e[0] != e[1]]
    d = spark.createDataFrame([(s, t, False) for s, t in edges], "src string, dst string, conditional boolean").coalesce(1)
    df = drift.cycles(d)
    assert "FlatMapGroupsInPandas" not in plan(df)
    comp = {r.path: r.scc for r in graph.scc(d).where("scc_size > 1").collect()}

    def cycle(start):  # the first of the shortest walks in the order of their paths
        walks = [(start,)]
        while True:
            walks = sorted(w + (t,) for w in walks for s, t in edges if s == w[-1] and comp.get(t) == start)
            done = [w for w in walks if w[-1] == start]
            if done:
                return "cycle: " + " → ".join(done[0])

    assert {r.file: r.message for r in df.collect()} == {c: cycle(c) for c in set(comp.values())}


def test_a_module_is_worked_out_once_a_path(spark, monkeypatch):  # F20
    seen = {}
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, **k: seen.setdefault(name, plan(df)) and keep(df, name, **k))
    e = spark.createDataFrame([("a/x.h", "b/y.h"), ("a/x.h", "b/z.h"), ("a/w.h", "top.h")], "src string, dst string")
    assert sorted((r.src, r.dst, r.a, r.b) for r in graph.with_modules(e).collect()) == [("a/x.h", "b/y.h", "a", "b"), ("a/x.h", "b/z.h", "a", "b")]
    assert "Aggregate" not in seen["modules"] and "Union" not in seen["modules"]  # only what is read from the written nodes


def test_paths_are_made_normal(spark):  # F20
    rows = ["a/b", "./a", "././a", ".\\.\\a", "a\\b", "a/./b", ".a", ".", "./", "", "..\\a", None]
    got = spark.createDataFrame([(x,) for x in rows], "p string").select(normalise_path(F.col("p")).alias("n")).collect()
    assert [r.n for r in got] == [x if x is None else re.sub(r"^(\./)+", "", x.replace("\\", "/")) for x in rows]
