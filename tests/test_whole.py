"""What SQL on the driver's tables does not show: odd documents, random graphs and long chains, cycle texts."""

import random

import duckdb
import pytest
from compare import assert_same

from codestrata.functions.classify import LICENSE_MARKERS
from codestrata.operators import clones, drift, graph
from codestrata.options import CloneOptions
from codestrata.queries import SQL, Q

SMALL = "/root/testdata/sf0.001"


def test_no_query_reads_a_slice():
    assert not [n for n, s in SQL.items() if "l_quantity >=" in s or "length(text) =" in s]


def test_every_document_is_classified(spark, tmp_path):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    for i, lead in ((-1, "é" * 900), (-2, "é" * 1000)):  # 1,800 and 2,000 bytes before the banner
        docs.append((i, lead + "Permission is hereby granted"))
    docs += [(-3, "é" * 2048), (-4, "é\n" * 2048), (-5, "é" * 40000 + "\n" * 2000), (-6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        if text is None:
            return None, None
        b = text.encode()
        sample = b[:65536]
        return any(m.encode() in b[:2000].lower() for m in LICENSE_MARKERS), len(b) >= 4096 and len(sample) // (1 + sample.count(b"\n")) > 110

    got = {r.doc_id: (r.license, r.minified) for r in Q["content_classes"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in docs}
    assert got[-1][0] and not got[-2][0] and got[-3][1] and not got[-4][1] and got[-5][1]


def closure(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    return reach


def brute(edges):
    """path: (component's smallest member, its size, depth, reach)."""
    reach = closure(edges)
    comp = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    depth = {}

    def deep(c):
        if c not in depth:
            depth[c] = max((1 + deep(comp[b]) for a, b in edges if comp[a] == c != comp[b]), default=0)
        return depth[c]

    return {n: (comp[n], sum(comp[m] == comp[n] for m in reach), deep(comp[n]), len(reach[n])) for n in reach}


def odd_graph():
    rng = random.Random(4)
    g = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("n010", "n005"), ("n030", "n029"), ("n040", "z")]  # a chain with two cycles
    g += [(f"r{i:02}", f"r{(i + 1) % 37:02}") for i in range(37)] + [("a", "r00"), ("r05", "b"), ("c", "d"), ("d", "c"), ("e", "f"), ("f", "e"), ("f", "g")]  # a ring, pairs
    g += [(f"x{rng.randrange(40)}", f"x{rng.randrange(40)}") for _ in range(55)]
    return [e for e in sorted(set(g)) if e[0] != e[1]]


def test_loops_kernel_and_brute_force_agree(spark):
    edges = odd_graph()
    e, want = spark.createDataFrame(edges, "src string, dst string").coalesce(1), brute(edges)
    assert {r.path: (r.scc, r.scc_size) for r in graph.scc(e, kernel_edges=0).collect()} == {n: w[:2] for n, w in want.items()}
    assert {r.path: r.depth for r in graph.depths(e, kernel_edges=0).collect()} == {n: w[2] for n, w in want.items()}
    assert {r.path: r.reach for r in graph.reach_counts(e, kernel_edges=0).collect()} == {n: w[3] for n, w in want.items()}
    assert {tuple(r) for r in graph._kernel(e, None, True).select("path", "scc", "scc_size", "depth", "reach").collect()} == {(n, *w) for n, w in want.items()}
    assert {r.path for r in graph.reachable_from(e, edges[0][0]).collect()} == closure(edges)[edges[0][0]]


def test_long_chains_take_few_rounds(spark):
    n = 400
    e = spark.range(n).selectExpr("format_string('n%05d', id) AS src", f"format_string('n%05d', (id + 1) % {n}) AS dst")
    short, taken = graph.bypassed(e)
    assert short.count() <= 2 and len(taken) <= 24
    c = graph.scc(e, kernel_edges=0)
    assert c.selectExpr("count(*)", "count(distinct scc)", "min(scc_size)").first()[:] == (n, 1, n)


def test_cycle_texts(spark):
    edges = [("a", "c"), ("c", "d"), ("d", "a"), ("a", "b"), ("b", "d"), ("x", "y"), ("y", "x"), ("p.h", "p_impl.h"), ("p_impl.h", "p.h"), ("u", "v"), ("v", "u")]
    e = spark.createDataFrame([(s, d, s in "uv", i) for i, (s, d) in enumerate(edges)], "src string, dst string, conditional boolean, ordinal int")
    got = {r.file: r.message for r in drift.cycles(e).collect()}
    # the shortest through the smallest member, ties by path; conditional ones and a header with its inline half are none
    assert got == {"a": "cycle: a → b → d → a", "x": "cycle: x → y → x"}


def fragments(spark, rows):
    f = [(i, file, start, start + 9, len(seq), 3, seq, raw, lines, lines, div) for i, (file, start, seq, raw, lines, div) in enumerate(rows)]
    return spark.createDataFrame(f, "frag_id long, file string, start_line int, end_line int, token_count int, stmts int, seq array<string>, raw_seq array<string>, norm_lines array<string>, norm_line_seq array<string>, diversity double")


def test_a_token_in_every_fragment_is_no_candidate(spark):
    rows = [("f", i, ["common", f"own{i}", f"more{i}"], [], [], 1.0) for i in range(500)] + [("f", 900 + k, ["common", "twin", "pair"], [], [], 1.0) for k in range(2)]
    assert [tuple(r) for r in clones.rare_pairs(fragments(spark, rows)).collect()] == [(500, 501, 2)]
    assert clones.rare_pairs(fragments(spark, rows), CloneOptions(rare_df_percent=100, min_shared_rare=1)).count() == 502 * 501 // 2


def test_whole_file_copies_generated_files_and_tables_are_left_out(spark):
    def block(k, n=40):
        return [f"t{k}_{j}" for j in range(n)]

    text = lambda k: [f"line {k} {j};" for j in range(8)]
    rows = [(f, 20 * k + 1, block(k), block(k), text(k), 1.0) for f in ("a.cpp", "copy.cpp") for k in range(3)]  # all of either file
    rows += [("b.cpp", 1, block(9), block(9), text(9), 1.0), ("c.cpp", 1, block(9), block(9), text(9), 1.0), ("c.cpp", 50, block(8), block(8), text(8), 1.0)]
    rows += [("d.pb.cc", 1, block(7), block(7), text(7), 1.0), ("e.cpp", 1, block(7), block(7), text(7), 1.0), ("e.cpp", 60, block(6), block(6), text(6), 1.0)]
    lit = ["lit"] * 20 + block(5, 20)
    rows += [("t.cpp", 1, lit, [str(i) for i in range(40)], text(5), 0.1), ("t.cpp", 90, lit, [str(i + 1) for i in range(40)], text(5), 0.1)]  # data tables
    many = ["idiom"] * 24 + block(4, 16)
    rows += [("h.cpp", 1, many, many, text(4), 1.0), ("h.cpp", 90, many, many, text(4), 1.0)]  # a token of most of one file
    rows += [(f"n{i}.cpp", 1, block(100 + i), block(100 + i), text(100 + i), 1.0) for i in range(20)]
    got = {(r.file_a, r.start_a, r.file_b, r.start_b): (r.weighted, r.type) for r in clones.report(clones.clone_pairs(fragments(spark, rows))).collect()}
    assert got == {("b.cpp", 1, "c.cpp", 1): (1.0, "EXACT"), ("h.cpp", 1, "h.cpp", 90): (0.8, "EXACT")}
    assert len(clones.clone_pairs(fragments(spark, rows), CloneOptions(whole_file=False)).collect()) == 5
    assert {(r.x.file, r.y.file) for r in clones.clone_pairs(fragments(spark, rows), CloneOptions(precise=True, metric="plain", min_diversity=0.5)).collect()} == {("b.cpp", "c.cpp"), ("h.cpp", "h.cpp")}


@pytest.mark.parametrize("name", ["rename_guard", "interval_join"])
def test_smallest_tables(spark, name):
    assert_same(Q[name](spark, SMALL), SQL[name], SMALL)
