"""Graph operators over ``edges(src, dst)``; nodes are paths.

Strongly connected components, depths and reach have two implementations that must agree: DataFrame loops that cut
their lineage in the shared folder, for any size, and a grouped kernel for graphs of at most ``KERNEL_EDGES`` edges
(the count is checked), where a loop's fixed cost would dominate.  Loops run on hashes of paths (checked to be distinct)
and begin by contracting what a few rounds show to be connected both ways; depths and reach need the condensation only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.classify import module_of, normalise_path
from codestrata.options import Extras
from codestrata.storage import forget, numbered, ship, written

KERNEL_EDGES = 2_000_000
KERNEL_REACH_NODES = 20_000
CORE_SLOTS = 1 << 27  # bits of a bitmap of nodes at most: 16 MB; a task has two of them as 128 MB each
GRAPH = "path string, scc string, scc_size int, depth int, reach long"


def merge_edges(raw: DataFrame) -> DataFrame:
    """Parallel edges become one: conditional only if all are, first ordinal and ``first_seen``; self edges go, paths are normalised."""
    d = raw.withColumns({"src": normalise_path(F.col("src")), "dst": normalise_path(F.col("dst"))}).where("src <> dst")
    keys = [c for c in ("snapshot", "src", "dst") if c in raw.columns]
    first = [F.min(c).alias(c) for c in ("ordinal", "first_seen") if c in raw.columns]
    return d.groupBy(*keys).agg(F.bool_and("conditional").alias("conditional"), *first)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("path")).union(edges.select(F.col("dst").alias("path"))).distinct()


def fan_in(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """path, fan_in; with ``nodes`` also those that nobody includes."""
    counted = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    return counted if nodes is None else nodes.join(counted, "path", "left").select("path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def _tarjan(n: int, out: list[list[int]]) -> list[list[int]]:
    """Components in reverse topological order, with an explicit stack."""
    index, low, on, stack, found, count = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            descend = False
            for j in range(k, len(out[v])):
                w = out[v][j]
                if index[w] < 0:
                    work += [(v, j + 1), (w, 0)]
                    descend = True
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            if descend:
                continue
            if low[v] == index[v]:
                own = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    own.append(w)
                    if w == v:
                        break
                found.append(own)
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return found


def _analyse(pdf: pd.DataFrame, reach: bool) -> pd.DataFrame:
    paths = sorted({*pdf.src, *pdf.dst.dropna()})
    at = {p: i for i, p in enumerate(paths)}
    out: list[list[int]] = [[] for _ in paths]
    for s, d in sorted({(at[s], at[d]) for s, d in zip(pdf.src, pdf.dst) if d is not None and s != d}):
        out[s].append(d)
    comps = _tarjan(len(paths), out)
    comp_of, rows = [0] * len(paths), []
    for c, members in enumerate(comps):
        for v in members:
            comp_of[v] = c
    size = [len(m) for m in comps]
    if "w" in pdf:  # nodes that stand for several, each a component of its own
        weight = {at[p]: w for p, w in zip(pdf.src, pdf.w) if w == w and w is not None}
        size = [sum(int(weight[v]) for v in m) for m in comps]
    depth, closure, total, large = [0] * len(comps), [0] * len(comps), [0] * len(comps), 0
    for c, members in enumerate(comps):  # children come before parents
        below = {comp_of[w] for v in members for w in out[v]} - {c}
        depth[c] = max((depth[b] + 1 for b in below), default=0)
        if reach:
            bits = 1 << c
            for b in below:
                bits |= closure[b]
            closure[c] = bits
            if size[c] > 1:
                large |= 1 << c
            total[c], x = (bits & ~large).bit_count(), bits & large
            while x:  # components of several members, each once
                low = x & -x
                total[c] += size[low.bit_length() - 1]
                x ^= low
        rows += [(paths[v], paths[min(members)], size[c], depth[c], total[c]) for v in members]
    return pd.DataFrame(rows, columns=["path", "scc", "scc_size", "depth", "reach"])


def _kernel(edges: DataFrame, nodes: DataFrame | None, reach: bool) -> DataFrame:
    ship(edges.sparkSession)
    d = edges.select("src", "dst")
    if nodes is not None:
        d = d.union(nodes.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")))
    return d.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: _analyse(pdf, reach), GRAPH)


def small(edges: DataFrame, limit: int = KERNEL_EDGES) -> bool:
    """Whether there are at most ``limit`` edges; counts no further than that."""
    return edges.limit(limit + 1).count() <= limit


def _trimmed(e: DataFrame) -> tuple[DataFrame, int]:
    """Without edges that lie on no cycle because an end has no edge in or none out, round after round."""
    n = e.count()
    while n:
        ends, begins = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = written(e.join(ends, "src", "left_semi").join(begins, "dst", "left_semi").select("src", "dst"), "trimmed", instead_of=e)
        m = e.count()
        if m == n:
            break
        n = m
    return e, n


def bypassed(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, list[DataFrame]]:
    """``edges`` after nodes in the middle of chains were taken out, and what was taken, round by round.

    A node with one edge in and one out lies on a cycle exactly if the edge that bypasses it does, so it is taken out and
    comes back with that edge (:func:`restored`).  Of such nodes in a row those whose hash is smaller than both neighbours'
    go together, a third a round on average, so a chain of n nodes is gone after some log n rounds.
    """
    taken: list[DataFrame] = []
    e = edges
    for _ in range(rounds):
        into = e.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("a"))
        out = e.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("b"))
        thin = into.join(out, "path").where("i = 1 AND o = 1 AND a <> path AND b <> path").select("path", "a", "b")
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(taken)))
        names = thin.select("path")
        # a neighbour that is thin too has to have a larger hash
        go = thin.join(names.toDF("a").withColumn("ta", F.lit(True)), "a", "left").join(names.toDF("b").withColumn("tb", F.lit(True)), "b", "left")
        go = go.where((F.col("ta").isNull() | (rank("path") < rank("a"))) & (F.col("tb").isNull() | (rank("path") < rank("b")))).select("path", "a", "b")
        go = written(go, "bypassed")
        if go.isEmpty():
            break
        taken.append(go)
        kept = e.join(go.select(F.col("path").alias("src")), "src", "left_anti").join(go.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst")
        e = written(kept.union(go.select("a", "b")).distinct(), "edges", instead_of=e)
    return e, taken


def restored(found: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """(path, c) of nodes on cycles by any name ``c`` of their component, with the nodes that were taken out."""
    for go in reversed(taken):
        both = go.join(found.toDF("a", "c"), "a").join(found.toDF("b", "c2"), "b").where("c = c2 OR a = b").select("path", "c")
        # a cycle of two, a and the node, has become an edge from a to itself
        own = go.where("a = b").join(found.select(F.col("path").alias("a")), "a", "left_anti")
        own = own.select(F.col("path").alias("path"), F.col("a").alias("c")).union(own.select("a", "a")).distinct()
        found = written(found.union(both).union(own).distinct(), "found", instead_of=found)
    return found


def scc_loop(edges: DataFrame) -> DataFrame:
    """(path, scc) of nodes on cycles, by bypassing, trimming and colouring; scc is the smallest member.

    Chains are shortened first (:func:`bypassed`), in a number of rounds that is logarithmic in their length, then nodes
    without an edge in or out are trimmed, as they lie on no cycle.  Then every node takes the smallest name that reaches
    it; a node that keeps its own is the root of the component of all nodes of its colour that reach it back.  Those
    components leave and the rest is coloured again.
    """
    e, found = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges"), None
    e, taken = bypassed(e)
    loops = written(e.where("src = dst").select(F.col("src").alias("path"), F.col("src").alias("c")), "loops")
    e = written(e.where("src <> dst"), "edges", instead_of=e)
    while True:
        e, n = _trimmed(e)
        if not n:
            break
        colour = written(nodes_of(e).select("path", F.col("path").alias("c")), "colour")
        while True:
            offer = e.join(colour, e.src == colour.path).select(F.col("dst").alias("path"), "c")
            new = written(colour.union(offer).groupBy("path").agg(F.min("c").alias("c")), "colour")
            same = new.join(colour, ["path", "c"], "left_anti").isEmpty()
            forget(colour)
            colour = new
            if same:
                break
        inside = e.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "c2"), "dst").where("c = c2").select("src", "dst", "c")
        inside = written(inside, "inside")
        back = written(colour.where("path = c"), "back")
        while True:
            step = inside.join(back.toDF("dst", "c"), ["dst", "c"]).select(F.col("src").alias("path"), "c")
            new = written(back.union(step).distinct(), "back")
            done = new.count() == back.count()
            forget(back)
            back = new
            if done:
                break
        found = back if found is None else written(found.union(back), "found")
        gone = back.select("path")
        e = written(e.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"), "left", instead_of=e)
    # a bypass may have closed on a node of its own, which is a component then
    alone = loops if found is None else loops.join(found.select("path"), "path", "left_anti")
    found = written(alone if found is None else found.union(alone), "found")
    found = restored(found, taken)
    size = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("scc")).where("n > 1")
    return written(found.join(size, "c").select("path", "scc"), "scc")


def hashed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges as pairs of longs, and ``names(id, path)``; the hash is another one where two paths would share a number."""
    for seed in range(8):
        number = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: E731, B023
        e = edges.where("src <> dst").select(F.struct(number("src").alias("id"), F.col("src").alias("path")).alias("s"), F.struct(number("dst").alias("id"), F.col("dst").alias("path")).alias("d"))
        names = written(e.select(F.inline(F.array("s", "d"))).distinct(), "names")
        if unique(names):
            return written(e.select(F.col("s.id").alias("src"), F.col("d.id").alias("dst")), "hashed"), names
        forget(names)
    raise RuntimeError("no hash keeps the paths apart")


def unique(names: DataFrame) -> bool:
    """Whether no two rows of ``names(id, path)`` share a number."""
    return names.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _bits(rows, slots: int) -> np.ndarray:
    """A bitmap of ``slots`` bits as bytes, from rows (bucket, bits) of 32,768 of them each."""
    out = np.zeros((slots // 32768, 4096), np.uint8)
    for bucket, bits in rows:
        out[bucket] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _flags(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, bitorder="little").view(bool)


def _spread(batches, maps, reverse: bool):
    """Bits new in this part of the edges: what ``seen`` reaches along edges of slots (or backwards), but for clashes."""
    seen, clash = (_flags(m) for m in maps.value)
    before = np.packbits(seen, bitorder="little")
    for b in batches:
        s, d = (b.column(i).to_numpy() for i in ((1, 0) if reverse else (0, 1)))
        hit = d[seen[s]]
        seen[hit[~clash[hit]]] = True
    new = (np.packbits(seen, bitorder="little") & ~before).reshape(-1, 4096)
    at = np.flatnonzero(new.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([new[i].tobytes() for i in at], pa.binary())], names=["bucket", "bits"])


def _replaced(batches, core, pivot: int):
    """Edges (src, dst, slots of both) with the core's nodes replaced by one; edges within it go."""
    inside = _flags(core.value)
    for b in batches:
        s, d, i, j = (b.column(k).to_numpy() for k in range(4))
        s, d = np.where(inside[i], pivot, s), np.where(inside[j], pivot, d)
        keep = s != d
        yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(d[keep])], names=["src", "dst"])


def _chosen(batches, core):
    inside = _flags(core.value)
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[inside[b.column(1).to_numpy()]])], names=["id"])


def core_of(e: DataFrame, ids: DataFrame, seed: int, rounds: int = 30, slots: int = CORE_SLOTS) -> tuple[DataFrame, DataFrame, int] | None:
    """One large set of nodes connected both ways as one: edges left, its ``(id)``, the node that stands for it.

    Edges are neither sorted nor shuffled for it.  A node is a bit of a bitmap by its hash; nodes that share a bit with
    another (all of ``ids`` are looked at) take no part, so every bit is one node.  From a node of many edges the bits that
    it reaches and that reach it grow round by round over the edges where they lie, and only bitmaps travel.  What both
    have in common is connected both ways whatever took no part and however many rounds were made, so the choice of the
    node and the bounds change what is left to do, never the components.
    """
    spark = e.sparkSession
    ship(spark)
    context = spark.sparkContext
    size = 32768
    while size < 4 * ids.count() and size < slots:
        size *= 2
    slot = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(size)).cast("int")
    bucket = F.shiftright("slot", 15)
    twice = ids.select(slot("id").alias("slot")).groupBy("slot").count().where("count > 1")
    clash = _bits(twice.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767))).collect(), size)
    # the source of most edges among some, of those that are ends too
    some = e.limit(20_000).select("src", "dst", slot("src").alias("i")).toPandas()
    some = some[~_flags(clash)[some.i.to_numpy()]]
    both = some[some.src.isin(some.dst)]
    starts = (both if len(both) else some).groupby(["src", "i"]).size().sort_values(ascending=False).index[:3]
    pairs = e.select(slot("src").alias("i"), slot("dst").alias("j"))
    for pivot, at in starts:
        seen = []
        for reverse in (False, True):
            own = np.zeros(size // 8, np.uint8)
            own[at >> 3] |= 1 << (at & 7)
            for _ in range(rounds):
                maps = context.broadcast((own, clash))
                new = pairs.mapInArrow(lambda it, m=maps, r=reverse: _spread(it, m, r), "bucket int, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits")).collect()
                maps.unpersist()
                if not new:
                    break
                own |= _bits(new, size)
            seen.append(own)
        core = seen[0] & seen[1]
        if _flags(core).sum() < 2:
            continue
        sent, pivot = context.broadcast(core), int(pivot)
        left = e.select("src", "dst", slot("src").alias("i"), slot("dst").alias("j")).mapInArrow(lambda it: _replaced(it, sent, pivot), "src long, dst long")
        inside = ids.select("id", slot("id").alias("slot")).mapInArrow(lambda it: _chosen(it, sent), "id long")
        return written(left.distinct(), "left"), written(inside, "core"), pivot
    return None


def contracted(e: DataFrame, rounds: int = 12, ids: DataFrame | None = None, large: int = KERNEL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Edges of the graph in which nodes connected both ways are one, and ``(path, c)`` of nodes by what stands for them.

    While there are more than ``large`` edges, a large set of such nodes is taken as one by :func:`core_of`, so that the
    rounds here, which shuffle edges, have the rest only.  ``ids``: all nodes, where a caller has them.
    """
    first, cores = e, []
    while len(cores) < 6 and not small(e, large):
        ids = written(nodes_of(e).select(F.col("path").alias("id")), "ids") if ids is None else ids
        got = core_of(e, ids, len(cores))
        if got is None:
            break
        left, inside, pivot = got
        cores.append((inside, pivot))
        before, n = e.count(), left.count()
        if e is not first:
            forget(e)
        e, ids = left, None  # the nodes of what is left
        if 2 * n > before:
            break
    left, member = _coloured(e, rounds)
    if not cores:
        return left, member
    # a core's node may be one with others since; there are as many as cores
    stands = {r.path: r.c for r in member.where(F.col("path").isin([p for _, p in cores])).collect()}
    for k in reversed(range(len(cores))):  # and a later core may have taken it
        inside, pivot = cores[k]
        for later, other in cores[k + 1 :]:
            if pivot not in stands and other != pivot and not later.where(F.col("id") == pivot).isEmpty():
                stands[pivot] = stands.get(other, other)
        taken = inside.select(F.col("id").alias("path"), F.lit(stands.get(pivot, pivot)).alias("c"))
        known = inside.select(F.col("id").alias("path"))
        member = taken.union(member.join(known, "path", "left_anti"))
    return left, written(member, "member")


def _coloured(e: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """:func:`contracted` by colours.

    Every node takes the smallest name that reaches it, as in :func:`scc_loop`, and those of a name that reach it back
    are one with it.  Both hold of whatever a bounded number of rounds has found, so what is left is smaller and has the
    same components; a component of small diameter is whole after it.
    """
    colour = front = written(nodes_of(e).select("path", F.col("path").alias("c")), "colour")
    for _ in range(rounds):
        offer = e.join(front.select(F.col("path").alias("src"), "c"), "src").groupBy(F.col("dst").alias("path")).agg(F.min("c").alias("c"))
        both = colour.select("path", "c", F.col("c").alias("was")).union(offer.select("path", "c", F.lit(None).cast("long")))
        colour = written(both.groupBy("path").agg(F.min("c").alias("c"), F.max("was").alias("was")), "colour", instead_of=colour)
        front = colour.where("c < was")
        if front.isEmpty():
            break
    colour = colour.select("path", "c")
    front = written(colour.where("path = c"), "back")
    seen, fronts = front, [front]
    for _ in range(rounds):
        step = e.join(front.select(F.col("path").alias("dst"), "c"), "dst").select(F.col("src").alias("path"), "c").distinct()
        front = written(step.join(colour, ["path", "c"], "left_semi").join(seen, "path", "left_anti"), "back")
        if front.isEmpty():
            break
        seen = seen.union(front)
        fronts.append(front)
    member = written(seen, "member")
    for f in fronts:
        forget(f)
    at = lambda c: member.select(F.col("path").alias(c), F.col("c").alias(f"{c}_c"))
    left = e.join(at("src"), "src", "left").withColumn("src", F.coalesce("src_c", "src")).select("src", "dst")
    left = left.join(at("dst"), "dst", "left").withColumn("dst", F.coalesce("dst_c", "dst")).select("src", "dst")
    return written(left.where("src <> dst").distinct(), "contracted"), member


def condensed(edges: DataFrame, nodes: DataFrame | None, kernel_edges: int, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(path, scc, scc_size)`` of all nodes, and the edges between components.

    ``names(id, path)``: of all nodes, where ``edges`` are numbers already; no path of theirs is then moved with an edge.
    """
    e, names = hashed(edges) if names is None else (edges.select("src", "dst").where("src <> dst"), names)
    left, member = contracted(e, ids=names.select("id"))
    forget(e)
    if small(left, kernel_edges):
        text = left.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        loop = _kernel(text, None, False).select(F.col("path").cast("long").alias("path"), F.col("scc").cast("long").alias("scc"))
        loop = written(loop.where("path <> scc"), "scc")
    else:
        loop = scc_loop(left)
    final = lambda d, c: d.join(loop.select(F.col("path").alias(c), "scc"), c, "left").withColumn(c, F.coalesce("scc", c)).drop("scc")
    known = names.join(member.select(F.col("path").alias("id"), "c"), "id", "left").select("path", F.coalesce("c", "id").alias("c"))
    known = written(final(known, "c"), "known")
    # a component of one is named by its only path, so only the larger ones are brought together
    label = written(known.groupBy("c").agg(F.min("path").alias("scc"), F.count(F.lit(1)).cast("int").alias("scc_size")), "labels")
    large = written(label.where("scc_size > 1"), "large")
    comp = known.join(large, "c", "left").select("path", F.coalesce("scc", "path").alias("scc"), F.coalesce("scc_size", F.lit(1)).alias("scc_size"))
    if nodes is not None:
        comp = comp.union(nodes.select("path").distinct().join(names, "path", "left_anti").select("path", "path", F.lit(1)))
    dag = final(final(left, "src"), "dst").where("src <> dst").distinct()
    called = label.select("c", "scc")
    dag = dag.join(called.toDF("src", "a"), "src").join(called.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return written(comp, "components"), written(dag, "dag")


def scc(edges: DataFrame, nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES, names: DataFrame | None = None) -> DataFrame:
    """(path, scc, scc_size) of all nodes; scc is the smallest member.

    ``names``: as in :func:`condensed`; edges are numbers, and every number has its one name.
    """
    if names is not None and small(edges, kernel_edges):
        at = lambda c: names.select(F.col("id").alias(c), F.col("path").alias(f"{c}_path"))
        e = edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst")
        return _kernel(e.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")), nodes, False).select("path", "scc", "scc_size")
    if names is not None:
        return condensed(edges, nodes, kernel_edges, names)[0]
    if small(edges, kernel_edges):
        return _kernel(edges, nodes, False).select("path", "scc", "scc_size")
    return condensed(edges, nodes, kernel_edges)[0]


def depths(edges: DataFrame, nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(path, depth): length of the longest path to a leaf of the condensation."""
    if small(edges, kernel_edges):
        return _kernel(edges, nodes, False).select("path", "depth")
    comp, dag = condensed(edges, nodes, kernel_edges)
    level = _kernel(dag, None, False).select(F.col("path").alias("scc"), "depth") if small(dag, kernel_edges) else _levels(nodes_of(dag), dag)
    return comp.join(level, "scc", "left").select("path", F.coalesce("depth", F.lit(0)).alias("depth"))


def _levels(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """(scc, depth) by one round a level; a round reads the edges into its front only."""
    level, depth = written(nodes.select(F.col("path").alias("scc"), F.lit(0).alias("depth")), "depth"), 0
    front = level.select("scc")
    while True:  # the nodes with a path of one edge more
        front = written(dag.join(front.toDF("dst"), "dst").select(F.col("src").alias("scc")).distinct(), "front", instead_of=front)
        if front.isEmpty():
            return level
        depth += 1
        level = written(level.join(front.withColumn("d", F.lit(depth)), "scc", "left").select("scc", F.coalesce("d", "depth").alias("depth")), "depth", instead_of=level)


def reachable_from(edges: DataFrame, start: str) -> DataFrame:
    """Nodes reached from ``start``, itself included, by frontiers over hashes of the paths."""
    e, names = hashed(edges)
    own = edges.sparkSession.createDataFrame([(start,)], "path string")
    front = written(names.join(own, "path", "left_semi").select("id"), "seen")
    seen = front
    while True:  # a front is written once and kept: all of them together are the answer
        front = written(e.join(front.toDF("src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            return own.union(names.join(seen, "id", "left_semi").select("path").where(F.col("path") != start))
        seen = written(seen.union(front), "seen", instead_of=seen)


def reach_by_blocks(comp: DataFrame, dag: DataFrame, block_buckets: int = 8) -> DataFrame:
    """(scc, reach) of the components in ``dag`` by bitmaps: each one's bitmap of the components that it reaches.

    A bitmap holds 32,768 components of one size in 4 KB and a block ``block_buckets`` of them, so a round's state is that
    many bitmaps a component (one more a size), whatever is reached; pairs are never listed and a component counts as one
    bit whatever its size.  Components are worked level by level from the leaves.
    """
    deep = written(_levels(nodes_of(dag), dag), "levels")
    dag = written(dag.join(deep.toDF("src", "level"), "src"), "dag")
    most = deep.agg(F.max("depth")).first()[0]
    if most is None:
        return comp.select("scc", F.lit(1).cast("long").alias("reach")).limit(0)
    number = written(numbered(comp.where("path = scc").join(deep.select("scc"), "scc", "left_semi").select("scc", "scc_size"), "scc_size", "scc"), "numbers")
    n = number.count()
    total, size = None, 32768 * block_buckets
    for low in range(0, n, size):
        own = number.where((F.col("k") >= low) & (F.col("k") < low + size)).groupBy("scc", F.struct("scc_size", F.floor(F.col("k") / 32768)).alias("bucket"))
        own = written(own.agg(F.bitmap_construct_agg((F.col("k") % 32768).cast("int")).alias("bits")), "bits")
        known = own.join(deep.where("depth = 0"), "scc").select("scc", "bucket", "bits")
        for level in range(1, most + 1):
            below = dag.where(F.col("level") == level).join(known.select(F.col("scc").alias("dst"), "bucket", "bits"), "dst").select(F.col("src").alias("scc"), "bucket", "bits")
            above = own.join(deep.where(F.col("depth") == level), "scc").select("scc", "bucket", "bits").union(below)
            known = written(known.union(above.groupBy("scc", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))), "reached")
        part = written(known.select("scc", (F.bitmap_count("bits") * F.col("bucket.scc_size")).alias("n")).groupBy("scc").agg(F.sum("n").alias("n")), "reach")
        total = part if total is None else written(total.union(part).groupBy("scc").agg(F.sum("n").alias("n")), "reach")
    return total.select("scc", F.col("n").alias("reach"))


def _measured(edges: DataFrame, nodes: DataFrame | None, kernel_edges: int, kernel_nodes: int) -> DataFrame:
    """(path, depth, reach) of all nodes."""
    all_nodes = nodes_of(edges) if nodes is None else nodes.select("path").union(nodes_of(edges)).distinct()
    if small(edges, kernel_edges) and all_nodes.limit(kernel_nodes + 1).count() <= kernel_nodes:
        return _kernel(edges, nodes, True).select("path", "depth", "reach")
    comp, dag = condensed(edges, nodes, kernel_edges)
    if small(dag, kernel_edges) and nodes_of(dag).limit(kernel_nodes + 1).count() <= kernel_nodes:
        weights = comp.where("path = scc").join(nodes_of(dag), "path", "left_semi").select("path", F.lit(None).cast("string"), "scc_size")
        d = dag.select("src", "dst", F.lit(None).cast("int").alias("w")).union(weights).withColumn("one", F.lit(1))
        ship(edges.sparkSession)
        known = d.groupBy("one").applyInPandas(lambda pdf: _analyse(pdf, True), GRAPH).select(F.col("path").alias("scc"), "depth", "reach")
    else:
        known = _levels(nodes_of(dag), dag).join(reach_by_blocks(comp, dag), "scc")
    return comp.join(written(known, "known"), "scc", "left").select("path", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("reach", F.col("scc_size").cast("long")).alias("reach"))


def reach_counts(edges: DataFrame, nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES, kernel_nodes: int = KERNEL_REACH_NODES) -> DataFrame:
    """(path, reach): number of nodes reached, itself included."""
    return _measured(edges, nodes, kernel_edges, kernel_nodes).select("path", "reach")


def metrics(edges: DataFrame, nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES, kernel_nodes: int = KERNEL_REACH_NODES) -> DataFrame:
    """One row: node_count, max_chain_length, max_fan_in, ccd, acd, nccd."""
    d = _measured(edges, nodes, kernel_edges, kernel_nodes)
    one = d.agg(F.count(F.lit(1)).alias("node_count"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_chain_length"), F.coalesce(F.sum("reach"), F.lit(0)).alias("ccd"))
    most = fan_in(edges).agg(F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"))
    one = one.crossJoin(most).select("node_count", "max_chain_length", "max_fan_in", "ccd")
    acd = F.when(F.col("node_count") > 0, F.col("ccd") / F.col("node_count")).otherwise(0.0)
    return one.withColumn("acd", acd).withColumn("nccd", F.when(F.col("node_count") > 0, F.col("acd") / F.log2(F.col("node_count") + 1)).otherwise(0.0))


def scc_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: total, cyclic and largest component."""
    c = scc(edges, nodes).select("scc", "scc_size").distinct()
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("scc_size") > 1).alias("cyclic"), F.coalesce(F.max("scc_size"), F.lit(0)).cast("long").alias("largest"))


# -- modules ---------------------------------------------------------------------------------------------------------


def with_modules(edges: DataFrame, extras: Extras = Extras()) -> DataFrame:
    """Edges between modules, with those of both ends as ``a`` and ``b``.

    A module is worked out once a path, not once an edge; written tables keep it from being worked out again in filters,
    and a filter on it from being moved before the paths are made distinct.
    """
    m = written(written(nodes_of(edges), "nodes").select("path", module_of(F.col("path"), extras).alias("m")), "modules").where("m <> ''")
    return edges.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").where("a <> b")


def module_pairs(edges: DataFrame, extras: Extras = Extras()) -> DataFrame:
    return written(with_modules(edges, extras).select("a", "b").distinct(), "pairs")


def module_metrics(pairs: DataFrame) -> DataFrame:
    """module, fid, fod, instability of ``pairs(a, b)``: how many modules include it, how many it includes."""
    p = pairs
    p = p.select(F.col("a").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(p.select(F.col("b"), F.lit(1), F.lit(0)))
    m = p.groupBy("module").agg(F.sum("i").alias("fid"), F.sum("o").alias("fod"))
    return m.withColumn("instability", F.when(F.col("fid") + F.col("fod") > 0, F.col("fod") / (F.col("fid") + F.col("fod"))).otherwise(0.5))


def shared_modules(measured: DataFrame) -> DataFrame:
    """Modules that many include and that include few: over half the largest fan-in, at most the upper median fan-out.

    The median's list has a number a module; ``measured`` is read twice, so write it before.
    """
    limits = measured.agg(F.max("fid").alias("most"), F.element_at(F.sort_array(F.collect_list("fod")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median"))
    return measured.crossJoin(F.broadcast(limits)).where("most > 0 AND fid > floor(0.5 * most) AND fod <= median").select("module")
