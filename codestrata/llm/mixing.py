"""Mixing sources to target weights by temperature.

Every source's token share is raised to an exponent and normalised.  The exponent is bisected in [0, 1] until
the weights' entropy reaches ``target_entropy`` (a share of the largest possible), or, if ``max_repeats`` is
given, to the smallest exponent (the flattest mix) that repeats no source more often than that.  Where both are
given the larger exponent holds.

The weights are then realised as budgeted block permutations: each source's documents are hashed into blocks of
about ``block_tokens``; in every epoch the blocks are walked in another pseudo-random order until the source's
budget is used up, and the block in which the budget ends is cut by the same rule document by document.  Only
block totals are ordered, so a hot source never has its documents sorted in one place, and documents are moved
for nothing but the one cut block of each source.

Defined results:

* tokens are maximal runs of non-space characters, counted over the whole text, however long; null, empty or blank texts have none and are in no mix;
* null ``source`` is a source of its own; ``doc_id`` may have any type that can be ordered, null is a value like any other; repeated rows are
  documents of their own (ties in a permutation are broken by text);
* a source's realised tokens are its budget rounded up to the end of the document in which it is reached;
* an empty table gives an empty mix; one source gets weight 1;
* extra columns of the input are carried along; one that has the name of an added column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.storage import written

TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS, STEPS, BROADCAST_ROWS = 0.98, 4.0, 1_000_000, 60, 500_000
ADDED = {"mix_tokens": "long", "mix_epoch": "long", "mix_block": "long", "mix_position": "long", "mix_order": "long", "mix_weight": "double"}


def weights(tokens: list[int], alpha: float) -> list[float]:
    total = math.fsum(tokens)
    w = [(t / total) ** alpha for t in tokens]
    s = math.fsum(w)
    return [x / s for x in w]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def solve(tokens: list[int], budget: float, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, steps: int = STEPS) -> float:
    """The exponent.  Entropy falls and the largest repetition falls as it rises, so both bounds bisect."""
    n = len(tokens)

    def bisect(low_side) -> float:
        lo, hi = 0.0, 1.0
        if not low_side(lo):
            return lo
        if low_side(hi):
            return hi
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_side(mid) else (lo, mid)
        return hi

    alpha = 0.0
    if target_entropy is not None and n > 1:
        alpha = bisect(lambda a: entropy(weights(tokens, a)) > target_entropy * math.log(n))
    if max_repeats is not None:
        alpha = max(alpha, bisect(lambda a: max(w * budget / t for w, t in zip(weights(tokens, a), tokens)) > max_repeats))
    return alpha


def _hash(*cols) -> F.Column:
    """The same 32 bits in any engine: the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, budget_tokens: float | None = None, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every use of a document in the mix: the columns of ``docs``, then :data:`ADDED`.

    ``budget_tokens``: tokens of the whole mix, by default as many as the documents have.  ``mix_position`` is
    the token of its source's stream at which the block begins; ``mix_order`` orders documents in a block.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ADDED]
    base = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"))
    base = base.select("row", F.coalesce(F.col("row.source").cast("string"), F.lit("(null)")).alias("s"), F.col("row.doc_id").cast("string").alias("i"), F.col("row.text").cast("string").alias("t")).where(F.col("t").rlike(r"\S"))
    base = base.withColumn("h", _hash(F.coalesce("i", F.lit("(null)")), F.md5("t")))
    # blocks follow from the hash alone, so tokens are counted once here and once where a document is used
    count = F.regexp_count("t", F.lit(r"\S+")).cast("long")
    sized = written(base.select("s", count.alias("n"), "h"), "sized")
    totals = [(r.s, r.t) for r in sized.groupBy("s").agg(F.sum("n").alias("t")).orderBy("s").collect()]  # a row by source
    if not totals:
        return docs.select(*kept, *[F.lit(None).cast(k).alias(c) for c, k in ADDED.items()]).limit(0)
    tokens = [t for _, t in totals]
    budget = float(sum(tokens) if budget_tokens is None else budget_tokens)
    w = weights(tokens, solve(tokens, budget, target_entropy, max_repeats))
    rows = [(s, t, round(x, 9), math.floor(x * budget + 0.5), max(1, -(-t // block_tokens))) for (s, t), x in zip(totals, w)]
    per = F.broadcast(spark.createDataFrame(rows, "s string, total long, weight double, quota long, blocks long"))
    blocks = sized.join(per, "s").groupBy("s", F.pmod("h", "blocks").alias("block")).agg(F.sum("n").alias("size"))
    epoch = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("quota") / F.col("total")) - 1, F.lit(0)).cast("int"))).alias("epoch")
    walk = blocks.join(per, "s").select("s", "block", "size", "quota", "total", "weight", epoch)
    order = Window.partitionBy("s", "epoch").orderBy(_hash(F.col("s"), F.col("epoch").cast("string"), F.col("block").cast("string")), "block").rowsBetween(Window.unboundedPreceding, -1)
    walk = walk.withColumn("at", F.col("epoch") * F.col("total") + F.coalesce(F.sum("size").over(order), F.lit(0))).where("at < quota")
    walk = written(walk.select("s", "block", "epoch", "at", "quota", "weight", (F.col("at") + F.col("size") > F.col("quota")).alias("cut")), "walk")
    near = F.broadcast if walk.count() <= broadcast_rows else lambda x: x
    d = base.join(per.select("s", "blocks"), "s").withColumn("block", F.pmod("h", "blocks")).drop("blocks")
    order_in_block = _hash(F.col("epoch").cast("string"), F.col("h").cast("string"))
    use = lambda w: d.join(near(w), ["s", "block"]).withColumns({"o": order_in_block, "n": count})
    whole, part = use(walk.where("NOT cut")), use(walk.where("cut AND quota > at"))
    inside = Window.partitionBy("s", "block", "epoch").orderBy("o", "h", "row.doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("b", F.coalesce(F.sum("n").over(inside), F.lit(0))).where(F.col("at") + F.col("b") < F.col("quota")).drop("b")
    used = whole.unionByName(part)
    return used.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("n").alias("mix_tokens"), F.col("epoch").cast("long").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("at").alias("mix_position"), F.col("o").alias("mix_order"), F.col("weight").alias("mix_weight"))


def _bisected(above: str) -> str:
    """SQL of :func:`solve`'s bisection over the list ``p`` of shares; ``above`` with {a} for the exponent."""
    mid = "((acc[1] + acc[2]) / 2)"
    steps = f"list_reduce(list_concat([[0.0::DOUBLE, 1.0::DOUBLE]], list_transform(range({STEPS}), lambda i: [i::DOUBLE, 0.0::DOUBLE])), lambda acc, i: CASE WHEN {above.format(a=mid)} THEN [{mid}, acc[2]] ELSE [acc[1], {mid}] END)[2]"
    return f"CASE WHEN NOT ({above.format(a='0.0')}) THEN 0.0 WHEN {above.format(a='1.0')} THEN 1.0 ELSE {steps} END"


_S = "list_sum(list_transform(p, lambda x: pow(x, {a})))"
_ENTROPY = _bisected(f"ln({_S}) - {{a}} * list_sum(list_transform(p, lambda x: pow(x, {{a}}) * ln(x))) / {_S} > {TARGET_ENTROPY} * ln(k)")
_REPEATS = _bisected(f"list_max(list_transform(p, lambda x: pow(x, {{a}}) / x)) / {_S} > {MAX_REPEATS}")
_MD5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"

#: :func:`mix` of ``documents(doc_id, text, source)``, without ``text``.
SQL = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(source, '(null)') AS s, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents),
t AS (SELECT *, {_MD5.format("coalesce(CAST(doc_id AS VARCHAR), '(null)') || '|' || md5(text)")} AS h FROM d WHERE n > 0),
tot AS (SELECT s, CAST(sum(n) AS BIGINT) AS total FROM t GROUP BY s),
f AS (SELECT list(total / budget ORDER BY s) AS p, max(budget) AS budget, count(*) AS k FROM (SELECT s, total, (SELECT sum(total) FROM tot) AS budget FROM tot) q),
e AS (SELECT p, budget, greatest({_REPEATS}, CASE WHEN k > 1 THEN {_ENTROPY} ELSE 0.0 END) AS a FROM f),
g AS (SELECT budget, a, {_S.format(a="a")} AS z FROM e),
per AS (SELECT s, total, pow(total / budget, a) / z AS weight, CAST(floor(pow(total / budget, a) / z * budget + 0.5) AS BIGINT) AS quota,
  CAST(greatest(1, ceil(total / {BLOCK_TOKENS}.0)) AS BIGINT) AS blocks FROM tot, g),
b AS (SELECT t.*, h % blocks AS block FROM t JOIN per ON per.s = t.s),
bl AS (SELECT s, block, CAST(sum(n) AS BIGINT) AS size FROM b GROUP BY s, block),
w0 AS (SELECT bl.s, block, size, quota, total, weight, unnest(range(CAST(greatest(ceil(quota / total), 1) AS BIGINT))) AS epoch FROM bl JOIN per ON per.s = bl.s),
w1 AS (SELECT *, epoch * total + coalesce(sum(size) OVER (PARTITION BY s, epoch ORDER BY {_MD5.format("s || '|' || epoch || '|' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w0),
u AS (SELECT b.doc_id, b.source, b.n, b.block, w1.epoch, w1.pos, w1.weight, w1.quota, {_MD5.format("w1.epoch || '|' || b.h")} AS o, b.h, b.text, b.s FROM b JOIN w1 ON w1.s = b.s AND w1.block = b.block WHERE w1.pos < w1.quota),
v AS (SELECT *, pos + coalesce(sum(n) OVER (PARTITION BY s, block, epoch ORDER BY o, h, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here FROM u)
SELECT doc_id, source, n AS mix_tokens, CAST(epoch AS BIGINT) AS mix_epoch, block AS mix_block, CAST(pos AS BIGINT) AS mix_position, o AS mix_order, round(weight, 9) AS mix_weight
FROM v WHERE here < quota
"""
