"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a pattern of the usual filter-list kind: ``*`` any characters, ``^`` a separator or the end, ``||`` a
host or a parent of it, ``|`` an end of the URL, ``@@`` in front an exception, ``/.../`` a plain regular
expression.  A literal token is a run of letters and digits that must occur as a whole token in every URL the
rule matches.  Token frequencies are counted over all URLs; each rule is indexed under its rarest one.  A
URL's own tokens fetch its candidate rules, and only those run their regular expression, which each worker compiles
once.  Rules without a literal token are candidates for every URL.

The rules are a list on the driver; their index is what is broadcast, so it is as large as that list and does not
grow with the pages.  Repeated rows are folded by the only shuffle, of page ids and URLs.

An exception outweighs any blocking rule; among rules of a kind the smallest ``rule_id`` is reported.

Defined results:

* a rule that is no regular expression, is null or empty, matches nothing; :func:`broken_rules` lists the former, and
  :func:`classify` warns of them;
* null URL: action ``none``; empty or very long URLs are handled like any other; case is ignored;
* repeated rows (the same ``page_id`` and ``url``) give one row; ``page_id`` may have any type, null is a value like
  any other;
* ties in token frequency go to the token first in order; a rule id that occurs twice counts as two rules;
* no rules: every action is ``none``; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from codestrata.storage import ship

FOUND = "action string, rule_id long, n_matched long"
#: rule_id, pattern: the production rules.
RULES = [
    (1, "||casino-win.example.com^"), (2, "||free-bets.example.com^"), (3, "||cheap-pills.example.com^"), (4, "||m.ththth.example.net^"),
    (5, "/ads/*"), (6, "?utm_source="), (7, "&ref=x|"), (8, "|http://blog."), (9, "||tionble.example.org/en/*.html|"),
    (10, "@@||tionsh.example.net/en/"), (11, "@@||thther.example.net^"), (12, "/de/*^page=2"), (13, "#top|"), (14, "|https://www.*.example.org/*/1"),
    (15, "/fr/[0-9]{3}(/|$)/"), (16, "||example.net/es/"), (17, "casino"), (18, "@@||casino-win.example.com/en/1*"), (19, "||tracker.invalid^"),
    (20, "/wp-login.php"), (21, "*/feed/*"), (22, "||xn--example.invalid^"), (23, "/[?&]sessionid=[0-9a-f]+/"), (24, "^utm_medium^"), (25, "||therhe.example.org/en/8"),
]

_SEPARATOR = r"([^a-z0-9_.%-]|$)"


def compile_rule(pattern: str) -> tuple[str, str, list[str]]:
    """(action, regular expression, literal tokens) of a rule; the expression is for lower-cased URLs."""
    action, p = ("allow", pattern[2:]) if pattern.startswith("@@") else ("block", pattern)
    p = p.lower()
    if len(p) > 2 and p[0] == p[-1] == "/" and re.search(r"[\[\](){}\\$+]", p):
        return action, p[1:-1], []
    out, body, left, right = "", p, False, False
    if body.startswith("||"):
        out, body, left = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:], True
    elif body.startswith("|"):
        out, body, left = "^", body[1:], True
    if body.endswith("|"):
        body, right = body[:-1], True
    for c in body:
        out += ".*" if c == "*" else _SEPARATOR if c == "^" else c if c.isalnum() and c.isascii() else "\\" + c if c.isascii() else c
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", body):
        a, b = m.span()
        before = left if a == 0 else body[a - 1] != "*"
        after = right if b == len(body) else body[b] != "*"
        if before and after:
            tokens.append(m.group())
    return action, out + ("$" if right else ""), sorted(set(tokens))


def broken_rules(rules: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """(rule_id, pattern, error) of rules whose regular expression does not compile."""
    out = []
    for i, p in rules:
        if p:
            try:
                re.compile(compile_rule(p)[1])
            except (re.error, OverflowError, RecursionError) as e:
                out.append((i, p, str(e)))
    return out


class RuleIndex:
    """Rules by their rarest token; expressions are compiled where they are used."""

    def __init__(self, compiled: list[tuple[int, str, str, list[str]]], frequency: dict[str, int]):
        self.rules = [(i, a == "allow", rx) for i, a, rx, _ in compiled]
        self.by: dict[str, list[int]] = {}
        for k, (*_, tokens) in enumerate(compiled):
            self.by.setdefault(min(tokens, key=lambda t: (frequency.get(t, 0), t)) if tokens else "", []).append(k)
        self.ready: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return self.__dict__ | {"ready": {}}

    def match(self, url: str | None) -> tuple[str, int | None, int]:
        if url is None:
            return "none", None, 0
        url = url.lower()
        allow, block, n = None, None, 0
        for token in {"", *re.findall("[a-z0-9]+", url)} & self.by.keys():
            for k in self.by[token]:
                pattern = self.ready.get(k) or self.ready.setdefault(k, re.compile(self.rules[k][2]))
                if pattern.search(url):
                    i, exception, _ = self.rules[k]
                    n += 1
                    if exception:
                        allow = i if allow is None else min(allow, i)
                    else:
                        block = i if block is None else min(block, i)
        return ("allow", allow, n) if allow is not None else ("block", block, n) if block is not None else ("none", None, 0)


def classify(pages: DataFrame, rules: list[tuple[int, str]] = RULES) -> DataFrame:
    """page_id, url, action (``block``, ``allow``, ``none``), rule_id, n_matched of each page."""
    spark = pages.sparkSession
    ship(spark)
    d = pages.select("page_id", F.col("url").cast("string").alias("url")).distinct()
    bad = broken_rules(rules)
    if bad:
        warnings.warn(f"rules that are no regular expressions and match nothing: {bad}", stacklevel=2)
    compiled = [(i, *compile_rule(p)) for i, p in rules if p and (i, p) not in {(i, p) for i, p, _ in bad}]
    literals = sorted({t for *_, ts in compiled for t in ts})
    frequency: dict[str, int] = {}
    if literals:
        wanted = spark.createDataFrame([(t,) for t in literals], "token string")
        tokens = F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))
        counts = d.select(F.explode(tokens).alias("token")).join(wanted, "token").groupBy("token").count()
        frequency = {r.token: r["count"] for r in counts.collect()}  # as many rows as the rules have literals
    index = spark.sparkContext.broadcast(RuleIndex(compiled, frequency))
    schema = StructType([*d.schema.fields, *_parse_datatype_string(FOUND).fields])

    def kernel(batches):
        for batch in batches:
            found = [index.value.match(u) for u in batch.column("url").to_pylist()]
            cols = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols, (pa.string(), pa.int64(), pa.int64()))], names=schema.names)

    return d.mapInArrow(kernel, schema)


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in compile_rule(p)[:2])) for i, p in RULES)
    return f"""
WITH rule(rule_id, kind, regex) AS (VALUES {values}),
m AS (SELECT p.page_id, p.url, r.rule_id, r.kind FROM (SELECT DISTINCT page_id, url FROM pages) p JOIN rule r ON regexp_matches(lower(p.url), r.regex)),
a AS (SELECT p.page_id, p.url, min(CASE WHEN kind = 'allow' THEN rule_id END) AS al, min(CASE WHEN kind = 'block' THEN rule_id END) AS bl, count(m.rule_id) AS n
      FROM (SELECT DISTINCT page_id, url FROM pages) p LEFT JOIN m ON p.page_id = m.page_id AND p.url = m.url GROUP BY p.page_id, p.url)
SELECT page_id, url, CASE WHEN al IS NOT NULL THEN 'allow' WHEN bl IS NOT NULL THEN 'block' ELSE 'none' END AS action,
       CAST(coalesce(al, bl) AS BIGINT) AS rule_id, CAST(n AS BIGINT) AS n_matched FROM a
"""


SQL = _sql()
