"""Not-modified revisit resolution for web archives.

A ``304 Not Modified`` capture has no payload: it refers to the latest earlier full response of the same
canonical URL.  Only records' metadata is joined as of their time, never payloads.  Records of one URL and time are
folded first, before the shuffle; the points that are left are cut into spans of time with about as many each, so that
a URL with a third of all captures is spread: within a span a running maximum finds the latest response, and what
comes from the spans before is one row a span.  The found response is accepted if a validator agrees (the entity tag,
compared weakly, or where either side has none, the modification time); then the headers that a 304 may change
(RFC 9110: Cache-Control, Content-Location, Date, ETag, Expires, Vary) replace those of the response.

Canonical URL: host in lower case without user and ``www.``, and without the port if it is the scheme's own; scheme,
fragment, trailing slashes and tracking parameters dropped; remaining parameters sorted.

Defined results, by ``resolution``:

* ``resolved``; ``validator_mismatch`` (the latest earlier response has another validator);
  ``no_validator`` (there is nothing to compare); ``no_earlier_response`` (none strictly earlier, also for a null time
  and for a URL that is null or has no scheme and host: such a URL has no canonical form and meets no other);
* ties: of several responses at the latest earlier time the one with the largest ``record_id``, of which any type will
  do that can be ordered; of responses that agree in both, the one whose headers come last in order;
* header names are compared without regard to case and reported in lower case; several fields of a name are one, their
  distinct values joined by ", " (RFC 9110); a header without a name or value counts as absent;
* repeated revisit rows are resolved one by one, alike; null headers count as none; a header of a revisit that
  is not permitted is ignored; URLs and headers are read whole, however long; an empty table gives an empty result;
  extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|sessionid|ref)="
SPANS = 64
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def canonical_url(url: Column) -> Column:
    """Null for a URL without a scheme and a host."""
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 3), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.array_join(params, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def folded(headers: Column) -> Column:
    """Headers by name in lower case, each once."""
    named = F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull() & (F.trim(e["key"]) != ""))
    named = F.transform(F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(named, lambda e: e["key"]))
    again = lambda k: F.array_join(F.array_distinct(F.transform(F.filter(named, lambda e: e["key"] == k), lambda e: e["value"])), ", ")
    return F.when(F.size(names) == F.size(named), F.map_from_entries(named)).otherwise(F.map_from_arrays(names, F.transform(names, again)))


def _tag(c: Column) -> Column:
    return F.regexp_replace(c.getItem("etag"), "^W/", "")


def _span(ts: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``ts``, by halving."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(ts < bounds[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds))


def resolve(records: DataFrame, spans: int = SPANS) -> DataFrame:
    """One row for each revisit of ``records(record_id, url, ts long, status int, headers map<string,string>)``."""
    r = records.select("record_id", canonical_url(F.col("url")).alias("canon"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"), folded(F.col("headers")).alias("own"))
    usable = F.col("canon").isNotNull() & F.col("ts").isNotNull()
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", F.to_json("own").alias("own")))
    cuts = records.select(F.col("ts").cast("long").alias("ts")).agg(F.percentile_approx("ts", [i / spans for i in range(1, spans)], 1000).alias("b")).first().b
    points = r.where(usable & F.col("status").isin(200, 304)).groupBy("canon", "ts").agg(F.max(full).alias("full"))
    points = points.withColumn("span", _span(F.col("ts"), sorted(set(cuts or []))))
    carried = points.groupBy("canon", "span").agg(F.max("full").alias("last"))
    carried = carried.select("canon", "span", F.max("last").over(Window.partitionBy("canon").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = Window.partitionBy("canon", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    base = points.withColumn("inside", F.max("full").over(inside)).join(carried, ["canon", "span"]).select("canon", "ts", F.coalesce("inside", "before").alias("base")).where("base IS NOT NULL")
    j = r.where("status = 304").join(base, ["canon", "ts"], "left").withColumn("old", F.from_json("base.own", "map<string,string>"))
    ours, theirs = _tag(F.col("own")), _tag(F.col("old"))
    by_tag = ours.isNotNull() & theirs.isNotNull()
    our_time, their_time = F.col("own").getItem("last-modified"), F.col("old").getItem("last-modified")
    by_time = our_time.isNotNull() & their_time.isNotNull()
    how = F.when(F.col("base").isNull(), "no_earlier_response").when(by_tag, F.when(ours == theirs, "resolved").otherwise("validator_mismatch"))
    how = how.when(by_time, F.when(our_time == their_time, "resolved").otherwise("validator_mismatch")).otherwise("no_validator")
    j = j.withColumn("resolution", how)
    may = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(may), k)), may)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    ok = F.col("resolution") == "resolved"
    return j.select("record_id", F.col("canon").alias("canonical_url"), "resolution", F.when(ok, F.col("base.record_id")).alias("refers_to"), F.when(ok, F.col("ts") - F.col("base.ts")).alias("age"), F.when(ok, lines).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl derived from ``pages``: each page was fetched once in full and asked for again twice.

    The first time again the server confirms its entity tag under another spelling of the URL; the second time,
    every third page confirms by time only, every third has changed its tag, and the rest was asked for before
    it was ever fetched.
    """
    p = pages.select(F.col("page_id").cast("long").alias("i"), F.col("url").alias("u"), F.md5("html").alias("m"), F.octet_length("html").alias("n"))
    p = p.withColumn("at", F.col("i") * 10)
    tag, day = F.concat(F.lit('"'), F.substring("m", 1, 16), F.lit('"')), F.concat(F.lit("day "), F.col("i").cast("string"))
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))])
    third = F.pmod("i", F.lit(3))
    full = F.struct((F.col("i") * 3).alias("record_id"), F.col("u").alias("url"), F.col("at").alias("ts"), F.lit(200).alias("status"), m(content_type=F.lit("text/html"), content_length=F.col("n"), etag=tag, last_modified=day, date=F.concat(F.lit("t"), F.col("at").cast("string"))).alias("headers"))
    again = F.struct((F.col("i") * 3 + 1).alias("record_id"), F.concat(F.regexp_replace("u", "#.*$", ""), F.lit("#again")).alias("url"), (F.col("at") + 4).alias("ts"), F.lit(304).alias("status"), m(etag=F.concat(F.lit("W/"), tag), date=F.concat(F.lit("t"), (F.col("at") + 4).cast("string")), cache_control=F.lit("max-age=60"), content_length=F.lit(0), server=F.lit("x")).alias("headers"))
    by_time, changed = m(last_modified=day, expires=F.lit("never")), m(etag=F.lit('"changed"'), last_modified=day)
    last = F.struct((F.col("i") * 3 + 2).alias("record_id"), F.col("u").alias("url"), F.when(third == 2, F.col("at") - 3).otherwise(F.col("at") + 7).alias("ts"), F.lit(304).alias("status"), F.when(third == 0, by_time).when(third == 1, changed).otherwise(m(etag=tag)).alias("headers"))
    return p.select(F.explode(F.array(full, again, last)).alias("r")).select("r.*")


SQL = r"""
WITH p AS (SELECT page_id AS i, url AS u, md5(html) AS m, strlen(html) AS n, page_id * 10 AS t0, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || page_id AS day FROM pages),
r AS (
  SELECT i * 3 AS record_id, u AS url, t0 AS ts, 200 AS status, tag AS etag, day AS lm, NULL AS cc, NULL AS ex, 't' || t0 AS dt, n FROM p
  UNION ALL SELECT i * 3 + 1, regexp_replace(u, '#.*$', '') || '#again', t0 + 4, 304, 'W/' || tag, NULL, 'max-age=60', NULL, 't' || (t0 + 4), 0 FROM p
  UNION ALL SELECT i * 3 + 2, u, CASE WHEN i % 3 = 2 THEN t0 - 3 ELSE t0 + 7 END, 304, CASE WHEN i % 3 = 1 THEN '"changed"' WHEN i % 3 = 2 THEN tag END,
    CASE WHEN i % 3 <> 2 THEN day END, NULL, CASE WHEN i % 3 = 0 THEN 'never' END, NULL, NULL FROM p),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|sessionid|ref)='))) AS ps,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), CASE WHEN url ILIKE 'https:%' THEN ':443$' ELSE ':80$' END, ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM r),
c AS (SELECT *, host || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canon FROM q),
k AS (SELECT a.record_id AS rid, b.record_id AS bid, row_number() OVER (PARTITION BY a.record_id ORDER BY b.ts DESC, b.record_id DESC) AS pick
  FROM c a JOIN c b ON a.canon = b.canon AND a.status = 304 AND b.status = 200 AND b.ts < a.ts),
j AS (SELECT a.*, b.record_id AS bid, b.ts AS bts, b.etag AS betag, b.lm AS blm, b.dt AS bdt, b.n AS bn,
  CASE WHEN b.record_id IS NULL THEN 'no_earlier_response'
    WHEN a.etag IS NOT NULL THEN CASE WHEN regexp_replace(a.etag, '^W/', '') = b.etag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN a.lm = b.lm THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM c a LEFT JOIN k ON k.rid = a.record_id AND k.pick = 1 LEFT JOIN c b ON b.record_id = k.bid WHERE a.status = 304)
SELECT record_id, canon AS canonical_url, resolution, CASE WHEN resolution = 'resolved' THEN bid END AS refers_to, CASE WHEN resolution = 'resolved' THEN ts - bts END AS age,
  CASE WHEN resolution = 'resolved' THEN coalesce('cache-control: ' || cc || chr(10), '') || 'content-length: ' || bn || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || coalesce(dt, bdt) || chr(10) || 'etag: ' || coalesce(etag, betag) || coalesce(chr(10) || 'expires: ' || ex, '') || chr(10) || 'last-modified: ' || blm END AS headers
FROM j
"""
