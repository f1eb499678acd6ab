"""WARC: resolve revisit records that say "not modified".

A revisit has no body of its own. It is resolved to the latest earlier full response of the same
canonical URL (an as-of join), if their validators agree, and takes that response's headers, updated
by those header fields that a 304 answer may change.

The as-of join works in two levels. All captures of a URL at one second become one point, by a partial
aggregation, since their answer is the same: so a span of time holds at most ``SPAN_S`` points of a URL
however often it was captured. Points are dealt by URL and span; inside a span a window carries the last
response forward, and across spans one summary row per URL and span does. The revisits then meet their
point, which is unique, so a hot one can be split. Bodies are not moved: a resolved record points to the
response that has the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPAN_S = 3600  # seconds, hence points, that one window takes of a URL
#: Header fields that a 304 answer may update (fixed values).
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, path without a trailing slash or "index.html",
    query without tracking and empty fields, in the order of the fields' text; neither scheme nor fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "\\?.*$", ""), "/index\\.html?$", "/"), "/+$", "")
    fields = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(ref|utm_[a-z]+)(=.*)?$"))
    kept = F.when(query == "", "").otherwise(F.array_join(F.array_sort(fields), "&"))
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _headers(c: Column) -> Column:
    """Header entries with lower-case names, sorted by name; of a repeated name the last by value."""
    entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
        F.lower(e["key"]).alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    return F.filter(entries, lambda e, i: (i + 1 >= F.size(entries)) | (F.get(entries, i + 1)["name"] != e["name"]))


def resolve_revisits(records: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """One row per revisit record: ``record_id, url_key, ts, outcome, response_id, digest, headers``.

    ``records`` has record_id, url, ts (seconds), kind ("response" or "revisit"), status (of the answer), etag,
    last_modified, digest and headers (a map). A response is full if its status is 200 to 299 or unknown; redirects and
    errors have no body that a revisit could mean. ``outcome`` is "resolved", "no response" (none is
    strictly earlier), "no validator" (nothing to compare on both sides) or "changed" (a validator
    differs). Entity tags are compared where both have one, else dates, else digests. ``headers`` is
    the merged list of (name, value), null unless resolved. Of responses at the same second the
    largest record_id counts. Records without url or ts resolve to "no response"; other kinds and
    null kinds are ignored, repeated records give repeated rows.
    """
    r = records.select("record_id", "kind", "status", F.col("ts").cast("long").alias("ts"), canonical_url(F.col("url")).alias("url_key"),
                       "etag", "last_modified", "digest", _headers(F.col("headers")).alias("headers"))
    r = r.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & F.coalesce(F.col("status").between(200, 299), F.lit(True))))
    lost = F.col("url_key").isNull() | F.col("ts").isNull()
    r, _ = stored(r.where(~lost | (F.col("kind") == "revisit")), "warc-records")  # keys and headers are worked out once
    full = F.when(F.col("kind") == "response",
                  F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    points = (r.where(~lost).groupBy("url_key", F.floor(F.col("ts") / span_s).alias("span"), "ts")
              .agg(F.max(full).alias("last"), F.max(F.col("kind") == "revisit").alias("asked")))
    points, _ = stored(points, "warc-points")
    in_span = Window.partitionBy("url_key", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    over_spans = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (points.groupBy("url_key", "span").agg(F.max("last").alias("last")).withColumn("far", F.max("last").over(over_spans))
               .where("far IS NOT NULL").select("url_key", "span", "far"))
    as_of = (points.withColumn("near", F.max("last").over(in_span)).where("asked").join(carried, ["url_key", "span"], "left")
             .select("url_key", "ts", F.coalesce("near", "far").alias("full")).where("full IS NOT NULL"))
    # a revisit that can't be placed has a null key and meets no point
    found = r.where("kind = 'revisit'").join(as_of, ["url_key", "ts"], "left")
    same = (F.when(F.col("etag").isNotNull() & F.col("full.etag").isNotNull(), F.col("etag") == F.col("full.etag"))
            .when(F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull(),
                  F.col("last_modified") == F.col("full.last_modified"))
            .when(F.col("digest").isNotNull() & F.col("full.digest").isNotNull(), F.col("digest") == F.col("full.digest")))
    outcome = (F.when(F.col("full").isNull(), "no response").when(same.isNull(), "no validator")
               .when(same, "resolved").otherwise("changed"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    new = F.filter(F.coalesce("headers", none), lambda h: h["name"].isin(*UPDATABLE))
    old = F.filter(F.coalesce("full.headers", none), lambda h: ~F.exists(new, lambda n: n["name"] == h["name"]))
    resolved = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", "outcome", F.when(resolved, F.col("full.record_id")).alias("response_id"),
        F.when(resolved, F.col("full.digest")).alias("digest"),
        F.when(resolved, F.array_sort(F.concat(old, new))).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Two capture records per row of ``pages``: a full response, and a later or earlier conditional
    request that was answered "not modified", with an entity tag, a date, a stale tag, a digest or nothing."""
    def sign(c: Column, i: int) -> Column:
        return F.ascii(F.substring(F.md5(c), i, 1))

    url = F.coalesce(F.col("url"), F.lit(""))
    mode = (sign(url, 1) + sign(url, 2)) % 7
    t = F.col("page_id") * 60 + 1_600_000_000
    tag, date = F.concat(F.lit('"'), F.substring("md5", 1, 16), F.lit('"')), F.concat(F.lit("d"), t.cast("string"))
    p = pages.withColumn("md5", F.md5(F.coalesce("html", F.lit(""))))
    response = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", t.alias("ts"), F.lit("response").alias("kind"),
        F.when(sign(url, 3) == 48, 404).when(sign(url, 3) == 49, 301).otherwise(200).alias("status"),
        F.when(mode != 3, tag).alias("etag"), F.when(mode != 5, date).alias("last_modified"), F.col("md5").alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"),
                     F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("ETag"), tag,
                     F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    later = t + F.when(mode == 6, -30).otherwise(30 + sign(F.col("md5"), 1) * 997 + sign(F.col("md5"), 2) * 31)
    revisit = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(mode.isin(0, 1, 3, 6), tag).when(mode == 2, F.lit('"stale"')).alias("etag"),
        F.when(mode.isin(3, 4), date).alias("last_modified"), F.when(mode == 5, F.col("md5")).alias("digest"),
        F.create_map(F.lit("Date"), F.concat(F.lit("d"), later.cast("string")), F.lit("Cache-Control"), F.lit("max-age=90"),
                     F.lit("Content-Length"), F.lit("0"), F.lit("Server"), F.lit("cache")).alias("headers"))
    return response.unionByName(revisit)


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS md5 FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(bare, '^[^/?]*', '') AS rest FROM c),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(rest, '\?.*$', ''), '/index\.html?$', '/'), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(ref|utm_[a-z]+)(=.*)?'))) AS args FROM k),
z AS (SELECT page_id, url, html, md5, host || path || CASE WHEN array_to_string(args, '&') <> '' THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key,
  url, page_id * 60 + 1600000000 AS t, '"' || left(md5, 16) || '"' AS tag FROM u),
m AS (SELECT *, (ascii(md5(coalesce(url, ''))) + ascii(substr(md5(coalesce(url, '')), 2, 1))) % 7 AS mode,
  ascii(md5(md5)) * 997 + ascii(substr(md5(md5), 2, 1)) * 31 AS gap FROM z),
v AS (SELECT page_id * 2 + 1 AS record_id, url_key, t + CASE WHEN mode = 6 THEN -30 ELSE 30 + gap END AS ts,
  CASE WHEN mode IN (0, 1, 3, 6) THEN tag WHEN mode = 2 THEN '"stale"' END AS etag,
  CASE WHEN mode IN (3, 4) THEN 'd' || t END AS last_modified, CASE WHEN mode = 5 THEN md5 END AS digest FROM m),
f AS (SELECT page_id * 2 AS record_id, url_key, t AS ts, CASE WHEN mode <> 3 THEN tag END AS etag,
  CASE WHEN mode <> 5 THEN 'd' || t END AS last_modified, md5 AS digest, tag, length(html) AS len FROM m
  WHERE substr(md5(coalesce(url, '')), 3, 1) NOT IN ('0', '1')),
b AS (SELECT v.*, f.record_id AS full_id, f.etag AS e, f.last_modified AS l, f.digest AS d, f.tag, f.len,
  row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
  FROM v LEFT JOIN f ON f.url_key = v.url_key AND f.ts < v.ts),
o AS (SELECT *, CASE WHEN etag IS NOT NULL AND e IS NOT NULL THEN etag = e
  WHEN last_modified IS NOT NULL AND l IS NOT NULL THEN last_modified = l
  WHEN digest IS NOT NULL AND d IS NOT NULL THEN digest = d END AS same FROM b WHERE n = 1)
SELECT record_id, url_key, ts, CASE WHEN full_id IS NULL THEN 'no response' WHEN same IS NULL THEN 'no validator'
  WHEN same THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN full_id IS NOT NULL AND same THEN full_id ELSE -1 END AS response_id, CASE WHEN full_id IS NOT NULL AND same THEN d END AS digest,
  CASE WHEN full_id IS NOT NULL AND same THEN 'cache-control: max-age=90' || chr(10) || 'content-length: ' || len || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: d' || ts || chr(10) || 'etag: ' || tag END AS headers
FROM o
"""
