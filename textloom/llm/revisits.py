"""WARC revisit resolution: an as-of join by canonical URL to the latest earlier full response.

Records are captures: ``response`` rows with a full payload, and ``revisit`` rows (not modified) without one. A revisit
resolves to the latest response of the same canonical URL before it (at the same time only by a smaller record id) if
their validators agree: equal entity tags where both have one (a weak tag's ``W/`` doesn't count), else equal
Last-Modified where both have one, else equal payload digests where both have one; with none in common it doesn't
resolve. The merged headers are the response's, with those of ``PERMITTED`` replaced by the revisit's.

The as-of join is a running "last response" over time. One URL may hold a third of all rows, so its rows are dealt into
slices of ``SLICE_S`` seconds; within a slice a window finds the last response, a second window over one row a slice
carries it over from earlier slices, and rows before the first response of their slice take that. Payloads don't move:
windows carry record ids, validators and headers.

Canonical URL: scheme, ``www.`` and default ports off, host lower-cased, the fragment and ``utm_*``, ``ref`` and
``sessionid`` parameters off, the other parameters sorted, a trailing slash off.

Defined cases: rows with a null URL or time never resolve, and go through no window; of rows with one URL, time and record id, which one is last
isn't defined, and they agree if the rows are repeats; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_S = 3_600
#: Headers that a not-modified answer may update, fixed by the HTTP specification (RFC 9111 section 4.3.4, RFC 9110 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts seconds, kind, etag, last_modified, digest, headers map).

    Gives (record_id, ts, url_key, refers_to, refers_ts, status, headers): refers_to is null unless status is
    ``resolved``; the others are ``changed`` (validators disagree), ``unverified`` (none in common) and ``orphan``.
    """
    r = records.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "digest", "headers")
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    lost = r.where(~placed & (F.col("kind") == "revisit"))  # never meets a response, so it goes into no window
    r = r.where(placed).withColumn("slice", F.floor(F.col("ts") / SLICE_S))
    r = r.withColumn("response", F.when(F.col("kind") == "response", F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers")))
    before = W.partitionBy("url_key", "slice").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = r.withColumn("near", F.last("response", ignorenulls=True).over(before)).where("kind = 'revisit'")
    ends = r.where("response is not null").groupBy("url_key", "slice").agg(F.max_by("response", F.struct("ts", "record_id")).alias("end"))
    needed = near.where("near is null").select("url_key", "slice").distinct()
    marks = ends.join(needed.withColumn("asked", F.lit(True)), ["url_key", "slice"], "full")
    earlier = W.partitionBy("url_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.withColumn("far", F.last("end", ignorenulls=True).over(earlier)).where("asked and far is not null").select("url_key", "slice", "far")
    found = near.join(carried, ["url_key", "slice"], "left").withColumn("to", F.coalesce("near", "far"))
    found = found.unionByName(lost, allowMissingColumns=True)

    def agree(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    valid = F.coalesce(agree(_strong(F.col("etag")), _strong(F.col("to.etag"))), agree(F.col("last_modified"), F.col("to.last_modified")), agree(F.col("digest"), F.col("to.digest")))
    status = F.when(F.col("to").isNull(), "orphan").when(valid.isNull(), "unverified").when(valid, "resolved").otherwise("changed")
    nothing = F.expr("cast(map() as map<string,string>)")
    theirs, own = F.coalesce("to.headers", nothing), F.coalesce("headers", nothing)
    allowed = F.map_filter(own, lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    taken = F.transform(F.map_keys(allowed), F.lower)
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(taken, F.lower(k))), allowed)
    found = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return found.select("record_id", "ts", "url_key", F.when(ok, F.col("to.record_id")).alias("refers_to"), F.when(ok, F.col("to.ts")).alias("refers_ts"), "status", F.when(ok, merged).alias("headers"))
