"""Resolution of not-modified revisit records to the responses that they stand for.

Method: an as-of join by canonical URL. Each revisit looks for the latest earlier full response of its URL, compares
validators (entity tag if both have one, else the last-modified date) and, where they agree, becomes that response with
the headers that a not-modified reply may update.

A hot URL is split by time: its history is cut at quantiles of its own times, so that bursts are split as finely as quiet
spells. Full responses are summarised by (URL, slice), a running latest over the few slices carries the last response
into each, and only then do rows meet inside their slice. Slices hold about ``SLICE_ROWS`` rows, so no task sorts a URL's
whole history. Bodies never move: the result names the response.

Defined cases: a revisit without an earlier response is ``unresolved``; with different validators ``changed``; without
a validator to compare ``unverified``; a null URL, or one without a scheme and host, matches nothing; an earlier response
at the same time doesn't count; of responses at one time the one with the largest id counts; repeated rows are resolved
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from umbra.llm.runtime import Scratch

SLICE_ROWS, SLICES, BUSY = 50_000, 256, 2000
#: Header fields that describe the stored body and which a not-modified reply must not replace.
BODY_FIELDS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and host, http as https, no www., fragment, trailing slash or default port of its scheme; sorted query.

    Null without a scheme and a host: such a URL names no page.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    args = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    scheme = F.when(scheme == "http", "https").otherwise(scheme)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path, F.when(args != "", F.concat(F.lit("?"), args)).otherwise("")))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Fields of the stored response, replaced by what the reply may update; keys are lower-case."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*BODY_FIELDS))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url, refers_to, state, etag, headers for each revisit.

    `records` has record_id, url (canonical), at (bigint), full (boolean), etag, modified and headers (map of strings).
    """
    scratch = Scratch(records.sparkSession, "warc")
    rows = records.select("record_id", "url", "at", "full", "etag", "modified", "headers").where("full is not null")
    rows = scratch.table(rows, "records")
    nameless = rows.where("url is null and not full")
    rows = rows.where("url is not null")
    busy = scratch.table(rows.groupBy("url").count().where(F.col("count") > SLICE_ROWS).select("url"), "busy")
    many = busy.count()
    if many:
        # at most one URL for SLICE_ROWS rows is busy; beyond BUSY of them the planner chooses the join
        busy = F.broadcast(busy) if many <= BUSY else busy
        steps = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
        cuts = rows.join(busy, "url", "left_semi").groupBy("url").agg(F.array_distinct(F.percentile_approx("at", steps, 10 * SLICES)).alias("cuts"))
        cuts = scratch.table(cuts, "cuts")
        rows = rows.join(F.broadcast(cuts) if many <= BUSY else cuts, "url", "left")
        rows = rows.withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda x: x <= F.col("at"))))).drop("cuts")
    else:
        rows = rows.withColumn("slice", F.lit(0))
    response = F.when(F.col("full"), F.struct("at", "record_id", "etag", "modified", "headers"))
    slim = F.when(F.col("full"), F.struct("at", "record_id"))
    # the last response of each slice, carried into the slices after it
    carried = rows.groupBy("url", "slice").agg(F.max(slim).alias("last"))
    before = W.partitionBy("url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select("url", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("url", "slice").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("near", F.max(slim).over(inside)).where("not full").join(carried, ["url", "slice"], "left")
    found = found.withColumn("source", F.coalesce("near", "carried")).drop("near", "carried", "slice", "full")
    found = found.unionByName(nameless.drop("full"), allowMissingColumns=True)
    held = rows.where("full").select(F.col("url").alias("held_url"), response.alias("held"))
    held = held.groupBy("held_url", F.col("held.at").alias("held_at"), F.col("held.record_id").alias("held_id")).agg(
        *[F.first(f"held.{c}").alias(f"held_{c}") for c in ("etag", "modified", "headers")]
    )
    joined = found.join(held, (found.url == held.held_url) & (found.source["at"] == held.held_at) & (found.source["record_id"] == held.held_id), "left")
    same = F.when(F.col("etag").isNotNull() & F.col("held_etag").isNotNull(), F.col("etag") == F.col("held_etag")).otherwise(F.col("modified") == F.col("held_modified"))
    state = F.when(F.col("held_id").isNull(), "unresolved").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    return scratch.finish(joined.withColumn("state", state).select(
        "record_id", "url", F.col("held_id").alias("refers_to"), "state", "etag",
        F.when(F.col("state") == "resolved", merge_headers(F.col("held_headers"), F.col("headers"))).alias("headers"),
    ))


def page_records(pages: DataFrame, lag: int = 100) -> DataFrame:
    """Each page as a full response at twice its id, and as a revisit `lag` pages later that carries its validators."""
    base = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), canonical_url(F.col("url")).alias("url"),
        F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("etag"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"),
    )
    kinds = F.array(F.lit(True), F.lit(False))
    rows = base.withColumn("full", F.explode(kinds))
    headers = F.when(F.col("full"), F.create_map(F.lit("content-length"), F.col("size"), F.lit("date"), F.col("page_id").cast("string"), F.lit("server"), F.lit("a")))
    headers = headers.otherwise(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") + lag).cast("string")))
    return rows.select(
        F.col("page_id").alias("record_id"), "url", F.when(F.col("full"), 2 * F.col("page_id")).otherwise(2 * (F.col("page_id") + lag) + 1).alias("at"),
        "full", "etag", F.lit(None).cast("string").alias("modified"), headers.alias("headers"),
    )
