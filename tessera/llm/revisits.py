"""Resolving not-modified revisits of web archives, in DataFrame operations.

A revisit (status 304) is joined as of its time to the latest earlier full response (status 200) of the
same canonical URL; its validators are compared and the headers that a 304 may update are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

# The header fields that a 304 response may carry to update a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, then path and query.

    Scheme, fragment, query parameters whose names begin with ``utm_``, a query that is then empty, and a
    closing slash are left out. A URL without a scheme begins with its host. Null stays null.
    """
    host = F.lower(F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)?[^/?#]*", ""), r"#.*$", "")
    path, query = F.substring_index(rest, "?", 1), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_")), "&")
    kept = F.regexp_replace(kept, r"&+$", "")
    return F.concat(host, F.when(kept == "", F.regexp_replace(path, r"/$", "")).otherwise(F.concat(path, F.lit("?"), F.regexp_replace(kept, r"/$", ""))))


def opaque(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per revisit: record_id, target_id, verdict, headers.

    ``records`` has record_id long, url string, ts long, status int, headers map<string, string> (names in
    any case). Earlier means a smaller (ts, record_id). ``verdict`` is ``resolved`` (a validator agrees:
    the entity tag by weak comparison if the revisit has one, else Last-Modified), ``mismatch``,
    ``unverified`` (the revisit has no validator) or ``no_response`` (no earlier one, or the URL is
    null). ``target_id`` is the response found, if any; ``headers`` has its headers with the permitted
    ones of the revisit over them if resolved, else the revisit's own. Null headers count as none, other
    statuses are passed over. Rows with equal (ts, record_id) are not earlier than one another. Extra
    columns are not carried: payloads stay in place and are never shuffled.

    The rows are range-partitioned by (URL, ts, record_id), so a URL with a third of all rows is spread
    evenly. A partition looks up responses within itself; what its first URL needs from before comes from
    a table with one row for each partition.
    """
    url, names = canonical_url(F.col("url")), lambda h: F.map_entries(F.coalesce(h, F.create_map().cast("map<string,string>")))
    lower = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(names(F.col("headers")), lambda e: F.lower(e["key"]))),
            lambda k: F.struct(k, F.filter(names(F.col("headers")), lambda e: F.lower(e["key"]) == k)[0]["value"]),
        )
    )
    rows = records.filter(F.col("status").isin(200, 304)).select("record_id", url.alias("url"), "ts", "status", lower.alias("headers"))
    lost = rows.filter("url IS NULL AND status = 304")
    rows = rows.filter("url IS NOT NULL")
    keys = ["url", "ts", "record_id"]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "revisits")
    response = F.when(F.col("status") == 200, F.struct("ts", "record_id", "headers"))
    # One row per partition: its first URL, and the last response of its last URL.
    place = F.struct("url", "ts", "record_id")
    edge = ranged.groupBy("part").agg(F.min("url").alias("first"), F.max("url").alias("last"), F.max(F.when(F.col("status") == 200, place)).alias("best"))
    edges = sorted(edge.collect(), key=lambda r: r["part"])
    carried, seen = [], {}
    for e in edges:
        if e["first"] in seen:
            carried.append((e["part"], e["first"], *seen[e["first"]]))
        best = e["best"]
        if best is not None and best["url"] == e["last"]:
            seen = {e["last"]: (best["ts"], best["record_id"])}
        elif e["last"] not in seen:
            seen = {}
    spark = records.sparkSession
    before = spark.createDataFrame(carried, "part int, url string, c_ts long, c_id long")  # one row per partition at most
    head = ranged.filter("status = 200").select("url", F.col("ts").alias("c_ts"), F.col("record_id").alias("c_id"), "headers")
    before = before.join(head, ["url", "c_ts", "c_id"]).dropDuplicates(["part"])
    before = before.select("part", "url", F.struct(F.col("c_ts").alias("ts"), F.col("c_id").alias("record_id"), "headers").alias("carried"))
    # Of rows with equal (ts, record_id) the revisits come first.
    order = Window.partitionBy("part", "url").orderBy("ts", "record_id", F.col("status").desc())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("_here", F.last(response, ignorenulls=True).over(so_far))
    found = found.filter("status = 304").join(before, ["part", "url"], "left")
    target = F.coalesce("_here", "carried")
    found = found.select("record_id", "headers", target.alias("target")).unionByName(
        lost.select("record_id", "headers", F.lit(None).cast(found.select(target.alias("t")).schema["t"].dataType).alias("target"))
    )
    mine, theirs = F.col("headers"), F.col("target.headers")
    tag, date = mine["etag"], mine["last-modified"]
    agrees = F.when(tag.isNotNull(), opaque(tag) == opaque(theirs["etag"])).when(date.isNotNull(), F.trim(date) == F.trim(theirs["last-modified"]))
    verdict = (
        F.when(F.col("target").isNull(), "no_response").when(tag.isNull() & date.isNull(), "unverified").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    )
    fresh = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    stale = F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return found.select(
        "record_id", F.col("target.record_id").alias("target_id"), verdict.alias("verdict"), F.when(verdict == "resolved", F.map_concat(stale, fresh)).otherwise(mine).alias("headers")
    )
