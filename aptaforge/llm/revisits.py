"""Operator 2: resolving WARC revisit records to earlier full responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aptaforge.llm.common import join_on, ranged

#: Headers that a not-modified record may not change: they describe the stored body or one connection.
FIXED_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Query parameters that name no resource.
TRACKING = r"(^|&)(utm_[^&=]*|fbclid|gclid|ref)=[^&]*"


def canonical_url(url: str = "url") -> Column:
    """Host in lower case without www. or m., path without a last slash, query sorted and without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.col(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), TRACKING, ""), "^&", "")
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with the full response that it stands for.

    ``records``: record_id, url, warc_date (long), record_type ("response" or "revisit"), status, etag,
    last_modified, payload_digest, headers (map of lower-case names). A revisit refers to the
    latest response of status 200 of its canonical URL that comes before it by (warc_date, record_id).
    Validators decide in this order, the first that both have: etag (weak comparison), last_modified, payload digest.

    Adds canonical_url, resolved_id, resolved_digest, verdict and merged_headers. verdict: ``full`` (a response, which stands for
    itself), ``match``, ``mismatch`` (validators differ: not resolved), ``unverified`` (no common validator: resolved),
    ``missing`` (no earlier response). Merged headers are the response's, updated by the revisit's except for FIXED_HEADERS.

    The as-of join range-partitions by (URL, date), looks back within each slice, and carries the
    last response of a URL over from the slices before, so a URL with any share of the rows is
    never in one task. Null URLs form no URL: their revisits are ``missing``. Rows with a null date come last in
    their URL. A record of any other type, or of none, stands for itself. Null headers are none. Repeated rows each get a result. Extra columns pass
    through whatever their names, but for those that are added here, which are replaced. An empty table gives no rows.
    """
    extra = [c for c in records.columns if c not in ("canonical_url", "resolved_id", "resolved_digest", "verdict", "merged_headers")]
    order = ["canonical_url", "doc.warc_date", "doc.record_id"]
    rows = ranged(records.select(F.struct(*extra).alias("doc"), canonical_url().alias("canonical_url")), order, "revisit-ranged")
    by = [F.col(c).asc_nulls_last() for c in order[1:]]
    own = {c: F.col(f"doc.{c}") for c in ("record_id", "warc_date", "record_type", "status", "etag", "last_modified", "payload_digest", "headers")}
    full = (own["record_type"] == "response") & (own["status"] == 200)
    response = F.struct(*[own[c].alias(c) for c in ("record_id", "etag", "last_modified", "payload_digest", "headers")])
    slice_ = Window.partitionBy("canonical_url", "_part").orderBy(*by)
    local = rows.withColumn("_here", F.last(F.when(full, response), ignorenulls=True).over(slice_.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.struct(own["warc_date"].isNull().alias("n"), own["warc_date"].alias("d"), own["record_id"].isNull().alias("m"), own["record_id"].alias("i"))
    last = rows.filter(full).groupBy("canonical_url", "_part").agg(F.max_by(response, place).alias("_last"))
    slices = join_on(rows.select("canonical_url", "_part").distinct(), last, ["canonical_url", "_part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("canonical_url", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    out = join_on(local, slices, ["canonical_url", "_part"])
    out = out.withColumn("_r", F.when(F.col("canonical_url").isNotNull(), F.coalesce("_here", "_carried")))
    r = F.col("_r")
    checks = F.coalesce(strong(own["etag"]) == strong(r["etag"]), own["last_modified"] == r["last_modified"], own["payload_digest"] == r["payload_digest"])
    is_full = ~own["record_type"].eqNullSafe(F.lit("revisit"))
    verdict = (
        F.when(is_full, "full").when(r.isNull(), "missing").when(checks.isNull(), "unverified").when(checks, "match").otherwise("mismatch")
    )
    empty = F.create_map().cast("map<string,string>")
    mine, stored = F.coalesce(own["headers"], empty), F.coalesce(r["headers"], empty)
    changes = F.map_filter(mine, lambda k, _: ~k.isin(FIXED_HEADERS))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(changes), k)), changes)
    resolved = F.col("_verdict").isin("match", "unverified")
    found = F.struct(
        "canonical_url",
        F.when(is_full, own["record_id"]).when(resolved, r["record_id"]).alias("resolved_id"),
        F.when(is_full, own["payload_digest"]).when(resolved, r["payload_digest"]).alias("resolved_digest"),
        F.col("_verdict").alias("verdict"),
        F.when(is_full, mine).when(resolved, merged).alias("merged_headers"),
    )
    return out.withColumn("_verdict", verdict).select("doc", found.alias("found")).select("doc.*", "found.*")
