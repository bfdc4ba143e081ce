"""WARC: not-modified revisits resolved to the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, keep

#: Headers of a not-modified response that replace the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Buckets of time of the as-of join: a URL's captures are looked through bucket by bucket, in as many tasks.
BUCKETS = 64


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port or user part, a path, query parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), "^.*@", "")
    host = F.when((scheme == "http") & host.endswith(":80") | (scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":[0-9]+$", "")).otherwise(host)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def as_of(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds found: (ts, id, etag, modified, tag) of the latest full response before each record of (id, key, ts, full, etag, modified, tag).

    Within a bucket of time a window looks back; for what came before the bucket, the last response of each of the
    key's earlier buckets is enough, at most ``buckets`` rows a key. Buckets end at quantiles of all times, so a key
    that holds a third of all records is spread over a third of the buckets at least, wherever outliers lie; only
    records of one key and one time stay together.
    """
    cuts = sorted(set(records.approxQuantile("ts", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    bucket = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("ts")))
    rows = records.withColumn("bucket", bucket)
    mine = F.when(F.col("full"), F.struct("ts", "id", "etag", "modified", "tag"))
    inside = Window.partitionBy("key", "bucket").orderBy("ts", "id", "etag", "modified", "tag").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(mine, ignorenulls=True).over(inside))
    last = records.withColumn("bucket", bucket).groupBy("key", "bucket").agg(F.max(mine).alias("top"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("key", "bucket", F.last("top", ignorenulls=True).over(before).alias("far"))
    return rows.join(last, ["key", "bucket"]).withColumn("found", F.coalesce("near", "far")).drop("bucket", "near", "far")


def resolve(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", kind_col: str = "kind", headers_col: str = "headers", payload_col: str = "payload") -> DataFrame:
    """One row per record: id, url_key, status, resolved_id, headers, payload.

    ``kind`` is response (a full one) or revisit (not modified); ``ts`` a whole number; headers a map with
    lower-case names. A revisit goes to the latest earlier (ts, then id) response of its canonical URL. Its
    entity tag, compared weakly, must equal the response's; without one its last-modified date must; without
    either it is taken as it is. status: full, resolved, unvalidated, mismatch or missing. Resolved revisits carry the
    response's payload and its headers with the permitted ones of the revisit in place; others keep their own headers
    and no payload. Null URLs, times and kinds resolve to nothing; null headers are empty; an empty table gives no
    rows. Rows that share an id are records of their own: none is lost or repeated, and a revisit takes the
    payload of the very response that was found. Other columns are not read.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base = records.select(col(id_col).alias("id"), col(url_col).alias("url"), col(time_col).cast("long").alias("ts"), F.coalesce(col(kind_col) == "response", F.lit(False)).alias("full"), F.coalesce(col(headers_col), none).alias("headers"), col(payload_col).alias("payload"))
    # What tells a response from others of its id and time; rows equal in this too have the same contents.
    tag = F.when(F.col("full"), F.xxhash64("url", "payload", F.array_sort(F.map_entries("headers"))))
    slim = base.select("id", canonical(F.col("url")).alias("url_key"), "ts", "full", _etag(F.col("headers")).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("modified"), tag.alias("tag"), F.when(~F.col("full"), F.col("headers")).alias("headers"))
    # A record without URL or time meets nothing.
    lone = F.col("url_key").isNull() | F.col("ts").isNull()
    got = as_of(slim.where(~lone).withColumn("key", F.col("url_key"))).where("not full")
    same = F.when(F.col("etag").isNotNull(), F.col("etag").eqNullSafe(F.col("found.etag"))).when(F.col("modified").isNotNull(), F.col("modified").eqNullSafe(F.col("found.modified")))
    status = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    got = got.select("id", "url_key", status.alias("status"), "headers", F.when(status.isin("resolved", "unvalidated"), F.col("found")).alias("found"))
    alone = slim.where(lone & ~F.col("full")).select("id", "url_key", F.lit("missing").alias("status"), "headers", F.lit(None).cast(got.schema["found"].dataType).alias("found"))
    asked = keep(got.unionByName(alone), "revisit-asked")
    fulls = F.col("full")
    empty = F.lit(None).cast(base.schema["id"].dataType)
    # Full responses pass straight through, and so does what resolves to nothing; payloads are shuffled once, for the rest.
    whole = base.where(fulls).select(F.col("id").alias(id_col), canonical(F.col("url")).alias("url_key"), F.lit("full").alias("status"), empty.alias("resolved_id"), "headers", "payload")
    lost = asked.where("found is null").select(F.col("id").alias(id_col), "url_key", "status", empty.alias("resolved_id"), "headers", F.lit(None).cast(base.schema["payload"].dataType).alias("payload"))
    on = ["resolved_id", "f_ts", "f_tag"]
    responses = base.where(fulls).select(F.col("id").alias("resolved_id"), F.col("ts").alias("f_ts"), tag.alias("f_tag"), F.col("headers").alias("stored"), "payload")
    met = asked.where("found is not null").select("id", "url_key", "status", "headers", F.col("found.id").alias("resolved_id"), F.col("found.ts").alias("f_ts"), F.col("found.tag").alias("f_tag"))
    met = met.join(responses.dropDuplicates(on), on)
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    found = met.select(F.col("id").alias(id_col), "url_key", "status", "resolved_id", merged.alias("headers"), "payload")
    return whole.unionByName(lost).unionByName(found)
