"""Creation, lookup, listing, metadata, deletion and expiry of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import accepted_type, closes, etag, expired, is_json, media_type, offset_text, ttl_error
from ..functions.jsoncanon import canonical, canonical_elements
from ..schema import START
from .read import with_nulls


def alive(streams: DataFrame, as_of: Column, strict: bool = False) -> DataFrame:
    """Streams that a lookup at as_of finds; it drops the others."""
    return streams.filter(~expired("created_at", "ttl_seconds", "expires_at", as_of, strict))


def lookup(streams: DataFrame, paths: DataFrame, as_of: Column) -> DataFrame:
    """Rows of streams whose path is in paths and that haven't expired."""
    return alive(streams, as_of).join(paths.select("path").distinct(), "path", "left_semi")


def list_paths(streams: DataFrame) -> DataFrame:
    """Every path, expired streams' too."""
    return streams.select("path")


def delete(streams: DataFrame, paths: DataFrame) -> DataFrame:
    """streams without those of paths."""
    return streams.join(paths.select("path").distinct(), "path", "left_anti")


def delete_outcomes(streams: DataFrame, requests: DataFrame, strict: bool = False) -> DataFrame:
    """204 for the first request for an existing path, else 404; at requests' as_of, if they have one, streams may have expired."""
    first = Window.partitionBy("path").orderBy("ingest_seq")
    joined = _found(streams, requests, strict).withColumn("_k", F.row_number().over(first))
    return joined.select("path", "ingest_seq", F.when(F.col("_found") & (F.col("_k") == 1), 204).otherwise(404).alias("http_status"))


def _found(streams: DataFrame, requests: DataFrame, strict: bool) -> DataFrame:
    """requests with `_found`: whether their stream exists and hasn't expired at their as_of (null or absent: whatever its age)."""
    known = with_nulls(streams, created_at="timestamp", ttl_seconds="long", expires_at="string")
    life = known.select("path", F.struct("created_at", "ttl_seconds", "expires_at").alias("_life"))
    joined = with_nulls(requests, as_of="timestamp").join(life, "path", "left")
    gone = expired("_life.created_at", "_life.ttl_seconds", "_life.expires_at", "as_of", strict)
    return joined.withColumn("_found", F.col("_life").isNotNull() & ~gone).drop("_life")


def head_outcomes(streams: DataFrame, requests: DataFrame, strict: bool = False) -> DataFrame:
    """requests (req_id, path, as_of) with http_status (200, or 404 where the stream is absent or expired) and the metadata of those found."""
    asked = _found(streams, requests, strict).select("req_id", "path", "_found")
    rows = asked.join(head(streams).drop("ttl_seconds", "expires_at"), "path", "left")
    own = (F.when(F.col("_found"), F.col(c)).alias(c) for c in ("next_offset", "content_type", "closed", "etag"))
    return rows.select("req_id", "path", F.when(F.col("_found"), 200).otherwise(404).alias("http_status"), *own)


def clear(streams: DataFrame) -> DataFrame:
    return streams.limit(0)


def head(streams: DataFrame) -> DataFrame:
    """Metadata of each stream. TTL and expiry are shown too, beyond what a HEAD answer has."""
    return streams.select("path", F.col("current_offset").alias("next_offset"), "content_type", "closed", etag("path", F.lit("-1"), "current_offset", "closed").alias("etag"), "ttl_seconds", "expires_at")


def create_outcomes(requests: DataFrame, streams: DataFrame | None = None, as_of: Column | None = None, strict: bool = False) -> DataFrame:
    """requests (schema.CREATE_REQUESTS) with status (created, exists, conflict, bad_request, invalid_json) and the stream's settings.

    The first valid request for a free path creates it; later ones match it or not, by media type,
    time to live, expiry text and closure. Bodies count at creation only."""
    kind = accepted_type("content_type")
    bad = ttl_error("stream_ttl", "stream_expires_at")
    body = F.coalesce(F.octet_length("body"), F.lit(0)) > 0
    rows = requests.withColumn("_type", kind).withColumn("_bad", bad)
    rows = rows.withColumn("_json", F.when(is_json("_type") & body & F.col("_bad").isNull(), canonical_elements(F.col("body"))))
    rows = rows.withColumn("_ttl", F.when(F.col("_bad").isNull() & (F.col("stream_ttl") != ""), F.col("stream_ttl").try_cast("long")))
    rows = rows.withColumn("_until", F.when(F.col("stream_expires_at") != "", F.col("stream_expires_at"))).withColumn("_closed", closes("stream_closed", strict))
    wrong_body = is_json("_type") & body & F.col("_json").isNull()
    can = F.col("_bad").isNull() & ~wrong_body
    setting = F.struct(media_type("_type").alias("type"), F.col("_ttl").alias("ttl"), F.col("_until").alias("until"), F.col("_closed").alias("closed"))
    rows = rows.withColumn("_set", setting).withColumn("_can", can)
    if streams is not None:
        old = streams if as_of is None else alive(streams, as_of, strict)
        old = old.select("path", F.struct(media_type("content_type").alias("type"), F.col("ttl_seconds").alias("ttl"), F.col("expires_at").alias("until"), F.col("closed").alias("closed")).alias("_old"))
        rows = rows.join(old, "path", "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast(rows.schema["_set"].dataType))
    firsts = rows.filter("_can").groupBy("path").agg(F.min(F.struct("ingest_seq", "_set")).alias("_first"))
    rows = rows.join(firsts, "path", "left")
    holder = F.coalesce("_old", F.when(F.col("_first.ingest_seq") <= F.col("ingest_seq"), F.col("_first._set")))
    creates = F.col("_old").isNull() & (F.col("_first.ingest_seq") == F.col("ingest_seq"))
    status = F.when(F.col("_bad").isNotNull(), "bad_request").when(creates, "created").when(holder.isNull(), "invalid_json").when(holder.eqNullSafe(F.col("_set")), "exists").otherwise("conflict")
    size = F.when(F.col("_json").isNotNull(), F.aggregate("_json", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)).otherwise(F.coalesce(F.octet_length("body"), F.lit(0)).cast("long"))
    out = rows.withColumn("status", status)
    code = F.when(out["status"] == "created", 201).when(out["status"] == "exists", 200).when(out["status"] == "conflict", 409).otherwise(400)
    return out.select("path", "ingest_seq", "status", code.alias("http_status"), F.col("_type").alias("content_type"), F.when(F.col("status") == "created", F.when(size > 0, offset_text(size)).otherwise(START)).alias("next_offset"), F.when(F.col("status").isin("created", "exists"), F.col("_closed")).alias("closed"), F.col("_ttl").alias("ttl_seconds"), F.col("_until").alias("expires_at"), "ts")


def created(outcomes: DataFrame) -> DataFrame:
    """The streams that create outcomes made (schema.STREAMS)."""
    made = outcomes.filter("status = 'created'")
    return made.selectExpr("path", "content_type", "next_offset as current_offset", "cast(null as string) as last_seq", "ttl_seconds", "expires_at", "ts as created_at", "closed", "cast(null as struct<producer_id:string,epoch:bigint,seq:bigint>) as closed_by")


__all__ = ["alive", "canonical", "clear", "create_outcomes", "created", "delete", "delete_outcomes", "head", "list_paths", "lookup"]
