"""Reads from offsets: many read requests against streams and their messages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import effective_offset, etag, expired, is_json, json_body, offset_position, read_error, response_cursor
from ..schema import CURSOR_INTERVAL


def resolved(reads: DataFrame, streams: DataFrame, strict: bool = False) -> DataFrame:
    """reads with their stream's tail and settings, the error of their parameters, and the effective offset.

    A stream that has expired at a read's as_of isn't found; a read without as_of asks of no time."""
    reads = with_nulls(reads, live="string", cursor="string", if_none_match="string", jitter_seconds="int", as_of="timestamp", n_offsets="int")
    known = with_nulls(streams, created_at="timestamp", ttl_seconds="long", expires_at="string")
    known = known.select("path", F.col("current_offset").alias("tail"), "content_type", "closed", F.struct("created_at", "ttl_seconds", "expires_at").alias("_life"))
    rows = reads.join(known, "path", "left")
    gone = expired("_life.created_at", "_life.ttl_seconds", "_life.expires_at", "as_of", strict)
    rows = rows.withColumn("tail", F.when(~gone, F.col("tail"))).drop("_life")
    after = F.when(F.col("tail").isNotNull(), effective_offset("offset", "tail"))
    return rows.withColumn("error", read_error("offset", "live", F.coalesce("n_offsets", F.lit(1)))).withColumn("after", after)


def with_nulls(df: DataFrame, **kinds: str) -> DataFrame:
    """df with these columns, null where it hasn't got them."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns})


def counted(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """rows with n, bytes and last of the messages past `after`, from running sums of each stream.

    Reads are merged into their stream's messages in order of offsets, so that a stream with many of both
    costs their sum and not their product. Rows hold no payloads."""
    m = messages.select("path", F.col("offset").alias("_at"), F.lit(0).alias("_kind"), F.col("nbytes").cast("long").alias("_n"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    r = rows.select("path", F.col("after").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"), F.struct("*").alias("_row"))
    upto = Window.partitionBy("path").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("path")
    is_message = (F.col("_kind") == 0).cast("long")
    merged = m.unionByName(r).withColumns({"_bytes": F.sum("_n").over(upto), "_count": F.sum(is_message).over(upto)})
    merged = merged.withColumns({"_bytes": F.sum("_n").over(whole) - F.col("_bytes"), "_count": F.sum(is_message).over(whole) - F.col("_count"), "_last": F.max(F.when(F.col("_kind") == 0, F.col("_at"))).over(whole)})
    some = F.col("_at").isNotNull()
    found = F.when(some, F.col("_count")).otherwise(0), F.when(some, F.col("_bytes")).otherwise(0), F.when(some & (F.col("_count") > 0), F.col("_last"))
    return merged.filter("_kind = 1").select("_row.*", *(c.alias(name) for c, name in zip(found, ("n", "bytes", "last"))))


def matched(rows: DataFrame, messages: DataFrame, body: bool = False) -> DataFrame:
    """rows with n, bytes and last of the messages past `after`; body: their payloads in order too, as text.

    Bodies need a join by path, with the offsets' order as a residual condition; messages' offsets are
    stored, so a constant offset reaches the scan. Without bodies, running sums do."""
    if not body:
        return counted(rows, messages)
    m = messages.select(F.col("path").alias("_path"), F.col("offset").alias("_end"), "nbytes", "data")
    joined = rows.join(m, (F.col("path") == F.col("_path")) & (F.col("_end") > F.col("after")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("_end").isNotNull(), F.struct("_end", F.col("data").cast("string").alias("t")))))
    text = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    return joined.groupBy(*rows.columns).agg(F.count("_end").alias("n"), F.coalesce(F.sum("nbytes"), F.lit(0)).cast("long").alias("bytes"), F.max("_end").alias("last"), text.alias("body"))


def read_outcomes(reads: DataFrame, streams: DataFrame, messages: DataFrame, body: bool = False, interval: int = CURSOR_INTERVAL, strict: bool = False) -> DataFrame:
    """The answer to each read: http_status, n, bytes, next_offset, closed, up_to_date, cursor, etag, and body where asked for.

    Streams that have expired at as_of aren't found. Long polls are answered as after a wait in which nothing
    came; answers to those in which something did are reads after it, from the same offset, and a stream that
    is deleted during a wait isn't found by them."""
    rows = matched(resolved(reads, streams, strict), messages, body)
    found = F.col("tail").isNotNull()
    good = found & F.col("error").isNull()
    polls, sse = F.coalesce(F.col("live") == "long-poll", F.lit(False)), F.coalesce(F.col("live") == "sse", F.lit(False))
    now = F.coalesce(F.col("offset") == "now", F.lit(False))
    empty_now = good & now & ~polls & ~sse
    caught_up = (now & (F.col("n") == 0)) | F.coalesce(F.col("after") == F.col("tail"), F.lit(False))
    waits = good & polls & caught_up & (F.col("n") == 0)
    answer = F.when(waits, F.when(F.col("closed"), F.col("tail")).otherwise(F.coalesce(F.when(F.col("after") != "", F.col("after")), F.col("tail")))).otherwise(F.coalesce("last", "tail"))
    rows = rows.withColumn("next_offset", F.when(good, answer))
    at_tail = F.col("next_offset") == F.col("tail")
    closed = F.col("closed") & (at_tail | empty_now | waits)
    tag = etag("path", "offset", "next_offset", closed)
    plain = good & ~waits & ~empty_now & ~sse
    rows = rows.withColumn("etag", F.when(plain, tag)).withColumn("closed_at_tail", F.when(good, closed))
    same = F.col("etag").isNotNull() & F.coalesce(F.col("if_none_match") == F.col("etag"), F.lit(False))
    status = F.when(~found, 404).when(F.col("error").isNotNull(), 400).when(waits, 204).when(same, 304).otherwise(200)
    rows = rows.withColumn("http_status", status)
    cursor = F.when(good & polls & ~(waits & F.col("closed")), response_cursor("cursor", "as_of", "jitter_seconds", interval))
    out = ["req_id", "path", "http_status", F.col("n"), F.col("bytes"), "next_offset", F.col("closed_at_tail").alias("closed"), F.when(good, F.lit(True)).alias("up_to_date"), cursor.alias("next_cursor"), "etag"]
    if body:
        text = F.when(is_json("content_type"), json_body("body")).otherwise(F.col("body"))
        out.append(F.when(F.col("http_status") == 200, F.when(empty_now, F.when(is_json("content_type"), "[]").otherwise("")).otherwise(text)).alias("body"))
    return rows.select(*out)


def response_bodies(messages: DataFrame, json: Column | bool = False) -> DataFrame:
    """path and body: every stream's payloads in order; JSON streams' as an array."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col("data").cast("string").alias("t"))))
    text = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    flag = F.lit(json) if isinstance(json, bool) else json
    return messages.groupBy("path").agg(text.alias("body")).withColumn("body", F.when(flag, json_body("body")).otherwise(F.col("body")))


def chunked(messages: DataFrame, limit: int, start: Column | int = 0) -> DataFrame:
    """Messages of a partial answer from position start on: those whose bytes, with all before them, stay within limit; the first always.

    Offsets are positions, so this is a filter."""
    end, since = offset_position("offset"), F.lit(start) if isinstance(start, int) else start
    return messages.filter((end > since) & ((end - since <= limit) | (end - F.col("nbytes") <= since)))
