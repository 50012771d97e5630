"""Request logs derived from the test tables, in DataFrame operations; catalog.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import offset_text
from ..functions.jsoncanon import canonical
from ..operators.offsets import tails, with_offsets

AS_OF = "2024-11-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation a stream of text, a turn a message."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("ingest_seq"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("nbytes"), "role")
    return with_offsets(rows)


def conversation_streams(messages: DataFrame) -> DataFrame:
    """Closed where the last turn is the assistant's."""
    s = messages.groupBy("path").agg(F.max("offset").alias("current_offset"), (F.max_by("role", "ingest_seq") == "assistant").alias("closed"))
    return s.select("path", "current_offset", F.lit("text/plain").alias("content_type"), "closed")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type and user a JSON stream, an event a message in canonical form."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("ingest_seq"), canonical(F.col("props")).cast("binary").alias("data"))
    return with_offsets(rows.withColumn("nbytes", F.octet_length("data").cast("long")))


def reads(streams: DataFrame) -> DataFrame:
    """Eight read requests for each stream with a number as its path: every kind of offset, live modes and cursors mixed in."""
    p = F.col("path").cast("long")
    k = F.col("k")
    offset = F.when(k == 1, "-1").when(k == 2, "now").when(k == 3, offset_text(p * 37 % 1500)).when(k == 4, "0_0").when(k == 5, offset_text(F.lit(10**12))).when(k == 6, "").when(k == 7, "abc")
    live = F.when(p % 3 == 1, "long-poll").when(p % 3 == 2, "x")
    cursor = F.when(p % 4 == 1, "abc").when(p % 4 == 2, "10").when(p % 4 == 3, "99999999")
    rows = streams.select("path").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    as_of = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) + p)
    return rows.select((p * 8 + k).alias("req_id"), "path", "k", offset.alias("offset"), live.alias("live"), cursor.alias("cursor"), as_of.alias("as_of"), (p % 3600 + 1).cast("int").alias("jitter_seconds"))


def _variants(base: DataFrame, keep: list[str]) -> DataFrame:
    """Base requests and the retries, gaps, zombies, bad restarts and unknown producers that follow some of them."""
    e, s, i, who = F.col("n") - F.col("n") % 10, F.col("n") % 10, F.col("event_id"), F.col("user_id").cast("string")
    epoch = (e / 10).cast("long")

    def one(when: Column, producer: Column, epoch_: Column, seq: Column, step: int) -> Column:
        return F.when(when, F.struct((i * 8 + step).alias("ingest_seq"), producer.alias("producer_id"), epoch_.cast("long").alias("epoch"), seq.cast("long").alias("seq")))

    each = F.array(
        one(F.lit(True), who, epoch, s, 0), one(i % 7 == 0, who, epoch, s, 1), one(i % 13 == 0, who, epoch, s + 5, 2), one((i % 17 == 0) & (epoch > 0), who, epoch - 1, s, 3),
        one(i % 19 == 0, who, epoch + 1, F.lit(1), 4), one(i % 23 == 0, F.concat(F.lit("late-"), who), F.lit(0), F.lit(3), 5),
    )
    return base.select(*keep, F.inline(F.filter(each, lambda x: x.isNotNull())))


def _numbered(events: DataFrame) -> DataFrame:
    own = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    return events.withColumn("n", F.row_number().over(own) - 1)


def producer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, producer_id, ingest_seq, epoch, seq, ts: streams are event types, producers users."""
    base = _numbered(table(spark, sf_dir, "events").withColumn("path", F.col("event_type")))
    return _variants(base, ["path", F.col("ts").cast("timestamp").alias("ts")])


def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append requests with sequence texts, wrong types, bad bodies, closures and partial headers."""
    bucket = F.col("user_id") % 25
    base = _numbered(table(spark, sf_dir, "events")).withColumn("path", F.concat_ws("/", "event_type", bucket.cast("string"))).withColumn("bucket", bucket)
    rows = _variants(base, ["path", "event_id", "bucket", "props", F.col("ts").cast("timestamp").alias("ts")])
    order = Window.partitionBy("path").orderBy("ingest_seq")
    rows = rows.withColumn("o", F.row_number().over(order)).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("path")) - F.col("o"))
    rows = rows.withColumn("before", F.lag(F.struct("producer_id", "epoch", "seq")).over(order))
    i, early = F.col("event_id"), F.col("left") > 2
    repeat = F.col("left") == 1
    whole = ~early | (i % 53 != 0)
    value = lambda c: F.when(whole, F.when(repeat, F.col(f"before.{c}")).otherwise(F.col(c)).cast("string"))
    return rows.select(
        "ingest_seq", "path",
        F.when(i % 31 == 0, "text/plain").otherwise("application/json; charset=utf-8").alias("content_type"),
        F.when(i % 5 == 0, F.format_string("%08d", "o")).when(i % 29 == 0, F.format_string("%08d", F.greatest(F.col("o") - 10, F.lit(0)))).alias("stream_seq"),
        F.when(F.col("left") == 2, "true").when(i % 11 == 0, "TRUE").alias("stream_closed"),
        value("producer_id").alias("producer_id"), value("epoch").alias("producer_epoch"),
        F.when(~early | (i % 43 != 0), value("seq")).alias("producer_seq"),
        F.when((F.col("left") == 2) & (F.col("bucket") % 2 == 0), F.lit(None)).when(early & (i % 37 == 0), "[]").when(early & (i % 41 == 0), "{").when(early & (i % 47 == 0), "").otherwise(F.col("props")).cast("binary").alias("body"),
        "ts",
    )


def append_streams(log: DataFrame) -> DataFrame:
    """The streams of append_log: bucket 24 was never created, bucket 23 lives for 15 days."""
    bucket = F.split_part("path", F.lit("/"), F.lit(2)).cast("int")
    s = log.select("path").distinct().filter(bucket != 24)
    return s.select("path", F.lit("application/json").alias("content_type"), F.lit("0000000000000000_0000000000000000").alias("current_offset"), F.lit(None).cast("string").alias("last_seq"), F.when(bucket == 23, F.lit(15 * 86400)).cast("long").alias("ttl_seconds"), F.lit(None).cast("string").alias("expires_at"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit(False).alias("closed"), F.lit(None).cast("struct<producer_id:string,epoch:bigint,seq:bigint>").alias("closed_by"))


def create_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests from documents: a few per source, with headers of every kind."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "application/json").when(i % 5 == 1, "Application/JSON; v=1").when(i % 5 == 2, "text/plain").when(i % 5 == 3, " ").otherwise("nonsense")
    return d.select(
        i.alias("ingest_seq"), F.concat_ws("/", "source", (i % 50).cast("string")).alias("path"), kind.alias("content_type"),
        F.when(i % 7 == 0, "3600").when(i % 7 == 1, "03600").when(i % 7 == 2, "+1").alias("stream_ttl"),
        F.when(i % 11 == 0, "2025-01-01T00:00:00Z").when(i % 11 == 1, "soon").alias("stream_expires_at"),
        F.when(i % 3 == 0, "true").when(i % 3 == 1, "TRUE").alias("stream_closed"),
        F.when(i % 13 == 0, "[]").when(i % 13 == 1, '[1, {"a": 2}]').when(i % 13 == 2, "{").cast("binary").alias("body"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
    )


__all__ = ["append_log", "append_streams", "conversation_messages", "conversation_streams", "create_log", "event_messages", "producer_log", "reads", "table", "tails"]
