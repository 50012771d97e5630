"""Byte offsets of messages: a running sum per stream, two-level so that one hot stream isn't one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import offset_text, tail_or_start
from ..schema import START

#: Rows of one stream that are summed in one task, as a span of ingest_seq.
SPAN = 1 << 20


def with_offsets(messages: DataFrame, span: int = SPAN) -> DataFrame:
    """messages (path, ingest_seq, nbytes, ...) with `offset`, the position after each message.

    Bytes are summed per span of ingest_seq, the spans per stream, and only then the rows of a span."""
    rows = messages.withColumn("_span", F.floor(F.col("ingest_seq") / span))
    sums = rows.groupBy("path", "_span").agg(F.sum("nbytes").alias("_bytes"))
    earlier = Window.partitionBy("path").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("path", "_span", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("path", "_span").orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(bases, ["path", "_span"])
    return joined.withColumn("offset", offset_text(F.col("_base") + F.sum("nbytes").over(inside))).drop("_span", "_base")


def with_starts(messages: DataFrame) -> DataFrame:
    """messages with offsets, and `start`, the position before each: its end less its size, so no order is needed."""
    end = F.split_part("offset", F.lit("_"), F.lit(2)).cast("long")
    return messages.withColumn("start", offset_text(end - F.col("nbytes")))


def tails(streams: DataFrame, messages: DataFrame) -> DataFrame:
    """path and current_offset of every stream; that of an empty one is the start."""
    last = messages.groupBy("path").agg(F.max("offset").alias("current_offset"))
    return streams.select("path").join(last, "path", "left").select("path", tail_or_start("current_offset").alias("current_offset"))


EMPTY_TAIL = START
