"""Event-stream framing of messages and control events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import base64_text, control_json, frame, is_json, is_text, json_body, response_cursor
from .read import matched, resolved


def payload(data: Column | str, content_type: Column | str) -> Column:
    """What a data event carries: text as it is, JSON elements as an array, other types in base64. Invalid UTF-8 gives null."""
    d = F.col(data) if isinstance(data, str) else data
    text = F.when(F.is_valid_utf8(d.cast("string")), d.cast("string"))
    return F.when(is_json(content_type), json_body(text)).when(is_text(content_type), text).otherwise(base64_text(d))


def data_frames(messages: DataFrame, content_type: Column | str) -> DataFrame:
    """messages with `frame`, and `error` where the payload can't be text."""
    p = payload("data", content_type)
    return messages.withColumn("_p", p).withColumn("frame", frame("data", "_p")).withColumn("error", F.col("_p").isNull()).drop("_p")


def control_frames(reads: DataFrame) -> DataFrame:
    """One control event per read pass: reads need next_offset, closed, cursor, as_of and jitter_seconds."""
    cursor = response_cursor("cursor", "as_of", "jitter_seconds")
    return reads.withColumn("control", control_json("next_offset", "closed", cursor)).withColumn("frame", frame("control", "control"))


def event_sequence(reads: DataFrame, streams: DataFrame, messages: DataFrame, strict: bool = False) -> DataFrame:
    """req_id, position, event and frame: what one pass of a live read as an event stream sends, in order.

    A data event for each message past the offset, then one control event, which closes where a closed
    stream has been read to its tail. Reads of absent or expired streams, and refused ones, send nothing."""
    asked = resolved(reads.withColumn("live", F.lit("sse")), streams, strict).filter("tail is not null and error is null")
    kind = asked.select("req_id", "path", "after", F.col("content_type").alias("_type"))
    m = messages.select(F.col("path").alias("_path"), F.col("offset").alias("_end"), "data")
    data = kind.join(m, (F.col("path") == F.col("_path")) & (F.col("_end") > F.col("after")))
    data = data_frames(data, "_type").filter("not error").select("req_id", "_end", F.lit("data").alias("event"), "frame")
    ends = matched(asked, messages).withColumn("next_offset", F.coalesce("last", "tail"))
    ends = ends.withColumn("closed", F.col("closed") & (F.col("next_offset") == F.col("tail")))
    control = control_frames(ends).select("req_id", F.lit(None).cast("string").alias("_end"), F.lit("control").alias("event"), "frame")
    order = Window.partitionBy("req_id").orderBy(F.col("_end").asc_nulls_last())
    return data.unionByName(control).select("req_id", F.row_number().over(order).alias("position"), "event", "frame")


def encoding(content_type: Column | str) -> Column:
    """The marker of binary streams."""
    return F.when(~is_text(content_type), "base64")
