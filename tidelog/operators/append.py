"""Appends and closes over whole request logs: each stream's requests in order, in bounded memory.

Requests are hashed by path and sorted within partitions; one pass per partition keeps the state of one
stream at a time, so a stream of any length is folded without being gathered. A stream's order is the
semantics, so one stream is one task; streams are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OUTCOMES, START
from .transition import Outcome, Request, StreamState, apply

COLUMNS = ["path", "ingest_seq", "status", "http_status", "next_offset", "closed", "producer_epoch", "producer_seq", "expected_seq", "received_seq", "stored"]


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _number(x: object) -> int | None:
    return None if x is None or x != x else int(x)


def state_of(r) -> StreamState:
    """From a row of kind 0."""
    by = None if _text(r.by_id) is None else (r.by_id, _number(r.by_epoch), _number(r.by_seq))
    return StreamState(True, _text(r.content_type), _text(r.current_offset) or START, _text(r.stream_seq), bool(r.closed), by, r.at, _number(r.ttl_seconds), _text(r.expires_at))


def request_of(r) -> Request:
    """From a row of kind 2."""
    body = bytes(r.body) if isinstance(r.body, (bytes, bytearray, memoryview)) else b""
    return Request(_text(r.content_type), _text(r.stream_seq), _text(r.stream_closed), _text(r.producer_id), _text(r.producer_epoch), _text(r.producer_seq), body, r.at)


def requests_of(frame: pd.DataFrame) -> Iterator[tuple[int, Request]]:
    """The number and request of each row of kind 2, without a tuple of all columns in between."""
    texts = ([_text(x) for x in frame[c]] for c in ("content_type", "stream_seq", "stream_closed", "producer_id", "producer_epoch", "producer_seq"))
    bodies = [bytes(x) if isinstance(x, (bytes, bytearray, memoryview)) else b"" for x in frame["body"]]
    return zip(frame["ingest_seq"].tolist(), map(Request, *texts, bodies, frame["at"].tolist()))


def outcome_frame(rows: list[tuple]) -> pd.DataFrame:
    """Numbers go from Python to 64 bits at once: by way of floats, large ones beside nulls would change."""
    longs = dict.fromkeys(["ingest_seq", "producer_epoch", "producer_seq", "expected_seq", "received_seq"], "Int64")
    kinds = longs | {"http_status": "int32", "closed": bool}
    columns = zip(*rows) if rows else ((),) * len(COLUMNS)
    return pd.DataFrame({c: pd.Series(pd.array(x, dtype=kinds[c]) if c in longs else x, dtype=kinds.get(c, object)) for c, x in zip(COLUMNS, map(list, columns))})


def outcome_row(path: str, ingest_seq: int, o: Outcome) -> tuple:
    return (path, ingest_seq, o.status, o.http_status, o.next_offset, o.closed, o.producer_epoch, o.producer_seq, o.expected_seq, o.received_seq, o.stored)


def _fold(strict: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, state = None, StreamState()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.path != path:
                    path, state = r.path, StreamState()
                if r.kind == 0:
                    state = state_of(r)
                elif r.kind == 1:
                    state.producers[r.producer_id] = (int(r.producer_epoch), int(r.producer_seq), r.at)
                else:
                    out.append(outcome_row(path, r.ingest_seq, apply(state, request_of(r), strict)))
            yield outcome_frame(out)

    return run


def events_of(requests: DataFrame, streams: DataFrame, producers: DataFrame | None) -> DataFrame:
    """Streams, what is known of producers, and requests, as rows of one shape."""
    at = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6).alias("at")
    nothing = {"kind": "0", "ingest_seq": "cast(0 as bigint)", "current_offset": "cast(null as string)", "closed": "false", "by_id": "cast(null as string)", "by_epoch": "cast(null as bigint)", "by_seq": "cast(null as bigint)", "ttl_seconds": "cast(null as bigint)", "expires_at": "cast(null as string)", "content_type": "cast(null as string)", "stream_seq": "cast(null as string)", "stream_closed": "cast(null as string)", "producer_id": "cast(null as string)", "producer_epoch": "cast(null as string)", "producer_seq": "cast(null as string)", "body": "cast(null as binary)"}

    def shaped(df: DataFrame, **own) -> DataFrame:
        return df.select("path", own.pop("at"), *(own.get(k, F.expr(v)).alias(k) for k, v in nothing.items()))

    s = shaped(streams, at=at("created_at"), content_type=F.col("content_type"), current_offset=F.col("current_offset"), stream_seq=F.col("last_seq"), ttl_seconds=F.col("ttl_seconds"), expires_at=F.col("expires_at"), closed=F.coalesce("closed", F.lit(False)), by_id=F.col("closed_by.producer_id"), by_epoch=F.col("closed_by.epoch"), by_seq=F.col("closed_by.seq"))
    r = shaped(requests, at=at("ts"), kind=F.lit(2), ingest_seq=F.col("ingest_seq"), **{c: F.col(c) for c in ("content_type", "stream_seq", "stream_closed", "producer_id", "producer_epoch", "producer_seq", "body")})
    every = s.unionByName(r)
    if producers is not None:
        every = every.unionByName(shaped(producers, at=at("last_updated"), kind=F.lit(1), producer_id=F.col("producer_id"), producer_epoch=F.col("epoch").cast("string"), producer_seq=F.col("last_seq").cast("string")))
    return every


def append_outcomes(requests: DataFrame, streams: DataFrame, producers: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The outcome of each request (see schema.OUTCOMES), given the streams and producer states before them."""
    rows = events_of(requests, streams, producers).repartition("path").sortWithinPartitions("path", "kind", "ingest_seq")
    return rows.mapInPandas(_fold(strict), OUTCOMES)


def messages_of(outcomes: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The messages that the outcomes stored: path, ingest_seq, data, nbytes, offset."""
    kept = outcomes.filter("status = 'accepted' and stored is not null")
    return kept.select("path", "ingest_seq", F.col("stored").alias("data"), F.octet_length("stored").alias("nbytes"), F.col("next_offset").alias("offset"))


def streams_after(streams: DataFrame, outcomes: DataFrame) -> DataFrame:
    """streams with the tails and closures that the outcomes left."""
    last = outcomes.groupBy("path").agg(F.max(F.when(F.col("status") == "accepted", F.col("next_offset"))).alias("_tail"), F.max("closed").alias("_closed"))
    joined = streams.join(last, "path", "left")
    return joined.withColumn("current_offset", F.coalesce("_tail", "current_offset")).withColumn("closed", F.coalesce("_closed", F.lit(False)) | F.col("closed")).drop("_tail", "_closed")
