"""Outcomes as responses, and what of a request decides where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_text

# Which operation a method asks for, and the constant headers of every response.
ROUTES = {"PUT": "create", "HEAD": "head", "GET": "read", "POST": "append", "DELETE": "delete", "OPTIONS": "preflight"}
COMMON = {
    "access-control-allow-origin": "*",
    "access-control-allow-methods": "GET, POST, PUT, DELETE, HEAD, OPTIONS",
    "access-control-allow-headers": "content-type, authorization, Stream-Seq, Stream-TTL, Stream-Expires-At, Stream-Closed, Producer-Id, Producer-Epoch, Producer-Seq",
    "access-control-expose-headers": "Stream-Next-Offset, Stream-Cursor, Stream-Up-To-Date, Stream-Closed, Producer-Epoch, Producer-Seq, Producer-Expected-Seq, Producer-Received-Seq, etag, content-type, content-encoding, vary",
    "x-content-type-options": "nosniff",
    "cross-origin-resource-policy": "cross-origin",
}


def route(method: Column | str) -> Column:
    """The operation; null: not allowed."""
    m = F.upper(F.col(method) if isinstance(method, str) else method)
    out = F.lit(None).cast("string")
    for name, operation in ROUTES.items():
        out = F.when(m == name, operation).otherwise(out)
    return out


def routed(requests: DataFrame) -> DataFrame:
    """requests (method) with operation and, where that alone decides, http_status: 204 for preflights, 405 for other methods."""
    return requests.withColumn("operation", route("method")).withColumn("http_status", F.when(F.col("operation").isNull(), 405).when(F.col("operation") == "preflight", 204))


def header_value(headers: Column | str, name: str) -> Column:
    """The first value of a header, in whatever case its name is written; headers: array<struct<name, value>> of Latin-1 bytes."""
    h = F.col(headers) if isinstance(headers, str) else headers
    mine = F.filter(h, lambda x: F.lower(F.decode(x["name"], "ISO-8859-1")) == name.lower())
    return F.decode(F.get(mine, 0)["value"], "ISO-8859-1")


def _map(pairs: dict[str, Column]) -> Column:
    """A response's own headers, where they aren't null, and those of every response."""
    pairs = pairs | {k: F.lit(v) for k, v in COMMON.items()}
    every = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*(p.cast("string") for p in pairs.values())))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def preflight_headers(requests: DataFrame) -> DataFrame:
    """routed requests with `headers` of those that their method alone answers: preflights and refused methods."""
    refused = F.when(F.col("http_status") == 405, F.lit("text/plain"))
    return routed(requests).withColumn("headers", F.when(F.col("http_status").isNotNull(), _map({"content-type": refused})))


def head_headers(answers: DataFrame) -> DataFrame:
    """Outcomes of lifecycle.head_outcomes with `headers`."""
    good = F.col("http_status") == 200
    own = {
        "stream-next-offset": F.col("next_offset"),
        "cache-control": F.when(good, F.lit("no-store")),
        "content-type": F.when(good, F.col("content_type")).otherwise(F.lit("text/plain")),
        "stream-closed": F.when(good & F.col("closed"), F.lit("true")),
        "etag": F.col("etag"),
    }
    return answers.withColumn("headers", _map(own))


def append_headers(outcomes: DataFrame, requests: DataFrame) -> DataFrame:
    """outcomes with `headers`, the map of their responses' own headers. requests: they, for what they asked."""
    size = F.coalesce(F.octet_length("body"), F.lit(0)) == 0
    asked = requests.select("path", "ingest_seq", size.alias("_only_close"))
    rows = outcomes.join(asked, ["path", "ingest_seq"])
    status = F.col("status")
    # a request that only closes and that its producer's state calls a duplicate is told "closed", whatever the stream is
    closed = F.when(status.isin("accepted", "duplicate", "stream_closed") & (F.col("closed") | (F.col("_only_close") & (status == "duplicate"))), F.lit("true"))
    own = {
        "stream-next-offset": F.when(status.isin("accepted", "duplicate", "stream_closed"), F.col("next_offset")),
        "stream-closed": closed,
        "producer-epoch": F.col("producer_epoch"),
        "producer-seq": F.col("producer_seq"),
        "producer-expected-seq": F.col("expected_seq"),
        "producer-received-seq": F.col("received_seq"),
        "content-type": F.when(F.col("http_status") >= 400, F.lit("text/plain")),
    }
    return rows.withColumn("headers", _map(own)).drop("_only_close")


def read_headers(answers: DataFrame) -> DataFrame:
    """Read outcomes with `headers`; a 304 has its ETag alone."""
    good = F.col("http_status").isin(200, 204)
    own = {
        "stream-next-offset": F.when(good, F.col("next_offset")),
        "stream-up-to-date": F.when(good, F.lit("true")),
        "stream-closed": F.when(good & F.col("closed"), F.lit("true")),
        "stream-cursor": F.when(good, F.col("next_cursor")),
        "etag": F.col("etag"),
        "content-type": F.when(F.col("http_status") >= 400, F.lit("text/plain")),
    }
    return answers.withColumn("headers", _map(own))


def event_stream_headers(content_type: Column | str) -> Column:
    """Of live reads as event streams; binary streams are marked."""
    return _map({"content-type": F.lit("text/event-stream"), "cache-control": F.lit("no-cache"), "connection": F.lit("keep-alive"), "stream-sse-data-encoding": F.when(~is_text(content_type), "base64")})


def carried_cursors(cursors: DataFrame) -> DataFrame:
    """Strict mode: a connection's cursors (connection, pass, cursor) never go back."""
    run = Window.partitionBy("connection").orderBy("pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cursors.withColumn("cursor", F.max(F.col("cursor").cast("long")).over(run).cast("string"))
