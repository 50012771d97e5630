"""Registered queries over the test tables. SQL twins, where SQL can express a query, are in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.jsoncanon import canonical, canonical_elements
from ..operators import append, faults, framing, http, lifecycle, producer, read, rollup
from ..operators.offsets import tails, with_offsets, with_starts
from ..schema import APPEND_REQUESTS, MESSAGES
from ..sources.log import read_messages, write_messages
from ..sources.scratch import new_path
from ..streaming import live
from ..streaming.settings import disk_state
from ..streaming.stateful import append_stream
from . import requests as R
from .oracle import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# -- offsets and tails -----------------------------------------------------------------------


@query
def stream_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return R.conversation_messages(spark, sf).select("path", "ingest_seq", "nbytes", "offset")


@query
def message_start_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return with_starts(R.conversation_messages(spark, sf)).select("path", "ingest_seq", "start", "offset")


@query
def document_stream_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as streams of multi-byte text: many messages each."""
    d = R.table(spark, sf, "documents")
    rows = d.select(F.col("source").alias("path"), F.col("doc_id").alias("ingest_seq"), F.octet_length("text").cast("long").alias("nbytes"))
    return with_offsets(rows).select("path", "ingest_seq", "nbytes", "offset")


@query
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    m = R.conversation_messages(spark, sf)
    return tails(m.select("path").distinct(), m)


# -- reads -----------------------------------------------------------------------------------


def _reads(spark: SparkSession, sf: str, kinds: list[int] | None = None, body: bool = False) -> DataFrame:
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    asked = R.reads(s)
    if kinds is not None:
        asked = asked.filter(F.col("k").isin(kinds))
    return read.read_outcomes(asked.drop("k"), s, m, body)


READ = ("req_id", "path", "http_status", "n", "bytes", "next_offset", "closed")


@query
def read_from_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [3]).select(*READ)


@query
def read_from_sentinel_start(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [0, 1]).select(*READ)


@query
def read_at_now(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [2]).select(*READ)


@query
def read_unpadded_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [4]).select(*READ)


@query
def read_beyond_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [5]).select(*READ)


@query
def read_mid_message(spark: SparkSession, sf: str) -> DataFrame:
    """The message that ends after an offset inside it comes whole."""
    m = with_starts(R.conversation_messages(spark, sf))
    inside = m.filter("nbytes > 1").select("path", "ingest_seq", X.offset_text(X.offset_position("start") + 1).alias("after"))
    return read.matched(inside, m).select("path", "ingest_seq", "n", "bytes", "last")


@query
def batch_reads(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf).select(*READ, "next_cursor", "etag")


@query
def long_poll_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Polls at the tail: closed streams end, open ones time out."""
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    asked = s.select(F.col("path").cast("long").alias("req_id"), "path", F.when(F.col("path").cast("long") % 2 == 0, "now").otherwise(F.col("current_offset")).alias("offset"), F.lit("long-poll").alias("live"), F.lit(R.AS_OF).cast("timestamp").alias("as_of"), F.lit(60).alias("jitter_seconds"))
    return read.read_outcomes(asked, s, m).select(*READ, "next_cursor")


@query
def conditional_read(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the readers come with the ETag that they will be given."""
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    known = F.when(F.col("path").cast("long") % 2 == 0, X.etag("path", F.lit("-1"), "current_offset", "closed")).otherwise(F.lit('"x"'))
    asked = s.select(F.col("path").cast("long").alias("req_id"), "path", F.lit(None).cast("string").alias("offset"), known.alias("if_none_match"))
    return read.read_outcomes(asked, s, m).select("req_id", "http_status", "etag")


@query
def response_body_text(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [0, 3], body=True).select("req_id", "http_status", "body")


@query
def response_body_json(spark: SparkSession, sf: str) -> DataFrame:
    return read.response_bodies(R.event_messages(spark, sf), json=True)


@query
def partial_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Strict mode: the first chunk of at most 1,000 bytes of each conversation."""
    return read.chunked(R.conversation_messages(spark, sf), 1000).select("path", "ingest_seq", "offset")


@query
def closed_eof(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [0, 2]).filter("closed").select("req_id", "path", "next_offset")


def _aging(streams: DataFrame) -> DataFrame:
    """Streams of which a third lives for a minute and another third until two minutes past."""
    p = F.col("path").cast("long")
    return streams.withColumns({"created_at": F.lit(R.AS_OF).cast("timestamp"), "ttl_seconds": F.when(p % 3 == 0, 60).cast("long"), "expires_at": F.when(p % 3 == 1, "2024-11-01T00:02:00Z")})


@query
def expired_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of streams that expire: those after their time find nothing."""
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    return read.read_outcomes(R.reads(s).drop("k"), _aging(s), m).select(*READ, "next_cursor", "etag")


@query
def expired_bodies(spark: SparkSession, sf: str) -> DataFrame:
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    return read.read_outcomes(R.reads(s).filter("k in (0, 3)").drop("k"), _aging(s), m, body=True).select("req_id", "http_status", "body")


@query
def expired_head(spark: SparkSession, sf: str) -> DataFrame:
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    asked = R.reads(s).filter("k = 0").select("req_id", "path", "as_of").unionByName(spark.createDataFrame([(-1, "none", None)], "req_id long, path string, as_of timestamp"))
    rows = http.head_headers(lifecycle.head_outcomes(_aging(s), asked))
    return rows.select("req_id", "http_status", "next_offset", "closed", "etag", F.col("headers")["cache-control"].alias("cache_control"), F.col("headers")["content-type"].alias("content_type"))


@query
def etag(spark: SparkSession, sf: str) -> DataFrame:
    return _reads(spark, sf, [1, 3]).filter("etag is not null").select("req_id", "etag")


# -- JSON ------------------------------------------------------------------------------------


@query
def json_canonical_ascii(spark: SparkSession, sf: str) -> DataFrame:
    e = R.table(spark, sf, "events")
    return e.select("event_id", canonical(F.col("props")).alias("stored"))


@query
def json_canonical_unicode(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as JSON: other than ASCII is escaped, which no SQL dialect here does."""
    d = R.table(spark, sf, "documents")
    stored = canonical(F.to_json(F.struct("doc_id", "text")))
    return d.select("doc_id", stored.alias("stored")).select("doc_id", F.octet_length("stored").cast("long").alias("nbytes"), F.md5(F.col("stored").cast("binary")).alias("md5"))


@query
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Strict mode: each element of an array is a message with an offset of its own."""
    e = R.table(spark, sf, "events")
    body = F.concat(F.lit("["), F.col("props"), F.lit(", "), F.col("event_id").cast("string"), F.lit(", [1, 2]]"))
    each = e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), "event_id", F.posexplode(canonical_elements(body.cast("binary"))).alias("k", "element"))
    rows = each.withColumn("ingest_seq", F.col("event_id") * 4 + F.col("k")).withColumn("nbytes", (F.octet_length("element") + 1).cast("long"))
    return with_offsets(rows).select("path", "ingest_seq", "element", "offset")


@query
def json_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of three kinds: kept, empty array, not JSON."""
    e = R.table(spark, sf, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "[]").otherwise(F.concat(F.lit("{"), "props"))
    parts = e.select("event_id", canonical_elements(body.cast("binary")).alias("p"))
    return parts.select("event_id", F.when(F.col("p").isNull(), "invalid_json").when(F.size("p") == 0, "empty_array").otherwise("accepted").alias("status"))


# -- headers and syntax ----------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "events").select("event_id", "user_id", "event_type")


@query
def offset_syntax_check(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 8 == 0, "-1").when(i % 8 == 1, "now").when(i % 8 == 2, F.concat_ws("_", F.lit("0"), i.cast("string"))).when(i % 8 == 3, "").when(i % 8 == 4, F.concat(i.cast("string"), F.lit("_"))).when(i % 8 == 5, "NOW").when(i % 8 == 6, X.offset_text(i))
    live_ = F.when(i % 3 == 1, "sse").when(i % 3 == 2, "other")
    return _events(spark, sf).select("event_id", text.alias("text"), live_.alias("live"), (1 + (i % 5 == 4).cast("int")).alias("k")).select("event_id", "text", X.read_error("text", "live", F.col("k")).alias("error"))


@query
def ttl_syntax_check(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    ttl = F.when(i % 7 == 0, "3600").when(i % 7 == 1, "0").when(i % 7 == 2, "+3600").when(i % 7 == 3, "03600").when(i % 7 == 4, "3600.0").when(i % 7 == 5, "3.6e3")
    until = F.when(i % 4 == 0, "2024-02-30T00:00:00Z").when(i % 4 == 1, "2024-02-28T00:00:00Z")
    return _events(spark, sf).select("event_id", ttl.alias("ttl"), until.alias("until")).select("event_id", X.ttl_error("ttl", "until").alias("error"))


@query
def content_type_normalize(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    given = F.when(i % 7 == 0, "Application/JSON; charset=utf-8").when(i % 7 == 1, "").when(i % 7 == 2, " ;x").when(i % 7 == 3, "text/plain").when(i % 7 == 4, "\tText/HTML ").when(i % 7 == 5, "nonsense")
    rows = _events(spark, sf).select("event_id", given.alias("t"))
    return rows.select("event_id", X.media_type("t").alias("media_type"), X.accepted_type("t").alias("accepted"), X.is_text("t").alias("is_text"), X.types_clash("t", F.lit("text/plain")).alias("clash"))


@query
def producer_header_check(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    rows = _events(spark, sf).select("event_id", *(x.alias(n) for n, x in {"producer_id": F.when(i % 5 != 0, F.when(i % 7 == 0, "").otherwise("p")), "producer_epoch": F.when(i % 5 != 1, F.when(i % 11 == 0, "-1").otherwise("1")), "producer_seq": F.when(i % 5 != 1, F.when(i % 13 == 0, "x").otherwise("2")), "content_type": F.when(i % 17 != 0, "text/plain"), "stream_closed": F.when(i % 3 == 0, "true"), "body": F.when(i % 2 == 0, "b").otherwise("").cast("binary")}.items()))
    return rows.select("event_id", X.header_error({c: F.col(c) for c in rows.columns}).alias("error"))


@query
def query_string_values(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    text = F.concat(F.lit("offset="), i, F.lit("&live=&offset=a%20b&x=1&cursor="), F.col("event_type"))
    rows = _events(spark, sf).select("event_id", text.alias("q"))
    offsets = X.query_values("q", "offset")
    return rows.select("event_id", offsets[0].alias("first_offset"), F.size(offsets).cast("long").alias("n_offsets"), offsets[1].alias("second_offset"), F.get(X.query_values("q", "live"), 0).alias("live"), F.get(X.query_values("q", "cursor"), 0).alias("cursor"))


@query
def location_address(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    rows = _events(spark, sf).select("event_id", F.when(i % 2 == 0, "http").otherwise("https").alias("scheme"), F.when(i % 3 == 0, "h.example").alias("host"), F.when(i % 3 == 1, "srv").alias("server"), F.when(i % 5 == 0, 80).when(i % 5 == 1, 443).otherwise(8080).alias("port"), F.concat(F.lit("/"), "event_type").alias("path"))
    return rows.select("event_id", X.location("scheme", "host", "server", "port", "path").alias("location"))


# -- cursors and frames ----------------------------------------------------------------------


@query
def cursor_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "events").select("event_id", X.cursor_bucket(F.col("ts").cast("timestamp")).alias("bucket"))


@query
def response_cursor(spark: SparkSession, sf: str) -> DataFrame:
    e = R.table(spark, sf, "events")
    i = F.col("event_id")
    client = F.when(i % 4 == 0, "-2000000").when(i % 4 == 1, (i * 3).cast("string")).when(i % 4 == 2, "x1")
    rows = e.select("event_id", client.alias("client"), F.col("ts").cast("timestamp").alias("as_of"), (i % 3600 + 1).cast("int").alias("j"))
    return rows.select("event_id", X.response_cursor("client", "as_of", "j").alias("cursor"))


@query
def sse_frames_text(spark: SparkSession, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[.] ", ".\r\n").cast("binary").alias("data"))
    return framing.data_frames(d, F.lit("text/plain")).select("doc_id", F.md5(F.col("frame").cast("binary")).alias("frame_md5"), F.octet_length("frame").cast("long").alias("nbytes"))


@query
def sse_frames_base64(spark: SparkSession, sf: str) -> DataFrame:
    p = R.table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    return framing.data_frames(p, F.lit("application/pdf")).select("page_id", F.md5(F.col("frame").cast("binary")).alias("frame_md5"), F.octet_length("frame").cast("long").alias("nbytes"))


@query
def sse_frames_json(spark: SparkSession, sf: str) -> DataFrame:
    return framing.data_frames(R.event_messages(spark, sf), F.lit("application/json")).select("path", "ingest_seq", "frame")


@query
def sse_control(spark: SparkSession, sf: str) -> DataFrame:
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m).select("path", F.col("current_offset").alias("next_offset"), "closed", F.lit(None).cast("string").alias("cursor"), F.lit(R.AS_OF).cast("timestamp").alias("as_of"), F.lit(1).alias("jitter_seconds"))
    return framing.control_frames(s).select("path", "control", "frame")


@query
def sse_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """All that one pass of a live read sends: data events in order, then the control event."""
    m = R.conversation_messages(spark, sf)
    s = R.conversation_streams(m)
    asked = R.reads(s).filter("k between 0 and 5").drop("k", "live")
    return framing.event_sequence(asked, s, m)


@query
def byte_safe_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads cut in the middle of a character aren't text: an error as text, whole in base64."""
    d = R.table(spark, sf, "documents")
    cut = F.substring(F.col("text").cast("binary"), 1, 60)
    rows = d.filter(F.octet_length("text") > 60).select("doc_id", F.concat(cut, F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("0A")))).alias("data"))
    text = framing.data_frames(rows.filter("doc_id % 4 < 2"), F.lit("text/plain"))
    coded = framing.data_frames(rows.filter("doc_id % 4 > 1"), F.lit("image/png"))
    return text.unionByName(coded).select("doc_id", "error", F.md5(F.col("frame").cast("binary")).alias("frame_md5"))


# -- lifecycle -------------------------------------------------------------------------------


@query
def create_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.create_outcomes(R.create_log(spark, sf)).select("path", "ingest_seq", "status", "http_status", "next_offset", "closed")


def _created(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.created(lifecycle.create_outcomes(R.create_log(spark, sf)))


@query
def stream_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Streams with times to live and expiry texts, as seen at each event's time."""
    e = R.table(spark, sf, "events")
    i = F.col("event_id")
    until = F.when(i % 4 == 0, "2024-01-10T00:00:00+02:00").when(i % 4 == 1, "2024-01-20T12:30:00Z").when(i % 4 == 2, "never")
    rows = e.select("event_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("c"), F.when(i % 3 == 0, i % 30 * 86400).alias("ttl"), until.alias("until"), F.col("ts").cast("timestamp").alias("as_of"))
    return rows.select("event_id", X.expired("c", "ttl", "until", "as_of").alias("expired"))


@query
def list_paths(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.list_paths(_created(spark, sf))


@query
def exists_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's path is looked up, and one beside it that nothing has created."""
    numbers = F.explode(F.array(F.col("doc_id") % 50, F.col("doc_id") % 7 * 10)).alias("n")
    d = R.table(spark, sf, "documents").select("source", "doc_id", numbers).select(F.concat_ws("/", "source", F.col("n").cast("string")).alias("path"))
    return lifecycle.lookup(_created(spark, sf), d, F.lit("2024-01-01 00:30:00").cast("timestamp")).select("path")


@query
def delete_anti(spark: SparkSession, sf: str) -> DataFrame:
    made = _created(spark, sf)
    gone = made.filter(F.split_part("path", F.lit("/"), F.lit(2)).cast("int") % 2 == 0).select("path")
    return lifecycle.delete(made, gone).select("path", "current_offset")


@query
def delete_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").select(F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("doc_id").alias("ingest_seq"))
    return lifecycle.delete_outcomes(_created(spark, sf), d)


@query
def expired_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Deletions around the time that streams expire at."""
    d = R.table(spark, sf, "documents").select(F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("doc_id").alias("ingest_seq"))
    as_of = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:59:50").cast("timestamp")) + F.col("ingest_seq") % 20)
    return lifecycle.delete_outcomes(_created(spark, sf), d.withColumn("as_of", as_of))


@query
def stream_head(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.head(_created(spark, sf))


# -- appends ---------------------------------------------------------------------------------


@query
def producer_fsm(spark: SparkSession, sf: str) -> DataFrame:
    return producer.producer_outcomes(R.producer_log(spark, sf), ttl=None)


@query
def producer_state_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """The same with states forgotten after seven days."""
    return producer.producer_outcomes(R.producer_log(spark, sf))


@query
def producer_final_state(spark: SparkSession, sf: str) -> DataFrame:
    return producer.producer_states(producer.producer_outcomes(R.producer_log(spark, sf), ttl=None))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    log = R.append_log(spark, sf)
    return append.append_outcomes(log, R.append_streams(log))


OUTCOME = ("path", "ingest_seq", "status", "http_status", "next_offset", "closed", "producer_epoch", "producer_seq", "expected_seq", "received_seq")


@query
def append_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select(*OUTCOME)


@query
def append_status_codes(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.outcome_counts(_outcomes(spark, sf))


@query
def append_messages(spark: SparkSession, sf: str) -> DataFrame:
    """What the accepted requests stored."""
    return append.messages_of(_outcomes(spark, sf)).select("path", "ingest_seq", F.col("data").cast("string").alias("data"), F.col("nbytes").cast("long").alias("nbytes"), "offset")


@query
def stream_seq_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).filter("status = 'seq_conflict'").select("path", "ingest_seq")


@query
def close_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Requests from a stream's closure on: the closing one, its retry, and one that comes too late."""
    return _outcomes(spark, sf).filter("closed").select("path", "ingest_seq", "status", "http_status", "next_offset")


@query
def streams_after_appends(spark: SparkSession, sf: str) -> DataFrame:
    log = R.append_log(spark, sf)
    streams = R.append_streams(log)
    return append.streams_after(streams, append.append_outcomes(log, streams)).select("path", "current_offset", "closed")


@query
def duplicate_share(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.duplicate_share(_outcomes(spark, sf))


@query
def fault_injection(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    asked = e.select(F.col("event_type").alias("path"), F.when(F.col("user_id") % 2 == 0, "GET").otherwise("post").alias("method"), F.col("event_id").alias("ingest_seq"))
    rules = spark.createDataFrame([("error", "get", 3, 503, 7), ("click", None, 0, 500, None), ("view", "POST", 2, None, 9)], "path string, method string, count int, status int, retry_after int")
    return faults.faulted(asked, rules)


# -- responses -------------------------------------------------------------------------------

HEADERS = ("stream-next-offset", "stream-closed", "producer-epoch", "producer-seq", "producer-expected-seq", "producer-received-seq", "content-type")


@query
def append_headers(spark: SparkSession, sf: str) -> DataFrame:
    log = R.append_log(spark, sf)
    rows = http.append_headers(append.append_outcomes(log, R.append_streams(log)), log)
    return rows.select("path", "ingest_seq", "http_status", *(F.col("headers")[h].alias(h.replace("-", "_")) for h in HEADERS))


@query
def read_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = http.read_headers(_reads(spark, sf))
    names = ("stream-next-offset", "stream-up-to-date", "stream-closed", "stream-cursor", "etag", "content-type")
    return rows.select("req_id", "http_status", *(F.col("headers")[h].alias(h.replace("-", "_")) for h in names))


@query
def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    method = F.when(i % 8 == 0, "get").when(i % 8 == 1, "PUT").when(i % 8 == 2, "Post").when(i % 8 == 3, "HEAD").when(i % 8 == 4, "DELETE").when(i % 8 == 5, "OPTIONS").when(i % 8 == 6, "PATCH").otherwise("TRACE")
    return http.routed(_events(spark, sf).select("event_id", method.alias("method")))


@query
def preflight_headers(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    method = F.when(i % 3 == 0, "OPTIONS").when(i % 3 == 1, "PATCH").otherwise("get")
    rows = http.preflight_headers(_events(spark, sf).select("event_id", method.alias("method")))
    names = ("access-control-allow-methods", "access-control-allow-headers", "access-control-expose-headers", "x-content-type-options", "cross-origin-resource-policy", "content-type")
    return rows.select("event_id", "http_status", *(F.col("headers")[h].alias(h.replace("-", "_")) for h in names))


@query
def header_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda n, v: F.struct(n.cast("binary").alias("name"), v.cast("binary").alias("value"))
    h = F.array(pair(F.lit("X-Other"), F.lit("1")), pair(F.lit("STREAM-Seq"), F.col("event_id").cast("string")), pair(F.lit("stream-seq"), F.lit("late")))
    rows = _events(spark, sf).select("event_id", h.alias("h"))
    return rows.select("event_id", http.header_value("h", "Stream-Seq").alias("seq"), http.header_value("h", "absent").alias("absent"))


@query
def carried_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Strict mode: jitter differs from pass to pass, a connection's cursor still doesn't go back."""
    e = R.table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("connection"), F.col("event_id").alias("pass"), (F.lit(1000) + F.col("event_id") * 7919 % 180).cast("string").alias("cursor"))
    return http.carried_cursors(rows)


@query
def strict_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """The zone of an expiry text counts in strict mode only."""
    e = R.table(spark, sf, "events")
    until = F.when(F.col("event_id") % 2 == 0, "2024-01-10T00:00:00+02:00").otherwise("2024-01-10T00:00:00-05:00")
    rows = e.select("event_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("c"), F.lit(None).cast("long").alias("ttl"), until.alias("until"), F.col("ts").cast("timestamp").alias("as_of"))
    return rows.select("event_id", X.expired("c", "ttl", "until", "as_of").alias("expired"), X.expired("c", "ttl", "until", "as_of", strict=True).alias("strictly"))


# -- streaming -------------------------------------------------------------------------------


@query
def streaming_append(spark: SparkSession, sf: str) -> DataFrame:
    """append_outcomes as a stream: the log arrives in files, in order, and state is kept between batches."""
    log = R.append_log(spark, sf)
    columns = [c.split()[0] for c in APPEND_REQUESTS.split(", ")]
    landing, out, checkpoint = (new_path(spark, n) for n in ("requests", "outcomes", "checkpoint"))
    log.select(*columns).repartitionByRange("ingest_seq").sortWithinPartitions("ingest_seq").write.parquet(landing)
    with disk_state(spark):
        asked = spark.readStream.schema(APPEND_REQUESTS).parquet(landing)
        rows = append_stream(asked, R.append_streams(spark.read.schema(APPEND_REQUESTS).parquet(landing))).select(*OUTCOME)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query
def live_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a written log past an offset, followed as a stream until all is read."""
    log, out, checkpoint = (new_path(spark, n) for n in ("log", "tail", "checkpoint"))
    m = R.conversation_messages(spark, sf).withColumn("nbytes", F.col("nbytes").cast("int"))
    write_messages(m, log, partitions=4)
    schema = ", ".join(c for c in MESSAGES.split(", ") if not c.startswith("ts "))
    rows = live.tail(spark, log, offset="0000000000000000_0000000000000500", schema=schema, files_per_batch=2).select("path", "ingest_seq", "offset")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query
def log_range_read(spark: SparkSession, sf: str) -> DataFrame:
    """One stream from an offset, out of a written log: path and offset reach the scan."""
    log = new_path(spark, "log")
    write_messages(R.conversation_messages(spark, sf).withColumn("nbytes", F.col("nbytes").cast("int")), log, partitions=4)
    return read_messages(spark, log, "7", "0000000000000000_0000000000000100").select("path", "ingest_seq", "offset")




__all__ = ["ORACLE_SQL", "QUERIES"]
