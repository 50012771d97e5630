"""A log in a folder over several batches, against one fold over all requests."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.engine import ConcurrentBatch, Log
from tidelog.operators import append
from tidelog.plans import requests as R
from tidelog.schema import APPEND_REQUESTS, CREATE_REQUESTS, MESSAGES, READ_REQUESTS
from tidelog.sources.datasource import LogSource

SF = "/root/testdata/sf0.001"
T = dt.datetime(2024, 1, 1)


def creates(spark, *rows):
    return spark.createDataFrame([(i, p, kind, None, None, closed, body, T) for i, (p, kind, closed, body) in enumerate(rows)], CREATE_REQUESTS)


def test_batches_equal_one_fold(spark, tmp_path):
    asked = R.append_log(spark, SF)
    streams = R.append_streams(asked).filter("ttl_seconds is null")
    log = Log(spark, f"file://{tmp_path}/log")
    made = streams.select(F.lit(0).cast("long").alias("ingest_seq"), "path", "content_type", F.lit(None).cast("string").alias("stream_ttl"), F.lit(None).cast("string").alias("stream_expires_at"), F.lit(None).cast("string").alias("stream_closed"), F.lit(None).cast("binary").alias("body"), F.col("created_at").alias("ts"))
    assert {r.http_status for r in log.create(made).collect()} == {201}
    want = {tuple(r) for r in append.append_outcomes(asked, streams).collect()}
    middle = asked.approxQuantile("ingest_seq", [0.5], 0.0)[0]
    got = set()
    for part in (F.col("ingest_seq") <= middle, F.col("ingest_seq") > middle):
        got |= {tuple(r) for r in log.append(asked.filter(part)).collect()}
    assert got == want
    tails = {r.path: r.current_offset for r in append.streams_after(streams, append.append_outcomes(asked, streams)).collect()}
    assert {r.path: r.next_offset for r in log.head().collect()} == tails
    assert log.messages().count() == sum(r[-1] is not None for r in want)


def test_life_of_a_stream(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    out = {r.ingest_seq: (r.status, r.http_status) for r in log.create(creates(spark, ("/a", "application/json", None, b"[1, 2]"), ("/a", "application/json", None, b"x"), ("/a", "text/plain", None, None), ("/b", "text/plain", "true", b"end"), ("/c", "application/json", None, b"{"))).collect()}
    assert out == {0: ("created", 201), 1: ("exists", 200), 2: ("conflict", 409), 3: ("created", 201), 4: ("invalid_json", 400)}
    rows = [(10, "/a", "application/json", None, None, None, None, None, b'{"k": "\xc3\xa9"}', T), (11, "/b", "text/plain", None, None, None, None, None, b"x", T)]
    out = {r.path: r.status for r in log.append(spark.createDataFrame(rows, APPEND_REQUESTS)).collect()}
    assert out == {"/a": "accepted", "/b": "stream_closed"}
    asked = [(1, "/a", None, None, None, None, T, 1), (2, "/b", "-1", None, None, None, T, 1), (3, "/a", "0000000000000000_0000000000000004", "x", None, None, T, 1), (4, "/z", None, None, None, None, T, 1), (5, "/b", "now", "long-poll", None, None, T, 1)]
    got = {r.req_id: (r.http_status, r.body, r.closed) for r in log.read(spark.createDataFrame(asked, READ_REQUESTS)).collect()}
    assert got == {1: (200, '[1,2,{"k":"\\u00e9"}]', False), 2: (200, "end", True), 3: (200, '[{"k":"\\u00e9"}]', False), 4: (404, None, None), 5: (204, None, True)}
    gone = spark.createDataFrame([("/b", 1), ("/b", 2), ("/y", 3)], "path string, ingest_seq long")
    assert {r.ingest_seq: r.http_status for r in log.delete(gone).collect()} == {1: 204, 2: 404, 3: 404}
    assert [r.path for r in log.list_paths().collect()] == ["/a"]
    assert {r.path for r in log.messages().collect()} == {"/a"}
    log.clear()
    assert log.list_paths().count() == 0 and log.messages().count() == 0


def test_expired_streams_are_not_found(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    rows = [(i, p, "text/plain", ttl, until, None, b"x", T) for i, (p, ttl, until) in enumerate([("/old", "60", None), ("/until", None, "2024-01-01T00:01:00+05:00"), ("/lasts", None, None)])]
    log.create(spark.createDataFrame(rows, CREATE_REQUESTS))
    for later, want in ((60, 200), (61, 404)):
        at = T + dt.timedelta(seconds=later)
        asked = spark.createDataFrame([(i, p, o, None, None, None, at, 1) for i, (p, o) in enumerate((p, o) for p in ("/old", "/until", "/lasts") for o in (None, "now", "0_0"))], READ_REQUESTS)
        for body in (False, True):
            got = log.read(asked, body).collect()
            assert {r.http_status for r in got if r.path != "/lasts"} == {want} and {r.http_status for r in got if r.path == "/lasts"} == {200}
            assert want == 200 or all(r.n == 0 and r.next_offset is None and r.etag is None for r in got if r.path != "/lasts")
        heads = {r.path: r.http_status for r in log.head_outcomes(asked.filter("req_id % 3 = 0")).collect()}
        assert heads == {"/old": want, "/until": want, "/lasts": 200}
        assert {r.path for r in log.head(F.lit(at)).collect()} == ({"/lasts"} if want == 404 else {"/old", "/until", "/lasts"})
        events = log.events(asked.filter("offset = 'now'")).collect()
        assert {r.req_id for r in events} == ({7} if want == 404 else {1, 4, 7}) and {r.event for r in events} == {"control"}
    gone = spark.createDataFrame([(p, i, at) for i, p in enumerate(("/old", "/lasts", "/z"))], "path string, ingest_seq long, as_of timestamp")
    assert {r.path: r.http_status for r in log.delete(gone).collect()} == {"/old": 404, "/lasts": 204, "/z": 404}
    assert [r.path for r in log.list_paths().collect()] == ["/until"]


def test_recreated_stream_has_none_of_its_old_messages(spark, tmp_path):
    """Even where it is created again at the very same time."""
    log = Log(spark, f"file://{tmp_path}/log")
    log.create(creates(spark, ("/a", "text/plain", None, b"one"), ("/b", "text/plain", None, b"kept")))
    log.delete(spark.createDataFrame([("/a", 1)], "path string, ingest_seq long"))
    log.create(creates(spark, ("/a", "text/plain", None, b"two")))
    assert {(r.path, bytes(r.data)) for r in log.messages().collect()} == {("/a", b"two"), ("/b", b"kept")}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    one, two = (Log(spark, f"file://{tmp_path}/log") for _ in range(2))
    one.create(creates(spark, ("/a", "text/plain", None, b"one")))
    began = two._begin()
    monkeypatch.setattr(two, "_begin", lambda: began)
    one.create(creates(spark, ("/b", "text/plain", None, b"x")))
    with pytest.raises(ConcurrentBatch):
        two.create(creates(spark, ("/c", "text/plain", None, b"lost")))
    monkeypatch.undo()
    assert sorted(r.path for r in two.list_paths().collect()) == ["/a", "/b"]
    assert {bytes(r.data) for r in two.messages().collect()} == {b"one", b"x"}
    two.create(creates(spark, ("/c", "text/plain", None, b"sent again")))
    assert sorted(r.path for r in one.list_paths().collect()) == ["/a", "/b", "/c"]


@pytest.mark.parametrize("part", ["", "/messages"])
def test_data_source_reads_an_engines_log(spark, tmp_path, part):
    spark.dataSource.register(LogSource)
    log, folder = Log(spark, f"file://{tmp_path}/log"), f"file://{tmp_path}/log"
    source = lambda r, path: r.format("tidelog").option("log", folder + part).option("path", path)
    assert part or source(spark.read, "/a").load().count() == 0  # before anything is written
    log.create(creates(spark, ("/a", "text/plain", None, b"one"), ("/b", "text/plain", None, b"other"), ("/none", "text/plain", None, None)))
    log.append(spark.createDataFrame([(10, "/a", "text/plain", None, None, None, None, None, b"two", T)], APPEND_REQUESTS))
    (tmp_path / "log/messages/version=failed").mkdir(parents=True)
    write = spark.createDataFrame([("/a", 99, b"never committed", 15, "0000000000000000_0000000000000099", T)], MESSAGES)
    write.write.mode("append").parquet(f"{folder}/messages/version=failed")
    assert [bytes(r.data) for r in source(spark.read, "/a").load().orderBy("offset").collect()] == [b"one", b"two"]
    assert [bytes(r.data) for r in source(spark.read, "/a").option("offset", "0000000000000000_0000000000000003").load().collect()] == [b"two"]
    assert source(spark.read, "/none").load().count() == 0 and source(spark.read, "/z").load().count() == 0
    got = []

    def follow():
        query = source(spark.readStream, "/a").load().writeStream.foreachBatch(lambda df, _: got.extend(bytes(r.data) for r in df.orderBy("offset").collect())).option("checkpointLocation", f"{tmp_path}/ck").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    follow()
    assert got == [b"one", b"two"]
    log.append(spark.createDataFrame([(11, "/a", "text/plain", None, None, None, None, None, b"three", T)], APPEND_REQUESTS))
    follow()
    assert got == [b"one", b"two", b"three"]


def test_command_line(spark, tmp_path, monkeypatch):
    from tidelog.__main__ import main

    main(["stream_tail", SF, f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
