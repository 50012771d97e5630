"""Streaming against batch, sources against scans, reads against themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog.operators import append, producer, read
from tidelog.operators.offsets import with_offsets
from tidelog.plans import requests as R
from tidelog.schema import APPEND_REQUESTS
from tidelog.sources.datasource import LogSource
from tidelog.sources.log import read_messages, write_messages
from tidelog.sources.scratch import new_path
from tidelog.streaming import live
from tidelog.streaming.settings import disk_state
from tidelog.streaming.stateful import append_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    m = R.conversation_messages(spark, SF).withColumn("nbytes", F.col("nbytes").cast("int"))
    path = f"file://{tmp_path_factory.mktemp('log')}/messages"
    write_messages(m, path, partitions=3)
    return path


@pytest.mark.parametrize("batches", [1, 4])
def test_streaming_equals_batch(spark, batches):
    asked = R.append_log(spark, SF)
    streams = R.append_streams(asked)
    batch = {tuple(r) for r in append.append_outcomes(asked, streams).drop("stored").collect()}
    columns = [c.split()[0] for c in APPEND_REQUESTS.split(", ")]
    landing, out, checkpoint = (new_path(spark, n) for n in ("requests", "out", "checkpoint"))
    with disk_state(spark):
        edges = [r[0] for r in asked.selectExpr(f"ntile({batches}) over (order by ingest_seq) t", "ingest_seq").groupBy("t").agg(F.max("ingest_seq")).orderBy("t").select("max(ingest_seq)").collect()]
        before = -1
        for edge in edges:
            asked.filter((F.col("ingest_seq") > before) & (F.col("ingest_seq") <= edge)).select(*columns).coalesce(1).write.mode("append").parquet(landing)
            before = edge
            rows = append_stream(spark.readStream.schema(APPEND_REQUESTS).parquet(landing), streams).drop("stored")
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == batch


def test_fold_equals_pass(spark):
    asked = R.producer_log(spark, SF)
    fold = {tuple(r) for r in producer.producer_outcomes(asked, fold_rows=10**9).collect()}
    passed = {tuple(r) for r in producer.producer_outcomes(asked, fold_rows=0).collect()}
    mixed = {tuple(r) for r in producer.producer_outcomes(asked, fold_rows=5).collect()}
    assert fold == passed == mixed


def test_offsets_in_spans(spark):
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) path", "id ingest_seq", "id % 7 + 1 nbytes")
    assert sorted(map(tuple, with_offsets(rows, 16).collect())) == sorted(map(tuple, with_offsets(rows).collect()))


def test_prefix_and_suffix_make_the_whole(spark):
    m = R.conversation_messages(spark, SF)
    whole = m.groupBy("path").agg(F.sum("nbytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    cuts = m.select("path", F.col("offset").alias("after"))
    rest = read.matched(cuts, m).withColumn("upto", F.split_part("after", F.lit("_"), F.lit(2)).cast("long"))
    assert rest.join(whole.withColumnRenamed("bytes", "all"), "path").filter("upto + bytes <> all").count() == 0


def test_data_source_reads_and_follows(spark, log):
    spark.dataSource.register(LogSource)
    after = "0000000000000000_0000000000000100"
    want = sorted((r.path, r.offset) for r in read_messages(spark, log, "3", after).collect())
    options = {"log": log, "path": "3", "offset": after}
    got = spark.read.format("tidelog").options(**options).load()
    assert sorted((r.path, r.offset) for r in got.collect()) == want
    out, checkpoint = new_path(spark, "out"), new_path(spark, "checkpoint")
    query = spark.readStream.format("tidelog").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.path, r.offset) for r in spark.read.parquet(out).collect()) == want


def test_follow_ends_with_closure(spark, log):
    seen = []
    query = live.follow(live.tail(spark, log, "3", schema="path string, ingest_seq long, data binary, nbytes int, offset string"), lambda df, _: seen.extend(df.select("offset").collect()), new_path(spark, "checkpoint"), lambda: len(seen) > 0, timeout=20)
    assert not query.isActive
    assert len(seen) == read_messages(spark, log, "3").count()


def test_log_filters_reach_the_scan(spark, log):
    plan = read_messages(spark, log, "3", "0000000000000000_0000000000000100").select("offset")._jdf.queryExecution().toString()
    assert "EqualTo(path,3)" in plan and "GreaterThan(offset," in plan


def test_scratch_is_cleared(spark):
    from tidelog.sources import scratch

    path = new_path(spark, "some")
    spark.range(3).write.parquet(path)
    scratch.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@pytest.mark.parametrize(("master", "fails"), [("local[4]", False), ("local", False), ("local-cluster[3,2,1024]", True), ("spark://host:7077", True), ("yarn", True)])
def test_no_folder_of_one_machine_on_a_cluster(master, fails):
    from types import SimpleNamespace

    from tidelog.sources.scratch import shared_dir

    set_ = {}
    session = SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d: set_.get(k, d), set=set_.__setitem__))
    if fails:
        with pytest.raises(RuntimeError):
            shared_dir(session)
    else:
        assert shared_dir(session) == shared_dir(session)
