"""A durable log in one folder: batches of requests in, tables of outcomes out."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import append, framing, lifecycle, read
from .schema import MESSAGES, PRODUCERS, STREAMS
from .sources.log import write_messages


STORED_STREAMS = f"{STREAMS}, born long"


class ConcurrentBatch(RuntimeError):
    """Another writer's batch was committed since this one started."""


class Log:
    """Streams, producers and messages under root, a folder that driver and executors share.

    States are written as whole versions and a batch counts once its version is named in `current`;
    messages are appended and name their version, so that those of a batch that failed don't count.
    A batch claims the number after the one that it started from, so of two writers that start from one
    state the later fails (ConcurrentBatch) and changes nothing; it may be sent again. A writer that dies between its
    claim and its entry in `current` leaves its number claimed: delete that file in `claims` to go on."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = False) -> None:
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict

    # -- states --------------------------------------------------------------------------------

    def _place(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _table(self, name: str, schema: str) -> DataFrame:
        files, path = self._place(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if files.exists(path) else self.spark.createDataFrame([], schema)

    def _committed(self) -> DataFrame:
        return self._table("current", "n long, version string")

    def _last(self) -> tuple[int, str | None]:
        """The number and name of the version that counts."""
        last = self._committed().agg(F.max("n"), F.max_by("version", "n")).first()
        return last[0] or 0, last[1]

    def _state(self, name: str, schema: str, version: str | None) -> DataFrame:
        return self._table(f"{name}/{version}", schema) if version else self.spark.createDataFrame([], schema)

    def _begin(self) -> tuple[str, int, DataFrame, DataFrame]:
        """A new version, its number, and the streams (with `born`, the number that created each) and producers before it."""
        n, last = self._last()
        return uuid.uuid4().hex, n + 1, self._state("streams", STORED_STREAMS, last), self._state("producers", PRODUCERS, last)

    def _commit(self, version: str, n: int, streams: DataFrame, producers: DataFrame) -> None:
        streams.write.parquet(f"{self.root}/streams/{version}")
        producers.write.parquet(f"{self.root}/producers/{version}")
        files, claim = self._place(f"claims/{n}")
        files.mkdirs(claim.getParent())
        try:
            mine = files.createNewFile(claim)  # atomic: one writer gets each number
        except Py4JJavaError:
            mine = False
        if not mine or self._last()[0] != n - 1:
            raise ConcurrentBatch(f"batch {n} is another writer's")
        try:
            self.spark.createDataFrame([(n, version)], "n long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/current")
        except BaseException:
            files.delete(claim, False)
            raise

    def _store(self, version: str, messages: DataFrame) -> None:
        write_messages(messages, f"{self.root}/messages/version={version}")

    def streams(self) -> DataFrame:
        return self._state("streams", STORED_STREAMS, self._last()[1]).drop("born")

    def producers(self) -> DataFrame:
        return self._state("producers", PRODUCERS, self._last()[1])

    def messages(self, path: str | None = None, offset: str | None = None) -> DataFrame:
        """Messages of committed batches, versions being partitions, and of streams as they are since the batch that created them."""
        every = self._table("messages", f"{MESSAGES}, version string")
        if path is not None:
            every = every.filter(F.col("path") == path)
        if offset not in (None, "", "-1"):
            every = every.filter(F.col("offset") > offset)
        born = self._state("streams", STORED_STREAMS, self._last()[1]).select("path", "born")
        return every.join(self._committed(), "version").join(born, "path").filter("n >= born").drop("version", "n", "born")

    # -- requests ------------------------------------------------------------------------------

    def create(self, requests: DataFrame) -> DataFrame:
        """Outcomes of create requests (schema.CREATE_REQUESTS); initial bodies become messages."""
        version, n, known, producers = self._begin()
        as_of = requests.agg(F.max("ts")).first()[0]
        alive = known if as_of is None else lifecycle.alive(known, F.lit(as_of), self.strict)
        out = lifecycle.create_outcomes(requests, alive, strict=self.strict)
        out.write.parquet(f"{self.root}/outcomes/{version}")
        out = self.spark.read.parquet(f"{self.root}/outcomes/{version}")
        made = lifecycle.created(out)
        stored = F.when(lifecycle.is_json(lifecycle.accepted_type("content_type")), lifecycle.canonical(F.col("body")).cast("binary")).otherwise(F.col("body"))
        first = requests.select("path", "ingest_seq", stored.alias("data"), "ts").join(out.filter("status = 'created'").select("path", "ingest_seq", F.col("next_offset").alias("offset")), ["path", "ingest_seq"])
        self._store(version, first.filter(F.octet_length("data") > 0).withColumn("nbytes", F.octet_length("data")))
        kept = alive.join(made.select("path"), "path", "left_anti")
        gone = known.select("path").join(kept.select("path"), "path", "left_anti")
        self._commit(version, n, kept.unionByName(made.withColumn("born", F.lit(n).cast("long"))), producers.join(gone, "path", "left_anti"))
        return out

    def append(self, requests: DataFrame) -> DataFrame:
        """Outcomes of append and close requests (schema.APPEND_REQUESTS)."""
        version, n, streams, producers = self._begin()
        append.append_outcomes(requests, streams, producers, self.strict).write.parquet(f"{self.root}/outcomes/{version}")
        out = self.spark.read.parquet(f"{self.root}/outcomes/{version}")
        asked = requests.select("path", "ingest_seq", "ts", "stream_seq", "producer_id", F.col("producer_epoch").try_cast("long").alias("epoch"), F.col("producer_seq").try_cast("long").alias("seq"), F.octet_length("body").alias("size"))
        done = out.filter("status = 'accepted'").join(asked, ["path", "ingest_seq"])
        self._store(version, append.messages_of(out).join(asked.select("path", "ingest_seq", "ts"), ["path", "ingest_seq"]))

        spoken = done.filter("producer_id is not null").groupBy("path", "producer_id").agg(F.max_by(F.struct("epoch", F.col("seq").alias("last_seq"), F.col("ts").alias("last_updated")), "ingest_seq").alias("s")).select("path", "producer_id", "s.*")
        old = producers.join(spoken.select("path", "producer_id"), ["path", "producer_id"], "left_anti")
        closing = done.filter("closed").groupBy("path").agg(F.min_by(F.struct("producer_id", "epoch", "seq"), "ingest_seq").alias("_by"))
        last = done.groupBy("path").agg(F.max("next_offset").alias("_tail"), F.max_by(F.when(F.col("size") > 0, F.col("stream_seq")), F.when(F.col("stream_seq").isNotNull() & (F.col("size") > 0), F.col("ingest_seq"))).alias("_seq"))
        joined = streams.join(last, "path", "left").join(closing, "path", "left")
        by = F.when(F.col("closed"), F.col("closed_by")).when(F.col("_by.producer_id").isNotNull(), F.col("_by"))
        after = joined.select("path", "content_type", F.coalesce("_tail", "current_offset").alias("current_offset"), F.coalesce("_seq", "last_seq").alias("last_seq"), "ttl_seconds", "expires_at", "created_at", (F.col("closed") | F.col("_by").isNotNull()).alias("closed"), by.alias("closed_by"), "born")
        self._commit(version, n, after, old.unionByName(spoken))
        return out

    def read(self, reads: DataFrame, body: bool = True) -> DataFrame:
        """Answers to read requests (schema.READ_REQUESTS); streams that have expired at a request's as_of aren't found."""
        return read.read_outcomes(reads, self.streams(), self.messages(), body, strict=self.strict)

    def events(self, reads: DataFrame) -> DataFrame:
        """What live reads as event streams send in one pass, in order."""
        return framing.event_sequence(reads, self.streams(), self.messages(), self.strict)

    def delete(self, requests: DataFrame) -> DataFrame:
        """Outcomes of delete requests (path, ingest_seq, and as_of, at which streams may have expired)."""
        version, n, known, producers = self._begin()
        out = lifecycle.delete_outcomes(known, requests, self.strict)
        out.write.parquet(f"{self.root}/outcomes/{version}")
        gone = requests.select("path").distinct()
        self._commit(version, n, lifecycle.delete(known, gone), producers.join(gone, "path", "left_anti"))
        return self.spark.read.parquet(f"{self.root}/outcomes/{version}")

    def clear(self) -> None:
        version, n, streams, producers = self._begin()
        self._commit(version, n, streams.limit(0), producers.limit(0))

    def head(self, as_of: Column | None = None) -> DataFrame:
        """Metadata of every stream that hasn't expired at as_of (all, without it)."""
        known = self.streams()
        return lifecycle.head(known if as_of is None else lifecycle.alive(known, as_of, self.strict))

    def head_outcomes(self, requests: DataFrame) -> DataFrame:
        """Answers to metadata requests (req_id, path, as_of): 404 for absent and expired streams."""
        return lifecycle.head_outcomes(self.streams(), requests, self.strict)

    def list_paths(self) -> DataFrame:
        return lifecycle.list_paths(self.streams())


