"""Idempotent producers on their own: outcomes of (epoch, seq) requests per stream and producer.

Valid for logs without stream sequence numbers, closure or bad bodies, which involve the whole stream.
A fold over each key's sorted requests stays in the JVM; it is an implementation apart from
`transition.judge` and is tested against it. Keys with more requests than `FOLD_ROWS` go through the
sorted pass of `append`'s kind instead, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRODUCER_TTL
from .transition import judge

FOLD_ROWS = 4096
OUT = "path string, producer_id string, ingest_seq long, epoch long, seq long, status string, current_epoch long, expected_seq long, last_seq long"


def _step(ttl: int | None):
    def step(a: Column, x: Column) -> Column:
        old = F.lit(False) if ttl is None else F.coalesce(x["t"] - a["t"] > ttl * 1_000_000, F.lit(False))
        known = a["e"].isNotNull() & ~old
        e, s = x["epoch"], x["seq"]
        status = (
            F.when(~known & (s == 0), "accepted").when(~known, "sequence_gap")
            .when(e < a["e"], "stale_epoch").when((e > a["e"]) & (s == 0), "accepted").when(e > a["e"], "invalid_epoch_seq")
            .when(s <= a["l"], "duplicate").when(s == a["l"] + 1, "accepted").otherwise("sequence_gap")
        )
        none = F.lit(None).cast("long")
        item = F.struct(
            x["ingest_seq"].alias("ingest_seq"), e.alias("epoch"), s.alias("seq"), status.alias("status"),
            F.when(status == "stale_epoch", a["e"]).otherwise(none).alias("current_epoch"),
            F.when(status == "sequence_gap", F.when(known, a["l"] + 1).otherwise(F.lit(0).cast("long"))).otherwise(none).alias("expected_seq"),
            F.when(status == "duplicate", a["l"]).otherwise(none).alias("last_seq"),
        )
        ok = status == "accepted"
        return F.struct(F.when(ok, e).when(known, a["e"]).alias("e"), F.when(ok, s).when(known, a["l"]).alias("l"), F.when(ok, x["t"]).when(known, a["t"]).alias("t"), F.array_append(a["out"], item).alias("out"))

    return step


def _folded(rows: DataFrame, ttl: int | None) -> DataFrame:
    none = "cast(null as bigint)"
    start = F.expr(f"named_struct('e', {none}, 'l', {none}, 't', {none}, 'out', cast(array() as array<struct<ingest_seq:bigint,epoch:bigint,seq:bigint,status:string,current_epoch:bigint,expected_seq:bigint,last_seq:bigint>>))")
    each = F.array_sort(F.collect_list(F.struct("ingest_seq", "epoch", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))))
    keyed = rows.groupBy("path", "producer_id").agg(each.alias("r"))
    done = keyed.select("path", "producer_id", F.aggregate("r", start, _step(ttl), lambda a: a["out"]).alias("o"))
    return done.select("path", "producer_id", F.inline("o"))


def _passed(rows: DataFrame, ttl: int | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, known = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.path, r.producer_id) != key:
                    key, known = (r.path, r.producer_id), None
                if known is not None and ttl is not None and r.t - known[2] > ttl:
                    known = None
                status, n = judge(known, r.epoch, r.seq)
                out.append((*key, r.ingest_seq, r.epoch, r.seq, status, n if status == "stale_epoch" else None, n if status == "sequence_gap" else None, n if status == "duplicate" else None))
                if status == "accepted":
                    known = (r.epoch, r.seq, r.t)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            yield frame.astype(dict.fromkeys(["current_epoch", "expected_seq", "last_seq"], "Int64"))

    timed = rows.select("path", "producer_id", "ingest_seq", "epoch", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timed.repartition("path", "producer_id").sortWithinPartitions("path", "producer_id", "ingest_seq").mapInPandas(run, OUT)


def producer_outcomes(requests: DataFrame, ttl: int | None = PRODUCER_TTL, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """requests (path, producer_id, ingest_seq, epoch, seq, ts) with the producer's verdict on each. ttl None: states never expire."""
    rows = requests.select("path", "producer_id", "ingest_seq", F.col("epoch").cast("long").alias("epoch"), F.col("seq").cast("long").alias("seq"), "ts")
    sizes = rows.groupBy("path", "producer_id").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= fold_rows:
        return _folded(rows, ttl)
    sized = rows.join(sizes, ["path", "producer_id"])
    short, long_ = sized.filter(F.col("_n") <= fold_rows).drop("_n"), sized.filter(F.col("_n") > fold_rows).drop("_n")
    return _folded(short, ttl).unionByName(_passed(long_, ttl))


def producer_states(outcomes: DataFrame) -> DataFrame:
    """path, producer_id, epoch, last_seq: what accepted requests leave behind."""
    kept = outcomes.filter("status = 'accepted'")
    last = F.max_by(F.struct("epoch", "seq"), "ingest_seq")
    return kept.groupBy("path", "producer_id").agg(last.alias("s")).select("path", "producer_id", "s.epoch", F.col("s.seq").alias("last_seq"))
