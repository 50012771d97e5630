"""Exact dedup as a stateful stream with disk-backed keyed state, in DataFrame operations only.

Each text, with its white space runs replaced by one space, has a SHA-256 digest. A Structured
Streaming query keeps, for each digest, the smallest identifier seen (the text that stays), the
locator of that text (file and row number) and the number of rows, in RocksDB state stores whose
checkpoint lies in the shared folder. The state has no watermark and never expires, so a later
run over the same checkpoint checks new files against all that came before. Every hit (a row whose
digest belongs to another row) is then confirmed on the full bytes of both texts, so that a digest
collision can't drop a document. Texts are fetched by locator: a Bloom filter of the hits' locators keeps
all other rows' texts out of every exchange, at any size of the table.

Defined results: null text counts as empty; empty texts are equal to one another; texts of any length are
compared whole; repeated rows with one identifier form a group of that size, of which each row counts as
kept where it has the keep_id, and of which `keep_first` leaves the first row alone (by file and row
number, which also settle ties of identifiers); a null identifier is never the one that stays unless all
are null; an empty table gives no rows; other columns, whatever their names, are ignored by the operator
and kept by `keep_first`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.settings import disk_state
from .common import PLACE, SPACE_CLASS, narrowed, new_path, placed, table, without, written


def normal(text: Column) -> Column:
    """Null as empty; each white space run as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normal(text).cast("binary"), 256)


def update_state(stream: DataFrame, checkpoint: str) -> None:
    """Feeds what is new in stream (doc_id, sha, file, row) to the state under checkpoint."""
    with disk_state(stream.sparkSession):
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
        kept = stream.groupBy("sha").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """sha, keep_id, file, row, n for each digest in the state."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    first = F.col("value")[value[0]]
    return state.select(F.col("key")[state.schema["key"].dataType.names[0]].alias("sha"), first["doc_id"].alias("keep_id"), first["file"].alias("file"), first["row"].alias("row"), F.col("value")[value[1]].alias("n"))


def landed(spark: SparkSession, docs: DataFrame, checkpoint: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs as files, (doc_id, sha, file, row) of them as a table, and as a stream with what landed for this state before.

    Digests are computed once, into a landing folder beside the state that a file source reads. The
    locator is the file that holds the row and the row's number there; rows that don't come from files are
    written beside the state first."""
    run = f"run={uuid.uuid4().hex}"
    docs, file, row = placed(docs, f"{checkpoint}-content/{run}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha"), file.alias("file"), row.alias("row"))
    rows.write.parquet(f"{checkpoint}-landing/{run}")
    return docs, spark.read.schema(rows.schema).parquet(f"{checkpoint}-landing/{run}"), spark.readStream.schema(rows.schema).parquet(f"{checkpoint}-landing")


def decided(docs: DataFrame, digests: DataFrame, state: DataFrame, seen_before: bool = False) -> DataFrame:
    """file, row, doc_id, keep_id, group_size, stays and sha for each row of docs, hits confirmed on full bytes.

    stays: the row itself is the one of its group that stays. Only rows of digests with several rows carry
    their text to the comparison. seen_before: the texts that stay may be those of earlier runs; they are
    read by their locators."""
    shared = written(state.filter("n > 1").select("sha", F.col("keep_id").alias("first_id"), F.col("file").alias("first_file"), F.col("row").alias("first_row"), "n"), "dedup-shared")
    alone = digests.join(shared.select("sha"), "sha", "left_anti").select("file", "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("stays"), "sha")
    wanted = written(digests.join(shared, "sha"), "dedup-wanted")
    meta = docs.metadataColumn("_metadata")
    texts = docs.select(meta["file_path"].alias("file"), meta["row_index"].alias("row"), normal(F.col("text")).alias("body"))
    texts, flag = narrowed(texts, [*PLACE], wanted)
    hits = written(texts.filter(F.col(flag)).drop(flag).join(wanted, [*PLACE]), "dedup-hits")
    own = (F.col("file") == F.col("first_file")) & (F.col("row") == F.col("first_row"))
    # written, so that the join's sides are plain exchanges, whose hot digests can be split
    first = written(hits.filter(own).select("sha", F.col("body").alias("first_body")), "dedup-first")
    if seen_before:
        first = first.unionByName(_earlier(shared.join(hits.select("sha"), "sha", "left_semi").join(first.select("sha"), "sha", "left_anti")))
    same = F.col("body") == F.col("first_body")
    checked = hits.join(first, "sha").select("file", "row", "doc_id", F.when(same, F.col("first_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.when(same, F.col("n")).otherwise(1).cast("long").alias("group_size"), (~same | own).alias("stays"), "sha")
    return alone.unionByName(checked)


def _earlier(wanted: DataFrame) -> DataFrame:
    """(sha, first_body) of texts that stayed in earlier runs, read from their files. Only the files' names reach the driver, as they do for any scan."""
    spark = wanted.sparkSession
    wanted = written(wanted.select("sha", F.col("first_file").alias("file"), F.col("first_row").alias("row")), "dedup-earlier")
    files = [r[0] for r in wanted.select("file").distinct().collect()]
    if not files:
        return wanted.select("sha", F.lit("").alias("first_body")).limit(0)
    kept = spark.read.parquet(*files)
    meta = kept.metadataColumn("_metadata")
    texts, flag = narrowed(kept.select(meta["file_path"].alias("file"), meta["row_index"].alias("row"), normal(F.col("text")).alias("first_body")), [*PLACE], wanted)
    return texts.filter(F.col(flag)).join(wanted, [*PLACE]).select("sha", "first_body")


def exact_dedup(spark: SparkSession, docs: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs; checkpoint: that of an earlier run, whose texts then count as seen."""
    return _told(_run(spark, docs, checkpoint)[1])


def _run(spark: SparkSession, docs: DataFrame, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    state = checkpoint or new_path(spark, "dedup-state")
    docs, digests, stream = landed(spark, docs, state)
    update_state(stream, state)
    return docs, decided(docs, digests, read_state(spark, state), seen_before=checkpoint is not None)


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with all its columns: that with the smallest identifier, of those the first."""
    docs, rows = _run(spark, docs)
    return without(docs, written(rows.filter("not stays").select(*PLACE), "dedup-gone"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
