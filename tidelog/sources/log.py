"""The durable log: messages as Parquet, sorted by path and offset so that point and range reads skip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import MESSAGES


def write_messages(messages: DataFrame, log: str, mode: str = "append", partitions: int | None = None) -> None:
    """Ranges of (path, offset) to files, each sorted: a filter on both reaches row-group statistics."""
    columns = [c.split()[0] for c in MESSAGES.split(", ")]
    rows = messages.select(*(c for c in columns if c in messages.columns))
    spread = rows.repartitionByRange(partitions, "path", "offset") if partitions else rows.repartitionByRange("path", "offset")
    spread.sortWithinPartitions("path", "offset").write.mode(mode).parquet(log)


def read_messages(spark: SparkSession, log: str, path: str | None = None, offset: str | None = None) -> DataFrame:
    rows = spark.read.parquet(log)
    if path is not None:
        rows = rows.filter(rows["path"] == path)
    if offset not in (None, "", "-1"):
        rows = rows.filter(rows["offset"] > offset)
    return rows
