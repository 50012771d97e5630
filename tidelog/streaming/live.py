"""Live tails of a message log: a file stream past an offset, ended by closure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import MESSAGES


def tail(spark: SparkSession, log: str, path: str | None = None, offset: str = "-1", schema: str = MESSAGES, files_per_batch: int | None = None) -> DataFrame:
    """The messages of a log folder past an offset, those to come included; offset and path are pushed to the scan."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(log)
    if path is not None:
        rows = rows.filter(F.col("path") == path)
    return rows if offset in ("", "-1") else rows.filter(F.col("offset") > offset)


def follow(rows: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, is_closed: Callable[[], bool], timeout: float = 30.0, poll: float = 0.2) -> StreamingQuery:
    """Hands batches of rows to take until is_closed() and all has been read, or nothing has come for timeout seconds."""
    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
    last, since = -1, time.monotonic()
    while query.isActive:
        progress = query.lastProgress
        batch = progress["batchId"] if progress and progress["numInputRows"] else last
        if batch != last:
            last, since = batch, time.monotonic()
        if is_closed():
            query.processAllAvailable()
            query.stop()
        elif time.monotonic() - since > timeout:
            query.stop()
        else:
            time.sleep(poll)
    return query
