"""Analytics over outcomes: an addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """path, status, http_status, n."""
    return outcomes.groupBy("path", "status", "http_status").agg(F.count(F.lit(1)).alias("n"))


def duplicate_share(outcomes: DataFrame) -> DataFrame:
    """path, n, share of requests that were retries."""
    return outcomes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "duplicate").cast("double")).alias("duplicate_share"))
