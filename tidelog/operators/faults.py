"""Injected faults: for each path, the first `count` requests of a method answer with its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .read import with_nulls


def faulted(requests: DataFrame, faults: DataFrame) -> DataFrame:
    """requests (path, method, ingest_seq) with `fault_status`, null where the request goes on, and `retry_after`.

    faults: at most one row a path, with method (null: any), count, status (null: used up without effect) and, if
    given, retry_after. Other fields of a fault have no effect. Only requests under a rule are ranked."""
    f = with_nulls(faults, retry_after="int")
    f = f.select(F.col("path").alias("_path"), F.upper("method").alias("_method"), F.col("count").alias("_count"), F.col("status").alias("_status"), F.col("retry_after").alias("_after"))
    rule = (F.col("path") == F.col("_path")) & (F.coalesce(F.col("_method") == "", F.lit(True)) | (F.col("_method") == F.upper("method")))
    order = Window.partitionBy("path").orderBy("ingest_seq")
    under = requests.join(f, rule).withColumn("_k", F.row_number().over(order))
    hit = F.col("_k") <= F.greatest("_count", F.lit(1))
    under = under.withColumns({"fault_status": F.when(hit, F.col("_status")), "retry_after": F.when(hit & F.col("_status").isNotNull(), F.col("_after"))})
    free = requests.join(f, rule, "left_anti").withColumns({"fault_status": F.lit(None).cast("int"), "retry_after": F.lit(None).cast("int")})
    columns = [*requests.columns, "fault_status", "retry_after"]
    return under.select(*columns).unionByName(free.select(*columns))
