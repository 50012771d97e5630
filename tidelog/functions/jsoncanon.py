"""Canonical JSON of a stream's payloads: exact only with Python's encoder, so one function serves batch, streaming and SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_compact = json.JSONEncoder(separators=(",", ":")).encode


def elements(body: bytes | None) -> list[str] | None:
    """The compact texts of a body's elements: of an array each one, else the value itself; None where the body isn't JSON."""
    try:
        value = json.loads(bytes(body or b"").decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    return [_compact(x) for x in (value if isinstance(value, list) else [value])]


def stored(parts: list[str]) -> bytes:
    """Elements as they lie in a stream: each followed by a comma."""
    return "".join(p + "," for p in parts).encode()


@F.pandas_udf(ArrayType(StringType()))
def canonical_elements(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in bodies:
        yield pd.Series([elements(b) for b in batch])


def canonical(body: Column) -> Column:
    """A body's stored text; null where it isn't JSON."""
    return F.aggregate(canonical_elements(body.cast("binary")), F.lit(""), lambda a, x: F.concat(a, x, F.lit(",")))


def register(spark: SparkSession) -> None:
    """Makes json_elements(body) callable from SQL."""
    spark.udf.register("json_elements", canonical_elements)
