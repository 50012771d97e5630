"""`python -m tidelog QUERY FOLDER [OUT]`: runs a registered query over a folder of tables and shows or writes its result."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.catalog import QUERIES


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("folder")
    parser.add_argument("out", nargs="?", help="a folder for the result; without it, 20 rows are shown")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"tidelog {given.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = QUERIES[given.query](spark, given.folder)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(20, False)


if __name__ == "__main__":
    main()
