"""From documents to packed sequences: five stages, each over all that the one before it kept.

Quality classifier, exact dedup, near-dedup, mixing to target weights, best-fit packing. Every stage
but the last returns rows of documents with their columns; each is written as Parquet and read again.

Defined results, by the stages' operators: a null text counts as empty (empty texts are equal to one
another, have no shingles, cost no words and are one end-of-text id when packed); texts of any length are
taken whole; of rows that repeat a text, with their identifier or another one or none, the row with the
smallest identifier stays, of those the first by file and row number; ties everywhere go by identifier;
null languages and sources are a leaf of their own; other columns, whatever their names, are carried up
to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, mixing, near_dedup, packing, quality
from tidelog.llm.common import new_path, table

#: Words to a shingle of the near-dedup stage, with a similarity of 0.8 or more. (The query op5 takes four by its own contract.)
SHINGLE = 5
#: Of the tokens that reach the mixing stage, so much is kept; each document at most once.
MIX_PART = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, SHINGLE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs, mixing.domain_of(F.col("source")), MIX_PART, mixing.WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tree ensembles, minhashes and tokens are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
