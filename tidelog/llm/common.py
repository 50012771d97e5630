"""Helpers that the training-data operators share: the shared folder, written tables, offsets of matches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: White space of the word rules: space and the control characters tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that a Python worker holds at once.
TEXT_ROWS = 1_000


def written(df: DataFrame, name: str, text_rows: int | None = None) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage and outlives executors.

    text_rows: rows to an Arrow batch while it is written, where df runs Python over texts."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if text_rows:
        spark.conf.set(key, str(text_rows))
    try:
        df.write.parquet(path)
    finally:
        if text_rows:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A row's place: the file that holds it and its number there. It tells rows apart that repeat an identifier, or have none.
PLACE = ("file", "row")


def _plain(docs: DataFrame) -> bool:
    """Whether docs is a table's files, filtered and projected at most, so that a place names one row of it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame, path: str) -> tuple[DataFrame, Column, Column]:
    """docs as rows of Parquet files (written to path where they aren't), and their places: file and row."""
    if _plain(docs):
        meta = docs.metadataColumn("_metadata")
        try:
            docs.select(meta["file_path"], meta["row_index"])
            return docs, meta["file_path"], meta["row_index"]
        except AnalysisException:  # files of a kind without row numbers
            pass
    docs.write.parquet(path)
    docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    meta = docs.metadataColumn("_metadata")
    return docs, meta["file_path"], meta["row_index"]


#: Size of the filter that keeps rows out of an exchange: so many bits for each wanted row, 64 MB at most, whatever the tables' size.
BITS_EACH = 16
FILTER_BITS = 1 << 29
WORDS = 64  # words of 64 bits to a row of the filter's table


def _slots(h: Column, words: int) -> tuple[Column, Column, Column]:
    """The filter's row, the word in it and the two bits of the word that belong to a hash."""
    word = F.pmod(h, F.lit(words))
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return (F.floor(word / WORDS)).cast("int"), (word % WORDS).cast("int"), bit(40).bitwiseOR(bit(50))


def narrowed(rows: DataFrame, keys: list[str], wanted: DataFrame) -> tuple[DataFrame, str]:
    """rows with a flag: false only where keys aren't among those of wanted, true wherever they are and by chance for a few others.

    A Bloom filter of the keys, each in one word, is broadcast: `FILTER_BITS` at most. So rows that a join with
    wanted can't touch stay out of its exchange, texts and all. With more than `FILTER_BITS / BITS_EACH` keys ever more
    rows are flagged by chance; the join that must follow decides, so results are the same. wanted should be written."""
    words = max(WORDS, min(FILTER_BITS, wanted.count() * BITS_EACH) // 64)
    block, word, bits = _slots(F.xxhash64(*keys), words)
    cells = wanted.select(block.alias("b"), word.alias("w"), bits.alias("v"))
    merged = cells.groupBy("b").agg(F.array(*(F.coalesce(F.bit_or(F.when(F.col("w") == i, F.col("v"))), F.lit(0).cast("long")) for i in range(WORDS))).alias("v"))
    b, v, flag = fresh(rows, "_b", "_v", "_flag")
    table_ = written(merged, "filter").select(F.col("b").alias(b), F.col("v").alias(v))
    hit = F.get(F.col(v), word).bitwiseAND(bits) == bits
    return rows.join(F.broadcast(table_), block == F.col(b), "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop(b, v), flag


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs, as returned by placed(), whose places dropped (PLACE) doesn't have, with all their columns.

    Only rows that the filter flags go through the anti-join's exchange."""
    columns, file, row = docs.columns, *fresh(docs, "_file", "_row")
    meta = docs.metadataColumn("_metadata")
    rows = docs.withColumns({file: meta["file_path"], row: meta["row_index"]})
    gone = dropped.select(F.col("file").alias(file), F.col("row").alias(row))
    rows, flag = narrowed(rows, [file, row], gone)
    plain = [F.col(f"`{c}`") for c in columns]
    unsure = rows.filter(F.col(flag)).join(gone, [file, row], "left_anti").select(*plain)
    return rows.filter(~F.col(flag)).select(*plain).union(unsure)


def held_out(doc_id: Column) -> Column:
    """True for rows that no classifier may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(text: Column, pattern: str) -> Column:
    """array<struct<p, m>>: each match m of pattern with the text p between it and the match before."""
    p = F.split(text, pattern, -1)
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(p, F.lit(1), F.size(m)).alias("p"), m.alias("m"))


#: Matches to a chunk: offsets are summed within chunks, then over chunks, so a text with very many stays cheap.
CHUNK = 128


def located(cuts: Column) -> Column:
    """array<struct<s, e, m, before>> from cut(): code point offsets, end exclusive.

    cuts must be a column of the frame, not an expression, so that it is computed once."""
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string,before:string>>)")

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["p"])
        e = s + F.length(x["m"])
        item = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(40)).alias("before"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    def block(b: Column) -> Column:
        return F.aggregate(F.slice(cuts, b * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out")), step)

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda y: F.struct((y["s"] + acc["pos"]).alias("s"), (y["e"] + acc["pos"]).alias("e"), y["m"].alias("m"), y["before"].alias("before")))
        return F.struct((acc["pos"] + x["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / CHUNK).cast("int")), block)
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.expr("cast(array() as array<array<struct<s:bigint,e:bigint,m:string,before:string>>>)").alias("out"))
    return F.when(F.size(cuts) > 0, F.flatten(F.aggregate(blocks, start, join, lambda a: a["out"]))).otherwise(empty)
