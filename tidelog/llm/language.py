"""Language identification by prediction by partial matching (PPM) over bytes.

For each language, a context tree over the folded bytes of a bounded training sample (at most
`SAMPLE` labelled rows a language, whole texts) holds the counts of each byte after contexts of up to
`ORDER` bytes. Its statistics are frozen, so the code length of a byte after a context is a constant:
with c occurrences of the byte among n after the longest context in which it occurs, and d distinct
bytes there, it costs log2((n + d) / c) bits, plus log2((n + d) / d) bits for each escape from a longer
context of which the tree knows something. A text's code length is the sum over all its bytes, and
the language with the shortest wins. Languages are taken `SLICE` at a time: the symbol sequences that any
of a slice's trees knows are rows of a hashed table (sequence by language) of code lengths, so scoring is
one lookup a byte and slice, and further ones, by escapes, only for sequences that none of them knows.
Tables grow with what the trees hold, so the order is `ORDER` for every alphabet and number of languages.

Folding: A-Z to a-z, digits to one symbol, white space to one symbol, bytes that no training text has to
one "other" symbol.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language
whose code sorts first; with nothing to learn from, all are `und`; texts of any length are scored whole,
every byte of them; repeated rows are learned from once and predicted each; an empty table gives no rows;
other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, table, written

#: At most so many rows of each language are learned from.
SAMPLE = 250
#: Longer texts aren't learned from, except by their first so many characters where a language has no others; they are predicted whole like any other.
SAMPLE_CHARS = 100_000
ORDER = 3
#: Languages that share a table.
SLICE = 8
#: Bytes of text that are scored at once.
BLOCK = 1 << 20
#: At most so many languages are learned, those with the most labelled rows, from so many characters in all, shared evenly: what a column of dirty codes costs is bounded.
LANGUAGES = 1_000
SAMPLE_TOTAL = 64_000_000


def folded() -> np.ndarray:
    """Byte to byte: letters in lower case, digits as 0, white space as a space."""
    fold = np.arange(256)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[9:14] = 32
    return fold


def sample(docs: DataFrame, most: int = SAMPLE) -> dict[str, list[str]]:
    """Texts to learn from, by language: of each, those whose identifiers' hashes are smallest, within its share of `SAMPLE_TOTAL`."""
    given = docs.select(F.col("doc_id").alias("id"), "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    size = F.length("text")
    rows = given.select("lang", F.xxhash64("id").alias("h"), "id", (size > SAMPLE_CHARS).alias("over"), F.least(size, F.lit(SAMPLE_CHARS)).alias("size")).groupBy("lang", "h", "id", "over").agg(F.min("size").alias("size"))
    rows = written(rows, "language-rows")
    shares = rows.groupBy("lang").agg(F.count_if(~F.col("over")).alias("short"), F.count_if("over").alias("long"))
    counted = shares.select("lang", (F.col("short") == 0).alias("only_over"), F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("long")).alias("n"))
    counted = written(counted.orderBy(F.col("n").desc(), "lang").limit(LANGUAGES), "language-counts")
    share = SAMPLE_TOTAL // max(1, counted.count())
    best = Window.partitionBy("lang").orderBy("h", "id")
    # hashes are uniform: twice the wanted share is cut out first, so that ranking sees few rows
    near = rows.join(F.broadcast(counted), "lang").filter(F.col("over") == F.col("only_over")).filter((F.col("n") <= 4 * most) | (F.col("h") < -(2.0**63) + 2.0**64 * 2 * most / F.col("n")))
    ranked = near.withColumn("k", F.row_number().over(best)).withColumn("upto", F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chosen = ranked.filter(F.col("k") <= most).filter((F.col("k") == 1) | (F.col("upto") <= share)).select("id", "lang", "over")
    # at most `SAMPLE` rows of each of `LANGUAGES` languages: identifiers and codes alone
    picked = given.withColumn("over", size > SAMPLE_CHARS).join(F.broadcast(chosen), ["id", "lang", "over"])
    picked = picked.groupBy("lang", "id").agg(F.min(F.substring("text", 1, min(SAMPLE_CHARS, max(1, share)))).alias("text"))  # repeated rows count once
    out: dict[str, list[str]] = {}
    for r in picked.collect():  # at most SAMPLE_TOTAL characters, and one text a language
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: sorted(v) for k, v in sorted(out.items())}


def sequences(symbols: np.ndarray, size: int, order: int) -> np.ndarray:
    """For each place, the number of its symbol after the order symbols before it; symbols must begin with order zeros."""
    code = np.zeros(len(symbols) - order, dtype=np.int64)
    for k in range(order + 1):
        code = code * size + symbols[k : len(symbols) - order + k]
    return code


class Rows:
    """Numbers of sorted distinct codes, by open addressing."""

    def __init__(self, codes: np.ndarray) -> None:
        self.bits = max(1, int(4 * len(codes)).bit_length())
        self.codes = np.append(codes, -1)  # the last stands for an empty slot
        self.slots = np.full(1 << self.bits, len(codes), dtype=np.int32)
        left, at = np.arange(len(codes)), self.place(codes)
        while len(left):
            free = self.slots[at] == len(codes)
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Each code's number; that of all codes where it isn't among them."""
        at = self.place(codes)
        out = self.slots[at]
        known = self.codes[out]
        left = np.flatnonzero((known != codes) & (known >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[at[left]]
            known = self.codes[out[left]]
            left = left[(known != codes[left]) & (known >= 0)]
        return out


class Trees:
    """Counts of each language's context tree, kept sparsely; laid out as tables of code lengths in each worker."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER) -> None:
        fold = folded()
        raw = {k: [fold[np.frombuffer(t.encode(), dtype=np.uint8)] for t in v] for k, v in texts.items()}
        seen = np.unique(np.concatenate([x for v in raw.values() for x in v] or [np.zeros(0, dtype=int)]))
        self.langs, self.symbol = list(texts), np.zeros(256, dtype=np.int64)
        number = np.zeros(256, dtype=np.int64)
        number[seen] = 1 + np.arange(len(seen))  # 0: begin of text, and bytes never seen
        self.symbol = number[fold]
        self.size = len(seen) + 1
        self.order = order
        self.counts = []
        for v in raw.values():
            lists = [sequences(np.concatenate((np.zeros(self.order, dtype=np.int64), number[x])), self.size, self.order) for x in v]
            self.counts.append(np.unique(np.concatenate(lists or [np.zeros(0, dtype=np.int64)]), return_counts=True))
        self._slices = None

    def slices(self) -> list[list[tuple[Rows, np.ndarray, Rows, np.ndarray]]]:
        """Of each slice of the languages and each order: known sequences with their bits, known contexts with their escapes."""
        if self._slices is None:
            self._slices = [self.levels(self.counts[j : j + SLICE]) for j in range(0, len(self.counts), SLICE)]
        return self._slices

    def levels(self, trees: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[Rows, np.ndarray, Rows, np.ndarray]]:
        out: list[tuple[Rows, np.ndarray, Rows, np.ndarray]] = []
        shorter = None
        for k in range(self.order + 1):
            every = np.unique(np.concatenate([codes for codes, _ in trees]) % self.size ** (k + 1))
            contexts = np.unique(every // self.size)
            bits, escapes = np.empty((len(every), len(trees)), dtype=np.float32), np.zeros((len(contexts) + 1, len(trees)), dtype=np.float32)
            for j, (codes, counts) in enumerate(trees):
                own, where = np.unique(codes % self.size ** (k + 1), return_inverse=True)
                c = np.bincount(where, counts, len(own))
                context, place = np.unique(own // self.size, return_inverse=True)
                n, d = np.bincount(place, c, len(context)), np.bincount(place, minlength=len(context))
                escapes[np.searchsorted(contexts, context), j] = np.log2((n + d) / np.maximum(d, 1))
                below = np.log2(self.size) if shorter is None else shorter[1][shorter[0].find(every % self.size**k), j]
                bits[:, j] = escapes[np.searchsorted(contexts, every // self.size), j] + below
                bits[np.searchsorted(every, own), j] = np.log2((n[place] + d[place]) / c)
            shorter = (Rows(every), bits)
            out.append((*shorter, Rows(contexts), escapes))
        return out

    def code_lengths(self, raw: bytes) -> np.ndarray:
        """Bits of a text in each language: every byte counts."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(raw), BLOCK):
            before = raw[max(0, at - self.order) : at]
            own = self.symbol[np.frombuffer(before + raw[at : at + BLOCK], dtype=np.uint8)]
            own = np.concatenate((np.zeros(self.order - len(before), dtype=np.int64), own))
            codes = sequences(own, self.size, self.order)
            for i, levels in enumerate(self.slices()):
                total[i * SLICE : (i + 1) * SLICE] += self.bits_of(codes, levels)
        return total

    def bits_of(self, codes: np.ndarray, levels: list[tuple[Rows, np.ndarray, Rows, np.ndarray]]) -> np.ndarray:
        total = np.zeros(levels[0][1].shape[1])
        for k in range(self.order, -1, -1):
            known, bits, contexts, escapes = levels[k]
            row = known.find(codes)
            new = row == len(bits)
            total += bits[row[~new]].sum(axis=0, dtype=np.float64)
            codes = codes[new]
            if not len(codes):
                return total
            total += escapes[contexts.find(codes // self.size)].sum(axis=0, dtype=np.float64)
            codes = codes % self.size**k
        return total + len(codes) * np.log2(self.size)


def predicted(trees: Trees, text: str) -> tuple[str, float]:
    """The language and its share of the posterior, by code lengths a byte times a fixed number of bytes."""
    raw = text.encode()
    bits = trees.code_lengths(raw)
    best = int(np.argmin(bits))
    odds = np.exp2(np.maximum(-(bits - bits[best]), -60.0))
    return trees.langs[best], float(1 / odds.sum())


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""
    spark = docs.sparkSession
    trees = Trees(sample(docs if learn_from is None else learn_from))
    shared = spark.sparkContext.broadcast(trees)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            found = [predicted(own, t) if letter and own.langs else ("und", 0.0) for t, letter in zip(batch["text"], batch["letter"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return given.mapInPandas(score, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
