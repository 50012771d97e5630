"""Best-fit packing of documents into sequences by large-item matching.

Each document is encoded in full and ends with an end-of-text id; longer ones than a sequence are cut
into whole sequences, the first piece taking the remainder. Packing works on the histogram of piece
lengths, at most one row a length, so the plan's size depends on the capacity alone, not on the
corpus: pieces above a third of the capacity pair at most twice per bin by greedy matching (the
longest with the longest that fits), smaller ones then go, longest first, to the tightest gap that
takes them. A plan row says "the pieces of this length with ranks a to b go to bins from c on, k to a
bin, from this offset". Pieces learn their rank within their length from task-local ranks plus a
running count over tasks, so a length that a third of all pieces share is spread like any other.

Defined results: null text counts as empty, and an empty document is the end-of-text id alone;
texts of any length are encoded whole and cut into pieces; repeated rows are packed each; pieces of equal
length are dealt in the order of their tasks (which of them goes where isn't part of the result); an
empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, table, written
from .tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [0]
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, seen, task = encoder(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = enc.ids(text or "")
                ids.append(end_id)
                starts = piece_starts(len(ids), capacity)
                raw = np.array(ids, dtype="<u4")
                for i, start in enumerate(starts):
                    own = raw[start : starts[i + 1] if i + 1 < len(starts) else len(ids)]
                    rows.append((doc_id, i, start, len(own), zlib.crc32(own.data), task, seen[len(own)]))
                    seen[len(own)] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])
            yield out.astype({"doc_id": "Int64", "piece": "int32"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces to a bin, offset in the bin) by large-item matching and best fit."""
    left = {s: n for s, n in histogram.items() if n}
    used = {s: 0 for s in left}
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first bin, bins)
    bins = 0

    def place(size: int, first: int, count: int, each: int, fill: int) -> None:
        """count bins from first on get each pieces of this size."""
        rows.append((size, used[size], used[size] + count * each, first, each, fill))
        used[size] += count * each
        left[size] -= count * each

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            mate = next((s for s in large if s <= capacity - size and left[s] and s <= size), None)
            if mate is None:
                n = left[size]
                place(size, bins, n, 1, 0)
                gaps[capacity - size].append((bins, n))
            elif mate == size:
                n = left[size] // 2
                if not n:
                    mate = next((s for s in large if s < size and left[s]), None)
                    n = 1
                    place(size, bins, 1, 1, 0)
                    if mate is not None:
                        place(mate, bins, 1, 1, size)
                    gaps[capacity - size - (mate or 0)].append((bins, 1))
                else:
                    place(size, bins, n, 2, 0)
                    gaps[capacity - 2 * size].append((bins, n))
            else:
                n = min(left[size], left[mate])
                place(size, bins, n, 1, 0)
                place(mate, bins, n, 1, size)
                gaps[capacity - size - mate].append((bins, n))
            bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            gap = next((g for g in range(size, capacity) if gaps.get(g)), None)
            if gap is None:  # a new bin takes as many as fit
                gap, first, many = capacity, bins, -(-left[size] // (capacity // size))
                bins += many
            else:
                first, many = gaps[gap].pop()
            each = gap // size
            whole = min(many, left[size] // each)
            if whole:
                place(size, first, whole, each, capacity - gap)
                gaps[gap - each * size].append((first, whole))
            rest = left[size] if whole < many else 0
            if rest:
                place(size, first + whole, 1, rest, capacity - gap)
                gaps[gap - rest * size].append((first + whole, 1))
                whole += 1
            if whole < many:
                gaps[gap].append((first + whole, many - whole))
    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: where it goes. Bins are numbered over the whole corpus."""
    cut = written(pieces(docs, tokenizer or default_path(), capacity, end_id), "pieces", TEXT_ROWS)
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row a length
    rows = sorted(plan(histogram, capacity))
    starts: dict[int, np.ndarray] = {}
    for size in {r[0] for r in rows}:
        starts[size] = np.array([r[1:] for r in rows if r[0] == size], dtype=np.int64)
    shared = spark.sparkContext.broadcast(starts)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            for size in np.unique(length):
                at, table_ = np.flatnonzero(length == size), shared.value[int(size)]
                row = table_[np.searchsorted(table_[:, 0], rank[at], side="right") - 1]
                i = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + i // row[:, 3], row[:, 4] + i % row[:, 3] * size
            yield batch.assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(deal, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
