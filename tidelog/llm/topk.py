"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Components become integers floor(256 * x). Rows are dealt into blocks of a bounded size; each block
is an index whose postings are grouped by dimension and quantised level (component // `WIDTH`), one
segment of row numbers each. For a query, a segment's impact is the least that it can add to the score
above the dimension's minimum, so impacts aren't negative; segments are processed by descending
quantised impact, each adding its impact to its rows' accumulators. At any time a row's score lies
between its accumulator and that plus the quantisation error and, for each dimension in which the row's
segment is still to come, the impact of the dimension's next segment. After the shares `CHECKS` of the
postings, rows whose upper bound is below the k-th best accumulator are struck out for good. Processing
stops only on proof: when at most `FEW` rows are left, or no segment is. All that are left are rescored
exactly, so nothing is lost; ties go to the smaller identifier.

Query blocks meet index blocks by key, both replicated by the other's number of blocks, and each meeting
returns k rows per query; nothing is broadcast and no pair of rows is ever emitted. A meeting builds its
block's index, which costs as much as some fifteen of its up to `BLOCK_QUERIES` queries.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part; vectors of
another length than the query's are compared over the dimensions that both have; identifiers name rows,
so rows that repeat the query's own identifier are not its candidates; a null identifier takes no part; an
empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE = 256
WIDTH = 2
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 8_192
#: Queries that are worth a task of their own where there are fewer meetings than cores.
TASK_QUERIES = 128
#: With so many possible members or fewer in a block, the rest is settled by rescoring.
FEW = 64
#: Shares of a block's postings after which bounds are compared.
CHECKS = (0.8, 0.88, 0.94, 1.0)
FOUND = "query_id long, vec_id long, score long"


class Index:
    """Postings of a block of integer vectors by (dimension, level)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        n, self.dims = rows.shape
        levels = np.floor_divide(rows[order], WIDTH)
        self.segment = np.empty((n, self.dims), dtype=np.intp)  # of each row and dimension: its segment
        posts, dim, low, size = [], [], [], []
        for d in range(self.dims):
            by = np.argsort(levels[:, d], kind="stable")
            at, where, count = np.unique(levels[by, d], return_inverse=True, return_counts=True)
            self.segment[by, d] = where + sum(map(len, low))
            posts.append(by)
            dim.append(np.full(len(at), d))
            low.append(at * WIDTH)
            size.append(count)
        self.posts = np.concatenate(posts)  # rows by dimension and level: segments one after another
        self.dim, self.low, self.size = np.concatenate(dim), np.concatenate(low), np.concatenate(size)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.level = np.repeat(self.low.astype(np.float64), self.size)
        self.edges = np.flatnonzero(np.diff(self.dim, prepend=-1, append=-1))  # of each dimension: its first segment, and the end
        self.processed = self.rescored = 0  # postings and rows of the last query

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (identifiers, scores), own_id left out."""
        q = query.astype(np.float64)
        weight = q[self.dim]
        base = np.where(q >= 0, 0.0, q * (WIDTH - 1))  # a negative weight's least is at the level's upper end
        least = weight * self.low + base[self.dim]
        floors = np.minimum.reduceat(least, self.edges[:-1])
        impact = least - floors[self.dim]
        order = np.argsort(-impact, kind="stable")
        upto = np.cumsum(self.size[order])
        error = np.abs(q).sum() * (WIDTH - 1)
        acc, done = np.zeros(len(self.ids)), 0
        gone = np.zeros(self.dims, dtype=np.intp)  # segments processed of each dimension: those of highest impact
        alive = np.flatnonzero(self.ids != own_id)
        for share in CHECKS:
            if len(alive) <= max(k, FEW):
                break
            end = int(np.searchsorted(upto, share * upto[-1])) + 1
            now = gone + np.bincount(self.dim[order[done:end]], minlength=self.dims)
            self._add(acc, q, base - floors, gone, now)
            gone, done = now, max(done, end)
            left = np.zeros(self.dims)
            np.maximum.at(left, self.dim[order[done:]], impact[order[done:]])
            bar = np.partition(acc[alive], len(alive) - k)[len(alive) - k] - error
            alive = alive[acc[alive] + left.sum() >= bar]
            to_come = left[self.dim]
            to_come[order[:done]] = 0.0
            alive = alive[acc[alive] + to_come[self.segment[alive]].sum(axis=1) >= bar]
        self.processed, self.rescored = int(upto[min(done, len(upto)) - 1]) if done else 0, len(alive)
        scores = self.rows[alive] @ q  # integers below 2**53: exact in float64
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][best], scores[best].astype(np.int64)

    def _add(self, acc: np.ndarray, q: np.ndarray, shift: np.ndarray, gone: np.ndarray, now: np.ndarray) -> None:
        """Adds to acc the impacts of each dimension's segments from gone to now, by descending impact: a stretch of its postings."""
        up = q >= 0
        a = self.first[np.where(up, self.edges[1:] - now, self.edges[:-1] + gone)]
        b = self.first[np.where(up, self.edges[1:] - gone, self.edges[:-1] + now)]
        parts = [d for d in range(self.dims) if a[d] < b[d] and q[d]]
        for i in range(0, len(parts), 8):  # a few dimensions at a time stay in the processor's cache
            some = parts[i : i + 8]
            rows = np.concatenate([self.posts[a[d] : b[d]] for d in some])
            impacts = np.concatenate([self.level[a[d] : b[d]] * q[d] + shift[d] for d in some])
            acc += np.bincount(rows, impacts, len(acc))


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(queries):
        for n in sorted(set(map(len, rows["v"]))):  # a block for each length of vector
            own = rows[rows["v"].map(len) == n]
            index = Index(own["vec_id"].to_numpy(dtype=np.int64), np.array(own["v"].tolist(), dtype=np.int64).reshape(len(own), n)) if n else None
            for query_id, v in zip(queries["vec_id"], queries["v"]):
                q = np.zeros(n, dtype=np.int64)
                q[: min(n, len(v))] = np.asarray(v, dtype=np.int64)[:n]
                if index is None:
                    ids = np.sort(own["vec_id"].to_numpy(dtype=np.int64))
                    ids = ids[ids != query_id][:k]
                    scores = np.zeros(len(ids), dtype=np.int64)
                else:
                    ids, scores = index.top(q, query_id, k)
                out.append(pd.DataFrame({"query_id": np.full(len(ids), query_id, dtype=np.int64), "vec_id": ids, "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_id", "vec_id", "score")})


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v, the integer vector, of rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best rows of vectors."""
    rows = whole(vectors, vector)
    asked = whole(vectors.filter(is_query), vector)
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    n = asked.count()
    spare = math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / blocks)
    parts = max(1, math.ceil(n / BLOCK_QUERIES), min(spare, n // TASK_QUERIES))
    spread = F.xxhash64("vec_id", F.monotonically_increasing_id())  # rows that repeat an identifier are spread too
    left = rows.withColumn("b", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("p", F.pmod(spread, F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(lambda a, b: search_block(a, b, k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
