"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

A text's set is its distinct `shingle`-word shingles, as 64-bit hashes. Two collections of `HALVES` short
minhash tuples (`WIDTH` minhashes each) are computed per distinct set; a table key is a pair (i, j) with the
tuples i of one collection and j of the other, so HALVES * HALVES tables of 2 * WIDTH minhashes each need
only 2 * HALVES * WIDTH minhashes. A pair of similarity 0.8 shares a key but for a chance of about
2 * (1 - 0.8**WIDTH)**HALVES, 7e-5.

1. Documents with equal sets are one class, named by the smallest identifier.
2. In each bucket (key), the class that shares most buckets leads; every other member is compared with
   the leaders of its buckets, on full sets: as many pairs as members, never all pairs of a bucket.
3. Verified links give components (alternating large and small stars over written tables).
4. What two members of a bucket could still have in common without their leader is settled exactly:
   members of a star with a member outside the leader's component meet by prefix filter, each with the
   `n - ceil(0.8 n) + 1` of its shingles that are rarest in the star, whether the leader has them or not, so
   a line that all members share makes no pairs while they have rarer shingles. Left out are members
   with too many shingles that no other member has, pairs of one component (of a list's largest one, only
   meetings with others are made), pairs that have too little left after their first meeting, and pairs too
   far apart by the triangle inequality of the Jaccard distance; survivors are verified.

Joins that many rows of one leader meet in are dealt over several tasks. Full texts are read for classes
with a partner alone: a Bloom filter keeps all others out of the exchange, at any size of the table.

Defined results: null and empty texts and texts without words have an empty set, are linked with nothing
and are their own component; texts with fewer words than a shingle are one shingle; texts of any length
are taken whole; repeated rows are in one class; an identifier that several texts share is in the
component of each of its texts; rows without an identifier are linked like others, and name a component
(null) or stay only where none in it has one; ties go to the smaller identifier, then by file and row
number; an empty table gives no rows; other columns, whatever their names, are kept by `keep_one` and
ignored otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLACE, TEXT_ROWS, narrowed, new_path, placed, table, without, written

HALVES = 10
WIDTH = 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Jaccard distance up to which sets can be linked.
FAR = 1 - PERCENT / 100 + 1e-9
#: Words to a shingle, unless the caller says otherwise (the registered query op5 takes four, the pipeline's stage these five).
SHINGLE = 5
#: Rows of one leader that one task compares.
SPLIT = 2_000
#: Classes whose keys one task makes, as long as that doesn't take more than so many tasks.
TASK_CLASSES = 10_000
MOST_TASKS = 20_000
BLOCK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DICE = np.random.Generator(np.random.PCG64(20))
BYTE = DICE.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(DICE.integers(0, 2**63)) * 2 + 1
FACTOR = DICE.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
SLOPE = DICE.integers(0, 2**64, 2 * HALVES * WIDTH, dtype=np.uint64) | np.uint64(1)
SHIFT = DICE.integers(0, 2**64, 2 * HALVES * WIDTH, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below size."""
    up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, pow(BASE, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of lower-cased bytes."""
    out = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            gaps = np.flatnonzero(SPACE[raw[at:end]])
            while not len(gaps) and end < len(raw):  # a word longer than a block
                end = min(len(raw), end + BLOCK)
                gaps = np.flatnonzero(SPACE[raw[at:end]])
            if len(gaps) and end < len(raw):
                end = at + int(gaps[-1]) + 1
        part = raw[at:end]
        at = end
        up, down = powers(1 << max(16, (len(part) - 1).bit_length()))
        gap = SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[part] * up[: len(part)], dtype=np.uint64)))
        out.append(mixed((run[last] - run[first]) * down[first] + (last - first).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The set: sorted distinct hashes of k-word shingles."""
    words = word_hashes(LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)])
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += words[i : i + n] * FACTOR[i % 64]
        if k > 64:
            total = mixed(total)
    return np.unique(mixed(total))


def minhashes(s: np.ndarray) -> np.ndarray:
    """The tuples of both collections, each as one number."""
    low = np.full(len(SLOPE), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[at : at + 2048, None] * SLOPE + SHIFT).min(axis=0), out=low)
    pairs = low.reshape(2 * HALVES, WIDTH)
    total = np.zeros(2 * HALVES, dtype=np.uint64)
    for i in range(WIDTH):
        total = mixed(total + pairs[:, i] * FACTOR[i])
    return total.view(np.int64)


def set_name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, file: Column, row: Column, k: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch["text"]]
            marks = [minhashes(s) if len(s) else np.zeros(0, dtype=np.int64) for s in sets]
            yield pd.DataFrame({"file": batch["file"], "row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "set_id": [set_name(s) for s in sets], "a": [m[:HALVES] for m in marks], "b": [m[HALVES:] for m in marks]})

    given = docs.select(file.alias("file"), row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return given.mapInPandas(sign, "file string, row long, doc_id long, n long, set_id binary, a array<long>, b array<long>")


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(id, s): the sets of the classes in needed (id, file, row), from the whole texts of their first documents."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "s": [shingles(t, k).view(np.int64) for t in batch["text"]]})

    meta = docs.metadataColumn("_metadata")
    texts, flag = narrowed(docs.select(meta["file_path"].alias("file"), meta["row_index"].alias("row"), F.col("text")), [*PLACE], needed)
    some = texts.filter(F.col(flag)).join(needed, [*PLACE]).select("id", "text")
    return some.mapInPandas(make, "id long, s array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest identifier that edges (x, y) reach, for each identifier in them that isn't a root."""
    edges = written(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return edges.select(F.col("x").alias("id"), F.col("y").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "links-least")
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.filter("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(low, "x")
        stars = joined.filter("y <> m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        edges = written(stars.distinct(), "links")


def spread(rows: DataFrame, heads: DataFrame, key: str, salt: str, counted: DataFrame) -> DataFrame:
    """rows joined to heads by key; a key with over `SPLIT` rows is dealt by salt over several tasks, each with a copy of its head.

    counted: a written table with a row for each of rows, by which keys are counted."""
    parts = written(counted.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")).filter("parts > 1"), "hot-keys")
    last = F.coalesce("parts", F.lit(1)) - 1
    dealt = rows.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64(salt), last + 1).cast("int")).drop("parts")
    copies = heads.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def sets_of(ids: DataFrame, sets: DataFrame, name: str, value: str) -> DataFrame:
    """sets as (name, value), without most of those that aren't in ids' column of that name, which should be written."""
    some, flag = narrowed(sets.select(F.col("id").alias(name), F.col("s").alias(value)), [name], ids)
    return some.filter(F.col(flag)).drop(flag)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) with the sizes of both sets and of what they share. pairs should be written."""
    first = pairs.join(sets_of(pairs, sets, "x", "sx"), "x")
    both = spread(first, sets_of(pairs, sets, "y", "sy"), "y", "x", pairs)
    return both.select("x", "y", F.size("sx").cast("long").alias("nx"), F.size("sy").cast("long").alias("ny"), F.size(F.array_intersect("sx", "sy")).cast("long").alias("both"))


def linked() -> Column:
    return 100 * F.col("both") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("both"))


def need(nx: Column, ny: Column) -> Column:
    """The least that sets of these sizes share where they are linked."""
    return F.ceil(PERCENT * (nx + ny) / (100 + PERCENT))


def leaders(classes: DataFrame) -> DataFrame:
    """Distinct (x, y): class x shares a bucket that y leads."""
    keys = F.flatten(F.transform("a", lambda u, i: F.transform("b", lambda v, j: F.xxhash64(i, j, u, v))))
    tasks = min(MOST_TASKS, math.ceil(classes.count() / TASK_CLASSES))
    rows = classes.select("id", "a", "b").repartition(max(1, tasks)).select("id", F.explode(keys).alias("key"))
    # sizes are summed before the shuffle and joined from a written table, so that a hot bucket is split, not one task
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "bucket-sizes")
    shared, flag = narrowed(rows, ["key"], sizes)  # most keys are one class's alone
    hits = written(shared.filter(F.col(flag)).drop(flag).join(sizes, "key"), "bucket-rows")
    degree = written(hits.groupBy("id").agg(F.sum("m").alias("degree")), "degrees")
    ranked = hits.select("id", "key").join(degree, "id")
    lead = written(ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("lead")).select("key", (-F.col("lead.id")).alias("y")), "bucket-leaders")
    return hits.select(F.col("id").alias("x"), "key").join(lead, "key").select("x", "y").filter("x <> y").distinct()


def open_stars(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(z, id, n, d, c) of members that could be linked to another member of their star z and aren't in one component with it."""
    union = F.col("nx") + F.col("ny") - F.col("both")
    root = roots.select(F.col("id").alias("x"), F.col("root").alias("rx"))
    lead = roots.select(F.col("id").alias("y"), F.col("root").alias("ry"))
    rows = stars.join(root, "x", "left").join(lead, "y", "left").select(F.col("y").alias("z"), F.col("x").alias("id"), F.col("nx").alias("n"), (1 - F.col("both") / union).alias("d"), F.coalesce("rx", "x").alias("c"), F.coalesce("ry", "y").alias("cz"))
    star = rows.groupBy("z").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(F.col("c") != F.col("cz"), F.col("d"))).alias("near"))
    # tables that hot stars are joined to are written, so that the joins' sides are plain exchanges, which can be split
    star = written(star.filter("m > 1 and near is not null").select("z", "near"), "star-heads")
    return rows.join(star, "z").filter((F.col("c") != F.col("cz")) | (F.col("near") <= F.col("d") + FAR)).select("z", "id", "n", "d", "c")


def prefixes(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(z, h, id, n, r, k, d, c), written: the shingles by which members of a star can meet.

    Shingles rank by the number of the star's members that have them, rarest first. r of a member's n are
    others' too; k is the rank in the member. Linked sets share one of their first n - ceil(0.8 n) + 1."""
    members = rest.select("z", "id", F.col("n").cast("int").alias("n")).join(sets_of(rest, sets, "id", "s"), "id")
    each = written(members.select("z", "id", "n", F.explode("s").alias("h")), "star-shingles")
    held = written(each.groupBy("z", "h").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1"), "star-held")
    own = Window.partitionBy("z", "id")
    # shingles that no other member has are the rarest: they only shift the ranks of the others
    each, flag = narrowed(each, ["z", "h"], held)
    ranked = each.filter(F.col(flag)).drop(flag).join(held, ["z", "h"]).withColumn("r", F.count(F.lit(1)).over(own)).withColumn("k", F.col("n") - F.col("r") + F.row_number().over(own.orderBy("df", "h")))
    smallest = F.ceil(F.col("n") * PERCENT / 100)
    first = ranked.filter((F.col("k") <= F.col("n") - smallest + 1) & (F.col("r") >= need(F.col("n"), smallest))).select("z", "h", "id", "r", "k")
    return written(first.join(rest, ["z", "id"]), "star-prefixes")


def meeting(keys: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of members that meet in a shingle, in different components, and could be linked by their sizes and ranks."""
    left = F.col("n") - F.col("k") + 1  # what a member has from this rank on: a pair shares no more, where this is its first meeting
    # what a member shares with others of the star is at most r
    for _ in range(2):
        lists = keys.groupBy("z", "h").agg(F.min("n").alias("least"), F.min("c").alias("c1"), F.max("c").alias("c2"))
        lists = written(lists.filter("c1 <> c2").select("z", "h", "least"), "star-lists")
        partner = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100))
        keys = written(keys.join(lists, ["z", "h"]).filter(F.least(F.col("r"), left) >= need(F.col("n"), partner)).drop("least"), "star-keys")
    # of a list's largest component only the meetings with others matter, so its members are on one side alone
    sized = keys.groupBy("z", "h", "c").agg(F.count(F.lit(1)).alias("m"))
    main = written(sized.groupBy("z", "h").agg(F.max_by("c", F.struct("m", "c")).alias("main")), "star-mains")
    others = keys.join(main, ["z", "h"]).filter("c <> main")
    right = keys.select("z", "h", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "r", "k", "d", "c")))
    wanted = need(F.col("n"), F.col("n2"))
    once = (F.col("c2") == F.col("main")) | (F.col("id") < F.col("id2"))
    near = (F.col("c") != F.col("c2")) & (F.abs(F.col("d") - F.col("d2")) <= FAR) & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2"))
    could = (F.least("r", "r2") >= wanted) & (F.least(F.col("n") - F.col("k"), F.col("n2") - F.col("k2")) + 1 >= wanted)
    met = others.join(right, ["z", "h"]).filter(once & near & could)
    return met.select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).distinct()


def linked_documents(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """docs as files, and file, row, doc_id, n of each row with the first row of its component (top: no_id, doc_id, file, row; null for empty sets)."""
    docs, file, row = placed(docs, new_path(docs.sparkSession, "near-docs"))
    signed = written(signatures(docs, file, row, k), "signatures", TEXT_ROWS)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    heads = signed.filter("n > 0").groupBy("n", "set_id").agg(F.min(F.struct(first.alias("top"), "a", "b")).alias("v"))
    # numbered as they are written: classes have names even where rows repeat an identifier or have none
    classes = written(heads.select(F.monotonically_increasing_id().alias("id"), "set_id", "v.top", "v.a", "v.b"), "classes")
    pairs = written(leaders(classes), "pairs")
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    needed = written(classes.select("id", "top.file", "top.row").join(wanted, "id"), "needed")
    sets = written(full_sets(docs, needed, k), "sets", TEXT_ROWS)
    stars = written(measured(pairs, sets), "stars")
    roots = components(stars.filter(linked()).select("x", "y"))
    rest = written(open_stars(stars, roots), "star-rest")
    if not rest.isEmpty():
        more = written(meeting(prefixes(rest, sets)), "rest-pairs")
        found = written(measured(more, sets).filter(linked()).select("x", "y"), "rest-links")
        if not found.isEmpty():
            roots = components(roots.select(F.col("id").alias("x"), F.col("root").alias("y")).unionByName(found))
    named = written(classes.select("id", "set_id", "top").join(roots, "id", "left").select("set_id", "top", F.coalesce("root", "id").alias("root")), "named")
    tops = written(named.groupBy("root").agg(F.min("top").alias("top")), "tops")
    by_set = named.select("set_id", "root").join(tops, "root").drop("root")
    rows = signed.select("file", "row", "doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return docs, rows.join(by_set, "set_id", "left").drop("set_id")


def near_duplicates(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    rows = linked_documents(docs, k)[1]
    component = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row of docs of each component, with all its columns: that with the smallest identifier, of those the first."""
    docs, rows = linked_documents(docs, k)
    gone = rows.filter(F.col("top").isNotNull() & ((F.col("file") != F.col("top.file")) | (F.col("row") != F.col("top.row"))))
    return without(docs, written(gone.select(*PLACE), "near-gone"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
