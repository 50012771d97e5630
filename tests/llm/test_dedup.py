"""Exact and near dedup against brute force, with nulls, ties, repeated rows and skewed groups."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm import exact_dedup as E
from tidelog.llm import near_dedup as N
from tidelog.llm.common import new_path
from tidelog.llm.exact_dedup import decided, exact_dedup, keep_first, landed, read_state, update_state

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more: str = ""):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


CLASHING = ("1 as sha", "2 as keep_id", "3 as _flag", "4 as _stay", "5 as file", "6 as row", "7 as _FILE", "8 as _b", "9 as body", "10 as stays", "11 as _metadata")
EXACT = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (4, ""), (7, "c"), (7, "c"), (8, "c d"), (3, "c d"), (6, "a b")]


def test_exact(spark):
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(spark, docs(spark, EXACT)).collect()}
    norm = {(i, k): re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for k, (i, t) in enumerate(EXACT)}
    want = set()
    for (i, _), t in norm.items():
        group = [j for (j, _), u in norm.items() if u == t]
        want.add((i, min(group), len(group), i == min(group), hashlib.sha256(t.encode()).hexdigest()))
    assert found == want


def test_exact_empty_and_extra_columns(spark):
    none = docs(spark, []).selectExpr("*", "1 as sha", "2 as n", "3 as _stay", "4 as file", "5 as row")
    assert exact_dedup(spark, none).count() == 0
    some = docs(spark, EXACT + [(None, "a b"), (None, "z"), (None, "z")]).selectExpr("*", *CLASHING)
    kept = keep_first(spark, some)
    assert kept.columns == some.columns
    # one row a text, of repeated rows and of those without an identifier too
    assert sorted((r.doc_id or -1, r._flag) for r in kept.collect()) == [(-1, 3), (1, 3), (2, 3), (3, 3), (7, 3), (8, 3), (9, 3)]


def test_exact_state_outlives_a_run(spark):
    state = new_path(spark, "state")
    exact_dedup(spark, docs(spark, [(1, "x"), (2, "y")]), state)
    later = exact_dedup(spark, docs(spark, [(3, "x"), (4, "z"), (5, "z"), (0, "y")]), state)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in later.collect()} == {(3, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False), (0, 0, 2, True)}
    assert read_state(spark, state).count() == 3


def test_full_bytes_decide(spark, monkeypatch):
    """Rows that the state calls equal but that differ in bytes stay apart."""
    monkeypatch.setattr(E, "digest", lambda text: F.lit("one digest for all"))
    state = new_path(spark, "state")
    d, digests, stream = landed(spark, docs(spark, [(1, "x"), (2, "y"), (3, "x ")]), state)
    update_state(stream, state)
    out = {(r.doc_id, r.keep_id, r.group_size, r.stays) for r in decided(d, digests, read_state(spark, state)).collect()}
    assert out == {(1, 1, 3, True), (2, 2, 1, True), (3, 3, 1, True)}


def near_brute(rows, k=4):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(dice, center, size, most):
    out = []
    for _ in range(size):
        w = list(center)
        for _ in range(dice.randrange(most)):
            w[dice.randrange(len(w))] = f"e{dice.randrange(40)}"
        out.append(" ".join(w))
    return out


def test_near(spark):
    dice = random.Random(3)
    word = lambda: f"w{dice.randrange(500)}"
    texts = [None, "", "   ", "One two", "one  TWO", "one two three", "İ x y z", "a b c d", "A B C D"]
    passage = [word() for _ in range(60)]
    for _ in range(6):
        center = [word() for _ in range(dice.choice([30, 120]))]
        texts += family(dice, center, 25, 9)
    texts += [" ".join(passage + [word() for _ in range(30)]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(50))] * 30
    dice.shuffle(texts)
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs(spark, rows)).collect()}
    assert found == near_brute(rows)


def test_near_edge_tables(spark):
    assert N.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (None, "p q r s t u"), (3, None)]
    odd = docs(spark, rows).selectExpr("*", "1 as id", "2 as key", "3 as n", "4 as set_id")
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in N.near_duplicates(odd).collect())
    assert [o[:3] for o in out if o[0] == 1] == [(1, 3, 1)] * 2
    assert (3, 0, 3, True) in out
    assert N.keep_one(odd).columns == odd.columns


def test_sets_of_long_texts_and_words(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(3000)) + " " + "x" * 5000 + " tail of it"
    whole = N.shingles(text, 4)
    monkeypatch.setattr(N, "BLOCK", 1000)
    assert np.array_equal(whole, N.shingles(text, 4))
    w = text.split()
    assert len(whole) == len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})


@pytest.mark.parametrize("edges", [[(2, 1), (3, 2), (4, 3), (9, 8)], [(5, 9), (9, 7), (7, 6)], []])
def test_components(spark, edges):
    got = {(r.id, r.root) for r in N.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {(2, 1), (3, 1), (4, 1), (9, 8)} if edges and edges[0] == (2, 1) else {(6, 5), (7, 5), (9, 5)} if edges else set()
    assert got == want


def test_near_rows_that_share_or_lack_an_identifier(spark):
    far, near = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y zz"
    rows = [(7, far), (7, "quite another text than that"), (None, near), (9, "quite another text than that"), (None, "on its own here"), (None, "on its own here"), (8, near), (None, None), (None, None)]
    d = docs(spark, rows).selectExpr("*", *CLASHING, "12 as top", "13 as set_id", "14 as n", "15 as _row")
    got = sorted((r.n_shingles, r.doc_id or -1, r.component_id or -1, r.kept) for r in N.near_duplicates(d).collect())
    assert got == [(0, -1, -1, True)] * 2 + [(1, -1, -1, True)] * 2 + [(2, 7, 7, True), (2, 9, 7, False), (23, -1, 7, False), (23, 7, 7, True), (23, 8, 7, False)]
    kept = N.keep_one(d, 4)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, ""), (-1, "on its own here"), (7, far), (7, "quite another text than that")]


def star(spark, members, own):
    """A leader and members that share a passage with it and a line with one another; each has words of its own, so none is linked."""
    ids = np.arange(1, members + 1)
    passage, line = np.arange(60), np.arange(1000, 1020)
    sets = [np.concatenate((passage, line, 10_000 + 50 * (i // 2) + np.arange(own), 10**6 + 50 * i + np.arange(25 - own))) for i in ids]
    rest = [(0, int(i), 105, 0.5, int(i)) for i in ids]
    made = spark.createDataFrame([(int(i), [int(x) for x in s]) for i, s in zip(ids, sets)], "id long, s array<long>")
    return spark.createDataFrame(rest, "z long, id long, n long, d double, c long"), made


@pytest.mark.parametrize("own", [10, 21, 25])
def test_a_line_that_all_members_of_a_star_share_makes_no_pairs(spark, own):
    """Candidates are linear in the members, and those that are linked (neighbours by twos, where own is 25) are among them."""
    members = 5000
    rest, sets = star(spark, members, own)
    keys = N.prefixes(rest, sets).cache()
    found = {(r.x, r.y) for r in N.meeting(keys).collect()}
    assert len(found) <= members
    if own == 25:
        assert found >= {(i, i + 1) for i in range(2, members, 2)}
    keys.unpersist()


def test_filter_flags_every_wanted_row_and_few_others(spark, monkeypatch):
    rows = spark.range(200_000).withColumn("_flag", F.lit(1))
    wanted = spark.range(0, 200_000, 20)
    for bits, most in ((1 << 29, 15_000), (64 * 64, 200_000)):  # a filter that is far too small lets more through, and loses none
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        out, flag = common.narrowed(rows, ["id"], wanted)
        assert flag == "_flag_" and out.columns == ["id", "_flag", "_flag_"]
        assert out.filter(F.col(flag)).join(wanted, "id").count() == 10_000
        assert 10_000 <= out.filter(F.col(flag)).count() <= most


def test_full_filters_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    test_exact(spark)
    test_exact_empty_and_extra_columns(spark)
    test_near_rows_that_share_or_lack_an_identifier(spark)


def test_texts_stay_out_of_exchanges(spark, tmp_path):
    """Of a table's texts only those of dropped rows, and a few by chance, go through an exchange."""
    docs(spark, [(i, f"text {i % 1900} " * 30) for i in range(2000)]).write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = keep_first(spark, d)
        assert len(kept.collect()) == 1900
        plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sure, flagged = plan.split("Union", 1)[1].split("SortMergeJoin", 1)
    assert "hashpartitioning" not in sure and flagged.count("Exchange hashpartitioning") == 2
