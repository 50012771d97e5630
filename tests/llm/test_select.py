"""Top-k search and mixing against brute force and their SQL; registered queries; the pipeline."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from oracle import assert_same, duck
from pyspark.sql import functions as F
from test_dedup import near_brute

import corpus_pipeline
from tidelog.llm import mixing, quality, topk
from tidelog.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF).sql(ORACLE_SQL[name]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize(("n", "dims", "few"), [(3, 4, 1), (400, 8, 1), (3000, 16, 20), (500, 3, 10**6)])
def test_index_is_exact(monkeypatch, n, dims, few):
    monkeypatch.setattr(topk, "FEW", few)
    dice = np.random.default_rng(n)
    x = dice.integers(-256, 257, (n, dims))
    x[n // 2 :: 7] = x[0]
    ids = dice.permutation(10 * n)[:n]
    index = topk.Index(ids, x)
    for i in range(0, n, max(1, n // 25)):
        got_ids, got = index.top(x[i], ids[i], 5)
        score = x @ x[i]
        want = sorted(((-s, j) for s, j in zip(score, ids) if j != ids[i]))[:5]
        assert [(-s, j) for s, j in want] == list(zip(got.tolist(), got_ids.tolist()))


def test_index_stops_on_proof_with_few_rows_left(spark):
    """On the test table: not all postings are processed, and under a tenth of the rows are rescored."""
    rows = topk.whole(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas()
    x = np.stack(rows.v.to_numpy())
    index = topk.Index(rows.vec_id.to_numpy(), x)
    processed, rescored = [], []
    for i in range(0, len(x), 50):
        ids, got = index.top(x[i], int(rows.vec_id[i]), 5)
        score = x @ x[i]
        want = sorted(((-s, j) for s, j in zip(score, rows.vec_id) if j != rows.vec_id[i]))[:5]
        assert [(-s, j) for s, j in want] == list(zip(got.tolist(), ids.tolist()))
        processed.append(index.processed / x.size)
        rescored.append(index.rescored)
    assert np.mean(processed) < 0.95 and np.mean(rescored) < 0.1 * len(x) and max(rescored) < 0.2 * len(x)


def test_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    assert_same(QUERIES["op2_topk"](spark, SF), duck(SF).sql(ORACLE_SQL["op2_topk"]))


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (50, [0.25, 0.25]), (51, [0.25, 0.25]), (51, [0.25, 0.25]), (None, [1.0, 1.0]), (52, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as b", "3 as p")
    got = [tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 50), (0, 2, 51), (0, 3, 51), (0, 4, 52)]
    assert got[0][3] == 256 * 64 + 128 * 64
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def shares(budget, caps, weights):
    """Water filling by repetition."""
    left, got, open_ = budget, dict.fromkeys(caps, 0), {k for k in caps if weights[k] > 0}
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= left * weights[k]}
        if not full:
            for k in open_:
                got[k] = min(caps[k], int(left * weights[k] / total))
            return got
        for k in full:
            got[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return got


def test_shortages_go_to_siblings_first(spark):
    rows = [("web", "en", "a", 10), ("web", "en", "b", 500), ("web", "de", "c", 500), ("books", "en", "d", 30), ("code", "en", "e", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long").withColumn("cap", F.col("tokens"))
    weights = {"domain": {"web": 2, "books": 2, "code": 1}, "lang": {}, "source": {}}
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(500.0), weights).collect()}
    top = shares(500, {"web": 1010, "books": 30, "code": 1000}, {"web": 2, "books": 2, "code": 1})
    assert top["books"] == 30 == got["d"] and got["e"] == top["code"]
    assert got["a"] == 10 and got["b"] == int(top["web"] / 2) - 10 and got["c"] == int(top["web"] / 2)


def test_mixing_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, 0), (2, "", "en", "src1", 0), (3, "a b c", "en", "src1", 5), (3, "a b c", "en", "src1", 5), (None, "d e", "en", "src2", 3)]
    d = spark.createDataFrame(rows, schema).selectExpr("*", "1 as h", "2 as tokens", "3 as domain", "4 as rest")
    out = mixing.mix(d, mixing.domain_of(F.col("source")), 1.0, {}, 1).collect()
    assert len(out) == 5 and {r.doc_id for r in out if r.tokens == 0 and r.copies == 1} == {1, 2}
    assert mixing.keep_mixed(d, mixing.domain_of(F.col("source")), 1.0, {}).columns == d.columns
    assert mixing.mix(d.limit(0), mixing.domain_of(F.col("source")), 1.0, {}).count() == 0


def drawn_by_hand(rows, part, weights, epochs, seed):
    """How often each row (doc_id, domain, lang, source, tokens) is drawn: budgets by repeated water filling, then one leaf after another."""
    budget = {(): int(sum(r[4] for r in rows) * part)}
    for depth, level in enumerate(mixing.LEVELS):
        caps = {}
        for r in rows:
            caps[r[1 : depth + 2]] = caps.get(r[1 : depth + 2], 0) + r[4] * epochs
        w = {node: weights.get(level, {}).get(node[-1], weights.get(level, {}).get("*", 1)) for node in caps}
        for parent in {node[:-1] for node in caps}:
            own = {n: c for n, c in caps.items() if n[:-1] == parent}
            budget |= shares(budget[parent], own, w)
    out = {}
    for leaf in {r[1:4] for r in rows}:
        own = [r for r in rows if r[1:4] == leaf]
        tokens = sum(r[4] for r in own)
        full, rest = divmod(budget[leaf], tokens) if tokens else (0, 0)
        upto = 0
        for r in sorted(own, key=lambda r: (int(hashlib.md5(f"{seed}:{full + 1}:{r[0]}".encode()).hexdigest()[:15], 16), r[0])):
            upto += r[4]
            out[r[0]] = full + (upto <= rest) if r[4] else 1
    return out


def domain_by_hand(source):
    n = re.search("[0-9]{1,9}", source or "")
    return ("web", "books", "code")[(int(n.group()) if n else 0) % 3]


def mixed_by_hand(docs, part, epochs):
    rows = [(d.doc_id, domain_by_hand(d.source), d.lang or "(none)", d.source or "(none)", len(re.findall(r"[^\x20\x09-\x0d]+", d.text or ""))) for d in docs]
    return drawn_by_hand(rows, part, mixing.WEIGHTS, epochs, 11)


@pytest.mark.parametrize("epochs", [1, 4])
def test_mixing_equals_brute_force(spark, epochs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.copies for r in mixing.mix(d, mixing.domain_of(F.col("source")), 0.6, mixing.WEIGHTS, epochs).collect()}
    assert got == mixed_by_hand(d.collect(), 0.6, epochs)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns; an empty table."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, 0), (10**9 + 1, "a b c " * 100_000, "en", None, None), (10**9 + 2, None, "en", "s1", 3)], d.schema)
    for name, rows in (("odd", d.unionByName(odd).unionByName(odd).selectExpr("*", "1 as file", "2 as _y", "3 as _f_n", "4 as row", "5 as _flag")), ("none", d.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, folder)
            assert kept.columns == rows.columns, stage
            ids = [r.doc_id for r in kept.select("doc_id").collect()]
            assert stage == "quality classifier" or len(ids) == len(set(ids)), stage
        out = corpus_pipeline.run(spark, folder).toPandas()
        assert set(out.doc_id) == set(ids)
        assert out.groupby("sequence_id").length.sum().max() <= 1024 or name == "none"


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in d.collect()}
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == d.columns, name
        rows = {r.doc_id: r for r in kept.collect()}
        assert rows.keys() <= before and all(rows[i] == texts[i] for i in rows), name
        if name == "quality classifier":
            scored = quality.scored(d, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert rows.keys() == {r.doc_id for r in scored if r.predicted}
        if name == "exact dedup":
            norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", texts[i].text or "") for i in before}
            assert rows.keys() == {min(j for j in norm if norm[j] == norm[i]) for i in norm}
        if name == "near-dedup":
            brute = near_brute([(i, texts[i].text) for i in before], corpus_pipeline.SHINGLE)
            assert rows.keys() == {i for i, (_, root) in brute.items() if i == root}
        if name == "mixing":
            assert rows.keys() == {i for i, n in mixed_by_hand([texts[i] for i in before], corpus_pipeline.MIX_PART, 1).items() if n}
        kept = spark.createDataFrame(list(rows.values()), d.schema)
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == set(rows)
    assert out.groupby("sequence_id").length.sum().max() <= 1024
