"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are DataFrame columns. Shallow trees are boosted on a bounded sample of
labelled rows (`SAMPLE` rows, chosen by a hash of the identifier); every path from a root to a node is
a conjunctive rule. A logistic model with lasso penalty weighs the rules, most weights become zero, and
the others are compiled into one Column expression, so scoring is a scan without Python.

Defined results: null and empty texts are scored by statistics of zero, texts of any length by statistics
of all of them; repeated rows are scored each; of labelled rows that repeat an identifier the one with the
smallest statistics is learned from; ties in the sample's order go by identifier; null labels and
labels of unknown documents are ignored; several labels of one document count as their largest; with no
labels, or one class only, every score is the smoothed share of good rows; an empty table gives no rows;
other columns, whatever their names, are kept by `keep_good` and ignored otherwise.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, held_out, table

#: At most so many labelled rows are learned from.
SAMPLE = 8_000
KEEP = 0.7
Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether above, threshold), all of which hold


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text, each from all of it."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.split(text, "\n", -1)

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    return {"n": n, "words": F.size(words), "distinct_words": F.size(F.array_distinct(words)), "lines": F.size(lines), "distinct_lines": F.size(F.array_distinct(lines)), "marks": left(r"[\p{L}\p{N}\s.,]+"), "upper": left(r"[^\p{Lu}]+"), "digits": left("[^0-9]+"), "stops": left("[^.,]+"), "letters": left(r"[^\p{L}]+")}


def features(counts: dict[str, Column]) -> dict[str, Column]:
    c = counts
    one = F.lit(1.0)

    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b.cast("double"), one)

    return {
        "log_words": F.log(c["words"] + one),
        "word_length": share(c["n"], c["words"]),
        "distinct_words": share(c["distinct_words"], c["words"]),
        "distinct_root": share(c["distinct_words"], F.sqrt(c["words"].cast("double"))),
        "distinct_lines": share(c["distinct_lines"], c["lines"]),
        "words_a_line": share(c["words"], c["lines"]),
        "marks": share(c["marks"], c["n"]),
        "marks_a_word": share(c["marks"], c["words"]),
        "upper": share(c["upper"], c["letters"]),
        "digits": share(c["digits"], c["n"]),
        "stops": share(c["stops"], c["words"]),
        "letters": share(c["letters"], c["n"]),
    }


NAMES = ("log_words", "word_length", "distinct_words", "distinct_root", "distinct_lines", "words_a_line", "marks", "marks_a_word", "upper", "digits", "stops", "letters")


def with_features(docs: DataFrame, *keep: str, prefix: str = "_f_") -> DataFrame:
    """The columns of keep, and the statistics, computed once per text, with a prefix that none of these begins with."""
    counts = statistics(F.col("text"))
    own = [F.col(f"`{c}`") for c in keep]
    counted = docs.select(*own, *(c.alias(f"{prefix}c_{k}") for k, c in counts.items()))
    made = features({k: F.col(f"{prefix}c_{k}") for k in counts})
    return counted.select(*own, *(made[k].alias(f"{prefix}{k}") for k in NAMES))


def unused(columns: list[str]) -> str:
    """A prefix that none of the columns begins with."""
    prefix = "_f_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most sample rows that may be learned from."""
    ids = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = ids.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    given = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text"))
    some = given.join(F.broadcast(chosen), "_id")  # at most sample rows of two numbers
    rows = with_features(some, "_id", "_y").groupBy("_id").agg(F.min(F.struct("_y", *(f"_f_{k}" for k in NAMES))).alias("r")).select("r.*").collect()  # repeated rows count once, so the bound holds
    x = np.array([[r[f"_f_{k}"] for k in NAMES] for r in rows], dtype=float).reshape(-1, len(NAMES))
    return x, np.array([r["_y"] for r in rows], dtype=float)


def grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], depth: int, rule: Rule, out: list[Rule], value: np.ndarray, rows: np.ndarray) -> None:
    """Splits rows where that helps a boosted tree most; each node's path goes to out, each leaf's step to value."""
    if rule:
        out.append(rule)
    g, h = slope[rows].sum(), curve[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 20:
        for j, c in enumerate(cuts):
            column = x[rows, j]
            side = np.searchsorted(c, column, side="left")  # x <= c[k] for side <= k
            gl = np.cumsum(np.bincount(side, slope[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(side, curve[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(side, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, float(c[int(gain.argmax())]))
    if best[1] < 0:
        value[rows] += 0.3 * g / (h + 1)
        return
    _, j, t = best
    above = x[rows, j] > t
    for up in (False, True):
        grow(x, slope, curve, cuts, depth - 1, (*rule, (NAMES[j], up, t)), out, value, rows[above == up])


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, seed: int = 7) -> list[Rule]:
    dice = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    score, out = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(dice.choice(len(y), max(1, len(y) * 7 // 10), replace=False))
        step = np.zeros(len(y))
        grow(x, y - p, p * (1 - p), cuts, depth, (), out, step, rows)
        score += step
    return list(dict.fromkeys(out))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for name, up, t in rule:
        ok &= (x[:, NAMES.index(name)] > t) == up
    return ok


def lasso(m: np.ndarray, y: np.ndarray, penalty: float = 5e-4, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient; the intercept is free."""
    n, k = m.shape
    rate = 4.0 * n / (np.linalg.norm(m, 2) ** 2 + n) if k else 1.0
    b, w, vb, vw, t = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), np.zeros(k), 0.0, np.zeros(k), 1.0
    vb = b
    for _ in range(steps):
        off = (1 / (1 + np.exp(-(m @ vw + vb))) - y) / n
        nb, nw = vb - rate * off.sum(), vw - rate * (m.T @ off)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / s * (nb - b), nw + (t - 1) / s * (nw - w)
        b, w, t = nb, nw, s
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    good = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return math.log(good / (1 - good)), []
    rules = tree_rules(x, y)
    b, w = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y)
    return b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6]


def score(model: tuple[float, list[tuple[Rule, float]]], prefix: str = "_f_") -> Column:
    total = F.lit(model[0])
    for rule, weight in model[1]:
        ok = F.lit(True)
        for name, up, t in rule:
            ok = ok & ((F.col(f"{prefix}{name}") > t) if up else (F.col(f"{prefix}{name}") <= t))
        total = total + F.when(ok, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and score and predicted for each row of docs."""
    model, prefix = fit(*labelled(docs, labels)), unused(list(keep))
    (own,) = fresh(docs.select(*(F.col(f"`{c}`") for c in keep)), "_score")
    plain = [F.col(f"`{c}`") for c in keep]
    rows = with_features(docs, *keep, prefix=prefix).select(*plain, score(model, prefix).alias(own))
    return rows.select(*plain, F.col(own).alias("score"), (F.col(own) >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""
    model, prefix = fit(*labelled(docs, labels)), unused(docs.columns)
    return with_features(docs, *docs.columns, prefix=prefix).filter(score(model, prefix) >= KEEP).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
