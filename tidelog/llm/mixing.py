"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget goes down a tree of domains, languages and sources. At each node it is shared among the
children by their weights, but no child gets more than its subtree can supply (its tokens times
`max_epochs`); what a child falls short of is shared among its siblings, by weight again, and only what
the whole subtree can't use was withheld by the ancestor, whose own siblings get it. With children
sorted by supply per weight, the water level of such sharing is the largest of
(budget - supplies before) / (weights from here on), so each level of the tree is one window over its
nodes. Weights are whole numbers and budgets are rounded down.

A leaf with budget b and t tokens takes b div t whole epochs, and of the next epoch, whose order is a
seeded hash of epoch and identifier, the prefix of documents whose running tokens stay within the
rest. Running sums are taken over `BUCKETS` hash ranges a leaf, and row by row only in the range where
the budget ends, so a source with a third of all rows isn't sorted in one task.

Tokens are words (runs of other than white space) unless a column says otherwise. Defined results: null
or empty texts have no tokens, cost nothing and are taken once; null languages and sources form the leaf
"(none)"; texts of any length are counted whole; repeated rows are drawn each; ties in the hash go by
identifier; weights of zero or less give nothing; an empty table gives no rows; other columns, whatever
their names, are kept by `keep_mixed`, which sends only rows that it drops (and a few by chance, see
`common.narrowed`) through an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLACE, WORD_CLASS, new_path, placed, table, without, written

LEVELS = ("domain", "lang", "source")
BUCKETS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def weighed(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(weights.get("*", 1)).cast("long"))


def share(nodes: DataFrame, parents: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """nodes (parents, name, cap, budget of the parent): adds the node's own budget, as the column of that name."""
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("_w", weighed(name, weights)).withColumn("_in", (F.col("_w") > 0).cast("int"))
    before = siblings.orderBy(F.col("_in").desc(), F.when(F.col("_w") > 0, F.col("cap") / F.col("_w")), name).rowsBetween(Window.unboundedPreceding, -1)
    caps = F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum(F.greatest("_w", F.lit(0))).over(siblings) - F.coalesce(F.sum(F.greatest("_w", F.lit(0))).over(before), F.lit(0))
    nodes = nodes.withColumn("_level", F.when((F.col("_w") > 0) & (weight > 0), (F.col("budget") - caps) / weight))
    own = F.least(F.col("cap"), F.floor(F.col("_w") * F.max("_level").over(siblings)).cast("long"))
    return nodes.withColumn("budget", F.when(F.col("_w") > 0, F.greatest(own, F.lit(0))).otherwise(F.lit(0).cast("long"))).drop("_w", "_in", "_level")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (LEVELS, tokens, cap) with each leaf's budget. total: of the sum of tokens, as a Column over it."""
    level = leaves.groupBy().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.floor(total).cast("long").alias("budget"))
    parents: list[str] = []
    for name in LEVELS:
        caps = leaves.groupBy(*parents, name).agg(F.sum("cap").alias("cap"))
        nodes = caps.join(level, parents) if parents else caps.join(F.broadcast(level))  # one row
        parents = [*parents, name]
        level = share(nodes, parents[:-1], name, weights.get(name, {})).select(*parents, "budget")
    return leaves.join(level, list(LEVELS))


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A hash below 2**60."""
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, domain: Column, part: float, weights: dict[str, dict[str, int]], max_epochs: int = 4, seed: int = 11, tokens: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens and copies of every row of docs: how often it is drawn.

    The total budget is part times the tokens of docs."""
    return _drawn(docs, domain, part, weights, max_epochs, seed, tokens)


def _drawn(docs: DataFrame, domain: Column, part: float, weights: dict[str, dict[str, int]], max_epochs: int, seed: int, tokens: Column | None, place: tuple[Column, ...] = ()) -> DataFrame:
    """The columns of place, and those of mix()."""
    given = docs.select(*place, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain, F.lit("(none)")).alias("domain"), *(F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in LEVELS[1:]), (words(F.col("text")) if tokens is None else tokens).alias("tokens"))
    rows = written(given, "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    plan = budgets(leaves, F.col("tokens") * part, weights)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = written(plan.select(*LEVELS, full.alias("full"), (F.col("budget") - full * F.col("tokens")).alias("rest")), "mix-plan")

    # rows have no text here, and Spark broadcasts a plan of few leaves by itself
    dealt = rows.join(plan, list(LEVELS)).withColumn("h", seeded(seed, F.col("full") + 1, F.col("doc_id"))).withColumn("bucket", F.shiftright("h", 48))
    key = [*LEVELS, "bucket"]
    sums = dealt.groupBy(*key).agg(F.sum("tokens").alias("upto"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("base", F.sum("upto").over(run) - F.col("upto"))
    ends = sums.filter("base <= rest and base + upto > rest").select(*LEVELS, F.col("bucket").alias("at"), "base")  # a row a leaf at most
    dealt = dealt.join(written(ends, "mix-ends"), list(LEVELS), "left")
    sure = dealt.filter("at is null or bucket <> at").withColumn("more", F.expr("at is null or bucket < at"))
    order = Window.partitionBy(*LEVELS).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = dealt.filter("bucket = at").withColumn("more", F.col("base") + F.sum("tokens").over(order) <= F.col("rest"))
    copies = F.when(F.col("tokens") == 0, 1).otherwise(F.col("full") + F.col("more").cast("int")).cast("long")
    return sure.unionByName(last).select(*(PLACE if place else ()), "doc_id", *LEVELS, "tokens", copies.alias("copies"))


def keep_mixed(docs: DataFrame, domain: Column, part: float, weights: dict[str, dict[str, int]], seed: int = 11) -> DataFrame:
    """The rows of docs that one epoch draws, with all their columns."""
    docs, file, row = placed(docs, new_path(docs.sparkSession, "mix-docs"))
    rows = _drawn(docs, domain, part, weights, 1, seed, None, (file.alias("file"), row.alias("row")))
    return without(docs, written(rows.filter("copies = 0").select(*PLACE), "mix-gone"))


#: The tree of the test tables: domains by the number in a source's name.
WEIGHTS = {"domain": {"web": 3, "books": 2, "code": 1}, "lang": {"en": 5, "de": 2, "*": 1}, "source": {}}
PART = 0.6


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})", 1), F.lit("999999999")), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("code")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_of(F.col("source")), PART, WEIGHTS)


def _share_sql(name: str, parents: str, source: str, weight: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    cols = f"{parents}, {name}" if parents else name
    return f"""
{name}_w AS (SELECT *, {weight} AS w FROM {source}),
{name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)::BIGINT) / (sum(w) OVER ({by}) - coalesce(sum(w) OVER b, 0))::BIGINT AS level FROM {name}_w
  WINDOW b AS ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT {cols}, greatest(0, least(cap, floor(w * max(level) OVER ({by}))::BIGINT)) AS budget FROM {name}_l)"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, CASE coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 4 AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * {PART}::DOUBLE)::BIGINT AS budget FROM leaf),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, any_value(budget) AS budget FROM leaf, root GROUP BY domain),
{_share_sql("domain", "", "n1", "CASE domain WHEN 'web' THEN 3 WHEN 'books' THEN 2 ELSE 1 END")},
n2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, any_value(budget) AS budget FROM leaf JOIN domain_b USING (domain) GROUP BY ALL),
{_share_sql("lang", "domain", "n2", "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 ELSE 1 END")},
n3 AS (SELECT domain, lang, source, tokens, cap, budget FROM leaf JOIN lang_b USING (domain, lang)),
{_share_sql("source", "domain, lang", "n3", "1")},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(s.budget / tokens)::BIGINT ELSE 0 END AS "full", s.budget, tokens AS leaf_tokens FROM source_b s JOIN leaf USING (domain, lang, source)),
h AS (SELECT d.*, p."full", budget - p."full" * leaf_tokens AS rest, ('0x' || substr(md5('11:' || (p."full" + 1) || ':' || doc_id), 1, 15))::BIGINT AS h FROM d JOIN p USING (domain, lang, source)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM h)
SELECT doc_id, domain, lang, source, tokens, CASE WHEN tokens = 0 THEN 1 ELSE "full" + (upto <= rest)::INTEGER END::BIGINT AS copies FROM r
"""
