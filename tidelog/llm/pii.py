"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the base matches of four kinds (email, ip, card, phone) and looser forms of them:
addresses spelled with "at" and "dot", IPv6 and IPv4 with bracketed dots, cards of 13 to 15 digits,
telephone numbers without a country code.
Three sorts of labelers vote 1, -1 or 0 (abstain) on each candidate: regex and checksum rules,
gazetteers (top-level domains, issuer prefixes, country codes, reserved networks) and context words
before the match. The votes of the whole table are counted by pattern, at most
`4 kinds * 3^5 votes * 4 shapes` rows, so that table alone reaches the driver. Expectation-maximisation
over it estimates each labeler's reliability per kind; its posteriors train a logistic span
classifier over votes and shape, which is compiled into one Column expression. Base matches stay
whatever the classifier says; looser candidates are added where it is sure and their check doesn't fail.

Texts are scanned once: candidates with their votes are written, and both the counts and the result read them.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; texts of any
length are scanned whole (offsets are summed in chunks, so that very many matches stay cheap); repeated
rows count once each and give repeated results; of looser candidates of one kind that overlap a base span
none is added, ties in start go by end; an empty table gives no rows and the classifier falls back on its
prior; other columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, located, table, written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Lookbehinds and possessive quantifiers change no match; they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, which only the classifier can turn into spans.
HEX = "[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": rf"(?<![0-9A-Za-z:._])(?=:{{0,2}}[0-9A-Fa-f])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}(?::{HEX}){{0,6}})?::(?:{HEX}(?::{HEX}){{0,6}})?)(?!:?[0-9A-Za-z]|::|\.[0-9])"
    r"|(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|[\[(]dot[\])])\x20?[0-9]{1,3}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.()-])(?<![0-9+)]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Failing base matches whose digits are so many as their issuer's cards have (15, 14, 13) count as looser forms.
LOOSE_CARD = r"^(3[47][0-9]{13}|(2131|1800)[0-9]{11}|3(0[0-5]|[689])[0-9]{11}|4[0-9]{12})$"
#: A cheap test that any match of the kind passes.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
VOTES = ("form", "check", "gazetteer", "context", "against")
SURE = 0.95
#: Votes of a labeler to each prior count of its reliability.
ANCHOR = 50
#: Share of what isn't personal data that passes the check all the same, at least: one number in ten has a sound check digit.
CHANCE = {"card": 0.1}

# Words and prefixes of the gazetteers and context labelers.
TLDS = ["com", "org", "net", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "xxx", "app", "dev", "blog", "cloud", "email", "online", "page", "shop", "site", "store", "tech", "web", "xyz", "club", "group", "agency", "news", "media", "world", "today", "live", "life", "work", "team", "company", "solutions", "systems", "services", "network", "digital", "software", "academy", "berlin", "london", "paris", "wien", "nyc", "tokyo"]
#: Domains of countries: two letters, whichever.
COUNTRY = "^[a-z]{2}$"
WORDS = {"email": r"e-?mail|mail(to)?|contact|write|reply|correo|courriel", "ip": r"\bip(s|v[46])?\b|addr|host|server|login|client|from", "card": r"card|visa|master|amex|pay|credit|karte|tarjeta|carte", "phone": r"tel|phone|call|fax|mobile|cell|whatsapp|numm?er|contact"}
AGAINST = {"email": r"example|image|retina", "ip": r"version|release|build|\bv$", "card": r"isbn|order|serial|tracking|invoice", "phone": r"isbn|order|serial|version|invoice|part"}
PREFIX = {"card": r"^(4|5[1-5]|2[2-7]|3[47]|3(0[0-5]|[689])|2131|1800|6011|65)", "phone": r"^\+(1|7|2(0|7|1[1-368]|[2-6][0-9]|9[0-17-9])|3([0-469]|[578][0-9])|4([013-9]|2[013])|5([1-8]|0[0-9]|9[0-9])|6([0-6]|7[02-9]|8[0-35-9]|9[0-2])|8([1246]|0[08]|5[02356]|7[08]|8[0-368])|9([0-58]|6[0-8]|7[0-7]|9[2-68]))|^[(]?[2-9]", "ip": r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^(?i:2[0-9a-f]{3}|3[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):|^::1$"}


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of digits has a sound check digit."""
    backward = F.split(F.reverse(number), "")
    worth = F.transform(backward, lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise((F.try_to_number(d, F.lit("9")) * 2 - F.when(F.try_to_number(d, F.lit("9")) > 4, 9).otherwise(0)).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(digits(m))
    return n.between(8, 15) if kind == "phone" else n.between(16, 19) & F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)


def sound_ip(m: Column) -> Column:
    """1 for an IPv6 or an IPv4 with bracketed dots, -1 for what has the form of one and can't be; 0 for IPv6 without a digit."""
    groups = F.size(F.filter(F.split(m, ":"), lambda x: x != ""))
    six = F.when((groups > 7) & F.contains(m, F.lit("::")), -1).when(m.rlike("^[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){7}$"), -1).when(m.rlike("[0-9]"), 1).otherwise(0)
    return F.when(F.contains(m, F.lit(":")), six).when(valid("ip", plain_ip(m)), 1).otherwise(-1)


def plain_ip(m: Column) -> Column:
    return F.regexp_replace(m, r"\x20?[\[(](?:\.|dot)[\])]\x20?", ".")


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def voted(kind: str, c: Column, base: bool) -> Column:
    """The candidate with its votes and shape: everything that the classifier may see of it."""
    m, before = c["m"], F.lower(c["before"])
    n = F.length(digits(m))
    good = valid(kind, m) if base else F.lit(False)
    check = {"email": vote(F.lower(m).rlike(r"(\.|dot[\])]\x20?)[a-z]{2,24}$"), ~F.lower(m).rlike(r"[a-z]{2,24}$")), "ip": vote(valid("ip", m), ~valid("ip", m)) if base else sound_ip(m), "card": vote(n.between(13, 19) & F.when(n.between(13, 19), luhn(digits(m))).otherwise(False), F.lit(True)), "phone": vote(n.between(8, 15), F.lit(True))}[kind]
    domain = F.regexp_extract(F.lower(m), r"([a-z]+)$", 1)
    known = domain.isin(TLDS) | domain.rlike(COUNTRY) if kind == "email" else {"card": digits, "ip": plain_ip}.get(kind, lambda x: x)(m).rlike(PREFIX[kind])
    shape = F.when(n == 0, 0).when(n < 8, 1).when(n < 13, 2).otherwise(3)
    form = vote(good, ~good if kind != "card" else ~good & ~digits(m).rlike(LOOSE_CARD)) if base else F.lit(0)
    return F.struct(
        c["s"].alias("s"), c["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), good.alias("valid"),
        F.struct(form.alias("form"), check.alias("check"), vote(known).alias("gazetteer"), vote(before.rlike(WORDS[kind])).alias("context"), F.when(before.rlike(AGAINST[kind]), -1).otherwise(0).alias("against"), shape.alias("shape")).alias("v"),
    )


def _voter(kind: str, base: bool):
    return lambda c: voted(kind, c, base)


NO_CUTS = "cast(array() as array<struct<p:string,m:string>>)"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, per kind, the candidates with their votes: base ones and looser ones clear of them."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    numbers = F.col("text").rlike("[0-9]{1}")
    cuts = [F.when(F.contains(F.col("text"), F.lit(HINT[k])) if HINT[k] else numbers, cut(F.col("text"), BASE[k])).otherwise(F.expr(NO_CUTS)).alias(f"b_{k}") for k in KINDS]
    brackets = F.col("text").rlike(r"[0-9]\x20?[\[(](?:\.|dot)[\])]")
    hints = {"ip": F.contains(F.col("text"), F.lit("::")) | F.col("text").rlike(f":{HEX}:{HEX}:{HEX}:") | brackets, "email": F.lower(F.col("text")).rlike(r"[\[(]at[\])]"), "phone": F.col("text").rlike("[0-9][.-][0-9]{4}")}
    cuts += [F.when(hints[k], cut(F.col("text"), LOOSE[k])).otherwise(F.expr(NO_CUTS)).alias(f"l_{k}") for k in LOOSE]
    rows = rows.select("doc_id", *cuts)
    rows = rows.select("doc_id", *(located(F.col(c)).alias(c) for c in rows.columns[1:]))
    rows = rows.select("doc_id", *(F.transform(F.col(c), _voter(c[2:], c[0] == "b")).alias(c) for c in rows.columns[1:]))

    taken = F.filter(F.concat(*(F.col(f"b_{k}") for k in KINDS)), lambda x: x["valid"])
    rows = rows.withColumn("taken", taken)
    rows = rows.withColumn("l_card", F.filter("b_card", _abstained)).withColumn("b_card", F.filter("b_card", lambda x: ~_abstained(x)))
    clear = [F.filter(F.col(f"l_{k}"), lambda x: ~F.exists(F.col("taken"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))).alias(f"l_{k}") for k in KINDS]
    return rows.select("doc_id", *(f"b_{k}" for k in KINDS), *clear)


def _abstained(x: Column) -> Column:
    return x["v"]["form"] == 0


def patterns(found: DataFrame) -> list[dict]:
    """How often each pattern of kind, votes and shape occurs: a bounded table, whatever the input's size."""
    every = F.concat(*(F.col(c) for c in found.columns[1:]))
    counted = found.select(F.explode(every).alias("c")).groupBy("c.kind", "c.v").agg(F.count(F.lit(1)).alias("n"))
    return [{"kind": r["kind"], "n": r["n"], "shape": r["v"]["shape"], **{j: r["v"][j] for j in VOTES}} for r in counted.collect()]


def reliabilities(rows: list[dict], rounds: int = 40) -> tuple[dict, list[float]]:
    """Expectation-maximisation of a two-class model with abstaining labelers, per kind.

    Returns P(vote | class, not abstained), smoothed by prior counts that grow with the labeler's votes, and
    each pattern's posterior of being personal data. Abstentions are no evidence. The share of the classes is
    that of base candidates and says nothing of looser ones (where the form labeler abstains): their odds start even."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(r[j] for j in VOTES))) for r in rows]
    model: dict = {}
    for _ in range(rounds):
        model = {}
        for k in KINDS:
            own = [(r, p) for r, p in zip(rows, post) if r["kind"] == k]
            base = {c: sum(r["n"] * (p if c else 1 - p) for r, p in own if r["form"]) for c in (0, 1)}
            anchor = max(1.0, (base[0] + base[1]) / ANCHOR)
            model[k] = {"prior": (base[1] + anchor) / (base[0] + base[1] + 2 * anchor)}
            for j in VOTES:
                anchor = max(1.0, sum(r["n"] for r, _ in own if r[j]) / ANCHOR)
                for c in (0, 1):
                    mass = sum(r["n"] * (p if c else 1 - p) for r, p in own if r[j])
                    for v in (-1, 1):
                        # a prior count keeps labelers better than chance, so that the classes can't change places
                        lean = 3.0 if v == (1 if c else -1) else 1.0
                        model[k][j, c, v] = (sum(r["n"] * (p if c else 1 - p) for r, p in own if r[j] == v) + lean * anchor) / (mass + 4 * anchor)
            by_chance = max(CHANCE.get(k, 0.0), model[k]["check", 0, 1])
            model[k] |= {("check", 0, 1): by_chance, ("check", 0, -1): 1 - by_chance}
        post = []
        for r in rows:
            m = model[r["kind"]]
            log = (math.log(m["prior"] / (1 - m["prior"])) if r["form"] else 0.0) + sum(math.log(m[j, 1, r[j]] / m[j, 0, r[j]]) for j in VOTES if r[j])
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, log)))))
    return model, post


def inputs(kind: str, r: dict) -> list[str]:
    return ["one", f"kind={kind}", f"{kind}:shape={r['shape']}", *(f"{kind}:{j}={r[j]}" for j in VOTES)]


def span_classifier(rows: list[dict], post: list[float], steps: int = 400, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model over votes and shape, fitted to the posteriors.

    Each pattern counts alike within its kind: rare ones, as looser candidates are, at any size of the table."""
    weights: dict[str, float] = {}
    total = {k: sum(r["kind"] == k for r in rows) for k in KINDS}
    for _ in range(steps):
        slope: dict[str, float] = {}
        for r, p in zip(rows, post):
            names = inputs(r["kind"], r)
            off = (p - 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in names)))) / total[r["kind"]]
            for x in names:
                slope[x] = slope.get(x, 0.0) + off
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) + 2.0 * (g - ridge * weights.get(x, 0.0))
    return weights


def probability(kind: str, v: Column, weights: dict[str, float]) -> Column:
    """The classifier as a Column."""
    total = F.lit(weights.get("one", 0.0) + weights.get(f"kind={kind}", 0.0))
    for j in ("shape", *VOTES):
        for value in (0, 1, 2, 3) if j == "shape" else (-1, 0, 1):
            if w := weights.get(f"{kind}:{j}={value}"):
                total = total + F.when(v[j] == value, w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _sure(kind: str, weights: dict[str, float], sure: float):
    return lambda c: (c["v"]["check"] >= 0) & (probability(kind, c["v"], weights) >= sure)


def find_pii(spark: SparkSession, docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id, base and added spans per kind: arrays of (s, e), ordered by start."""
    found = written(candidates(docs), "pii-candidates")  # narrow; texts are scanned once, not for the counts and again for the result
    rows = patterns(found)
    _, post = reliabilities(rows)
    weights = span_classifier(rows, post)
    out = [F.col("doc_id")]
    for k in KINDS:
        out.append(F.transform(F.filter(F.col(f"b_{k}"), lambda x: x["valid"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"base_{k}"))
        more = F.filter(F.col(f"l_{k}"), _sure(k, weights, sure))
        out.append(F.transform(more, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"added_{k}"))
    return found.select(*out)


def told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(spark, table(spark, sf_dir, "documents"))
    base = F.array_join(F.concat(*(told(k, F.col(f"base_{k}")) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(told(k, F.array_sort(F.concat(F.col(f"base_{k}"), F.col(f"added_{k}")))) for k in KINDS)), ",")
    return spans.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))
