"""Secrets in texts: base patterns, and candidate strings whose sliding-window entropy is high.

A candidate is a run of letters, digits and `+/_=-` of at least `SHORTEST` characters that no base
match covers. Its characters fall into classes (lower, upper, digit, symbol); a window (all of a shorter
candidate) slides over it, and counts per character and per class are kept incrementally, with n*log2(n)
terms updated for the one character that comes and the one that goes. A window is suspicious where it
mixes two of lower, upper and digit, at least half of it lies outside word-like runs, numbers and separators, and
the Shannon entropy of its characters, overall and within each class, reaches its floor: what as many
characters drawn at random from the window's alphabet (that of its classes, or the 16 hex digits) fall
short of with a chance of `TAIL`. The union of overlapping suspicious windows is the added span,
unless the allow-list (single words, numbers, UUIDs, paths and addresses, repeated units) suppresses it.
Random letters of one case alone look like a word and are no candidates. Base matches always stay.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; texts of any
length are scanned whole; repeated rows give repeated results; spans that start together are ordered by
kind as listed, then by end; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can be left out at once
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")

# What looks random and isn't secret.
ALLOW = [
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"[A-Z]?[a-z]+|[A-Z]+"),
    re.compile(r"[0-9]+"),
    re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[-_/=+])+(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4}"),
    re.compile(r"[-_=+/]+"),
    re.compile(r"(.{1,8})\1{2,}.{0,8}"),
    re.compile(r"(?:https?/|www|sha[0-9]+-|data/|image/).*"),
]
WINDOW = 20
#: Chance that a random window falls short of one entropy floor.
TAIL = 0.001
SYMBOLS = {"lower": 26, "upper": 26, "digit": 10, "symbol": 2}
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")

# Numbers set off by separators, runs of letters that may be words, and the letters that follow each letter in words of European languages.
NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])")
RUN = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
FOLLOW = {
    "a": "bcdefghiklmnprstuvxyz", "b": "abeilorstuy", "c": "acehiklortuy", "d": "adeilorsuy", "e": "abcdefghilmnopqrstuvwxy", "f": "aefilortuy", "g": "aeghilnorstuy",
    "h": "aeilnortuy", "i": "abcdefgklmnopqrstvz", "j": "aeou", "k": "aeilnorsty", "l": "abdefgiklmopstuvy", "m": "abeimnopsuy", "n": "acdefgiklnostuvyz",
    "o": "abcdefghiklmnoprstuvwxy", "p": "aehiloprstuy", "q": "u", "r": "abcdefgiklmnoprstuvwyz", "s": "aceghiklmnopqstuwyz", "t": "acehilorstuwyz",
    "u": "abcdefgiklmnprstxz", "v": "aeiou", "w": "aehilnors", "x": "aceiptu", "y": "aceilmnoprst", "z": "aeiotuyz",
}


def class_of(c: str) -> str:
    return "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "symbol"


class Counts:
    """Counts of a window's characters, overall and per class, with their entropies in bits."""

    def __init__(self) -> None:
        self.count: dict[str, int] = {}
        self.total = {"all": 0, "lower": 0, "upper": 0, "digit": 0, "symbol": 0}
        self.weight = dict.fromkeys(self.total, 0.0)  # sum of n * log2(n)

    def change(self, c: str, by: int) -> None:
        old = self.count.get(c, 0)
        new = old + by
        self.count[c] = new
        moved = (new * math.log2(new) if new > 1 else 0.0) - (old * math.log2(old) if old > 1 else 0.0)
        for k in ("all", class_of(c)):
            self.total[k] += by
            self.weight[k] += moved

    def entropy(self, k: str = "all") -> float:
        n = self.total[k]
        return math.log2(n) - self.weight[k] / n if n > 1 else 0.0


def partitions(n: int, most: int) -> Iterator[tuple[int, ...]]:
    """Ways to write n as a sum of positive numbers of at most so much, largest first."""
    if n == 0:
        yield ()
    for c in range(min(n, most), 0, -1):
        for rest in partitions(n - c, c):
            yield (c, *rest)


@lru_cache(maxsize=4096)
def floor_of(n: int, symbols: int) -> float:
    """The entropy that n characters drawn evenly from so many symbols fall short of with a chance of TAIL at most (exact)."""
    chances = []
    for part in partitions(n, n):
        if len(part) <= symbols:
            ways = math.factorial(n) * math.perm(symbols, len(part))
            for x in (*part, *Counter(part).values()):
                ways //= math.factorial(x)
            chances.append((math.log2(n) - sum(c * math.log2(c) for c in part) / n, ways / symbols**n))
    below = 0.0
    for entropy, chance in sorted(chances):
        if below + chance > TAIL:
            return entropy - 1e-9
        below += chance
    return 0.0


def loose(s: str) -> list[int]:
    """For each length of a prefix of s, its letters and digits outside numbers and word-like runs: those with one unusual pair of letters in eight at most."""
    free = [c.isalnum() for c in s]
    for m in NUMBER.finditer(s):
        free[m.start() : m.end()] = [False] * (m.end() - m.start())
    for m in RUN.finditer(s):
        w = m.group().lower()
        if len(w) > 2 and sum(b not in FOLLOW[a] for a, b in zip(w, w[1:])) <= len(w) // 8:
            free[m.start() : m.end()] = [False] * len(w)
    out = [0]
    for x in free:
        out.append(out[-1] + x)
    return out


def suspicious(s: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of overlapping windows of s that look random: mixed classes, with the entropy of random strings overall and in each."""
    found: list[tuple[int, int]] = []
    counts, free, foreign = Counts(), loose(s), 0
    window = min(window, len(s))
    for i, c in enumerate(s):
        counts.change(c, 1)
        foreign += c not in HEX_DIGITS
        if i >= window:
            counts.change(s[i - window], -1)
            foreign -= s[i - window] not in HEX_DIGITS
        if i + 1 < window or 2 * (free[i + 1] - free[i + 1 - window]) < window:
            continue
        total = counts.total
        mixed = [k for k in ("lower", "upper", "digit") if total[k]]
        if len(mixed) < 2:
            continue
        symbols = {k: SYMBOLS[k] if foreign or k == "digit" else 6 for k in mixed}
        alphabet = sum(symbols.values()) + (SYMBOLS["symbol"] if total["symbol"] else 0) if foreign else 16
        if counts.entropy() < floor_of(window, alphabet) or any(counts.entropy(k) < floor_of(total[k], symbols[k]) for k in mixed):
            continue
        start = i + 1 - window
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], i + 1)
        else:
            found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(p.fullmatch(s) for p in ALLOW):
            continue
        for start, end in suspicious(s):
            start, end = start + m.start(), end + m.start()
            if not any(a < end and start < b for a, b, _ in base):
                found.append((start, end, "entropy"))
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (start, end, kind)."""
    spans = "array<struct<start:long,end:long,kind:string>>"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(t or "") for t in batch["text"]]
            more = [added_spans(t or "", b) for t, b in zip(batch["text"], base)]
            named = [[[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in column] for column in (base, more)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": named[0], "added": named[1]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, f"doc_id long, base {spans}, added {spans}")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def order(x):
        return F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "entropy"))), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))

    every = F.array_sort(F.transform(F.concat("base", "added"), order))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(every).alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    """base_sha256 of spans, as a plain function."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
