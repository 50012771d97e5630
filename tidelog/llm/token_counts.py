"""Token counts per section by offset-mapped attribution.

The fields of a document are joined and encoded once, as a whole. Each token covers a span of the
encoded text; the spans tile it. Sections (fields, and their lines with the line break that ends
them) tile it too, so the interval join of the two is a merge of sorted ends. A token inside one
section counts there; one that crosses a boundary goes, by the rule "most", to the section that holds
most of its bytes, ties to the earlier one ("first": to the one with its first byte; "last": with its
last byte). The counts of a document's sections therefore sum to its tokens.

Defined results: a null field counts as empty; an empty document has one section of no characters and
no tokens; texts of any length are encoded whole; repeated rows are counted each, and a null identifier
stays null; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import default_path, encoder

COUNTS = "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long"
RULES = ("most", "first", "last")


def owners(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For tokens and sections that tile the same bytes: each token's section, and whether it crosses a boundary."""
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    own = last.copy() if rule == "last" else first.copy()
    crossing = first != last
    if rule == "most":
        for i in np.flatnonzero(crossing):
            inside = [min(section_ends[k], token_ends[i]) - max(section_ends[k - 1] if k else 0, starts[i]) for k in range(first[i], last[i] + 1)]
            own[i] = first[i] + int(np.argmax(inside))
    return own, crossing


def section_bytes(parts: list[str]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The joined text, and for each section its field's number, its number in the field and its end in bytes."""
    whole, ends, at = [], [], 0
    for f, part in enumerate(parts):
        raw = (part if f == len(parts) - 1 else part + "\n").encode()
        lines = raw.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        for i, line in enumerate(lines):
            at += len(line)
            ends.append((f, i, at))
        whole.append(raw)
    return b"".join(whole), ends


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), tokenizer: str | None = None, rule: str = "most") -> DataFrame:
    """One row per section: its characters (start and end in the joined text), its tokens, and how many of them cross into it or out of it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for row in batch.itertuples(index=False):
                raw, sections = section_bytes([x or "" for x in row[2:]])
                which = np.array(sections, dtype=np.int64)
                ends = which[:, 2]
                ids = np.array(enc.ids(raw.decode()), dtype=np.int64)
                own, crossing = owners(np.cumsum(enc.width[ids]), ends, rule) if len(ids) else (ids, ids.astype(bool))
                n = np.bincount(own, minlength=len(ends))
                crossed = np.bincount(own[crossing], minlength=len(ends))
                characters = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
                until = characters[ends]
                out.append((np.full(len(ends), row[0], dtype=np.int64), np.full(len(ends), row[1], dtype=bool), which[:, 0], which[:, 1], np.concatenate(([0], until[:-1])), until, n, crossed))
            if not out:
                continue
            columns = [np.concatenate(x) for x in zip(*out)]
            frame = pd.DataFrame(dict(zip(["doc_id", "null", "field", "section", "start", "end", "n_tokens", "n_crossing"], columns)))
            frame["field"] = np.array(fields, dtype=object)[frame["field"]]
            frame["doc_id"] = pd.arrays.IntegerArray(frame["doc_id"].to_numpy(), frame.pop("null").to_numpy())
            yield frame.astype({"section": "int32"})

    # a null identifier goes as a flag: pandas would turn identifiers beside it into floats
    id_ = F.col("doc_id").cast("long")
    given = docs.select(F.coalesce(id_, F.lit(0)).alias("_id"), id_.isNull().alias("_null"), *(F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)))
    return given.mapInPandas(count, COUNTS)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
