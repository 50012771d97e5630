"""Every registered query of the engine against its SQL twin."""

from __future__ import annotations

import pytest
from oracle import assert_same, duck

from tidelog.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


def test_all_but_one_have_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"byte_safe_payloads"}
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert_same(QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name]))


def test_unicode_canonical_form(spark):
    import hashlib
    import json

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["json_canonical_unicode"](spark, SF).collect():
        stored = json.dumps({"doc_id": r.doc_id, "text": docs[r.doc_id]}, separators=(",", ":")).encode() + b","
        assert (len(stored), hashlib.md5(stored).hexdigest()) == (r.nbytes, r.md5)


def test_payloads_that_are_not_text(spark):
    import base64
    import hashlib

    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = set()
    for r in QUERIES["byte_safe_payloads"](spark, SF).collect():
        raw = docs[r.doc_id][:60] + (b"\xc3" if r.doc_id % 2 == 0 else b"\n")
        try:
            text = base64.b64encode(raw).decode() if r.doc_id % 4 > 1 else raw.decode()
        except UnicodeDecodeError:
            text = None
        seen.add((r.doc_id % 4, text is None))
        frame = None if text is None else "event: data\n" + "".join(f"data:{x}\n" for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")) + "\n"
        assert (r.error, r.frame_md5) == (text is None, frame and hashlib.md5(frame.encode()).hexdigest())
    assert {(0, True), (1, False), (2, False), (3, False)} <= seen
