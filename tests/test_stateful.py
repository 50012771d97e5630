"""The stateful operator over a store that counts its calls."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pytest

from tidelog.operators.append import outcome_frame, outcome_row
from tidelog.operators.transition import Request, StreamState, apply
from tidelog.schema import PRODUCER_TTL
from tidelog.streaming.stateful import Appends

TEXT, N = "text/plain", 3000


class Store:
    """Both kinds of state that Appends asks for, in memory."""

    def __init__(self):
        self.calls, self.value, self.map = Counter(), None, {}

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        self.calls["containsKey"] += 1
        return key in self.map

    def getValue(self, key):  # noqa: N802
        self.calls["getValue"] += 1
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls["updateValue"] += 1
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls["removeKey"] += 1
        self.map.pop(key, None)

    def iterator(self):
        return iter(list(self.map.items()))


def opened() -> tuple[Store, Appends]:
    store, appends = Store(), Appends()
    appends.init(store)
    start = {"current_offset": None, "closed": False, "by_id": None, "by_epoch": None, "by_seq": None, "ttl_seconds": None, "expires_at": None, "content_type": TEXT, "stream_seq": None, "at": 0.0}
    appends.handleInitialState(("s",), pd.DataFrame([start]), None)
    return store, appends


def asked(rows: list[tuple]) -> pd.DataFrame:
    """Rows of ingest_seq, producer, sequence number and time."""
    return pd.DataFrame([{"at": float(t), "kind": 2, "ingest_seq": i, "current_offset": None, "closed": False, "by_id": None, "by_epoch": None, "by_seq": None, "ttl_seconds": None, "expires_at": None, "content_type": TEXT, "stream_seq": None, "stream_closed": None, "producer_id": p, "producer_epoch": "0", "producer_seq": str(q), "body": b"x"} for i, p, q, t in rows])


def outcomes(appends: Appends, rows: list[tuple]) -> list[tuple]:
    frames = appends.handleInputRows(("s",), iter([asked(part) for part in (rows[::2], rows[1::2]) if part]), None)
    return [tuple(None if x is pd.NA else x for x in r) for f in frames for r in f.itertuples(index=False)]


def folded(state: StreamState, rows: list[tuple]) -> list[tuple]:
    return [outcome_row("s", i, apply(state, Request(TEXT, None, None, p, "0", str(q), b"x", float(t)))) for i, p, q, t in rows]


def test_calls_to_the_store_dont_grow_with_each_producer():
    store, appends = opened()
    outcomes(appends, [(i, f"p{i}", 0, i) for i in range(N)])
    assert sum(store.calls.values()) < N / 20
    store.calls.clear()
    outcomes(appends, [(N + i, f"p{i}", 1, N + i) for i in range(N)])
    assert sum(store.calls.values()) < N / 20


def test_one_request_reads_and_writes_a_small_part():
    store, appends = opened()
    outcomes(appends, [(i, f"p{i}", 0, i) for i in range(N)])
    before = dict(store.map)
    store.calls.clear()
    outcomes(appends, [(N, "p7", 1, N)])
    changed = [k for k in store.map if store.map[k] != before.get(k)]
    assert sum(store.calls.values()) <= 3 and len(changed) == 1 and len(store.map[changed[0]][0]) < N / 4


@pytest.mark.parametrize("size", [N, 700, 41])
def test_batches_equal_one_fold(size):
    """New producers, retries, gaps and numbers that go on, over pages that split; at the end, most are too old."""
    rows = [(i, f"p{i * 7919 % (1 + i // 2)}é", (i // 500) % 3, i * 10) for i in range(N)]
    rows += [(N + i, f"p{i}é", i % 4, i * 10 + N * 10 + PRODUCER_TTL - N * 5) for i in range(N)]
    store, appends = opened()
    got = [x for k in range(0, len(rows), size) for x in outcomes(appends, rows[k : k + size])]
    want = folded(StreamState(True, TEXT, sweep_at=10**9), rows)
    assert got == want
    assert len({x[2] for x in want}) > 2


def test_old_producers_leave_the_state():
    store, appends = opened()
    outcomes(appends, [(i, f"p{i}", 0, i) for i in range(N)])
    held = lambda: sum(len(v[0]) for v in store.map.values())
    assert held() == N
    outcomes(appends, [(N, "new", 0, N + 2 * PRODUCER_TTL)])
    assert held() == 1
    assert outcomes(appends, [(N + 1, "p1", 1, N + 2 * PRODUCER_TTL)])[0][2] == "sequence_gap"


def test_large_numbers_beside_nulls_stay():
    state = StreamState(True, TEXT)
    rows = [outcome_row("s", i, apply(state, Request(TEXT, None, None, p, e, "0", b"x", 0.0))) for i, (p, e) in enumerate([("p", str(2**53 + 1)), (None, None), ("q", str(2**63 - 1))])]
    rows[1] = outcome_row("s", 1, apply(state, Request(TEXT, None, None, None, None, None, b"x", 0.0)))
    assert outcome_frame(rows)["producer_epoch"].tolist() == [2**53 + 1, pd.NA, 2**63 - 1]
