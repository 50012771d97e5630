"""One row for each line of the outcome tables, and properties of the transition."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.operators.transition import Request, StreamState, apply, judge
from tidelog.schema import PRODUCER_TTL, START, STRICT_MAX


def fresh(kind: str = "text/plain", **more) -> StreamState:
    return StreamState(exists=True, content_type=kind, **more)


def req(body: bytes = b"x", who: tuple | None = None, kind: str | None = "text/plain", seq: str | None = None, close: str | None = None, ts: float = 0.0) -> Request:
    p, e, s = who or (None, None, None)
    return Request(kind, seq, close, p, None if e is None else str(e), None if s is None else str(s), body, ts)


@pytest.mark.parametrize(
    ("known", "epoch", "seq", "verdict"),
    [
        (None, 0, 1, ("sequence_gap", 0)),
        (None, 7, 0, ("accepted", None)),
        ((5, 3, 0), 4, 0, ("stale_epoch", 5)),
        ((5, 3, 0), 6, 1, ("invalid_epoch_seq", None)),
        ((5, 3, 0), 6, 0, ("accepted", None)),
        ((5, 3, 0), 5, 3, ("duplicate", 3)),
        ((5, 3, 0), 5, 0, ("duplicate", 3)),
        ((5, 3, 0), 5, 4, ("accepted", None)),
        ((5, 3, 0), 5, 5, ("sequence_gap", 4)),
    ],
)
def test_producer_table(known, epoch, seq, verdict):
    assert judge(known, epoch, seq) == verdict


@pytest.mark.parametrize(
    ("state", "request_", "status", "code"),
    [
        (StreamState(), req(), "not_found", 404),
        (StreamState(), req(b"", close="true"), "not_found", 404),
        (fresh(), req(b"", close="true"), "accepted", 204),
        (fresh(closed=True), req(b"", close="true"), "accepted", 204),
        (fresh(), req(b"", ("p", 0, 0), close="true"), "accepted", 204),
        (fresh(closed=True, closed_by=("p", 0, 0)), req(b"", ("p", 0, 0), close="true"), "duplicate", 204),
        (fresh(closed=True), req(b"", ("p", 0, 0), close="true"), "stream_closed", 409),
        (fresh(closed=True), req(), "stream_closed", 409),
        (fresh(closed=True, closed_by=("p", 1, 2)), req(who=("p", 1, 2)), "duplicate", 204),
        (fresh(), req(kind="text/html"), "content_type_mismatch", 409),
        (fresh(), req(kind="TEXT/plain; a=b"), "accepted", 204),
        (fresh(last_seq="b"), req(seq="b"), "seq_conflict", 409),
        (fresh(last_seq="b"), req(seq="c"), "accepted", 204),
        (fresh("application/json"), req(b"{", kind="application/json"), "invalid_json", 400),
        (fresh("application/json"), req(b"\xff", kind="application/json"), "invalid_json", 400),
        (fresh("application/json"), req(b"[]", kind="application/json"), "empty_array", 400),
        (fresh(), req(), "accepted", 204),
        (fresh(), req(who=("p", 3, 0)), "accepted", 200),
        (fresh(producers={"p": (1, 1, 0.0)}), req(who=("p", 1, 1)), "duplicate", 204),
        (fresh(producers={"p": (1, 1, 0.0)}), req(who=("p", 0, 1)), "stale_epoch", 403),
        (fresh(producers={"p": (1, 1, 0.0)}), req(who=("p", 2, 1)), "invalid_epoch_seq", 400),
        (fresh(producers={"p": (1, 1, 0.0)}), req(who=("p", 1, 3)), "sequence_gap", 409),
        (fresh(), req(b""), "bad_request", 400),
        (fresh(), req(kind=None), "bad_request", 400),
        (fresh(), Request("text/plain", None, None, "p", "1", None, b"x", 0), "bad_request", 400),
        (fresh(), req(who=("", 0, 0)), "bad_request", 400),
        (fresh(), req(who=("p", "-1", 0)), "bad_request", 400),
        (fresh(), req(b"", close="TRUE"), "bad_request", 400),
    ],
)
def test_outcome_table(state, request_, status, code):
    o = apply(state, request_)
    assert (o.status, o.http_status) == (status, code)


def test_strict_mode():
    assert apply(fresh(), req(b"", close="TRUE"), strict=True).status == "accepted"
    big = STRICT_MAX + 1
    assert apply(fresh(), req(who=("p", big, 0)), strict=True).status == "bad_request"
    assert apply(fresh(), req(who=("p", 10**30, 0))).producer_epoch == 2**63 - 1


def test_state_changes_only_with_success():
    s = fresh("application/json")
    assert apply(s, req(b"{", ("p", 0, 0), "application/json")).status == "invalid_json"
    assert apply(s, req(b"1", ("p", 0, 0), "application/json")).status == "accepted"
    assert s.tail == "0000000000000000_0000000000000002"


def test_expiry():
    assert apply(fresh(ttl_seconds=10), req(ts=10.0)).status == "accepted"
    assert apply(fresh(ttl_seconds=10), req(ts=10.1)).status == "not_found"
    zone = "1970-01-01T02:00:00+02:00"
    assert apply(fresh(expires_at=zone), req(ts=3600.0)).status == "accepted"
    assert apply(fresh(expires_at=zone), req(ts=3600.0), strict=True).status == "not_found"
    assert apply(fresh(expires_at="soon"), req(ts=1e12)).status == "accepted"
    late = PRODUCER_TTL + 1.0
    assert apply(fresh(producers={"p": (1, 1, 0.0)}), req(who=("p", 0, 0), ts=late)).status == "accepted"


requests_ = st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.integers(0, 2), st.integers(0, 3), st.binary(min_size=1, max_size=3), st.sampled_from([None, "a", "b", "c"]), st.booleans()), max_size=30)


@settings(max_examples=100, deadline=None)
@given(requests_)
def test_properties(rows):
    s, last, closed = fresh(), START, False
    for p, e, q, body, seq, close in rows:
        r = req(body, None if p is None else (p, e, q), seq=seq, close="true" if close and q == 3 else None)
        o = apply(s, r)
        if o.status == "accepted":
            assert o.next_offset > last
            last = o.next_offset
            if p is not None:
                assert apply(s, r).status == "duplicate"
        assert s.closed >= closed
        closed = s.closed
        assert s.tail == last


def test_many_producers_of_one_stream_cost_linear_time():
    """100,000 producers: nothing is swept at each request, and old ones are forgotten all the same."""
    import time

    def fold(n):
        state, start = StreamState(True, "text/plain"), time.perf_counter()
        for i in range(n):
            assert apply(state, Request("text/plain", None, None, f"p{i}", "0", "0", b"x", float(i))).status == "accepted"
        return time.perf_counter() - start, state

    fold(1_000)
    small, _ = fold(10_000)
    large, state = fold(100_000)
    assert large < 40 * small and len(state.producers) == 100_000
    late = 100_000 + PRODUCER_TTL + 1.0
    assert apply(state, Request("text/plain", None, None, "p99999", "0", "1", b"x", late)).status == "sequence_gap"
    for i in range(200_000):
        state.known("nobody", late)
        state.producers.setdefault(f"q{i}", (0, 0, late))
    assert not any(k.startswith("p") for k in state.producers)
