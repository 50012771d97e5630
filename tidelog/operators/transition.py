"""What one append or close request does to a stream: the one transition that batch and streaming share."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.jsoncanon import elements, stored
from ..schema import DEFAULT_TYPE, PRODUCER_TTL, START, STRICT_MAX

LONG_MAX = 2**63 - 1
DIGITS = re.compile(r"\d+$")

# The HTTP status of each outcome. Requests that only close answer 204 where an append would say 200.
HTTP = {"not_found": 404, "bad_request": 400, "stream_closed": 409, "content_type_mismatch": 409, "seq_conflict": 409, "sequence_gap": 409, "stale_epoch": 403, "invalid_epoch_seq": 400, "invalid_json": 400, "empty_array": 400, "duplicate": 204}


@dataclass
class StreamState:
    """One stream. exists is False for paths that were never created."""

    exists: bool = False
    content_type: str | None = None
    tail: str = START
    last_seq: str | None = None
    closed: bool = False
    closed_by: tuple[str, int, int] | None = None
    created_at: float = 0.0
    ttl_seconds: int | None = None
    expires_at: str | None = None
    producers: dict[str, tuple[int, int, float]] = field(default_factory=dict)  # epoch, last seq, when
    sweep_at: int = 1024

    def known(self, producer: str, now: float) -> tuple[int, int, float] | None:
        """A producer's state, unless it is too old. All old ones are forgotten each time that their number has doubled, so a request costs the same with many producers as with few."""
        if len(self.producers) > self.sweep_at:
            self.producers = {k: v for k, v in self.producers.items() if now - v[2] <= PRODUCER_TTL}
            self.sweep_at = max(1024, 2 * len(self.producers))
        found = self.producers.get(producer)
        return found if found is not None and now - found[2] <= PRODUCER_TTL else None

    def is_gone(self, now: float, strict: bool) -> bool:
        if not self.exists:
            return True
        if self.ttl_seconds is not None and now - self.created_at > self.ttl_seconds:
            return True
        until = instant(self.expires_at, strict)
        return until is not None and now > until


@dataclass(slots=True)
class Request:
    content_type: str | None
    stream_seq: str | None
    stream_closed: str | None
    producer_id: str | None
    producer_epoch: str | None
    producer_seq: str | None
    body: bytes
    ts: float


@dataclass(slots=True)
class Outcome:
    status: str
    http_status: int
    next_offset: str | None = None
    closed: bool = False
    producer_epoch: int | None = None
    producer_seq: int | None = None
    expected_seq: int | None = None
    received_seq: int | None = None
    stored: bytes | None = None


def instant(text: str | None, strict: bool) -> float | None:
    """Seconds of ISO text; its zone counts in strict mode only; None for bad or absent text."""
    if text is None:
        return None
    try:
        when = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    if when.tzinfo is None or not strict:
        when = when.replace(tzinfo=dt.timezone.utc)
    return when.timestamp()


@lru_cache(256)
def media_type(text: str | None) -> str:
    return text.partition(";")[0].strip().lower() if text else DEFAULT_TYPE


def advanced(offset: str, nbytes: int) -> str:
    read_seq, _, position = offset.partition("_")
    return f"{int(read_seq):016d}_{int(position) + nbytes:016d}"


def judge(known: tuple[int, int, float] | None, epoch: int, seq: int) -> tuple[str, int | None]:
    """A producer's (epoch, seq) against what is known of it: the outcome, and the number that explains it."""
    if known is None:
        return ("accepted", None) if seq == 0 else ("sequence_gap", 0)
    current, last, _ = known
    if epoch != current:
        if epoch < current:
            return "stale_epoch", current
        return ("accepted", None) if seq == 0 else ("invalid_epoch_seq", None)
    if seq <= last:
        return "duplicate", last
    return ("accepted", None) if seq == last + 1 else ("sequence_gap", last + 1)


def refused(r: Request, strict: bool) -> bool:
    """What the headers alone rule out."""
    given = (r.producer_id is not None) + (r.producer_epoch is not None) + (r.producer_seq is not None)
    if given not in (0, 3):
        return True
    if given and (r.producer_id == "" or not DIGITS.match(r.producer_epoch) or not DIGITS.match(r.producer_seq)):
        return True
    if given and strict and max(int(r.producer_epoch), int(r.producer_seq)) > STRICT_MAX:
        return True
    if not r.body:
        return not wants_close(r, strict)
    return not r.content_type


def wants_close(r: Request, strict: bool) -> bool:
    return (r.stream_closed or "").lower() == "true" if strict else r.stream_closed == "true"


def apply(state: StreamState, r: Request, strict: bool = False) -> Outcome:
    """Handles r, changing state as far as r is accepted."""
    if refused(r, strict):
        return Outcome("bad_request", 400, closed=state.closed)
    if state.is_gone(r.ts, strict):
        state.exists = False
        return Outcome("not_found", 404)
    only_close = not r.body
    close = wants_close(r, strict)
    who = None if r.producer_id is None else (r.producer_id, int(r.producer_epoch), int(r.producer_seq))

    if state.closed:
        if who is not None and who == state.closed_by:
            return Outcome("duplicate", 204, state.tail, True, _fit(who[1]), _fit(who[2]))
        if only_close and who is None:
            return Outcome("accepted", 204, state.tail, True)
        return Outcome("stream_closed", 409, state.tail, True)
    if not only_close and state.content_type and media_type(r.content_type) != media_type(state.content_type):
        return Outcome("content_type_mismatch", 409)

    if who is not None:
        verdict, number = judge(state.known(who[0], r.ts), who[1], who[2])
        if verdict == "stale_epoch":
            return Outcome(verdict, 403, producer_epoch=_fit(number))
        if verdict == "sequence_gap":
            return Outcome(verdict, 409, expected_seq=_fit(number), received_seq=_fit(who[2]))
        if verdict == "duplicate":
            return Outcome(verdict, 204, state.tail if only_close else None, False, _fit(who[1]), _fit(number))
        if verdict != "accepted":
            return Outcome(verdict, HTTP[verdict])

    data = b""
    if not only_close:
        if r.stream_seq is not None and state.last_seq is not None and r.stream_seq <= state.last_seq:
            return Outcome("seq_conflict", 409)
        data = r.body
        if media_type(state.content_type) == "application/json":
            parts = elements(r.body)
            if not parts:
                return Outcome("invalid_json" if parts is None else "empty_array", 400)
            data = stored(parts)
        state.tail = advanced(state.tail, len(data))
        if r.stream_seq is not None:
            state.last_seq = r.stream_seq
    if who is not None:
        state.producers[who[0]] = (who[1], who[2], r.ts)
    if close:
        state.closed, state.closed_by = True, who
    status = 204 if only_close or who is None else 200
    return Outcome("accepted", status, state.tail, state.closed, who and _fit(who[1]), who and _fit(who[2]), stored=None if only_close else data)


def _fit(n: int | None) -> int | None:
    """Numbers are unbounded here and long in tables, where larger ones saturate."""
    return None if n is None else min(n, LONG_MAX)
