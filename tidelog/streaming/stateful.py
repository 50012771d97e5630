"""Appends as a Structured Streaming query: the transition of the batch fold over keyed state."""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.append import events_of, outcome_frame, outcome_row, requests_of, state_of
from ..operators.transition import StreamState, apply
from ..schema import APPEND_REQUESTS, OUTCOMES, PRODUCER_TTL

STREAM_STATE = "exists boolean, content_type string, tail string, last_seq string, closed boolean, by_id string, by_epoch long, by_seq long, created double, ttl long, expires string, swept double, pages int, known long"
REQUEST = ["at", "ingest_seq", "content_type", "stream_seq", "stream_closed", "producer_id", "producer_epoch", "producer_seq", "body"]
#: Producers of a page of state, on average at most.
PAGE = 256


class Appends(StatefulProcessor):
    """Keyed by path: one value for the stream, and its producers on pages, by a hash of their identifiers.

    A call to the state store costs far more than a request's fold, so a batch makes one for each page that it
    needs, not some for each producer. Pages double in number as they fill: they hold PAGE producers on average at most."""

    def __init__(self, strict: bool = False) -> None:
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stream = handle.getValueState("stream", STREAM_STATE)
        self.pages = handle.getMapState("pages", "page int", "ids array<string>, epochs array<long>, seqs array<long>, at array<double>")

    def _load(self) -> tuple[StreamState, float, int, int]:
        """The stream, when old producers were last forgotten, how many pages there are and how many producers on them."""
        if not self.stream.exists():
            return StreamState(), 0.0, 1, 0
        exists, kind, tail, seq, closed, by_id, by_epoch, by_seq, at, ttl, until, swept, pages, known = self.stream.get()
        return StreamState(exists, kind, tail, seq, closed, None if by_id is None else (by_id, by_epoch, by_seq), at, ttl, until), swept, pages, known

    def _save(self, s: StreamState, swept: float, pages: int, known: int) -> None:
        self.stream.update((s.exists, s.content_type, s.tail, s.last_seq, s.closed, *(s.closed_by or (None, None, None)), s.created_at, s.ttl_seconds, s.expires_at, swept, pages, known))

    def _page(self, k: int) -> dict:
        found = self.pages.getValue((k,)) if self.pages.containsKey((k,)) else ((), (), (), ())
        return dict(zip(found[0], zip(*found[1:])))

    def _put(self, k: int, page: dict) -> None:
        if page:
            self.pages.updateValue((k,), (list(page), *map(list, zip(*page.values()))))
        else:
            self.pages.removeKey((k,))

    def _write(self, held: dict[int, dict], changed: set[int], pages: int, known: int, now: float | None) -> tuple[int, int]:
        """Writes the pages that changed; forgets what is too old at now, if that is given; splits pages that are too full. One page at a time beside those held."""
        more = pages
        while known > more * PAGE:
            more *= 2
        if now is not None:
            known = 0
        for k in range(pages) if now is not None or more > pages else changed:
            page = held.pop(k) if k in held else self._page(k)
            kept = page if now is None else {p: v for p, v in page.items() if not now - v[2] > PRODUCER_TTL}
            if now is not None:
                known += len(kept)
            if more > pages:
                parts = defaultdict(dict)
                for p, v in kept.items():
                    parts[place(p, more)][p] = v
                for part in sorted({k, *parts}):
                    self._put(part, parts[part])
            elif k in changed or len(kept) < len(page):
                self._put(k, kept)
        return more, known

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self._save(state_of(r), r.at, 1, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, swept, pages, known = self._load()
        given = pd.concat([r[REQUEST] for r in rows]).sort_values("ingest_seq", kind="stable")
        held: dict[int, dict] = {}
        before = {}
        for p in set(given["producer_id"].dropna()):
            if (k := place(p, pages)) not in held:
                held[k] = self._page(k)
            if p in held[k]:
                before[p] = held[k][p]
        state.producers = dict(before)
        state.sweep_at = sys.maxsize  # what is too old counts as unknown, but is forgotten by _write alone
        out = [outcome_row(key[0], n, apply(state, r, self.strict)) for n, r in requests_of(given)]
        changed = set()
        for p, v in state.producers.items():
            if before.get(p) != v:
                k = place(p, pages)
                changed.add(k)
                known += p not in held[k]
                held[k][p] = v
        now = float(given["at"].max())
        sweeping = now - swept > PRODUCER_TTL  # once in that time
        pages, known = self._write(held, changed, pages, known, now if sweeping else None)
        self._save(state, now if sweeping else swept, pages, known)
        yield outcome_frame(out)


def place(producer: str, pages: int) -> int:
    """The page of a producer, out of a power of two of them: where their number doubles, a page splits into itself and one more."""
    return zlib.crc32(producer.encode("utf-8", "surrogatepass")) % pages


def append_stream(requests: DataFrame, streams: DataFrame, strict: bool = False) -> DataFrame:
    """Outcomes of a stream of requests, given the streams that exist. Requests of a path must arrive in order of ingest_seq over batches.

    Start it within settings.disk_state: it needs the RocksDB state store. A batch reads the pages (PAGE
    producers each) of the producers that its requests name and no others; those older than PRODUCER_TTL seconds count as
    unknown and are deleted once in that time, so state is bounded by the producers of twice that time. One path's part of
    one batch is held in memory: bound the trigger (maxFilesPerTrigger and the like). Checkpoints of versions that kept one
    entry for each producer don't go on: Spark refuses their schema."""
    none = streams.sparkSession.createDataFrame([], APPEND_REQUESTS)
    known = events_of(none, streams, None).filter("kind = 0")
    rows = _requests_only(requests)
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=Appends(strict), outputStructType=OUTCOMES, outputMode="Append", timeMode="None", initialState=known.groupBy("path"))


def _requests_only(requests: DataFrame) -> DataFrame:
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    return requests.select("path", *(at if c == "at" else F.col(c).cast("long").alias(c) if c == "ingest_seq" else c for c in REQUEST))
