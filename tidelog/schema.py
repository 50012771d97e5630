"""Schemas of the request, state and outcome tables."""

from __future__ import annotations

CREATE_REQUESTS = "ingest_seq long, path string, content_type string, stream_ttl string, stream_expires_at string, stream_closed string, body binary, ts timestamp"
APPEND_REQUESTS = "ingest_seq long, path string, content_type string, stream_seq string, stream_closed string, producer_id string, producer_epoch string, producer_seq string, body binary, ts timestamp"
READ_REQUESTS = "req_id long, path string, offset string, live string, cursor string, if_none_match string, as_of timestamp, jitter_seconds int"
CLOSED_BY = "struct<producer_id:string,epoch:long,seq:long>"
STREAMS = f"path string, content_type string, current_offset string, last_seq string, ttl_seconds long, expires_at string, created_at timestamp, closed boolean, closed_by {CLOSED_BY}"
MESSAGES = "path string, ingest_seq long, data binary, nbytes int, offset string, ts timestamp"
PRODUCERS = "path string, producer_id string, epoch long, last_seq long, last_updated timestamp"
OUTCOMES = "path string, ingest_seq long, status string, http_status int, next_offset string, closed boolean, producer_epoch long, producer_seq long, expected_seq long, received_seq long, stored binary"

#: The offset of an empty stream.
START = "0000000000000000_0000000000000000"
#: Producer states older than this many seconds are forgotten.
PRODUCER_TTL = 7 * 24 * 3600
#: Cursor buckets: seconds since this instant, in intervals.
CURSOR_EPOCH = 1728432000
CURSOR_INTERVAL = 20
#: Largest epoch and sequence number that strict mode accepts.
STRICT_MAX = 2**53 - 1
DEFAULT_TYPE = "application/octet-stream"
