"""SQL twins of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

# -- relations that several queries share ----------------------------------------------------

OFFSETS = """
m AS (SELECT conv_id::VARCHAR AS path, turn AS ingest_seq, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS nbytes, role,
  sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS pos FROM conversations),
o AS (SELECT *, printf('%016d_%016d', 0, pos) AS "offset", printf('%016d_%016d', 0, pos - nbytes) AS start FROM m)"""
STREAMS = OFFSETS + """,
s AS (SELECT path, max("offset") AS tail, arg_max(role, ingest_seq) = 'assistant' AS closed FROM o GROUP BY path)"""


def _answers(asked: str, kind: str = "text/plain") -> str:
    """asked: a relation with req_id, path, offset, live, cursor, if_none_match, as_of, jitter."""
    return f"""{STREAMS},
q0 AS ({asked}),
q AS (SELECT q0.*, s.tail, s.closed AS is_closed,
  CASE WHEN "offset" = '' THEN 'empty' WHEN NOT regexp_full_match("offset", '-1|now|[0-9]+_[0-9]+') THEN 'invalid' WHEN live IN ('long-poll', 'sse') AND "offset" IS NULL THEN 'offset required' END AS error,
  CASE WHEN "offset" IS NULL OR "offset" IN ('', '-1') THEN '' WHEN "offset" = 'now' THEN s.tail ELSE "offset" END AS after FROM q0 LEFT JOIN s USING (path)),
a AS (SELECT q.*, x.n, x.bytes, x.last, x.body FROM q JOIN
  (SELECT q.req_id, count(o.path) AS n, coalesce(sum(o.nbytes), 0)::BIGINT AS bytes, max(o."offset") AS last, string_agg(o.text, '' ORDER BY o."offset") AS body
   FROM q LEFT JOIN o ON q.path = o.path AND o."offset" > q.after GROUP BY q.req_id) x USING (req_id)),
b AS (SELECT *, error IS NULL AS good, coalesce("offset" = 'now', false) AS is_now, coalesce(live = 'long-poll', false) AS polls,
  n = 0 AND (coalesce("offset" = 'now', false) OR after = tail) AS at_end FROM a),
c AS (SELECT *, good AND polls AND at_end AS waits, good AND is_now AND NOT polls AS only_now FROM b),
d AS (SELECT *, CASE WHEN NOT good THEN NULL WHEN waits AND is_closed THEN tail WHEN waits THEN after ELSE coalesce(last, tail) END AS next_offset FROM c),
e AS (SELECT *, CASE WHEN good THEN is_closed AND (next_offset = tail OR only_now OR waits) END AS closed_at, trunc((epoch_us(as_of) / 1e6 - 1728432000) / 20)::BIGINT AS bucket FROM d),
f AS (SELECT *, CASE WHEN good AND NOT waits AND NOT only_now THEN '"' || to_base64(encode(path)) || ':' || CASE WHEN "offset" <> '' THEN "offset" ELSE '-1' END || ':' || next_offset || CASE WHEN closed_at THEN ':c' ELSE '' END || '"' END AS etag,
  CASE WHEN good AND polls AND NOT (waits AND is_closed) THEN (CASE WHEN try_cast(cursor AS BIGINT) >= bucket THEN try_cast(cursor AS BIGINT) + greatest(1, jitter // 20) ELSE bucket END)::VARCHAR END AS next_cursor FROM e),
r AS (SELECT req_id, path, CASE WHEN NOT good THEN 400 WHEN waits THEN 204 WHEN etag = if_none_match THEN 304 ELSE 200 END AS http_status, n, bytes, next_offset, closed_at AS closed, next_cursor, etag, only_now, coalesce(body, '') AS text FROM f)"""


_KINDS = """
SELECT path::BIGINT * 8 + k AS req_id, path, CASE k WHEN 1 THEN '-1' WHEN 2 THEN 'now' WHEN 3 THEN printf('%016d_%016d', 0, path::BIGINT * 37 % 1500) WHEN 4 THEN '0_0' WHEN 5 THEN printf('%016d_%016d', 0, 1000000000000) WHEN 6 THEN '' WHEN 7 THEN 'abc' END AS "offset",
  CASE path::BIGINT % 3 WHEN 1 THEN 'long-poll' WHEN 2 THEN 'x' END AS live, CASE path::BIGINT % 4 WHEN 1 THEN 'abc' WHEN 2 THEN '10' WHEN 3 THEN '99999999' END AS cursor, NULL::VARCHAR AS if_none_match,
  TIMESTAMP '2024-11-01 00:00:00' + to_seconds(path::BIGINT) AS as_of, (path::BIGINT % 3600 + 1)::INTEGER AS jitter
FROM s, (SELECT unnest(range(8))::BIGINT AS k) t WHERE k IN ({kinds})"""
READ = "req_id, path, http_status, n, bytes, next_offset, closed"


def _read(kinds: str, columns: str = READ, tail: str = "") -> str:
    return f"WITH {_answers(_KINDS.replace('{kinds}', kinds))} SELECT {columns} FROM r {tail}"


ORACLE_SQL |= {
    "stream_offsets": f'WITH {OFFSETS} SELECT path, ingest_seq, nbytes, "offset" FROM o',
    "message_start_offsets": f'WITH {OFFSETS} SELECT path, ingest_seq, start, "offset" FROM o',
    "document_stream_offsets": """SELECT source AS path, doc_id AS ingest_seq, strlen(text)::BIGINT AS nbytes,
  printf('%016d_%016d', 0, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT) AS "offset" FROM documents""",
    "stream_tail": f"WITH {STREAMS} SELECT path, tail AS current_offset FROM s",
    "read_from_offset": _read("3"),
    "read_from_sentinel_start": _read("0, 1"),
    "read_at_now": _read("2"),
    "read_unpadded_offset": _read("4"),
    "read_beyond_tail": _read("5"),
    "read_mid_message": f"""WITH {OFFSETS}, i AS (SELECT path, ingest_seq, printf('%016d_%016d', 0, pos - nbytes + 1) AS after FROM o WHERE nbytes > 1)
SELECT i.path, i.ingest_seq, count(*) AS n, sum(o.nbytes)::BIGINT AS bytes, max(o."offset") AS last FROM i JOIN o ON i.path = o.path AND o."offset" > i.after GROUP BY i.path, i.ingest_seq""",
    "batch_reads": _read("0, 1, 2, 3, 4, 5, 6, 7", READ + ", next_cursor, etag"),
    "long_poll_outcomes": "WITH "
    + _answers("""SELECT path::BIGINT AS req_id, path, CASE WHEN path::BIGINT % 2 = 0 THEN 'now' ELSE tail END AS "offset", 'long-poll' AS live, NULL::VARCHAR AS cursor, NULL::VARCHAR AS if_none_match, TIMESTAMP '2024-11-01 00:00:00' AS as_of, 60 AS jitter FROM s""")
    + f" SELECT {READ}, next_cursor FROM r",
    "conditional_read": "WITH "
    + _answers("""SELECT path::BIGINT AS req_id, path, NULL::VARCHAR AS "offset", NULL::VARCHAR AS live, NULL::VARCHAR AS cursor,
  CASE WHEN path::BIGINT % 2 = 0 THEN '"' || to_base64(encode(path)) || ':-1:' || tail || CASE WHEN closed THEN ':c' ELSE '' END || '"' ELSE '"x"' END AS if_none_match, NULL::TIMESTAMP AS as_of, NULL::INTEGER AS jitter FROM s""")
    + " SELECT req_id, http_status, etag FROM r",
    "response_body_text": _read("0, 3", "req_id, http_status, CASE WHEN http_status = 200 THEN text END AS body"),
    "response_body_json": """SELECT event_type || '/' || user_id AS path, '[' || string_agg(replace(props, ' ', ''), ',' ORDER BY event_id) || ']' AS body FROM events GROUP BY ALL""",
    "partial_chunks": f'WITH {OFFSETS} SELECT path, ingest_seq, "offset" FROM o WHERE pos <= 1000 OR pos = nbytes',
    "closed_eof": _read("0, 2", "req_id, path, next_offset", "WHERE closed"),
    "etag": _read("1, 3", "req_id, etag", "WHERE etag IS NOT NULL"),
}

# at p seconds past, streams whose number p divides by three without rest live for a minute, those with rest one until two minutes past
_GONE = "((path::BIGINT % 3 = 0 AND path::BIGINT > 60) OR (path::BIGINT % 3 = 1 AND path::BIGINT > 120))"
ORACLE_SQL |= {
    "expired_reads": _read("0, 1, 2, 3, 4, 5, 6, 7", f"""req_id, path, CASE WHEN {_GONE} THEN 404 ELSE http_status END AS http_status, CASE WHEN {_GONE} THEN 0 ELSE n END AS n, CASE WHEN {_GONE} THEN 0 ELSE bytes END::BIGINT AS bytes,
  CASE WHEN NOT {_GONE} THEN next_offset END AS next_offset, CASE WHEN NOT {_GONE} THEN closed END AS closed, CASE WHEN NOT {_GONE} THEN next_cursor END AS next_cursor, CASE WHEN NOT {_GONE} THEN etag END AS etag"""),
    "expired_bodies": _read("0, 3", f"req_id, CASE WHEN {_GONE} THEN 404 ELSE http_status END AS http_status, CASE WHEN http_status = 200 AND NOT {_GONE} THEN text END AS body"),
    "expired_head": f"""WITH {STREAMS} SELECT path::BIGINT * 8 AS req_id, CASE WHEN {_GONE} THEN 404 ELSE 200 END AS http_status, CASE WHEN NOT {_GONE} THEN tail END AS next_offset, CASE WHEN NOT {_GONE} THEN closed END AS closed,
  CASE WHEN NOT {_GONE} THEN '"' || to_base64(encode(path)) || ':-1:' || tail || CASE WHEN closed THEN ':c' ELSE '' END || '"' END AS etag, CASE WHEN NOT {_GONE} THEN 'no-store' END AS cache_control, 'text/plain' AS content_type FROM s
UNION ALL SELECT -1, 404, NULL, NULL, NULL, NULL, 'text/plain'""",
}

# -- JSON ------------------------------------------------------------------------------------

ORACLE_SQL |= {
    "json_canonical_ascii": "SELECT event_id, replace(props, ' ', '') || ',' AS stored FROM events",
    "json_flatten": """WITH e AS (SELECT event_type || '/' || user_id AS path, event_id * 4 + k AS ingest_seq, CASE k WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN event_id::VARCHAR ELSE '[1,2]' END AS element FROM events, (SELECT unnest(range(3))::BIGINT AS k) t)
SELECT path, ingest_seq, element, printf('%016d_%016d', 0, sum(strlen(element) + 1) OVER (PARTITION BY path ORDER BY ingest_seq)::BIGINT) AS "offset" FROM e""",
    "json_errors": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'empty_array' ELSE CASE WHEN json_valid('{' || props) THEN 'accepted' ELSE 'invalid_json' END END AS status FROM events",
}

# -- headers and syntax ----------------------------------------------------------------------

ORACLE_SQL |= {
    "offset_syntax_check": """WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '-1' WHEN 1 THEN 'now' WHEN 2 THEN '0_' || event_id WHEN 3 THEN '' WHEN 4 THEN event_id || '_' WHEN 5 THEN 'NOW' WHEN 6 THEN printf('%016d_%016d', 0, event_id) END AS text,
  CASE event_id % 3 WHEN 1 THEN 'sse' WHEN 2 THEN 'other' END AS live FROM events)
SELECT event_id, text, CASE WHEN text = '' THEN 'empty' WHEN text IS NOT NULL AND event_id % 5 = 4 THEN 'repeated' WHEN NOT regexp_full_match(text, '-1|now|[0-9]+_[0-9]+') THEN 'invalid' WHEN live = 'sse' AND text IS NULL THEN 'offset required' END AS error FROM t""",
    "ttl_syntax_check": """SELECT event_id, CASE WHEN event_id % 7 < 6 AND event_id % 4 < 2 THEN 'both' WHEN event_id % 7 IN (2, 3, 4, 5) THEN 'invalid ttl' WHEN event_id % 4 = 0 THEN 'invalid expiry' END AS error FROM events""",
    "content_type_normalize": """WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Application/JSON; charset=utf-8' WHEN 1 THEN '' WHEN 2 THEN ' ;x' WHEN 3 THEN 'text/plain' WHEN 4 THEN chr(9) || 'Text/HTML ' WHEN 5 THEN 'nonsense' END AS t FROM events),
n AS (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'application/octet-stream' ELSE lower(trim(split_part(t, ';', 1), ' ' || chr(9) || chr(10) || chr(13))) END AS media_type FROM t)
SELECT event_id, media_type, CASE WHEN regexp_matches(t, '^[\\w-]+/[\\w-]+') THEN t ELSE 'application/octet-stream' END AS accepted, t IS NOT NULL AND t <> '' AND (starts_with(media_type, 'text/') OR media_type = 'application/json') AS is_text,
  coalesce(t <> '' AND media_type <> 'text/plain', false) AS clash FROM n""",
    "producer_header_check": """WITH t AS (SELECT event_id, event_id % 5 <> 0 AS a, event_id % 5 <> 1 AS b, event_id % 7 = 0 AS no_id, event_id % 11 = 0 AS bad_e, event_id % 13 = 0 AS bad_s, event_id % 17 <> 0 AS typed, event_id % 3 = 0 AS closing, event_id % 2 = 0 AS has_body FROM events)
SELECT event_id, CASE WHEN a <> b THEN 'partial producer' WHEN a AND no_id THEN 'empty producer id' WHEN a AND bad_e THEN 'bad epoch' WHEN a AND bad_s THEN 'bad seq' WHEN NOT has_body AND NOT closing THEN 'empty body' WHEN has_body AND NOT typed THEN 'no content type' END AS error FROM t""",
    "query_string_values": "SELECT event_id, event_id::VARCHAR AS first_offset, 2::BIGINT AS n_offsets, 'a b' AS second_offset, '' AS live, event_type AS cursor FROM events",
    "location_address": """WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'https' END AS scheme, CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 ELSE 8080 END AS port, '/' || event_type AS path FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN scheme || '://h.example' WHEN 1 THEN scheme || '://srv' || CASE WHEN (scheme = 'http' AND port = 80) OR (scheme = 'https' AND port = 443) THEN '' ELSE ':' || port END ELSE 'http://localhost:4437' END || path AS location FROM t""",
}

# -- cursors and frames ----------------------------------------------------------------------

_BUCKET = "trunc((epoch_us(ts) / 1e6 - 1728432000) / 20)::BIGINT"
ORACLE_SQL |= {
    "cursor_bucket": f"SELECT event_id, {_BUCKET} AS bucket FROM events",
    "response_cursor": f"""WITH t AS (SELECT event_id, {_BUCKET} AS bucket, CASE event_id % 4 WHEN 0 THEN -2000000 WHEN 1 THEN event_id * 3 END AS client, event_id % 3600 + 1 AS j FROM events)
SELECT event_id, (CASE WHEN client >= bucket THEN client + greatest(1, j // 20) ELSE bucket END)::VARCHAR AS cursor FROM t""",
    "sse_frames_text": """WITH t AS (SELECT doc_id, 'event: data' || chr(10) || 'data:' || replace(replace(replace(replace(text, '. ', '.' || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(10) || 'data:') || chr(10) || chr(10) AS f FROM documents)
SELECT doc_id, md5(f) AS frame_md5, strlen(f)::BIGINT AS nbytes FROM t""",
    "sse_frames_base64": """WITH t AS (SELECT page_id, 'event: data' || chr(10) || 'data:' || to_base64(encode(html)) || chr(10) || chr(10) AS f FROM pages)
SELECT page_id, md5(f) AS frame_md5, strlen(f)::BIGINT AS nbytes FROM t""",
    "sse_frames_json": """SELECT event_type || '/' || user_id AS path, event_id AS ingest_seq, 'event: data' || chr(10) || 'data:[' || replace(props, ' ', '') || ']' || chr(10) || chr(10) AS frame FROM events""",
    "sse_control": f"""WITH {STREAMS}, c AS (SELECT path, CASE WHEN closed THEN '{{"streamNextOffset":"' || tail || '","streamClosed":true}}' ELSE '{{"streamNextOffset":"' || tail || '","streamCursor":"' || trunc((epoch_us(TIMESTAMP '2024-11-01 00:00:00') / 1e6 - 1728432000) / 20)::BIGINT || '","upToDate":true}}' END AS control FROM s)
SELECT path, control, 'event: control' || chr(10) || 'data:' || control || chr(10) || chr(10) AS frame FROM c""",
}

_FRAME = "'event: {event}' || chr(10) || 'data:' || replace({x}, chr(10), chr(10) || 'data:') || chr(10) || chr(10)"
ORACLE_SQL |= {
    "sse_sequence": "WITH " + _answers(_KINDS.replace("{kinds}", "0, 1, 2, 3, 4, 5").replace("CASE path::BIGINT % 3 WHEN 1 THEN 'long-poll' WHEN 2 THEN 'x' END AS live", "'sse' AS live")) + f""",
x AS (SELECT *, CASE WHEN is_closed AND coalesce(last, tail) = tail THEN '{{"streamNextOffset":"' || coalesce(last, tail) || '","streamClosed":true}}'
  ELSE '{{"streamNextOffset":"' || coalesce(last, tail) || '","streamCursor":"' || CASE WHEN try_cast(cursor AS BIGINT) >= bucket THEN try_cast(cursor AS BIGINT) + greatest(1, jitter // 20) ELSE bucket END || '","upToDate":true}}' END AS control FROM f WHERE good),
y AS (SELECT req_id, o."offset" AS spot, 'data' AS event, {_FRAME.format(event="data", x="replace(replace(o.text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS frame FROM x JOIN o ON x.path = o.path AND o."offset" > x.after
  UNION ALL SELECT req_id, '~', 'control', {_FRAME.format(event="control", x="control")} FROM x)
SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY spot)::INTEGER AS position, event, frame FROM y""",
    "json_canonical_unicode": r"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).'), lambda x: CASE WHEN x = '"' THEN '\"' WHEN x = chr(92) THEN chr(92) || chr(92) WHEN x = chr(10) THEN '\n' WHEN x = chr(13) THEN '\r' WHEN x = chr(9) THEN '\t' WHEN x = chr(8) THEN '\b' WHEN x = chr(12) THEN '\f'
  WHEN ord(x) < 32 OR ord(x) BETWEEN 128 AND 65535 THEN printf('\u%04x', ord(x)) WHEN ord(x) > 65535 THEN printf('\u%04x\u%04x', 55296 + ((ord(x) - 65536) >> 10), 56320 + ((ord(x) - 65536) & 1023)) ELSE x END) AS parts FROM documents),
s AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"text":"' || array_to_string(parts, '') || '"},' AS stored FROM c)
SELECT doc_id, strlen(stored)::BIGINT AS nbytes, md5(stored) AS md5 FROM s""",
}

# -- lifecycle -------------------------------------------------------------------------------

CREATES = r"""
c AS (SELECT doc_id AS ingest_seq, source || '/' || doc_id % 50 AS path, CASE doc_id % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN 'Application/JSON; v=1' WHEN 2 THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type,
  CASE doc_id % 7 WHEN 0 THEN 3600 END::BIGINT AS ttl, CASE doc_id % 11 WHEN 0 THEN '2025-01-01T00:00:00Z' END AS until, doc_id % 3 = 0 AS closed,
  (doc_id % 7 < 3 AND doc_id % 11 < 2) OR doc_id % 7 IN (1, 2) OR doc_id % 11 = 1 AS bad, doc_id % 5 < 2 AS json, CASE doc_id % 13 WHEN 0 THEN '[]' WHEN 1 THEN '[1, {"a": 2}]' WHEN 2 THEN '{' END AS body FROM documents),
k AS (SELECT *, CASE WHEN json THEN 'application/json' WHEN content_type = 'text/plain' THEN 'text/plain' ELSE 'application/octet-stream' END AS media, NOT bad AND NOT (json AND body IS NOT NULL AND body = '{') AS can,
  CASE WHEN body IS NULL THEN 0 WHEN NOT json THEN strlen(body) WHEN body = '[]' THEN 0 ELSE strlen('1,{"a":2},') END::BIGINT AS size FROM c),
f AS (SELECT path, min(ingest_seq) AS first FROM k WHERE can GROUP BY path),
g AS (SELECT k.*, f.first, h.media AS m1, h.ttl AS t1, h.until AS u1, h.closed AS c1 FROM k LEFT JOIN f USING (path) LEFT JOIN k h ON h.path = k.path AND h.ingest_seq = f.first),
r AS (SELECT *, CASE WHEN bad THEN 'bad_request' WHEN ingest_seq = first THEN 'created' WHEN first IS NULL OR first > ingest_seq THEN 'invalid_json'
  WHEN media = m1 AND ttl IS NOT DISTINCT FROM t1 AND until IS NOT DISTINCT FROM u1 AND closed = c1 THEN 'exists' ELSE 'conflict' END AS status FROM g),
made AS (SELECT path, content_type, printf('%016d_%016d', 0, size) AS current_offset, ttl, until, closed FROM r WHERE status = 'created')"""
ORACLE_SQL |= {
    "create_outcomes": f"""WITH {CREATES} SELECT path, ingest_seq, status, CASE status WHEN 'created' THEN 201 WHEN 'exists' THEN 200 WHEN 'conflict' THEN 409 ELSE 400 END AS http_status,
  CASE WHEN status = 'created' THEN printf('%016d_%016d', 0, size) END AS next_offset, CASE WHEN status IN ('created', 'exists') THEN closed END AS closed FROM r""",
    "stream_expired": """SELECT event_id, (event_id % 3 = 0 AND epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') > event_id % 30 * 86400 * 1000000)
  OR (event_id % 4 = 0 AND ts > TIMESTAMP '2024-01-10 00:00:00') OR (event_id % 4 = 1 AND ts > TIMESTAMP '2024-01-20 12:30:00') AS expired FROM events""",
    "list_paths": f"WITH {CREATES} SELECT path FROM made",
    "exists_semi": f"WITH {CREATES} SELECT path FROM made WHERE path IN (SELECT source || '/' || unnest([doc_id % 50, doc_id % 7 * 10]) FROM documents)",
    "delete_anti": f"WITH {CREATES} SELECT path, current_offset FROM made WHERE split_part(path, '/', 2)::INTEGER % 2 = 1",
    "delete_outcomes": f"""WITH {CREATES} SELECT path, ingest_seq, CASE WHEN path IN (SELECT path FROM made) AND row_number() OVER (PARTITION BY path ORDER BY ingest_seq) = 1 THEN 204 ELSE 404 END AS http_status FROM k""",
    "expired_delete": f"""WITH {CREATES} SELECT k.path, k.ingest_seq, CASE WHEN made.path IS NOT NULL AND row_number() OVER (PARTITION BY k.path ORDER BY k.ingest_seq) = 1 AND NOT coalesce(made.ttl = 3600 AND k.ingest_seq % 20 > 10, false) THEN 204 ELSE 404 END AS http_status FROM k LEFT JOIN made ON k.path = made.path""",
    "stream_head": f"""WITH {CREATES} SELECT path, current_offset AS next_offset, content_type, closed, '"' || to_base64(encode(path)) || ':-1:' || current_offset || CASE WHEN closed THEN ':c' ELSE '' END || '"' AS etag, ttl AS ttl_seconds, until AS expires_at FROM made""",
    "fault_injection": """WITH e AS (SELECT event_type AS path, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'post' END AS method, event_id AS ingest_seq FROM events),
x AS (SELECT *, (path = 'error' AND method = 'GET') OR path = 'click' OR (path = 'view' AND method = 'post') AS hit FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY path, hit ORDER BY ingest_seq) AS n FROM x)
SELECT path, method, ingest_seq, CASE WHEN hit AND path = 'error' AND n <= 3 THEN 503 WHEN hit AND path = 'click' AND n <= 1 THEN 500 END AS fault_status, CASE WHEN hit AND path = 'error' AND n <= 3 THEN 7 END AS retry_after FROM k""",
}

# -- appends ---------------------------------------------------------------------------------

_VARIANTS = """
n AS (SELECT event_id, event_type, user_id, props, ts, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1)::BIGINT AS n FROM events),
b AS (SELECT *, n // 10 AS epoch, n % 10 AS seq, user_id::VARCHAR AS who FROM n),
v AS (SELECT *, event_id * 8 AS ingest_seq, who AS producer_id, epoch AS e, seq AS s FROM b
  UNION ALL SELECT *, event_id * 8 + 1, who, epoch, seq FROM b WHERE event_id % 7 = 0
  UNION ALL SELECT *, event_id * 8 + 2, who, epoch, seq + 5 FROM b WHERE event_id % 13 = 0
  UNION ALL SELECT *, event_id * 8 + 3, who, epoch - 1, seq FROM b WHERE event_id % 17 = 0 AND epoch > 0
  UNION ALL SELECT *, event_id * 8 + 4, who, epoch + 1, 1 FROM b WHERE event_id % 19 = 0
  UNION ALL SELECT *, event_id * 8 + 5, 'late-' || who, 0, 3 FROM b WHERE event_id % 23 = 0)"""


def _fsm(ttl: bool) -> str:
    fresh = "AND date_diff('microsecond', st.t, l.ts) <= 604800000000" if ttl else ""
    return f"""RECURSIVE {_VARIANTS},
l AS (SELECT event_type AS path, producer_id, ingest_seq, e, s, ts, row_number() OVER (PARTITION BY event_type, producer_id ORDER BY ingest_seq) AS k FROM v),
st AS (SELECT DISTINCT path, producer_id, 0::BIGINT AS k, NULL::BIGINT AS ce, NULL::BIGINT AS cl, NULL::TIMESTAMP AS t, NULL::BIGINT AS ingest_seq, NULL::BIGINT AS epoch, NULL::BIGINT AS seq, NULL::VARCHAR AS status, NULL::BIGINT AS current_epoch, NULL::BIGINT AS expected_seq, NULL::BIGINT AS last_seq FROM l
 UNION ALL
 SELECT path, producer_id, k, CASE WHEN status = 'accepted' THEN e ELSE ce END, CASE WHEN status = 'accepted' THEN s ELSE cl END, CASE WHEN status = 'accepted' THEN ts ELSE t END, ingest_seq, e, s, status,
  CASE WHEN status = 'stale_epoch' THEN ce END, CASE WHEN status = 'sequence_gap' THEN coalesce(cl + 1, 0) END, CASE WHEN status = 'duplicate' THEN cl END
 FROM (SELECT *, CASE WHEN ce IS NULL THEN CASE WHEN s = 0 THEN 'accepted' ELSE 'sequence_gap' END WHEN e < ce THEN 'stale_epoch' WHEN e > ce THEN CASE WHEN s = 0 THEN 'accepted' ELSE 'invalid_epoch_seq' END
   WHEN s <= cl THEN 'duplicate' WHEN s = cl + 1 THEN 'accepted' ELSE 'sequence_gap' END AS status
  FROM (SELECT l.path, l.producer_id, l.k, l.ingest_seq, l.e, l.s, l.ts, CASE WHEN st.ce IS NOT NULL {fresh} THEN st.ce END AS ce, CASE WHEN st.ce IS NOT NULL {fresh} THEN st.cl END AS cl, CASE WHEN st.ce IS NOT NULL {fresh} THEN st.t END AS t
        FROM st JOIN l ON l.path = st.path AND l.producer_id = st.producer_id AND l.k = st.k + 1)))"""


_FSM_COLUMNS = "path, producer_id, ingest_seq, epoch, seq, status, current_epoch, expected_seq, last_seq"
ORACLE_SQL |= {
    "producer_fsm": f"WITH {_fsm(False)} SELECT {_FSM_COLUMNS} FROM st WHERE k > 0",
    "producer_state_ttl": f"WITH {_fsm(True)} SELECT {_FSM_COLUMNS} FROM st WHERE k > 0",
    "producer_final_state": f"WITH {_fsm(False)} SELECT path, producer_id, arg_max(epoch, ingest_seq) AS epoch, arg_max(seq, ingest_seq) AS last_seq FROM st WHERE status = 'accepted' GROUP BY ALL",
}

_APPENDS = f"""RECURSIVE {_VARIANTS},
w AS (SELECT *, event_type || '/' || user_id % 25 AS path, user_id % 25 AS bucket, row_number() OVER p AS o, count(*) OVER (PARTITION BY event_type, user_id % 25) - row_number() OVER p AS rest,
   lag(producer_id) OVER p AS bp, lag(e) OVER p AS be, lag(s) OVER p AS bs FROM v WINDOW p AS (PARTITION BY event_type, user_id % 25 ORDER BY ingest_seq)),
l AS (SELECT path, bucket, ingest_seq, o, event_id % 31 = 0 AS wrong_type, CASE WHEN event_id % 5 = 0 THEN printf('%08d', o) WHEN event_id % 29 = 0 THEN printf('%08d', greatest(o - 10, 0)) END AS sseq, rest = 2 AS closing,
   CASE WHEN rest <= 2 OR event_id % 53 <> 0 THEN CASE WHEN rest = 1 THEN bp ELSE producer_id END END AS pid, CASE WHEN rest <= 2 OR event_id % 53 <> 0 THEN CASE WHEN rest = 1 THEN be ELSE e END END AS pe,
   CASE WHEN rest <= 2 OR (event_id % 43 <> 0 AND event_id % 53 <> 0) THEN CASE WHEN rest = 1 THEN bs ELSE s END END AS ps,
   CASE WHEN rest = 2 AND bucket % 2 = 0 THEN '' WHEN rest > 2 AND event_id % 37 = 0 THEN '[]' WHEN rest > 2 AND event_id % 41 = 0 THEN '{{' WHEN rest > 2 AND event_id % 47 = 0 THEN '' ELSE props END AS body, ts,
   bucket = 24 OR (bucket = 23 AND date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) > 15 * 86400 * 1000000::BIGINT) AS missing FROM w),
st AS (SELECT DISTINCT path, 0::BIGINT AS o, 0::BIGINT AS tail, NULL::VARCHAR AS last_seq, false AS closed, NULL::VARCHAR AS cb, MAP {{}}::MAP(VARCHAR, STRUCT(e BIGINT, s BIGINT, t TIMESTAMP)) AS known,
   NULL::BIGINT AS ingest_seq, NULL::VARCHAR AS status, NULL::BIGINT AS pe, NULL::BIGINT AS ps, false AS only_close, false AS who, NULL::BIGINT AS kn_e, NULL::BIGINT AS kn_s, NULL::VARCHAR AS stored, false AS was_closed, NULL::VARCHAR AS verdict FROM l
 UNION ALL
 SELECT path, o, CASE WHEN stores THEN tail + strlen(data) ELSE tail END, CASE WHEN stores THEN coalesce(sseq, last_seq) ELSE last_seq END, closed OR (status = 'accepted' AND closing), CASE WHEN status = 'accepted' AND closing AND NOT closed AND pid IS NOT NULL THEN tuple ELSE cb END,
   CASE WHEN status = 'accepted' AND pid IS NOT NULL AND NOT closed THEN map_concat(known, MAP {{pid: {{'e': pe, 's': ps, 't': ts}}}}) ELSE known END, ingest_seq, status, pe, ps, only_close, pid IS NOT NULL, kn.e, kn.s, CASE WHEN stores THEN data END, closed, verdict
 FROM (SELECT *, status = 'accepted' AND NOT only_close AS stores, replace(body, ' ', '') || ',' AS data FROM (SELECT *, CASE WHEN (pid IS NOT NULL)::INT + (pe IS NOT NULL)::INT + (ps IS NOT NULL)::INT NOT IN (0, 3) OR (only_close AND NOT closing) THEN 'bad_request' WHEN missing THEN 'not_found'
     WHEN closed AND tuple = cb THEN 'duplicate' WHEN closed AND only_close AND pid IS NULL THEN 'accepted' WHEN closed THEN 'stream_closed' WHEN NOT only_close AND wrong_type THEN 'content_type_mismatch'
     WHEN pid IS NOT NULL AND verdict <> 'accepted' THEN verdict WHEN NOT only_close AND sseq <= last_seq THEN 'seq_conflict' WHEN body = '[]' THEN 'empty_array' WHEN body = '{{' THEN 'invalid_json' ELSE 'accepted' END AS status
   FROM (SELECT *, CASE WHEN kn IS NULL THEN CASE WHEN ps = 0 THEN 'accepted' ELSE 'sequence_gap' END WHEN pe < kn.e THEN 'stale_epoch' WHEN pe > kn.e THEN CASE WHEN ps = 0 THEN 'accepted' ELSE 'invalid_epoch_seq' END
       WHEN ps <= kn.s THEN 'duplicate' WHEN ps = kn.s + 1 THEN 'accepted' ELSE 'sequence_gap' END AS verdict
     FROM (SELECT *, CASE WHEN known[pid] IS NOT NULL AND date_diff('microsecond', known[pid].t, ts) <= 604800000000 THEN known[pid] END AS kn
       FROM (SELECT l.*, st.tail, st.last_seq, st.closed, st.cb, st.known, l.body = '' AS only_close, l.pid || '|' || l.pe || '|' || l.ps AS tuple FROM st JOIN l ON l.path = st.path AND l.o = st.o + 1)))))),
r AS (SELECT path, ingest_seq, status, CASE status WHEN 'accepted' THEN CASE WHEN only_close OR NOT who THEN 204 ELSE 200 END WHEN 'duplicate' THEN 204 WHEN 'stale_epoch' THEN 403 WHEN 'not_found' THEN 404
    WHEN 'bad_request' THEN 400 WHEN 'invalid_epoch_seq' THEN 400 WHEN 'invalid_json' THEN 400 WHEN 'empty_array' THEN 400 ELSE 409 END AS http_status,
  CASE WHEN status IN ('accepted', 'stream_closed') OR (status = 'duplicate' AND (was_closed OR only_close)) THEN printf('%016d_%016d', 0, tail) END AS next_offset,
  CASE WHEN status = 'accepted' THEN closed WHEN status IN ('duplicate', 'stream_closed', 'bad_request') THEN was_closed ELSE false END AS closed,
  CASE WHEN who AND (status = 'duplicate' OR (status = 'accepted' AND NOT (was_closed AND only_close))) THEN pe WHEN status = 'stale_epoch' THEN kn_e END AS producer_epoch,
  CASE WHEN status = 'duplicate' THEN CASE WHEN was_closed THEN ps ELSE kn_s END WHEN status = 'accepted' AND who THEN ps END AS producer_seq,
  CASE WHEN status = 'sequence_gap' THEN coalesce(kn_s + 1, 0) END AS expected_seq, CASE WHEN status = 'sequence_gap' THEN ps END AS received_seq, stored FROM st WHERE o > 0)"""
_OUTCOME = "path, ingest_seq, status, http_status, next_offset, closed, producer_epoch, producer_seq, expected_seq, received_seq"
ORACLE_SQL |= {
    "append_outcomes": f"WITH {_APPENDS} SELECT {_OUTCOME} FROM r",
    "streaming_append": f"WITH {_APPENDS} SELECT {_OUTCOME} FROM r",
    "append_status_codes": f"WITH {_APPENDS} SELECT path, status, http_status, count(*) AS n FROM r GROUP BY ALL",
    "append_messages": f'WITH {_APPENDS} SELECT path, ingest_seq, stored AS data, strlen(stored)::BIGINT AS nbytes, next_offset AS "offset" FROM r WHERE stored IS NOT NULL',
    "stream_seq_conflicts": f"WITH {_APPENDS} SELECT path, ingest_seq FROM r WHERE status = 'seq_conflict'",
    "close_outcomes": f"WITH {_APPENDS} SELECT path, ingest_seq, status, http_status, next_offset FROM r WHERE closed",
    "streams_after_appends": f"""WITH {_APPENDS} SELECT path, coalesce(max(CASE WHEN status = 'accepted' THEN next_offset END), '0000000000000000_0000000000000000') AS current_offset, bool_or(closed) AS closed FROM r WHERE split_part(path, '/', 2) <> '24' GROUP BY path""",
    "duplicate_share": f"WITH {_APPENDS} SELECT path, count(*) AS n, avg((status = 'duplicate')::INTEGER::DOUBLE) AS duplicate_share FROM r GROUP BY path",
    "live_tail": f"""WITH {OFFSETS} SELECT path, ingest_seq, "offset" FROM o WHERE "offset" > '0000000000000000_0000000000000500'""",
    "log_range_read": f"""WITH {OFFSETS} SELECT path, ingest_seq, "offset" FROM o WHERE path = '7' AND "offset" > '0000000000000000_0000000000000100'""",
}

# -- responses -------------------------------------------------------------------------------

ORACLE_SQL |= {
    "append_headers": f"""WITH {_APPENDS}, x AS (SELECT r.*, l.body = '' AS only_close FROM r JOIN l USING (path, ingest_seq))
SELECT path, ingest_seq, http_status, next_offset AS stream_next_offset, CASE WHEN (status IN ('accepted', 'duplicate', 'stream_closed') AND closed) OR (status = 'duplicate' AND only_close) THEN 'true' END AS stream_closed,
  producer_epoch::VARCHAR AS producer_epoch, producer_seq::VARCHAR AS producer_seq, expected_seq::VARCHAR AS producer_expected_seq, received_seq::VARCHAR AS producer_received_seq, CASE WHEN http_status >= 400 THEN 'text/plain' END AS content_type FROM x""",
    "read_headers": _read("0, 1, 2, 3, 4, 5, 6, 7", """req_id, http_status, CASE WHEN http_status < 300 THEN next_offset END AS stream_next_offset, CASE WHEN http_status < 300 THEN 'true' END AS stream_up_to_date, CASE WHEN http_status < 300 AND closed THEN 'true' END AS stream_closed,
  CASE WHEN http_status < 300 THEN next_cursor END AS stream_cursor, etag, CASE WHEN http_status >= 400 THEN 'text/plain' END AS content_type"""),
    "dispatch": """WITH m AS (SELECT event_id, ['get', 'PUT', 'Post', 'HEAD', 'DELETE', 'OPTIONS', 'PATCH', 'TRACE'][event_id % 8 + 1] AS method FROM events)
SELECT event_id, method, CASE upper(method) WHEN 'GET' THEN 'read' WHEN 'PUT' THEN 'create' WHEN 'POST' THEN 'append' WHEN 'HEAD' THEN 'head' WHEN 'DELETE' THEN 'delete' WHEN 'OPTIONS' THEN 'preflight' END AS operation, CASE event_id % 8 WHEN 5 THEN 204 WHEN 6 THEN 405 WHEN 7 THEN 405 END AS http_status FROM m""",
    "preflight_headers": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 204 WHEN 1 THEN 405 END AS http_status, CASE WHEN event_id % 3 < 2 THEN 'GET, POST, PUT, DELETE, HEAD, OPTIONS' END AS access_control_allow_methods,
  CASE WHEN event_id % 3 < 2 THEN 'content-type, authorization, Stream-Seq, Stream-TTL, Stream-Expires-At, Stream-Closed, Producer-Id, Producer-Epoch, Producer-Seq' END AS access_control_allow_headers,
  CASE WHEN event_id % 3 < 2 THEN 'Stream-Next-Offset, Stream-Cursor, Stream-Up-To-Date, Stream-Closed, Producer-Epoch, Producer-Seq, Producer-Expected-Seq, Producer-Received-Seq, etag, content-type, content-encoding, vary' END AS access_control_expose_headers,
  CASE WHEN event_id % 3 < 2 THEN 'nosniff' END AS x_content_type_options, CASE WHEN event_id % 3 < 2 THEN 'cross-origin' END AS cross_origin_resource_policy, CASE WHEN event_id % 3 = 1 THEN 'text/plain' END AS content_type FROM events""",
    "header_lookup": "SELECT event_id, event_id::VARCHAR AS seq, NULL::VARCHAR AS absent FROM events",
    "carried_cursors": "SELECT user_id AS connection, event_id AS pass, (max(1000 + event_id * 7919 % 180) OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR AS cursor FROM events",
    "strict_expiry": """SELECT event_id, ts > TIMESTAMP '2024-01-10 00:00:00' AS expired, ts > CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-09 22:00:00' ELSE TIMESTAMP '2024-01-10 05:00:00' END AS strictly FROM events""",
}
