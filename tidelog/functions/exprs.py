"""Scalar functions and predicates of the log, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CURSOR_EPOCH, CURSOR_INTERVAL, DEFAULT_TYPE, START

#: Python's str.strip() removes these; SQL's trim() only spaces.
BLANKS = " \t\n\r\x0b\x0c"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- content types ---------------------------------------------------------------------------


def media_type(content_type: Column | str) -> Column:
    """The part before `;`, trimmed, in lower case; absent or empty: the octet-stream default."""
    c = _col(content_type)
    return F.when(c.isNull() | (c == ""), F.lit(DEFAULT_TYPE)).otherwise(F.lower(F.btrim(F.split_part(c, F.lit(";"), F.lit(1)), F.lit(BLANKS))))


def is_json(content_type: Column | str) -> Column:
    return media_type(content_type) == "application/json"


def accepted_type(content_type: Column | str) -> Column:
    """What a create request stores: the header where it begins like a media type, else the default."""
    c = _col(content_type)
    return F.when(c.rlike(r"^[\p{L}\p{N}_-]+/[\p{L}\p{N}_-]+"), c).otherwise(F.lit(DEFAULT_TYPE))


def is_text(content_type: Column | str) -> Column:
    """Whether event-stream frames carry the payload as text; otherwise in base64. An absent type isn't text."""
    c = F.lower(F.btrim(F.split_part(F.lower(F.coalesce(_col(content_type), F.lit(""))), F.lit(";"), F.lit(1)), F.lit(BLANKS)))
    return c.startswith("text/") | (c == "application/json")


def types_clash(given: Column | str, stored: Column | str) -> Column:
    """Only where both are given, and non-empty, can they differ."""
    g, s = _col(given), _col(stored)
    return F.coalesce((g != "") & (s != "") & (media_type(g) != media_type(s)), F.lit(False))


# -- offsets ---------------------------------------------------------------------------------


def offset_text(position: Column | str, read_seq: Column | int = 0) -> Column:
    """Two zero-padded numbers; longer numbers are kept whole."""
    first = F.lit(read_seq).cast("long") if isinstance(read_seq, int) else read_seq
    return F.format_string("%016d_%016d", first, _col(position).cast("long"))


def offset_position(offset: Column | str) -> Column:
    return F.split_part(_col(offset), F.lit("_"), F.lit(2)).cast("long")


def offset_error(offset: Column | str, given: Column | int = 1) -> Column:
    """Null for a good offset parameter. given: how often the parameter was given."""
    o, n = _col(offset), F.lit(given) if isinstance(given, int) else given
    return F.when(o.isNull(), F.lit(None).cast("string")).when(o == "", "empty").when(n > 1, "repeated").when(~o.rlike(r"^(-1|now|\p{Nd}+_\p{Nd}+)$"), "invalid")


def read_error(offset: Column | str, live: Column | str, given: Column | int = 1) -> Column:
    """As offset_error; live modes also need an offset."""
    o, mode = _col(offset), _col(live)
    return F.coalesce(offset_error(o, given), F.when(mode.isin("long-poll", "sse") & o.isNull(), F.lit("offset required")))


def effective_offset(offset: Column | str, tail: Column | str) -> Column:
    """What messages' offsets must exceed: nothing for absent, empty and -1; the tail for now."""
    o = _col(offset)
    return F.when(o.isNull() | o.isin("", "-1"), F.lit("")).when(o == "now", _col(tail)).otherwise(o)


# -- expiry ----------------------------------------------------------------------------------


def ttl_error(ttl: Column | str, expires_at: Column | str) -> Column:
    t, e = _col(ttl), _col(expires_at)
    both = F.coalesce((t != "") & (e != ""), F.lit(False))
    return F.when(both, "both").when((t != "") & ~t.rlike(r"^(0|[1-9]\p{Nd}*)$"), "invalid ttl").when((e != "") & expiry_instant(e).isNull(), "invalid expiry")


def expiry_instant(text: Column | str, strict: bool = False) -> Column:
    """The instant of ISO text; its zone is dropped and taken as UTC, but for strict mode, which honours it."""
    c = _col(text)
    if strict:
        return F.try_to_timestamp(c)
    return c.try_cast("timestamp_ntz").cast("timestamp") if hasattr(c, "try_cast") else F.expr("null")


def expired(created_at: Column | str, ttl_seconds: Column | str, expires_at: Column | str, as_of: Column | str, strict: bool = False) -> Column:
    """Strictly later than the time to live, or than the expiry text's instant; bad text never expires."""
    age = (F.unix_micros(_col(as_of)) - F.unix_micros(_col(created_at))) > _col(ttl_seconds) * 1_000_000
    late = _col(as_of) > expiry_instant(expires_at, strict)
    return F.coalesce(age, F.lit(False)) | F.coalesce(late, F.lit(False))


# -- cursors ---------------------------------------------------------------------------------


def cursor_bucket(as_of: Column | str, interval: int = CURSOR_INTERVAL, epoch: float = CURSOR_EPOCH) -> Column:
    """The number of whole intervals since the epoch, truncated toward zero."""
    return ((F.unix_micros(_col(as_of)) / 1e6 - epoch) / interval).cast("long")


def response_cursor(client: Column | str, as_of: Column | str, jitter_seconds: Column | str, interval: int = CURSOR_INTERVAL) -> Column:
    """The current bucket, or, where the client is there already or ahead, the client's moved on by the jitter."""
    now = cursor_bucket(as_of, interval)
    own = F.btrim(_col(client), F.lit(BLANKS)).try_cast("long")
    ahead = own + F.greatest(F.lit(1).cast("long"), F.floor(_col(jitter_seconds) / interval).cast("long"))
    return F.when(own >= now, ahead).otherwise(now).cast("string")


# -- bytes, ETags, frames --------------------------------------------------------------------


def base64_text(data: Column | str) -> Column:
    """Base64 without line breaks, which base64() puts in after every 76 characters."""
    return F.translate(F.base64(_col(data).cast("binary")), "\r\n", "")


def etag(path: Column | str, offset: Column | str, response_offset: Column | str, closed_at_tail: Column | str) -> Column:
    start = F.when(_col(offset) != "", _col(offset)).otherwise(F.lit("-1"))
    return F.concat(F.lit('"'), base64_text(path), F.lit(":"), start, F.lit(":"), _col(response_offset), F.when(_col(closed_at_tail), ":c").otherwise(""), F.lit('"'))


def json_body(text: Column | str) -> Column:
    """Stored elements, each followed by a comma, as an array."""
    return F.concat(F.lit("["), F.regexp_replace(F.coalesce(_col(text), F.lit("")), r",\z", ""), F.lit("]"))


def frame(event: str, payload: Column | str) -> Column:
    """An event-stream frame: a data line for each line of the payload, whatever its line breaks."""
    lines = F.split(F.regexp_replace(_col(payload), "\r\n|\r", "\n"), "\n", -1)
    return F.concat(F.lit(f"event: {event}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("data:"), x, F.lit("\n"))), ""), F.lit("\n"))


def control_json(offset: Column | str, closed: Column | str, cursor: Column | str) -> Column:
    """The control event's object: the offset, and either closed or cursor and up-to-date."""
    c = _col(closed)
    at = F.to_json(F.struct(_col(offset).alias("streamNextOffset"), F.lit(True).alias("streamClosed")))
    on = F.to_json(F.struct(_col(offset).alias("streamNextOffset"), _col(cursor).alias("streamCursor"), F.lit(True).alias("upToDate")))
    return F.when(c, at).otherwise(on)


# -- requests --------------------------------------------------------------------------------


def header_error(r: dict[str, Column], strict: bool = False) -> Column:
    """Why an append request is refused before its stream is looked at; null where it isn't.

    r: producer_id, producer_epoch, producer_seq, content_type, stream_closed, body."""
    trio = [r["producer_id"], r["producer_epoch"], r["producer_seq"]]
    some, every = trio[0].isNotNull() | trio[1].isNotNull() | trio[2].isNotNull(), trio[0].isNotNull() & trio[1].isNotNull() & trio[2].isNotNull()
    number = r"^\p{Nd}+$"
    size = F.coalesce(F.octet_length(r["body"]), F.lit(0))
    out = F.when(some & ~every, "partial producer").when(every & (trio[0] == ""), "empty producer id").when(every & ~trio[1].rlike(number), "bad epoch").when(every & ~trio[2].rlike(number), "bad seq")
    if strict:
        most = F.lit(2**53 - 1)
        out = out.when(every & ((F.length(trio[1]) > 18) | (trio[1].try_cast("long") > most)), "bad epoch").when(every & ((F.length(trio[2]) > 18) | (trio[2].try_cast("long") > most)), "bad seq")
    close = closes(r["stream_closed"], strict)
    return out.when((size == 0) & ~close, "empty body").when((size > 0) & F.coalesce(r["content_type"] == "", F.lit(True)), "no content type")


def closes(header: Column | str, strict: bool = False) -> Column:
    """The closing header: exactly "true"; strict mode takes any case."""
    c = _col(header)
    return F.coalesce((F.lower(c) if strict else c) == "true", F.lit(False))


def query_values(query: Column | str, name: str) -> Column:
    """All values of a parameter in a query string, decoded, blanks kept, in order."""
    def decoded(x: Column) -> Column:
        return F.try_url_decode(x)

    pairs = F.filter(F.split(F.coalesce(_col(query), F.lit("")), "&"), lambda p: decoded(F.split_part(p, F.lit("="), F.lit(1))) == name)
    return F.transform(pairs, lambda p: F.coalesce(decoded(F.regexp_replace(p, "^[^=]*=?", "")), F.lit("")))


def location(scheme: Column | str, host: Column | str, server: Column | str, port: Column | str, path: Column | str) -> Column:
    """The absolute address of a new stream: by host header, else by server and port, defaults left out, else local."""
    s, h, v, p = _col(scheme), _col(host), _col(server), _col(port)
    usual = ((s == "http") & (p == 80)) | ((s == "https") & (p == 443))
    base = F.when(h != "", F.concat(s, F.lit("://"), h)).when(v.isNotNull() & usual, F.concat(s, F.lit("://"), v)).when(v.isNotNull(), F.concat(s, F.lit("://"), v, F.lit(":"), p.cast("string"))).otherwise("http://localhost:4437")
    return F.concat(base, _col(path))


def tail_or_start(offset: Column | str) -> Column:
    return F.coalesce(_col(offset), F.lit(START))
