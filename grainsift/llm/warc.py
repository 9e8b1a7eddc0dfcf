"""WARC derivatives: metadata and plain-text conversion records from responses."""

from __future__ import annotations

import gzip
import html.entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm._common import keep_columns, prepare, table

CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GZIP = b"\x1f\x8b\x08"
_FEED = 1 << 16

# --- records as bytes ------------------------------------------------------


def _members(data: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of a file, or the file itself. Of a damaged member
    what could be unpacked comes out, and reading goes on with the next one."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, out, place = zlib.decompressobj(31), [], at
        try:
            while not member.eof and place < len(data):
                out.append(member.decompress(view[place : place + _FEED]))
                place += _FEED
        except zlib.error:
            place = None
        yield b"".join(out)
        end = min(place, len(data)) - len(member.unused_data) if place is not None and member.eof else at + 3
        at = data.find(_GZIP, end)


def _record(plain: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record that begins here and where it ends; None if it isn't a whole one."""
    end = plain.find(b"\r\n\r\n", at)
    if end < 0 or plain[at : at + 5] != b"WARC/":
        return None
    headers: dict[str, str] = {}
    name = ""
    for line in plain[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()
    length = headers.get("content-length", "0") or "0"
    if not (length.isascii() and length.isdigit()) or end + 4 + int(length) > len(plain):
        return None
    stop = end + 4 + int(length)
    return headers, plain[end + 4 : stop], stop


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case; the last of a repeated one) and block of every
    record; gzip members are unpacked. A record that is cut short, damaged or has no
    valid length is passed over, and reading goes on with the next one."""
    for plain in _members(data):
        at = 0
        while 0 <= at < len(plain):
            while plain[at : at + 2] == b"\r\n":
                at += 2
            found = _record(plain, at)
            if found is None:
                at = plain.find(b"WARC/1.", at + 1)
                continue
            yield found[0], found[1]
            at = found[2]


def write_record(headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def _unchunked(body: bytes) -> bytes:
    """The body without its transfer chunks; as it is where they aren't whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;.*)?", body[at:end]) if end >= 0 else None
        if size is None:
            return b"".join(out) if out and at >= len(body) else body
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def payload(head: str, body: bytes) -> str:
    """The text of an HTTP message: chunks joined, gzip and deflate undone, read in
    the character set of its header or, without one, of its meta tag, else as UTF-8;
    what doesn't fit that is read as Windows-1252. Unknown encodings are left as
    they are."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    coding = fields.get("content-encoding", "").lower()
    for wrap in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            body = zlib.decompressobj(wrap).decompress(body)
            break
        except zlib.error:
            continue
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I)
    named = named or re.search(r"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", body[:2048].decode("latin-1"), re.I)
    for name in ([named[1]] if named else []) + ["utf-8"]:
        try:
            text = body.decode({"iso-8859-1": "cp1252", "latin1": "cp1252"}.get(name.lower(), name))
            return text if isinstance(text, str) else body.decode("cp1252", "replace")
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("cp1252", "replace")


RESPONSES = "record_id string, target_uri string, date string, block_digest string, payload_digest string, http_headers string, html string"
READ_BYTES = 8 << 20


def read_responses(files: DataFrame) -> DataFrame:
    """Response records of WARC files given as ``content`` (binary), a file a row.
    Bodies are read by ``payload``; other record types are passed over, damaged
    records too, and files that are null, empty or no WARC give nothing. Repeated
    files give repeated records. Rows leave some megabytes at a time."""
    names = [f.split()[0] for f in RESPONSES.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for value in batch.column(0):
                for h, block in parse_records(value.as_py() or b""):
                    if h.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = head.decode("latin-1")
                        rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-block-digest"), h.get("warc-payload-digest"), http, payload(http, body)))
                        size += len(block)
                        if size > READ_BYTES:
                            yield made(rows)
                            rows, size = [], 0
            yield made(rows)

    prepare(files.sparkSession)
    return keep_columns(files, "content").mapInArrow(run, RESPONSES)


def to_records(derived: DataFrame) -> DataFrame:
    """The rows of ``derive`` as WARC records, ``content`` (binary): a gzip member a
    row, so that any number of them one behind the other is a file. Null fields are
    left out; line ends inside a field become blanks, so none can be forged."""
    fields = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Refers-To-Digest", "source_digest"), ("Content-Type", "content_type"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                headers = {name: re.sub(r"\s*[\r\n]+\s*", " ", row[c]) for name, c in fields if row[c] is not None}
                out.append(write_record(headers, (row["block"] or "").encode()))
            yield pa.record_batch([pa.array(out, pa.binary())], ["content"])

    prepare(derived.sparkSession)
    return keep_columns(derived, *[c for _, c in fields], "block").mapInArrow(run, "content binary")


# --- derivatives -----------------------------------------------------------

# patterns that Java and RE2 read alike; all begin with a plain sign, which is found fast
DROP = r"(?is)<(?:script(?:[\s/][^>]*)?>.*?</script[^>]*>|style(?:[\s/][^>]*)?>.*?</style[^>]*>|!--.*?-->|head(?:\s[^>]*)?>.*?</head\s*>)"
BLOCKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|nav|article|section|header|footer|aside|main|blockquote|pre|title|form)(?:[ /][^>]*)?>"
TAGS = r"</?[a-zA-Z!][^>]*>"
# of the SQL
BLANKS = r"[ \t\r]{2,}|[\t\r]"
BREAKS = r" ?\n[ \n]*"
ENDS = r"^[ \n]+|[ \n]+$"
TITLE = r"(?is)<title[^>]*>([^<]*)</title"
LANGUAGE = r"(?i)<html[^>]* lang=[\"']?([a-zA-Z-]+)"
LINK = r"(?i)<a [^>]*href=[\"']([^\"']*)[\"']"
LINES = "[\r\n]+"

# character references: all named ones that end in a semicolon, and numbers
_FREQUENT = "amp lt gt quot nbsp copy middot apos reg trade hellip mdash ndash rsquo lsquo rdquo ldquo bull laquo raquo eacute egrave agrave ccedil uuml ouml auml szlig ntilde oacute euro deg times".split()
_NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")} | {"nbsp": " "}
ENTITIES = {k: _NAMED[k] for k in _FREQUENT} | _NAMED  # maps are searched from the front
REFERENCE = r"^(#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[a-zA-Z][a-zA-Z0-9]{1,31});"
#: numbers 128 to 159 name the characters of Windows-1252
_C1 = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]
_LOST = "\ufffd"


def _character(code: Column) -> Column:
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(wrong, _LOST).when(code.between(128, 159), F.get(F.array(*[F.lit(c) for c in _C1]), (code - 128).cast("int"))).otherwise(plain)


def unescape(text: Column) -> Column:
    """Character references resolved, once; unknown ones stay."""
    known = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # folded to a literal

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).cast("long")
        value = F.when(name.startswith("#"), _character(number)).when(name != "", F.try_element_at(known, name))
        return F.coalesce(F.concat(value, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    parts = F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(one(p)))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def plain_text(page: Column) -> Column:
    """Visible text: one line per block, blanks folded, references resolved once."""
    out = F.regexp_replace(page, DROP, "")
    out = F.regexp_replace(F.regexp_replace(out, BLOCKS, "\n"), TAGS, "")
    # each step is bound once: its value is used several times in the next
    for step in (unescape, lambda x: F.when(x.contains("\t") | x.contains("\r"), F.translate(x, "\t\r", "  ")).otherwise(x), _folded):
        out = F.get(F.transform(F.array(out), step), F.lit(0))
    return out


def _folded(text: Column) -> Column:
    """Single blanks, lines without blanks around them, no empty lines, of a text
    without tabs. The same as the patterns of the SQL, which take several times as long."""
    single = F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    return F.array_join(F.filter(F.transform(F.split(single, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def digest(block: Column) -> Column:
    """``sha1:`` and the base-32 form of the SHA-1."""
    return F.concat(F.lit("sha1:"), _base32(F.sha1(block)))


def _base32(hexed: Column) -> Column:
    # ten hexadecimal digits, 40 bits, are eight letters
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _urn(text: Column) -> Column:
    h = F.md5(text)
    return F.when(text.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")))


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` (title, language, out-links, source
    digest and headers, as application/warc-fields) and ``conversion`` (plain text).

    Columns: ``record_id, warc_type, refers_to, concurrent_to, target_uri, date,
    content_type, source_digest, source_payload_digest, source_headers, block_digest,
    content_length, block``. ``refers_to`` is the response's id; the two name each other in
    ``concurrent_to``. Ids come from the response's id and type, so a repeated run
    gives the same ones; repeated responses give repeated records. The response's
    digests and HTTP headers are kept as they were; in the metadata block line ends
    inside a field are blanks or dropped (links), so a page can't forge fields. A null or empty page gives an
    empty conversion; other null fields stay null, a null record id gives null ids
    on all links and a row nonetheless. An empty table stays empty. One scan, no
    shuffle, no Python.
    """
    names = [f.split()[0] for f in RESPONSES.split(", ")]
    src = keep_columns(responses, *names)
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: unescape(F.translate(x, "\t\r\n", ""))))
    title = F.regexp_replace(unescape(F.regexp_extract(html, TITLE, 1)), "[ \t\r\n]+", " ")
    fields = F.concat(
        F.lit("title: "), title, F.lit(CRLF),
        F.lit("language: "), F.regexp_extract(html, LANGUAGE, 1), F.lit(CRLF),
        F.lit("source-digest: "), F.coalesce("block_digest", F.lit("")), F.lit(CRLF),
        F.lit("source-headers: "), F.regexp_replace(F.coalesce("http_headers", F.lit("")), LINES, "; "), F.lit(CRLF),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, LINES, " "), F.lit(CRLF))), ""),
    )
    kinds = [("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", plain_text(html))]
    made = F.array(*[F.struct(F.lit(k).alias("warc_type"), F.lit(c).alias("content_type"), b.alias("block")) for k, c, b in kinds])
    ident = {k: _urn(F.concat(F.col("record_id"), F.lit("/" + k))) for k, _, _ in kinds}
    rows = src.select("*", F.explode(made).alias("d")).select("*", "d.*")
    meta = F.col("warc_type") == "metadata"
    return rows.select(
        F.when(meta, ident["metadata"]).otherwise(ident["conversion"]).alias("record_id"),
        "warc_type",
        F.col("record_id").alias("refers_to"),
        F.when(meta, ident["conversion"]).otherwise(ident["metadata"]).alias("concurrent_to"),
        "target_uri",
        "date",
        "content_type",
        F.col("block_digest").alias("source_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("http_headers").alias("source_headers"),
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
DATE = "2024-01-01T00:00:00Z"


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages as response records: the id is made from page_id and url."""
    src = keep_columns(pages, "page_id", "url", "html")
    return src.select(
        _urn(F.concat_ws(" ", F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        digest(F.concat(F.lit(HTTP + CRLF + CRLF), F.coalesce("html", F.lit("")))).alias("block_digest"),
        digest(F.coalesce("html", F.lit(""))).alias("payload_digest"),
        F.lit(HTTP).alias("http_headers"),
        "html",
    )


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_of(table(spark, sf_dir, "pages")))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_urn(x: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_digest(x: str) -> str:
    letters = " || ".join(f"substr('{_BASE32}', (((('0x' || substr(sha1({x}), i, 5))::BIGINT >> {s}) & 31) + 1)::INT, 1)" for s in (15, 10, 5, 0))
    return f"'sha1:' || list_aggregate(list_transform(range(1, 37, 5), lambda i: {letters}), 'string_agg', '')"


def _sql_unescape(x: str) -> str:
    """With the names in column ``names`` and the characters 128 to 159 in ``c1``."""
    name = f"regexp_extract(part, {_q(REFERENCE)}, 1)"
    code = f"CASE WHEN {name}[2:2] IN ('x', 'X') THEN ('0x' || substr({name}, 3))::BIGINT ELSE substr({name}, 2)::BIGINT END"
    char = f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {code} BETWEEN 128 AND 159 THEN c1[({code}) - 127] ELSE chr(({code})::INT) END"
    value = f"CASE WHEN {name} = '' THEN NULL WHEN {name}[1:1] = '#' THEN {char} ELSE names[{name}] END"
    one = f"coalesce({value} || substr(part, length({name}) + 2), '&' || part)"
    return f"list_aggregate(list_transform(string_split({x}, '&'), lambda part, place: CASE WHEN place = 1 THEN part ELSE {one} END), 'string_agg', '')"


def _sql_text() -> str:
    out = f"regexp_replace(html, {_q(DROP)}, '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {_q(BLOCKS)}, chr(10), 'g'), {_q(TAGS)}, '', 'g')"
    out = _sql_unescape(out)
    out = f"regexp_replace(regexp_replace({out}, {_q(BLANKS)}, ' ', 'g'), {_q(BREAKS)}, chr(10), 'g')"
    return f"regexp_replace({out}, {_q(ENDS)}, '', 'g')"


_HTTP_SQL = _q(HTTP.replace(CRLF, "~~")).replace("~~", "' || chr(13) || chr(10) || '")
_END = "chr(13) || chr(10)"
_HREFS = f"list_transform(regexp_extract_all(html, {_q(LINK)}, 1), lambda href: {_sql_unescape("translate(href, chr(9) || chr(10) || chr(13), '')")})"
SQL = f"""
WITH known AS (SELECT MAP {{{", ".join(f"{_q(k)}: {_q(v)}" for k, v in sorted(ENTITIES.items()))}}} AS names, [{", ".join(_q(c) for c in _C1)}] AS c1),
responses AS (
  SELECT {_sql_urn("page_id || ' ' || url")} AS rid, url, html, {_sql_digest(f"{_HTTP_SQL} || {_END} || {_END} || html")} AS source_digest, {_sql_digest("html")} AS source_payload_digest,
    {_HREFS} AS links, {_sql_unescape(f"regexp_extract(html, {_q(TITLE)}, 1)")} AS title, {_sql_text()} AS body
  FROM pages, known),
blocks AS (
  SELECT *, 'metadata' AS warc_type, 'conversion' AS other, 'application/warc-fields' AS content_type,
    'title: ' || regexp_replace(title, '[ \t\r\n]+', ' ', 'g') || {_END} || 'language: ' || regexp_extract(html, {_q(LANGUAGE)}, 1) || {_END}
    || 'source-digest: ' || source_digest || {_END} || 'source-headers: ' || {_q(HTTP.replace(CRLF, "; "))} || {_END}
    || coalesce(list_aggregate(list_transform(list_filter(links, lambda x, i: list_position(links, x) = i), lambda x: 'outlink: ' || regexp_replace(x, '[\r\n]+', ' ', 'g') || {_END}), 'string_agg', ''), '') AS block
  FROM responses
  UNION ALL
  SELECT *, 'conversion', 'metadata', 'text/plain; charset=utf-8', body FROM responses)
SELECT {_sql_urn("rid || '/' || warc_type")} AS record_id, warc_type, rid AS refers_to, {_sql_urn("rid || '/' || other")} AS concurrent_to, url AS target_uri, '{DATE}' AS date,
  content_type, source_digest, source_payload_digest, {_HTTP_SQL} AS source_headers, {_sql_digest("block")} AS block_digest, strlen(block)::BIGINT AS content_length, block
FROM blocks
"""
