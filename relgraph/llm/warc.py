"""WARC derivatives: a metadata and a plain-text conversion record for each response.

``derive`` makes both records from a response, linked to it by ``WARC-Refers-To``,
with the response's own headers and digests preserved. All of it is built-in
expressions; nothing is shuffled. ``responses`` makes response records of a table of
pages; ``read_warc`` reads them from WARC files and ``serialise`` writes any record's bytes.

Defined results: a null URL is kept as null; a null page counts as an empty body.
Record ids come from page id, URL and body, so a run again gives the same ids and
repeated rows repeated ids. Empty tables give empty results. Other columns are left out. A very long page is one
record like any other. Records that ``read_warc`` reads have no page id; a body is undone from its chunks and from gzip or
deflate, and read in the charset that its header names (UTF-8 if it names none, or one that isn't known).
"""

from __future__ import annotations

import codecs
import io
import re
import zlib
from collections.abc import Iterator
from html.entities import html5
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WARC_DATE = "2026-01-01T00:00:00Z"
_BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h1|h2|h3|h4|h5|h6|section|article|header|footer|nav|aside|main|title|body|blockquote|pre|form|option|dd|dt|hr"
_HIDDEN = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>"
#: The same with its sign in front: one thing to look for at each place of a page, not five.
_HIDDEN_AT_SIGN = "(?is)<(?:" + _HIDDEN.removeprefix("(?is)").replace("|<", "|").removeprefix("<") + ")"
_BLOCK = f"(?i)</?(?:{_BLOCKS})(?:[\\s/][^>]*)?>"
_TAG = "</?[A-Za-z!?][^>]*>"
#: Named references that end in a semicolon, those that pages have most first: a map is searched in its order.
_OFTEN = "amp nbsp quot lt gt copy middot apos mdash ndash rsquo lsquo ldquo rdquo hellip raquo laquo bull times reg trade eacute egrave agrave uuml ouml auml szlig".split()
_NAMED = {k: " " if k == "nbsp" else html5[f"{k};"] for k in [*_OFTEN, *sorted(n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in _OFTEN)]}
_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_HREF = "(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
RESPONSE_COLUMNS = ["page_id", "record_id", "target_uri", "warc_date", "warc_headers", "http_headers", "payload_digest", "block_digest", "body"]


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    """``sha1:`` and the digest in base 32, as WARC writes it."""
    h = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, i, n), 16, 32), n * 4 // 5, "0") for i, n in ((1, 15), (16, 15), (31, 10))]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"))


def plain_text(html: Column) -> Column:
    """Visible text: hidden elements and tags go, block elements end lines, character references (named, decimal, hexadecimal; with their semicolon) are decoded, once."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _HIDDEN_AT_SIGN, ""), _BLOCK, "\n"), _TAG, "")  # to be named once: a lambda's text isn't shared
    names = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    code = lambda n: F.when(n.rlike("^#[0-9]"), F.substring(n, 2, 7).cast("int")).when(n.rlike("^#[xX]"), F.conv(F.substring(n, 3, 6), 16, 10).cast("int"))
    valid = lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
    sign = lambda n: F.when(F.substring(n, 1, 1) == "#", F.when(valid(code(n)), F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32"))).when(n != "", names[n])
    pieces = F.transform(F.split(t, "&"), lambda x: F.struct(x.alias("x"), F.regexp_extract(x, _REFERENCE, 1).alias("n")))  # a reference is looked for once
    piece = lambda x, n: F.coalesce(F.concat(sign(n), x.substr(F.length(n) + 2, F.length(x))), F.concat(F.lit("&"), x))
    decoded = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p["x"]).otherwise(piece(p["x"], p["n"]))), "")
    lines = F.transform(F.split(F.regexp_replace(decoded, "[ \t\f\r ]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = WARC_DATE) -> DataFrame:
    """Response records (columns ``RESPONSE_COLUMNS``) of pages that come without their WARC headers."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).alias("body"))
    p = p.withColumn("http_headers", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n")))
    p = p.withColumns({"payload_digest": _digest(F.col("body")), "block_digest": _digest(F.concat("http_headers", "body")), "warc_date": F.lit(date)})
    p = p.withColumn("record_id", _uuid(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("target_uri", F.lit("")), F.col("payload_digest")))
    lines = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("warc_date")), ("WARC-Target-URI", F.coalesce("target_uri", F.lit(""))), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.lit("application/http; msgtype=response"))]
    p = p.withColumn("warc_headers", F.concat(*(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in lines)))
    return p.select(*RESPONSE_COLUMNS)


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` (a JSON envelope) and ``conversion`` (plain text)."""
    r = records.select(*RESPONSE_COLUMNS).withColumns({c: F.coalesce(c, F.lit("")) for c in ("body", "http_headers", "warc_headers")})
    r = r.withColumn("text", plain_text(F.col("body")))
    title = F.trim(F.regexp_extract("body", "(?is)<title[^>]*>(.*?)</title", 1))
    r = r.withColumn(
        "envelope",
        F.to_json(
            F.struct(
                F.coalesce("record_id", F.lit("")).alias("record_id"),
                F.coalesce("target_uri", F.lit("")).alias("target_uri"),
                F.col("warc_headers"),
                F.col("http_headers"),
                F.coalesce("payload_digest", F.lit("")).alias("payload_digest"),
                F.coalesce("block_digest", F.lit("")).alias("block_digest"),
                F.octet_length("body").alias("body_bytes"),
                title.alias("title"),
                F.transform(F.regexp_extract_all("body", F.lit(_HREF), 1), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")).alias("links"),
            )
        ),
    )
    record = lambda kind, mime, payload: F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), F.col(payload).alias("payload"))
    both = r.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", "block_digest", "warc_headers", "http_headers", F.explode(F.array(record("metadata", "application/json", "envelope"), record("conversion", "text/plain", "text"))).alias("d"))
    return both.select(
        "page_id",
        "d.warc_type",
        _uuid(F.col("d.warc_type"), F.coalesce("record_id", F.lit(""))).alias("warc_record_id"),
        F.col("record_id").alias("warc_refers_to"),
        F.col("target_uri").alias("warc_target_uri"),
        "warc_date",
        "d.content_type",
        F.octet_length("d.payload").alias("content_length"),
        _digest(F.col("d.payload")).alias("warc_block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"),
        F.col("warc_headers").alias("source_warc_headers"),
        F.col("http_headers").alias("source_http_headers"),
        "d.payload",
    )


def serialise(row: dict) -> bytes:
    """Bytes of a derived record, in WARC/1.1."""
    body = (row["payload"] or "").encode()
    head = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["warc_record_id"]), ("WARC-Refers-To", row["warc_refers_to"]), ("WARC-Target-URI", row["warc_target_uri"]), ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["warc_block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"


def _opened(source: object, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file by pieces; gzip members are opened one after the other, a broken one ends the file."""
    data = source.read(size)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(size)
        return
    member = zlib.decompressobj(wbits=31)
    while data:
        try:
            out = member.decompress(data, size)
        except zlib.error:
            return
        if out:
            yield out
        if member.eof:
            data = member.unused_data.lstrip(b"\0") or source.read(size)
            member = zlib.decompressobj(wbits=31)
        else:
            data = member.unconsumed_tail or source.read(size)


class _Window:
    """A moving piece of a stream, as long as a record needs it."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def find(self, mark: bytes) -> int:
        """Where ``mark`` is next, from the present place; -1 if it isn't."""
        begun = 0
        while (at := self.held.find(mark, self.at + begun)) < 0:
            begun = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return -1
        return at

    def take(self, size: int) -> bytes | None:
        while len(self.held) - self.at < size:
            if not self.more():
                return None
        out = bytes(self.held[self.at : self.at + size])
        self.at += size
        return out


def parse(source: bytes | object) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """``(headers, raw header lines, block)`` of each record of a file or its bytes, holding one
    record at a time; gzip members are opened; a broken end is left out."""
    window = _Window(_opened(io.BytesIO(source) if isinstance(source, bytes) else source))
    while (at := window.find(b"WARC/")) >= 0:
        window.at = at
        stop = window.find(b"\r\n\r\n")
        if stop < 0:
            return
        head = window.take(stop + 4 - window.at)
        lines = head[:-4].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not re.fullmatch("[0-9]+", headers.get("content-length", "")):
            window.at -= len(head) - 5
            continue
        block = window.take(int(headers["content-length"]))
        if block is None:
            return
        yield headers, "".join(f"{x}\r\n" for x in lines if not x.lower().startswith("content-length:")), block


def unchunked(body: bytes) -> bytes:
    """A body without its chunk sizes; what follows a broken one is left out."""
    out, at = [], 0
    while (stop := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:stop].partition(b";")[0].strip(), 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 4 + size
    return b"".join(out)


def _inflated(body: bytes, kind: str) -> bytes:
    for bits in (31,) if kind != "deflate" else (15, -15):
        try:
            return zlib.decompressobj(wbits=bits).decompress(body)
        except zlib.error:
            continue
    return b""


def body_text(head: str, body: bytes) -> str:
    """Text of an HTTP body by its header lines."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    if (kind := fields.get("content-encoding", "").lower().removeprefix("x-")) in ("gzip", "deflate"):
        body = _inflated(body, kind)
    named = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", fields.get("content-type", ""), re.I)
    try:
        charset = codecs.lookup(named[1] if named else "utf-8").name
        return body.decode(charset, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzip, one file to a task at most; of a file a record is held at a time.

    A local or mounted path (``file:`` or none) is opened by the task, so a file may be of any size; what
    Spark alone can open comes as ``binaryFile``, of 2 GB at most."""
    columns = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in RESPONSE_COLUMNS[1:])])
    whole = re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", path, re.I)

    def rows(source: object) -> Iterator[dict]:
        for headers, raw, block in parse(source):
            if headers.get("warc-type") == "response":
                head, sep, body = block.partition(b"\r\n\r\n")
                http, get = (head + sep).decode("utf-8", "replace"), headers.get
                yield {"page_id": None, "record_id": get("warc-record-id"), "target_uri": get("warc-target-uri"), "warc_date": get("warc-date"), "warc_headers": raw, "http_headers": http, "payload_digest": get("warc-payload-digest"), "block_digest": get("warc-block-digest"), "body": body_text(http, body)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0).to_pylist():
                held, size = [], 0
                with io.BytesIO(item) if whole else open(unquote(urlsplit(item).path), "rb") as source:  # noqa: SIM115
                    for row in rows(source):
                        held.append(row)
                        size += len(row["body"])
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, columns)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, columns)

    files = spark.read.format("binaryFile").load(path).select("content" if whole else "path")
    files = files if whole else files.repartition(max(1, files.count()))  # files are long, their names short
    return files.mapInArrow(run, "page_id bigint, " + ", ".join(f"{c} string" for c in RESPONSE_COLUMNS[1:]))


def _sql_digest(x: str) -> str:
    quads = " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', (n // {32**k}) % 32 + 1, 1)" for k in (3, 2, 1, 0)).replace("n //", "('0x' || substr(sha1(@), i, 5))::INT //").replace("@", x)
    return f"'sha1:' || array_to_string(list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: {quads}), '')"


def _sql_uuid(x: str) -> str:
    h = f"md5({x})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


def _sql_text(x: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({x}, '{_HIDDEN}', '', 'g'), '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g')"
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    names = f"MAP([{', '.join(map(quote, _NAMED))}], [{', '.join(map(quote, _NAMED.values()))}])"
    name = f"regexp_extract(x, '{_REFERENCE}', 1)"
    code = f"CASE WHEN {name} LIKE '#x%' OR {name} LIKE '#X%' THEN try_cast('0x' || substr({name}, 3) AS INT) ELSE try_cast(substr({name}, 2) AS INT) END"
    sign = f"CASE WHEN {name} LIKE '#%' THEN CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) END WHEN {name} <> '' THEN {names}[{name}] END"
    t = f"array_to_string(list_transform(string_split({t}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce({sign} || regexp_replace(x, '^[^;]*;', ''), '&' || x) END), '')"
    return f"trim(regexp_replace(regexp_replace({t}, '[ \\t\\f\\r ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


ORACLE_SQL = f"""
WITH a AS (SELECT page_id, url, coalesce(html, '') AS body, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS http FROM pages),
b AS (SELECT *, {_sql_digest("body")} AS payload_digest, {_sql_digest("(http || body)")} AS block_digest FROM a),
c AS (SELECT *, {_sql_uuid("'response' || chr(31) || page_id || chr(31) || coalesce(url, '') || chr(31) || payload_digest")} AS record_id FROM b),
d AS (SELECT *, array_to_string(list_transform([['WARC-Type', 'response'], ['WARC-Record-ID', record_id], ['WARC-Date', '{WARC_DATE}'], ['WARC-Target-URI', coalesce(url, '')], ['WARC-Payload-Digest', payload_digest], ['WARC-Block-Digest', block_digest], ['Content-Type', 'application/http; msgtype=response']], lambda x: x[1] || ': ' || x[2] || chr(13) || chr(10)), '') AS warc FROM c),
e AS (SELECT *, to_json({{record_id: record_id, target_uri: coalesce(url, ''), warc_headers: warc, http_headers: http, payload_digest: payload_digest, block_digest: block_digest, body_bytes: strlen(body),
    title: trim(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)), links: list_transform(regexp_extract_all(body, '{_HREF.replace("'", "''")}', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g'))}})::VARCHAR AS envelope, {_sql_text("body")} AS text FROM d),
f AS (SELECT *, 'metadata' AS warc_type, 'application/json' AS content_type, envelope AS payload FROM e UNION ALL SELECT *, 'conversion', 'text/plain', text FROM e)
SELECT page_id, warc_type, {_sql_uuid("warc_type || chr(31) || record_id")} AS warc_record_id, record_id AS warc_refers_to, url AS warc_target_uri, '{WARC_DATE}' AS warc_date, content_type,
  strlen(payload)::INT AS content_length, {_sql_digest("payload")} AS warc_block_digest, payload_digest AS source_payload_digest, block_digest AS source_block_digest, warc AS source_warc_headers, http AS source_http_headers, payload
FROM f
"""
