"""WARC derivatives: linked metadata and plain-text conversion records from response records.

A record is a row: type, id, the ids and addresses it refers to, date, content type, its named headers,
digests and block. ``derive`` makes of each response one ``metadata`` record (``application/warc-fields``:
title, language, charset, outlinks, and the source's HTTP headers and digests) and one ``conversion``
record (``text/plain``). Both name the response by ``WARC-Refers-To`` with its address and date; the
conversion also links to the metadata record as concurrent. Ids are UUIDs (version 5) of the response's
id and the record's type, so a rerun gives the same records. Digests are ``sha1:`` with base 32.

``serialize`` gives a record's bytes, ``parse_records`` reads records from WARC bytes, plain or gzipped
a record at a time; ``read_warcs`` applies it to files. All work is per record, without a shuffle.

Edge cases: a null block is empty; a response without an HTTP head is all payload; null addresses leave
their headers out; a response without a date gives records dated ``NO_DATE``, as the format demands one;
charsets that are unknown or no text encodings fall back to UTF-8 with replacement; a ``<`` behind the last
``>`` begins no tag; records that are no responses are passed over; repeated rows are derived alike; an
empty table gives no records. Of damaged WARC bytes all whole records are read: a header without a length,
a cut record or a gzip member that can't be inflated is passed over, and reading goes on at the next
``WARC/`` line or gzip member. All patterns are linear in a page's length.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sparkio import bound_batches

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
CRLF = b"\r\n"
GZIP = b"\x1f\x8b"
SCHEMA = T.StructType([
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("warc_date", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("block_digest", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("block", T.BinaryType()),
])

NO_DATE = "1970-01-01T00:00:00Z"
#: how much of a payload is searched for a ``<meta>`` charset; the HTML standard asks for 1024 bytes
CHARSET_BYTES = 4096
#: longer record headers are taken for damage
HEADER_BYTES = 1 << 16
#: Python's encodings that are no charsets of documents
_NO_CHARSETS = frozenset(("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "unicode-escape", "raw-unicode-escape"))

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[!/?]?([A-Za-z][A-Za-z0-9]*)[^>]*>")
_BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_LINKS = frozenset(("a", "img", "link", "script", "iframe"))
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_ADDRESS = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def derived_id(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, kind + ' ' + source_id)}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(CRLF + CRLF)
    status, *rest = head.decode("utf-8", "replace").split("\r\n")
    return status, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in rest)], payload


def charset_of(headers: list[tuple[str, str]], payload: bytes) -> str:
    found = next((m[1] for n, v in headers if n.lower() == "content-type" and (m := re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", v, re.I))), None)
    if not found and (m := _META_CHARSET.search(payload[:CHARSET_BYTES])):
        found = m[1].decode()
    try:
        b"a".decode(found or "utf-8")
    except (LookupError, UnicodeError):
        found = None
    return "utf-8" if not found or codecs.lookup(found).name in _NO_CHARSETS else found.lower()


def decoded(data: bytes, charset: str) -> tuple[str, str]:
    """The text, and the charset that gave it: UTF-8 where the named one can't."""
    try:
        return data.decode(charset, "replace"), charset
    except UnicodeError:
        return data.decode("utf-8", "replace"), "utf-8"


def tags(html: str) -> Iterator[re.Match]:
    """The tags of a page, from left to right. Behind the last ``>`` nothing can be one, so every search ends at once."""
    return _TAG.finditer(html, 0, html.rfind(">") + 1)


def plain_text(html: str) -> str:
    """Visible text: a line for each block, spaces collapsed, entities resolved, empty lines left out."""
    html = _DROPPED.sub(" ", html)
    out, at = [], 0
    for m in tags(html):
        out += [html[at : m.start()], "\n" * (m[1].lower() in _BREAKS)]
        at = m.end()
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out) + html[at:]).split("\n"))
    return "\n".join(x for x in lines if x)


def described(html: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language and outlinks (address, tag and attribute) of a page, from one pass over its tags."""
    title = lang = None
    links, last = [], html.lower().rfind("</title")
    for m in tags(html):
        name = m[1].lower()
        if name in _LINKS and html[m.start() + 1] == m[1][0] and (found := _ADDRESS.search(m[0])):
            links.append(f"{entities.unescape(found[2] or found[3] or found[4] or '')} {name}/{found[1].lower()}")
        elif name == "html" and lang is None and (found := _LANG.search(m[0])):
            lang = found[1]
        elif name == "title" and title is None and html[m.start() + 1] != "/" and last >= m.end():
            end = re.compile(r"</title\s*>", re.I).search(html, m.end())
            title = " ".join(entities.unescape(html[m.end() : end.start()]).split()) if end else None
            last = last if end else -1
    return title, lang, links


def _one_line(value: str) -> str:
    """A header's or field's value: line breaks would begin another one."""
    return " ".join(value.split()) if "\n" in value or "\r" in value else value


def derive_record(r: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block = r["block"] or b""
    status, http, payload = split_http(block)
    charset = charset_of(http, payload)
    html, charset = decoded(payload, charset)
    title, lang, links = described(html)
    source_id = r["record_id"] or ""
    source = {k.lower(): v for k, v in ((h["name"], h["value"]) for h in r["headers"] or ())}
    payload_digest = r["payload_digest"] or digest(payload)
    fields = [("title", title), ("language", lang), ("charset", charset), ("source-block-digest", r["block_digest"] or digest(block)), ("source-payload-digest", payload_digest), ("source-status", status or None)]
    fields += [(f"source-header-{n}", v) for n, v in http]
    fields += [("outlink", x) for x in links]
    date = r["warc_date"] or NO_DATE
    out = []
    for kind, content_type, data in (("metadata", "application/warc-fields", "".join(f"{n}: {_one_line(v)}\r\n" for n, v in fields if v is not None).encode("utf-8", "replace")), ("conversion", "text/plain; charset=UTF-8", plain_text(html).encode("utf-8", "replace"))):
        own = derived_id(source_id, kind)
        named = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id or None), ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["warc_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", date), ("WARC-Warcinfo-ID", source.get("warc-warcinfo-id")), ("WARC-Concurrent-To", derived_id(source_id, "metadata") if kind == "conversion" else None), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        headers = [{"name": n, "value": _one_line(v)} for n, v in named if v is not None]
        out.append({"warc_type": kind, "record_id": own, "refers_to": source_id or None, "target_uri": r["target_uri"], "warc_date": date, "content_type": content_type, "headers": headers, "block_digest": digest(data), "payload_digest": payload_digest, "block": data})
    return out


def _arrow_schema() -> pa.Schema:
    kinds = {T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.schema([pa.field(f.name, kinds.get(f.dataType, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))) for f in SCHEMA])


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two records for each response; the columns ``keep`` of the response go along."""
    bound_batches(responses.sparkSession)
    keep = list(keep or ())
    source = responses.where("warc_type = 'response'").select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *SCHEMA.names)
    schema = T.StructType([T.StructField(f"k{i}", responses.schema[c].dataType) for i, c in enumerate(keep)] + SCHEMA.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [x for r in part.select(SCHEMA.names).to_pylist() for x in derive_record(r)]
                twice = pa.array([i // 2 for i in range(len(rows))], pa.int64())
                made = pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(twice) for i in range(len(keep))), *made.columns], names=schema.names)

    return source.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *SCHEMA.names)


def pages_as_responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html), with an HTTP head and digests; ``page_id`` stays as the first column. The pages name no time of capture; ``date`` stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = (html or "").encode()
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    own = derived_id(f"{page} {url or ''}", "response")
                    named = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                    rows.append({"warc_type": "response", "record_id": own, "refers_to": None, "target_uri": url, "warc_date": date, "content_type": named[6][1], "headers": [{"name": n, "value": v} for n, v in named if v is not None], "block_digest": digest(block), "payload_digest": digest(payload), "block": block})
                yield pa.RecordBatch.from_arrays([part.column(0), *pa.RecordBatch.from_pylist(rows, schema=_arrow_schema()).columns], names=["page_id", *SCHEMA.names])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, T.StructType([T.StructField("page_id", T.LongType()), *SCHEMA.fields]))


def serialize(r: dict, compress: bool = False) -> bytes:
    """The bytes of a record; gzipped as a member of its own if wanted."""
    head = b"WARC/1.1\r\n" + b"".join(f"{h['name']}: {h['value']}\r\n".encode() for h in r["headers"])
    out = head + CRLF + (r["block"] or b"") + CRLF + CRLF
    return gzip.compress(out, mtime=0) if compress else out


def _chunks(data: bytes) -> Iterator[bytes]:
    """The bytes as they are, or each gzip member inflated (as crawlers write them, one a record); damaged ones up to their damage."""
    if data[:2] != GZIP:
        yield data
        return
    at = 0
    while at >= 0:
        member, part = zlib.decompressobj(31), data[at:] if at else data
        try:
            yield member.decompress(part)
            at = len(data) - len(member.unused_data) if member.eof else -1
        except zlib.error:
            yield from _salvaged(part)
            at += 2
        at = data.find(GZIP, at) if 0 <= at < len(data) else -1


def _salvaged(part: bytes) -> Iterator[bytes]:
    """What a damaged member still gives."""
    member, step = zlib.decompressobj(31), 1 << 12
    try:
        for at in range(0, len(part), step):
            yield member.decompress(part[at : at + step])
    except zlib.error:
        return


def _header(data: bytes, end: int) -> tuple[list[tuple[str, str]], int | None]:
    """The named fields before ``end``, and the block's length, if they tell it."""
    pairs = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in data[:end].decode("utf-8", "replace").split("\r\n")[1:])]
    size = next((v for n, v in pairs if n.lower() == "content-length"), "")
    return pairs, int(size) if size.isascii() and size.isdigit() else None


def _next_record(data: bytes, at: int) -> int:
    """Where the next line begins that could open a record; -1 if none does."""
    if data.startswith(b"WARC/", at):
        return at
    found = data.find(b"\nWARC/", at)
    return found + 1 if found >= 0 else -1


def parse_records(data: bytes) -> Iterator[dict]:
    """The whole records of WARC bytes; at most one gzip member and one record are held inflated."""
    held, members = b"", data[:2] == GZIP
    for chunk in _chunks(data):
        held = chunk if not held or chunk.startswith(b"WARC/") else held + chunk  # what a new record's member cuts short is lost
        at = 0
        while (at := _next_record(held, at)) >= 0:
            end = held.find(CRLF + CRLF, at)
            if end < 0:
                break
            pairs, size = _header(held[at:end], end - at) if end - at <= HEADER_BYTES else ([], None)
            past = end + 4 + (size or 0)
            # behind a whole block comes a line break, or nothing
            if size is None or past > len(held) or not (past == len(held) or held.startswith(CRLF, past)):
                if members and size is not None and past > len(held):
                    break  # the next member may hold the rest
                at += 5
                continue
            get = {n.lower(): v for n, v in pairs}.get
            yield {"warc_type": get("warc-type"), "record_id": get("warc-record-id"), "refers_to": get("warc-refers-to"), "target_uri": get("warc-target-uri"), "warc_date": get("warc-date"), "content_type": get("content-type"), "headers": [{"name": n, "value": v} for n, v in pairs], "block_digest": get("warc-block-digest"), "payload_digest": get("warc-payload-digest"), "block": held[end + 4 : past]}
            at = past
        held = held[at:] if at >= 0 else b""


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files, plain or gzipped; a file is one task's, so keep files to a GB as crawlers do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for r in parse_records(content.as_py()):
                    rows.append(r)
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
