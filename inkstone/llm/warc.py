"""Operator 9, WARC derivatives: every response record gives a linked metadata record and a plain-text conversion record.

A response is a WARC record whose block is an HTTP message. Its derivatives name it in ``WARC-Refers-To``, keep its target,
date and digests, and carry its own headers and HTTP headers, repeated ones too, in the metadata. Identifiers come from a
hash of what a record says, so a task that runs again, or runs twice, builds the same records. One pass, no shuffle.
``read_warc`` and ``derive`` do it for WARC files, a record at a time; ``build`` makes the responses of a table of pages.

Markup is read by one forward scan: a tag ends at the next ``>`` and what is hidden at its end tag, so that the time is in
proportion to the page whatever it holds.

Defined results: a null page is an empty body; a null URL is the target ``about:blank``; a null page id stays null.
Repeated rows give repeated records with the same identifiers. A body of any length is converted whole; a tag, comment or
hidden element that does not close runs to the end of the page. A body is decoded by the charset of its Content-Type, by
UTF-8 where that names none or an unknown one; bytes that do not decode become U+FFFD. A file that is damaged gives the
records before the damage and a row with an ``error``. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
SCHEMA = (
    "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, content_length bigint, block_digest string, payload_digest string, headers string, content string"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_HIDDEN = frozenset("noscript svg head".split())
_RAW = frozenset("script style template".split())
_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article nav header footer aside main blockquote pre title hr dl dt dd form figure".split())
_TAG = re.compile(r"<(?:!--|/?([a-zA-Z][^\s/<>]*)|[/!?])")
_TAGS = re.compile(r"<[/!?a-zA-Z][^<>]*>?")
_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW | {"title"}}
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_FAR = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s\"';]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*said: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(said).encode()).digest()[:16], version=5)}>"


def scan(page: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, name) of what a page consists of, in order: ``text``, ``tag`` and ``hidden``, the last for comments
    and for scripts, styles and templates with all they hold."""
    at, n = 0, len(page)
    while m := _TAG.search(page, at):
        lt = m.start()
        if lt > at:
            yield "text", at, lt, ""
        if m[0] == "<!--":
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            yield "hidden", lt, at, ""
            continue
        gt = page.find(">", m.end())
        at = n if gt < 0 else gt + 1
        name = (m[1] or "").lower()
        if name in _RAW and page[lt + 1] != "/":
            closed = _ENDS[name].search(page, at)
            at = closed.end() if closed else n
            yield "hidden", lt, at, name
        else:
            yield "tag", lt, at, name
    if at < n:
        yield "text", at, n, ""


def unescaped(text: str) -> str:
    """Character references replaced; a number that no character has is U+FFFD, however long it is."""
    return entities.unescape(_FAR.sub("\ufffd", text)) if "&" in text else text


def attribute(tag: str, name: str) -> str | None:
    """The first value of an attribute of a tag; none where it has no value."""
    start = _NAME.match(tag)
    for m in _ATTRIBUTE.finditer(tag, start.end() if start else 0):
        if m[1].lower() == name and m.lastindex > 1:
            return m[m.lastindex]
    return None


def lines_of(text: str) -> str:
    return _LINES.sub("\n", _SPACE.sub(" ", unescaped(text))).strip()


def read(page: str) -> tuple[str, dict]:
    """What a reader sees of a page, blocks on lines of their own and runs of space as one; and its title, language and
    links, those of its head too, in one pass."""
    out, inside = [], None  # the hidden element that the place is in
    title, lang, links, titled = None, None, [], 0
    for kind, a, b, name in scan(page):
        if kind == "text":
            if inside is None:
                out.append(page[a:b])
            continue
        if kind == "hidden":
            if inside is None:
                out.append(" ")
            continue
        closing = page[a + 1 : a + 2] == "/"
        if not closing and a >= titled:
            if name == "a":
                if (link := attribute(page[a:b], "href")) is not None:
                    links.append(unescaped(link))
            elif name == "title" and title is None:
                end = _ENDS["title"].search(page, b)
                titled = end.end() if end else len(page)
                title = " ".join(unescaped(_TAGS.sub("", page[b : end.start() if end else len(page)])).split())
            elif name == "html" and lang is None:
                lang = attribute(page[a:b], "lang")
        if name in _HIDDEN:
            if not closing and inside is None:
                inside = name
            elif closing and inside == name:
                inside = None
                out.append(" ")
        elif inside is None and name in _BLOCK:
            out.append("\n")
    return lines_of("".join(out)), {"title": title, "lang": lang, "links": links}


def serialise(headers: list[tuple[str, str]] | dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record."""
    pairs = headers.items() if isinstance(headers, dict) else headers
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines, repeated ones too; a line that begins with space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def value_of(pairs: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in pairs if k.lower() == name.lower()), None)


def records(stream: BinaryIO) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC stream, one in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC record ends within its headers")
            head.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        pairs = fields(head)
        size = int(value_of(pairs, "Content-Length") or -1)
        block = stream.read(size) if size >= 0 else b""
        if len(block) != size:
            raise ValueError("a WARC record is shorter than it says")
        yield pairs, block


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC file in memory."""
    return records(io.BytesIO(data))


def response(url: str | None, page: str | None, date: str = DATE) -> tuple[dict[str, str], bytes]:
    """The response record of a fetched page."""
    body = (page or "").encode()
    target = url or "about:blank"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", target, date, digest(block)),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": digest(body),
        "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return headers, block


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, fields(lines), body


def decoded(body: bytes, content_type: str | None) -> str:
    named = _CHARSET.search(content_type or "")
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # no such charset, or one that is none of text
        return body.decode("utf-8", "replace")


def derivatives(headers: list[tuple[str, str]] | dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response record."""
    pairs = list(headers.items()) if isinstance(headers, dict) else headers
    status, http_headers, body = http(block)
    page = decoded(body, value_of(http_headers, "Content-Type"))
    text, html = read(page)
    text = text.encode("utf-8", "replace")
    headers = {"WARC-Record-ID": "", "WARC-Target-URI": "about:blank", "WARC-Date": DATE, "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block)}
    headers |= {name: v for name in headers if (v := value_of(pairs, name)) is not None}
    source, target, date = headers["WARC-Record-ID"], headers["WARC-Target-URI"], headers["WARC-Date"]
    conversion_id = record_id("conversion", source, digest(text))
    said = {
        "envelope": {"warc-headers": pairs, "http-status": status, "http-headers": http_headers, "payload-digest": headers["WARC-Payload-Digest"], "block-digest": headers["WARC-Block-Digest"]},
        "conversion": {"record-id": conversion_id, "digest": digest(text), "length": len(text)},
        "html": html,
    }
    info = json.dumps(said, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")

    def made(kind: str, own_id: str, content_type: str, content: bytes) -> tuple[dict[str, str], bytes]:
        return {
            "WARC-Type": kind,
            "WARC-Record-ID": own_id,
            "WARC-Refers-To": source,
            "WARC-Date": date,
            "WARC-Target-URI": target,
            "WARC-Payload-Digest": headers["WARC-Payload-Digest"],
            "WARC-Block-Digest": digest(content),
            "Content-Type": content_type,
            "Content-Length": str(len(content)),
        }, content

    return [made("metadata", record_id("metadata", source, digest(info)), "application/json", info), made("conversion", conversion_id, "text/plain; charset=utf-8", text)]


def _rows(page_id: int | None, made: list[tuple[dict[str, str], bytes]]) -> Iterator[tuple]:
    for h, content in made:
        yield (
            (page_id, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["Content-Type"], len(content))
            + (h["WARC-Block-Digest"], h["WARC-Payload-Digest"], json.dumps(h, ensure_ascii=False), content.decode())
        )


def _batches(rows: Iterable[tuple], size: int = 256, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, or of fewer where their contents are large."""
    kinds = [pa.int64() if c in ("page_id", "content_length") else pa.string() for c in _NAMES]
    held, weight = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], _NAMES)
    for row in rows:
        held.append(row)
        weight += row[7]
        if len(held) >= size or weight >= most:
            yield made()
            held, weight = [], 0
    if held:
        yield made()


def build(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The derivative records of ``pages(page_id, url, html)``, two a page; ``headers`` is the record's as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                columns = (batch.column(c).slice(i, 256).to_pylist() for c in ("page_id", "url", "html"))
                yield from _batches(row for page_id, url, page in zip(*columns) for row in _rows(page_id, derivatives(*response(url, page, date))))

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, SCHEMA)


RECORDS = "path string, record bigint, headers array<struct<name: string, value: string>>, block binary, error string"


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """``RECORDS`` of all files under a folder named ``*.warc`` or ``*.warc.gz``. The listing reads no contents; each file is
    streamed by the task that has its name, so that its size does not matter, only that of a record."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").option("recursiveFileLookup", "true").load(root).select("path")
    listed = listed.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from pyarrow import fs

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), kind, pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], ["path", "record", "headers", "block", "error"])

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if uri.endswith(".gz") else raw, 1 << 20)
                    rows, weight, n = [], 0, 0
                    try:
                        for n, (pairs, block) in enumerate(records(stream), 1):
                            rows.append((uri, n - 1, [{"name": k, "value": v} for k, v in pairs], block, None))
                            weight += len(block)
                            if weight > 4 << 20:
                                yield batch_of(rows)
                                rows, weight = [], 0
                    except (ValueError, EOFError, gzip.BadGzipFile, zlib.error) as e:
                        rows.append((uri, n, None, None, f"{type(e).__name__}: {e}"))
                    if rows:
                        yield batch_of(rows)

    return listed.mapInArrow(run, RECORDS)


def derive(found: DataFrame) -> DataFrame:
    """The derivative records of the responses among ``found(headers, block)``, as ``RECORDS`` has them; ``page_id`` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = ((b["headers"], b["block"]) for i in range(batch.num_rows) for b in batch.slice(i, 1).to_pylist())
            yield from _batches(row for headers, block in each for row in _rows(None, derivatives([(h["name"], h["value"]) for h in headers], block)))

    is_response = F.exists("headers", lambda h: (F.lower(h["name"]) == "warc-type") & (F.lower(h["value"]) == "response"))
    return found.filter(is_response & F.col("block").isNotNull()).select("headers", "block").mapInArrow(run, SCHEMA)


def warc_files(records: DataFrame) -> DataFrame:
    """``part int, warc binary``: the records of ``build`` as compressed WARC files of about 64 MB, one member a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        held, size, part = [], 0, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["part", "warc"])

        for batch in batches:
            for headers, content in zip(batch.column("headers").to_pylist(), batch.column("content").to_pylist()):
                held.append(gzip.compress(serialise(json.loads(headers), content.encode()), mtime=0))
                size += len(held[-1])
                if size >= 64 << 20:
                    yield made()
                    held, size, part = [], 0, part + 1
        if held:
            yield made()

    return records.select("headers", "content").mapInArrow(run, "part int, warc binary")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark.read.parquet(f"{sf_dir}/pages.parquet"))
