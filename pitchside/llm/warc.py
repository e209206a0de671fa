"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response gives a metadata record (its HTTP status and headers, and what the conversion found)
and, where its body is text, a conversion record with the plain text. Both name the response in
WARC-Refers-To, keep its target, date and payload digest, and carry a digest of their own block. The
metadata record also names its conversion in WARC-Concurrent-To. Identifiers are name-based, so a
task that runs again writes the same records.

Everything is row by row, without a shuffle. `read_records` splits uncompressed files of any version
1.x at record starts, so that a file is read by many tasks; only files with a record start inside a
record go through a shuffle, one task each. `write_records` writes records that can be read again.

Defined cases: a null block is empty; a block without an HTTP head is all body, with status 0. A null
target or date leaves its header out. Bodies that are no text, or cannot be decoded (unknown or broken
content encoding, a chunk without a size, over MOST_BYTES when inflated), have no conversion; bytes that are
wrong in their charset become U+FFFD, and a charset that is unknown or none of text is UTF-8. A null record_id is the empty
one. Repeated rows give equal records. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import written
from pitchside.llm.dom import parse

VERSION = "WARC/1.0"
#: A body that inflates to more bytes than this has no conversion (it would be a bomb, or no page).
MOST_BYTES = 256_000_000
#: Files are split at this text; it never overlaps itself. What follows it at a record start.
SPLIT, START = b"WARC/1.", re.compile(rb"[0-9]+\r\n")
RECORD = "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, concurrent_to string, content_type string, payload_digest string, block_digest string, block binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest"}
#: A page's own charset, anywhere before its body.
META = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.I)
BODY = re.compile(rb"<body\b|</head\b", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(names))}>"


def http_message(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers in their order, and the body as it was sent."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return 0, [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\S+ (\d{3})", first)
    fields = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines) if sep]
    return int(status.group(1)) if status else 0, fields, body


def _unchunked(body: bytes) -> bytes:
    """The chunks of a body. A size is hexadecimal digits alone (no sign, which would lead backwards), else ValueError."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            raise ValueError("no size of a chunk")
        size = int(size, 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _inflated(body: bytes, bits: int) -> bytes:
    """The inflated members of a body, one after another; ValueError past MOST_BYTES, before that much is held."""
    out, total = [], 0
    while body:
        one = zlib.decompressobj(bits)
        out.append(one.decompress(body, MOST_BYTES - total + 1))
        total += len(out[-1])
        if total > MOST_BYTES:
            raise ValueError("inflates to too much")
        if not one.eof:
            raise EOFError("ends early")
        body = one.unused_data if bits > 15 else b""
        if bits > 15 and not body.strip(b"\0"):  # gzip files may be padded
            break
    return b"".join(out)


def _charset(name: str) -> str:
    """The codec of a charset that a page names, UTF-8 where it is unknown or isn't one of text."""
    try:
        known = codecs.lookup(name)
    except (LookupError, ValueError):
        return "utf-8"
    return known.name if known._is_text_encoding and known.name not in ("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape") else "utf-8"


def decoded(fields: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The body without transfer and content encodings; None if they are unknown or broken, or give over MOST_BYTES."""
    of = {k.lower(): v.lower() for k, v in fields}
    try:
        if "chunked" in of.get("transfer-encoding", ""):
            body = _unchunked(body)
        coding = of.get("content-encoding", "identity")
        if coding in ("gzip", "x-gzip"):
            return _inflated(body, 31)
        if coding == "deflate":
            return _inflated(body, 15)
        return body if coding in ("identity", "") else None
    except (ValueError, OSError, EOFError, zlib.error):
        return None


def plain_text(kind: str, data: bytes) -> str | None:
    """The text of html and plain-text bodies, one line for each block of a page."""
    mime, _, rest = kind.partition(";")
    mime = mime.strip().lower()
    if mime and mime not in ("text/html", "application/xhtml+xml", "text/plain"):
        return None
    named = re.search(r"charset\s*=\s*\"?([\w:.-]+)", rest, re.I)
    body = BODY.search(data)
    found = META.search(data, 0, body.start() if body else len(data))
    charset = named.group(1) if named else found.group(1).decode() if found else "utf-8"
    try:
        text = data.decode(_charset(charset), "replace")
    except (UnicodeError, ValueError):  # a codec that doesn't know "replace"
        text = data.decode("utf-8", "replace")
    return text if mime == "text/plain" else "\n".join(t for _, t in parse(text)[1])


def derive(source: str, target: str | None, date: str | None, block: bytes, payload_digest: str | None) -> list[tuple]:
    """The derivative records (as RECORD) of one response."""
    status, fields, body = http_message(block)
    payload = payload_digest or digest(body)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    data = decoded(fields, body)
    text = None if data is None else plain_text(kind, data)
    out, conversion = [], None
    if text is not None:
        conversion = record_id(source, "conversion")
        raw = text.encode("utf-8", "replace")
        out.append((conversion, "conversion", target, date, source, None, "text/plain; charset=utf-8", payload, digest(raw), raw))
    lines = [("http-status", str(status)), *((f"http-header-{k.lower()}", v) for k, v in fields), ("source-payload-digest", payload), ("source-length", str(len(block)))]
    if text is not None:
        lines += [("text-characters", str(len(text))), ("text-digest", out[0][8])]
    raw = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    return [(record_id(source, "metadata"), "metadata", target, date, source, conversion, "application/warc-fields", payload, digest(raw), raw), *out]


def derivatives(responses: DataFrame) -> DataFrame:
    """RECORD rows for the responses among records (record_id, warc_type, target_uri, warc_date, payload_digest, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                source, target, date, payload, block = (batch.column(k)[i].as_py() for k in range(5))
                rows += derive(source or "", target, date, block or b"", payload)
            types = [pa.string()] * 9 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, types)], names=NAMES)

    only = responses.filter("warc_type = 'response'")
    return only.select("record_id", "target_uri", "warc_date", "payload_digest", F.col("block").cast("binary")).mapInArrow(run, RECORD)


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records; the identifier is named by id, url and payload digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                key, url, html = (batch.column(k)[i].as_py() for k in range(3))
                body = (html or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                payload = digest(body)
                rows.append((key, record_id(str(key), url or "", payload), "response", url, date, None, None, "application/http; msgtype=response", payload, digest(block), block))
            types = [pa.int64(), *[pa.string()] * 9, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 11, types)], names=["page_id", *NAMES])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id long, {RECORD}")


def serialised(records: DataFrame) -> DataFrame:
    """One column `record`: head and block of each record, without the two line ends after it."""
    head = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\r\n"))).otherwise("") for c, name in HEADERS.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    return records.select(F.concat(F.lit(f"{VERSION}\r\n"), *head, length).alias("head"), "block").select(F.concat(F.col("head").cast("binary"), F.col("block")).cast("string").alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    serialised(records).write.option("lineSep", "\r\n\r\n").text(path)


def _head(data: bytes) -> tuple[dict[str, str], int, int | None] | None:
    """Fields of a record whose version's last number comes first, where its block starts, and where it ends (None without a length)."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not START.match(data):
        return None
    pairs = [x.partition(":") for x in data[:end].decode("utf-8", "replace").split("\r\n")]
    of = {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}
    length = of.get("content-length", "")
    return of, end + 4, end + 4 + int(length) if length.isdecimal() else None


def _is_whole(data: bytes) -> bool:
    """A record with nothing but its two line ends after it."""
    head = _head(data)
    return head is not None and head[2] is not None and len(data) >= head[2] and not data[head[2] :].strip(b"\r\n")


def _record(data: bytes) -> tuple | None:
    head = _head(data)
    if head is None:
        return None
    row = {c: head[0].get(name.lower()) for c, name in HEADERS.items()}
    return (*(row[c] for c in NAMES[:-1]), data[head[1] : head[2]])


def _joined(pieces: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
    """Records from the pieces of files in their order: pieces follow until the head and Content-Length are reached."""
    of = buffer = need = None
    for path, data in pieces:
        if path != of and buffer is not None:
            yield bytes(buffer)  # cut off by the end of its file
            buffer = None
        of = path
        if buffer is None:
            if not START.match(data):
                continue  # before the first record, or after the end of one
            buffer, need = bytearray(data), None
        else:
            buffer += SPLIT + data
        if need is None and (head := _head(bytes(buffer))):
            need = head[1] if head[2] is None else head[2]
        if need is not None and len(buffer) >= need:
            yield bytes(buffer)
            buffer = None
    if buffer is not None:
        yield bytes(buffer)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of uncompressed files. Blocks end where Content-Length says, or at the next record start where there is none."""
    pieces = spark.read.option("lineSep", SPLIT.decode()).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("raw")
    )

    def odd_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = {p.as_py() for p, part, raw in zip(*batch.columns) if (data := raw.as_py() or b"") and not _is_whole(data) or not data and part.as_py()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(odd), pa.string())], names=["path"])

    def rows_of(records: Iterator[bytes]) -> pa.RecordBatch:
        rows = [row for row in map(_record, records) if row]
        types = [pa.string()] * 9 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, types)], names=NAMES)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_of(x.as_py() for x in batch.column(0))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = _joined((p.as_py(), raw.as_py() or b"") for batch in batches for p, raw in zip(*batch.columns))
        while some := list(islice(records, 100)):
            yield rows_of(some)

    odd = written(pieces.select("path", "part", "raw").mapInArrow(odd_paths, "path string").distinct(), "odd-files")
    plain = pieces.join(odd, "path", "left_anti").select("raw").mapInArrow(alone, RECORD)
    ordered = pieces.join(odd, "path", "left_semi").repartition("path").sortWithinPartitions("path", "part", "n")
    return plain.unionByName(ordered.select("path", "raw").mapInArrow(together, RECORD))
