"""WARC archives of pages: written in segments, read back by reassembling them.

Each page becomes one record. The payload sits in an HTTP message with chunked transfer
framing. A block of more than `SEGMENT_BYTES` is cut into a first record and continuation
records that name their origin, their number and, on the last, the total length. Of the
pages with equal payloads of at least `least_bytes`, the one with the largest `page_id`
holds the payload (response); the others refer to it (revisit) and hold headers only.

Reading parses every archive file in parallel. Whole records are decoded in place; only
segments are grouped by origin and put in order, their total length is checked, and the
chunk framing is decoded. A payload is spread over one group, never a source or a host.

Archives are written by Spark's text writer with the record end as line separator, so only
committed task attempts count, and any file system will do.

Defined results: a null html is an empty payload; a null url leaves its header out; repeated
rows of one page are all kept; a row with null `page_id` is a response unless a page with
an id has the same payload; other columns are ignored; an empty table gives no rows. A
record that is damaged or lacks a segment comes back with `intact` false and the payload's
fields null; its page and type are known as far as its headers are whole. A record is whole
if its length leads to a record end; behind one that is not, reading goes on at the next
record, so a file that is cut or overwritten costs the records that it hits and no others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.common import chunks, rows_batch, ship
from tideglass.operators.lookup import lookup_join
from tideglass.session import materialise, scratch_folder

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: A file's size is at most this times SEGMENT_BYTES, so a reader can take it whole.
RECORDS_PER_FILE = 1024
DATE = "2026-01-01T00:00:00Z"

_CRLF, _END = b"\r\n", "\r\n\r\n"
#: Where a record begins: behind the end of another, with a header.
_BEGIN = re.compile(rb"\r\n\r\n(?=WARC/\d\.\d\r\n[A-Za-z-]+:)")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _CRLF + _CRLF + block


def _chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        piece = payload[at : at + CHUNK_BYTES]
        parts += (f"{len(piece):x}\r\n".encode(), piece, _CRLF)
    return b"".join([*parts, b"0\r\n\r\n"])


def _dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.index(_CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if len(parts[-1]) != size or body[at + size : at + size + 2] != _CRLF:
            raise ValueError("broken chunk")
        at += size + 2


def page_records(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES
) -> Iterator[bytes]:
    """The records of one page, without their ends; `refers_to` makes it a revisit."""
    digest = payload_digest(payload)
    own, page = _record_id(page_id, digest), "" if page_id is None else str(page_id)
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", page),
    ]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)
        headers.append(("WARC-Target-URI", safe))
    if revisit:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", _record_id(refers_to, digest)))
        yield _record(headers, f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block += _chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(headers, block)
        return
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield _record([*headers, ("WARC-Segment-Number", "1")], pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"{own[:-1]}:{number}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", str(number)),
            ("X-Page-ID", page),
        ]
        if number == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(more, piece)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (lower-case names) and block of each record of an archive; no block if it is damaged."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:] if end < 0 else data[at:end]
        headers = {}
        for line in head.split(_CRLF)[1:]:
            name, colon, value = line.partition(b":")
            if colon:
                headers[name.decode(errors="replace").lower()] = value.decode(errors="replace").strip()
        size = _whole_number(headers.get("content-length"))
        if end >= 0 and size is not None and head.startswith(b"WARC/"):
            stop = end + 4 + size
            if data[stop : stop + 4] == b"\r\n\r\n":
                yield headers, data[end + 4 : stop]
                at = stop + 4
                continue
        yield headers, None
        following = _BEGIN.search(data, at)
        at = following.end() if following else len(data)


def _whole_number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def decode_block(kind: str, digest: str, block: bytes) -> tuple[int, str] | None:
    """Payload size and digest of a whole HTTP message; None if it does not hold together."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(_CRLF)[1:])}
    try:
        if kind == "revisit":
            return int(fields[b"content-length"]), digest
        payload = _dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except (ValueError, KeyError):
        return None
    found = payload_digest(payload)
    return (len(payload), found) if found == digest else None


def first_seen(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` with `refers_to`: the page that holds an equal payload, null for itself."""
    keyed = pages.withColumn("_sha", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "UTF-8"))))
    firsts = materialise(
        keyed.where(F.col("_sha").isNotNull())
        .groupBy("_sha")
        .agg(F.max("page_id").alias("_holder"), F.count(F.lit(1)).alias("_pages"))
        .where("_pages > 1")
    )
    # Payloads without a twin, and those too small, need no partner in the join.
    joined = lookup_join(keyed, firsts, ["_sha"], weight="_pages", spread="page_id")
    other = F.col("_holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_holder"))
    return joined.withColumn("refers_to", F.when(other, F.col("_holder"))).drop("_sha", "_holder")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> str:
    """Write the pages' records as archive files below `path`, a folder all executors share."""
    ship(pages.sparkSession)
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    schema = pa.schema([("record", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                records = []
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    records += page_records(page_id, url, html.encode(), refers_to, segment_bytes)
                yield rows_batch(schema, [records])

    (
        first_seen(plain, least_bytes)
        .mapInArrow(run, "record binary")
        # Bytes as they are: a cast from binary checks and changes nothing.
        .select(F.col("record").cast("string"))
        .write.option("lineSep", _END)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )
    return path


_PAGE = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
    ]
)
_PAGE_TYPE = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"
)


def _signed_number(text: str | None) -> int | None:
    number = _whole_number(text.removeprefix("-")) if text else None
    return -number if number is not None and text.startswith("-") else number


def _page_row(headers: dict[str, str], block: bytes | None) -> list:
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    found = None if block is None else decode_block(kind, digest, block)
    refers = headers.get("warc-refers-to")
    return [
        _signed_number(headers.get("x-page-id")),
        *(found or (None, None)),
        kind,
        _signed_number(refers.split(":")[2]) if refers and refers.count(":") > 2 else None,
        found is not None,
    ]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page whose records are in the archive files below `path`."""
    ship(spark)
    parsed_schema = pa.schema(
        [("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.string()), ("block", pa.binary())]
    )

    def parse(batches):
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in parse_records(content.as_buffer().to_pybytes()):
                    origin = headers.get("warc-segment-origin-id") or headers.get("warc-record-id")
                    # Without its origin a segment cannot be placed: a damaged record of its own.
                    number = (_whole_number(headers.get("warc-segment-number")) or 0) if origin else 0
                    total = _whole_number(headers.get("warc-segment-total-length"))
                    fields = "\n".join(f"{k}: {v}" for k, v in headers.items())
                    if number == 0:
                        row = _page_row(headers, block)
                        block, fields = repr(row).encode(), None
                    rows.append((origin, number, total, fields, block))
                    held += len(block or b"")
                    if len(rows) >= 4096 or held >= 4 << 20:
                        yield rows_batch(parsed_schema, list(zip(*rows)))
                        rows, held = [], 0
        if rows:
            yield rows_batch(parsed_schema, list(zip(*rows)))

    def assemble(batches):
        """Rows sorted by origin and number; holds the segments of one origin at a time."""
        import ast

        origin, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["number"] == 0:
                    out.append(ast.literal_eval(row["block"].decode()))
                    continue
                if row["origin"] != origin:
                    out += _assembled(held)
                    origin, held = row["origin"], []
                held.append(row)
            if out:
                yield rows_batch(_PAGE, list(zip(*out)))
        if held:
            yield rows_batch(_PAGE, list(zip(*_assembled(held))))

    records = (
        spark.read.format("binaryFile")
        .load(path)
        .select("content")
        .mapInArrow(parse, "origin string, number bigint, total bigint, headers string, block binary")
    )
    return records.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(assemble, _PAGE_TYPE)


def _assembled(rows: list[dict]) -> list[list]:
    """Pages from the sorted segments of one origin; repeats of a page give several."""
    if not rows:
        return []
    first = [r for r in rows if r["number"] == 1]
    source = first or rows
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in source[0]["headers"].split("\n"))
    if not first:
        headers |= {"warc-type": "response"}
    # Of a segment that comes several times a whole one counts.
    segments = {r["number"]: r["block"] for r in rows if r["block"] is not None}
    totals = {r["total"] for r in rows if r["total"] is not None}
    complete = len(totals) == 1 and sorted(segments) == list(range(1, len(segments) + 1))
    block = b"".join(segments[n] for n in sorted(segments)) if complete else None
    if block is not None and len(block) not in totals:
        block = None
    return [_page_row(headers, block) for _ in range(max(1, len(first)))]


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives (below the session's shared folder unless told otherwise), read them back."""
    spark = pages.sparkSession
    path = path or f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(spark, write_archives(pages, path, least_bytes, segment_bytes))
