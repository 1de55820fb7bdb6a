"""WARC archives written by Spark's own committer, and a reader that salvages damaged ones."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import until_exit
from .staging import shared_folder, small, stage
from .textkernel import frugal

VERSION = b"WARC/1.1"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a file is closed, of a record's headers at most, and of what a gzip member may inflate to.
FILE_BYTES, HEADER_BYTES, INFLATED_BYTES = 32 << 20, 1 << 20, 1 << 30
_STEP = 4096
_SIZE = re.compile(r"[0-9]{1,18}", re.ASCII)
_START = re.compile(rb"WARC/1\.[01]\r\n")
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's digest


def record_name(page: int | None) -> str:
    return f"<urn:page:{'unknown' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record without the two line ends that close it; a revisit holds no payload but names its digest and size."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    target = re.sub(r"[\x00-\x20\x7f]", "", url) if url else ""
    lines = [
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_name(page)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target or 'urn:nothing'}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Bytes: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


@dataclass
class Gap:
    """Bytes from ``start`` to ``end`` that no valid record covers."""

    start: int
    end: int
    reason: str


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    payload: bytes = field(default=b"")


class Damage(Exception):
    pass


def whole_number(told: str | None) -> int | None:
    """A size as headers give it: up to 18 ASCII digits; anything else is none."""
    return int(told) if told and _SIZE.fullmatch(told) else None


def agrees(told: str | None, data: bytes) -> bool:
    """Whether a digest header agrees with the data: SHA-1 in base32 or hex, in any case; other digests cannot be checked."""
    name, colon, value = (told or "").partition(":")
    if not colon or name.strip().lower() != "sha1":
        return True
    value = value.strip().rstrip("=")
    return value.lower() == hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper() == sha1_base32(data)  # noqa: S324


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    start = _START.match(data, at)
    if not start:
        raise Damage("no version line")
    stop = data.find(b"\r\n\r\n", start.end() - 2, at + HEADER_BYTES)
    if stop < 0:
        raise Damage("headers do not end")
    headers: dict[str, str] = {}
    for line in data[start.end() : stop].split(b"\r\n") if stop > start.end() else ():
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("a header line has no colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = whole_number(headers.get("content-length"))
    if size is None:
        raise Damage("no content length")
    begin, end = stop + 4, stop + 4 + size
    if end > len(data):
        raise Damage("the block ends beyond the data")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("the record is not closed")
    block = data[begin:end]
    if not agrees(headers.get("warc-block-digest"), block):
        raise Damage("the block's digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    if headers.get("warc-type") == "response" and not agrees(headers.get("warc-payload-digest"), payload):
        raise Damage("the payload's digest differs")
    return Record(at, headers, block, payload), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's bytes, and where it ends; damage carries what came before it."""
    inflate, parts, k, held = zlib.decompressobj(31), [], at, 0
    try:
        while k < len(data) and not inflate.eof:
            parts.append(inflate.decompress(memoryview(data)[k : k + _STEP]))
            k = min(k + _STEP, len(data))
            held += len(parts[-1])
            if held > INFLATED_BYTES:
                raise Damage(f"the member inflates to more than {INFLATED_BYTES} bytes", b"".join(parts))
    except zlib.error as e:
        raise Damage(f"member: {e}", b"".join(parts)) from e
    if not inflate.eof:
        raise Damage("the member does not end", b"".join(parts))
    return b"".join(parts), k - len(inflate.unused_data)


def _member(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """All records and gaps of a gzip member: records at the member's offset, a gap as the member's bytes, with the place in what it holds in its reason."""
    plain, after = _inflate(data, at)
    if not plain:
        return [Gap(at, after, "the member is empty")], after
    found = list(_salvage(plain, False))
    for x in found:
        if isinstance(x, Record):
            x.offset = at
        else:
            x.reason, x.start, x.end = f"{x.reason} (bytes {x.start} to {x.end} of the member)", at, after
    return found, after


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every valid record in order, and a gap for each stretch that had to be given up.

    After a failed check the reader goes on one byte further: to the next gzip
    member of a compressed archive or the next version line of a plain one.
    Records that follow the damage are found again; a wrong length in one
    record cannot hide the next, since its version line is inside the stretch.
    A member may hold any number of records; what it inflates to is salvaged
    like a plain archive.
    """
    packed = data[:2] == b"\x1f\x8b" or (not _START.match(data) and b"\x1f\x8b\x08" in data and not _START.search(data))
    return _salvage(data, packed)


def _salvage(data: bytes, packed: bool) -> Iterator[Record | Gap]:
    at, gap = 0, None
    while at < len(data):
        try:
            if packed:
                found, after = _member(data, at)
            else:
                record_, after = _parse(data, at)
                found = [record_]
        except Damage as e:
            # records that a damaged member held before its damage are checked by their own lengths and digests
            before = [x for x in _salvage(e.args[1], False) if isinstance(x, Record)] if len(e.args) > 1 else []
            if gap and before:
                gap.end = at
                yield gap
                gap = None
            for x in before:
                x.offset = at
                yield x
            gap = gap or Gap(at, at, e.args[0])
            if packed:
                at = data.find(b"\x1f\x8b\x08", at + 1)
            else:
                following = _START.search(data, at + 1)
                at = following.start() if following else -1
            if at < 0:
                break
            continue
        if gap:
            gap.end = at
            yield gap
            gap = None
        yield from found
        at = after
    if gap:
        gap.end = len(data)
        yield gap


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Write a record for each page; returns the folder of plain WARC files (without one given, a shared one that goes with the application).

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with
    the smallest id is the response and the others revisit it.  Null payload
    counts as empty.  A page with a null id is a response unless another page
    with an id has its payload.  Rows that repeat the smallest id are responses
    all.  Only digests are grouped and shuffled, combined before the shuffle;
    pages themselves move only where the repeated payloads are too many to send
    to each task.  A file is closed once its records come to ``file_bytes``, so
    none is larger than that and one more record.  Other columns are ignored.
    An empty table gives a folder without records.
    """
    target = folder or shared_folder(pages.sparkSession)
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    digest = F.unhex(F.sha2(body, 256))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.when(F.length(body) >= least_bytes, digest).alias("h"))
    repeated = rows.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("h", "first")
    joined = rows.join(small(stage(repeated), 48), "h", "left")
    rows = joined.select("id", "url", "body", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("of"))

    @frugal
    def build(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(*row))
                size += len(held[-1]) + 4
                if size >= file_bytes:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([b"\r\n\r\n".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"\r\n\r\n".join(held)], pa.binary())})

    # the text writer puts bytes down as they are; a row is a file, and the line separator closes its last record
    values = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "none").text(target)
    return target if folder else until_exit(pages.sparkSession, target)


def _rows(batches, gaps: bool):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out: list[tuple] = []
            for found in salvage(content.as_py()):
                if isinstance(found, Gap):
                    if gaps:
                        out.append((name, found.start, found.end, found.reason))
                elif not gaps:
                    h = found.headers
                    kind = h.get("warc-type")
                    size = len(found.payload) if kind == "response" else whole_number(h.get("x-payload-bytes")) or 0
                    out.append((name, found.offset, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), (h.get("warc-payload-digest") or "").removeprefix("sha1:"), size, found.payload))
            schema = _GAPS if gaps else _RECORDS
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 512], strict=True), schema.types, strict=True)], schema.names)


_GAPS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())])
_RECORDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records of all archives in a folder, with their payloads.

    A header that is absent is null (a digest is empty); of a revisit the size
    is what it tells of its payload, 0 where that is no number.  Records that
    repeat are all given; an empty file has none.  No damage raises.
    """
    return _files(spark, folder).mapInArrow(lambda b: _rows(b, False), "file string, offset long, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """The byte gaps that :func:`read_warc` passed over: file, start, end and reason; none for an undamaged or empty file."""
    return _files(spark, folder).mapInArrow(lambda b: _rows(b, True), "file string, start long, end long, reason string")


def page_of(column: str):
    """The page id inside a record's name; null where it is unknown."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
