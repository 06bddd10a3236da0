"""WARC archives of web pages: writing, and reading that salvages what it can from damaged files.

Archives are written and read through Spark's own sources, so that they lie in whatever store the shared folder is
in, and a lost task's files never count. Each holds at most ``SEGMENT`` bytes, or one record that is longer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import warnings
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import fresh_path, ship, stage

SEGMENT = 16_000_000
#: Bytes of a member that are read together.
PORTION = 1 << 14
#: Buckets of page ids, of which those with revisits are broadcast.
ID_BUCKETS = 1 << 20
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
_RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id: int, url: str | None, payload: bytes, refers_to: int | None = None, minimum: int = 0) -> bytes:
    """A response record, or, where refers_to names an equal page's response, a revisit record without the payload."""
    digest = payload_digest(payload)
    revisit = refers_to is not None and len(payload) >= minimum
    block = _RESPONSE_HEAD + (b"" if revisit else payload)
    target = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "") or f"urn:page:{page_id}"
    lines = [
        "WARC-Type: " + ("revisit" if revisit else "response"),
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Page-Id: {page_id}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


@dataclass
class Record:
    """A record that passed its checks: its headers by lower-case name, its block, and the file's bytes that hold it."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Salvaged:
    """What reading gave: the sound records, and the byte gaps (start, end, reason) that were put in quarantine."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class Damaged(ValueError):
    """A record or member that fails a check."""


class Finder:
    """The next place of something in data, for questions that move forward: it is searched again when it is passed."""

    def __init__(self, find):
        self.find, self.begin, self.place = find, 0, -2

    def __call__(self, begin: int) -> int:
        if self.place == -2 or begin < self.begin or 0 <= self.place < begin:
            self.begin, self.place = begin, self.find(begin)
        return self.place


def _parse(data: bytes, at: int, end_of_headers) -> tuple[Record, int]:
    """The record that begins at a byte of uncompressed data, and where the next begins."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise Damaged("no version line")
    close = end_of_headers(version.end() - 2)
    if close < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    name, place = "", version.end()
    while place < close:
        stop = data.find(b"\r\n", place, close)
        stop = close if stop < 0 else stop
        text = data[place:stop].decode("utf-8", "replace")
        place = stop + 2
        if text[:1] in (" ", "\t") and name:
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        name = name.strip().lower()
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    begin = close + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    block = data[begin:end]
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damaged("mandatory headers are missing")
    record = Record(headers, block, at, end + 4)
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != payload_digest(block):
        raise Damaged("the block digest differs")
    said = headers.get("warc-payload-digest", "")
    if said.startswith("sha1:") and headers["warc-type"] == "response" and said[5:] != payload_digest(record.payload):
        raise Damaged("the payload digest differs")
    return record, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member that begins at a byte, where it ends, and what is wrong with it, if anything.

    It is read in portions, so that what is no member costs little. Of a member that breaks off there is what it holds;
    of one with a bad code or checksum nothing, as no check tells which of its records' headers are right.
    """
    inflate, out, view, place = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while place < len(data) and not inflate.eof:
            out.append(inflate.decompress(view[place : place + PORTION]))
            place += PORTION
    except zlib.error as e:
        raise Damaged(f"bad member: {e}") from None
    if not inflate.eof:
        return b"".join(out), len(data), "the member does not end"
    return b"".join(out), min(place, len(data)) - len(inflate.unused_data), ""


def _records(inner: bytes) -> tuple[list[Record], str]:
    """The sound records of a member's content, and the first reason, if any, why some of it holds none."""
    found: list[Record] = []
    place, why = 0, ""
    close = Finder(lambda begin: inner.find(b"\r\n\r\n", begin))
    while place < len(inner):
        try:
            record, place = _parse(inner, place, close)
            found.append(record)
        except Damaged as e:
            why = why or str(e)
            line = _VERSION_LINE.search(inner, place + 1)
            place = line.start() if line else len(inner)
    return found, why


def salvage(data: bytes) -> Salvaged:
    """Read plain records and gzip members, mixed as they may be.

    After a failed check the search goes on, one byte past where the bad record began, for the next version line or
    member that parses and passes. The bytes between are one gap of the log, with the first reason. Trailing
    bytes that hold no record are a gap too. Empty data gives nothing. Of a member all records are kept that pass their
    own checks, and if some of it is no record, the whole member is a gap as well; so are the bytes of a member that
    breaks off, of which the sound records before its end are kept. A member with a bad code or checksum gives no records.
    """
    out = Salvaged()
    at, bad, why = 0, -1, ""
    ends = Finder(lambda begin: data.find(b"\r\n\r\n", begin))
    member_, line_ = Finder(lambda begin: data.find(_MEMBER, begin)), Finder(lambda begin: m.start() if (m := _VERSION_LINE.search(data, begin)) else -1)

    def following(begin: int) -> int:
        return min((p for p in (member_(begin), line_(begin)) if p >= 0), default=len(data))

    def close(end: int) -> None:
        nonlocal bad
        if bad >= 0 and end > bad:
            out.gaps.append((bad, end, why))
        bad = -1

    while at < len(data):
        try:
            if data.startswith(_MEMBER, at):
                inner, end, wrong = _inflate(data, at)
                found, reason = _records(inner)
                for record in found:
                    record.start, record.end = at, end
                if wrong:
                    out.records += found
                    raise Damaged(wrong)
                if not found:
                    raise Damaged(reason or "an empty member")
                if reason:
                    close(at)
                    out.gaps.append((at, end, reason))
            else:
                record, end = _parse(data, at, ends)
                found = [record]
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            at = following(at + 1)
            continue
        close(at)
        out.records += found
        at = end
    close(len(data))
    return out


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", minimum: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat an earlier page's payload of at least ``minimum`` bytes.

    Only digests are shuffled. Counting combines before its shuffle, and the join that follows reads two written
    tables, so that a payload that very many pages share can be split between tasks.
    """
    digests = stage(
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(payload_col, F.lit("")).alias("p")).where(F.octet_length("p") >= minimum).select("page_id", F.sha1(F.encode("p", "UTF-8")).alias("digest")),
        "page-digests",
    )
    repeated = stage(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "page-repeats")
    return digests.join(repeated, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", minimum: int = 0) -> None:
    """Write a record per row into archives below ``path``. Null payloads count as empty, null urls get a urn."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    revisits = stage(mark_revisits(pages, id_col, payload_col, minimum), "revisits")
    # only pages that can be revisits are shuffled for the join; the others are told by a bounded list of buckets
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(ID_BUCKETS))
    buckets = F.broadcast(revisits.select(bucket.alias("bucket")).distinct())
    rows = rows.withColumn("bucket", bucket)
    perhaps = rows.join(buckets, "bucket", "left_semi").drop("bucket").join(revisits, ["page_id", "digest"], "left")
    rows = rows.join(buckets, "bucket", "left_anti").withColumn("refers_to", F.lit(None).cast("long")).unionByName(perhaps.drop("digest"), allowMissingColumns=True).select("page_id", "url", "payload", "refers_to")

    def segments(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, refers_to = (c[k].as_py() for c in batch.columns)
                record = record_bytes(page, url, payload.encode("utf-8", "surrogatepass"), refers_to, minimum)
                if held and size + len(record) > SEGMENT:
                    yield _segment(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield _segment(held)

    # Spark's text writer puts raw bytes, then its separator; a record's end is that separator
    (
        rows.mapInArrow(segments, "segment binary")
        .select(F.col("segment").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _segment(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-4]], pa.binary())], names=["segment"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """What salvage() finds in the archives below ``path``: a row per record, and one per gap with kind "gap".

    kind, file, start, end, reason, page_id, payload_bytes, payload_digest, record_type, refers_to, payload.
    """
    ship(spark)

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = (c[k].as_py() for c in batch.columns)
                found = salvage(data)
                rows = []
                for r in found.records:
                    h = r.headers
                    full = int(h["payload-length"]) if h.get("payload-length", "").isdigit() else len(r.payload)
                    rows.append(("record", file, r.start, r.end, None, _number(h.get("page-id")), full, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h["warc-type"], _number(h.get("refers-to-page-id")), r.payload))
                rows += [("gap", file, a, b, why, None, None, None, None, None, None) for a, b, why in found.gaps]
                columns = list(zip(*rows, strict=True)) or [()] * len(_READ)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, _READ, strict=True)], names=[n for n, _, _ in _READ])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, ", ".join(f"`{n}` {s}" for n, _, s in _READ))


_READ = [
    ("kind", pa.string(), "string"), ("file", pa.string(), "string"), ("start", pa.int64(), "long"), ("end", pa.int64(), "long"), ("reason", pa.string(), "string"),
    ("page_id", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("payload", pa.binary(), "binary"),
]


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def warc_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", minimum: int = 0) -> DataFrame:
    """Write every row into archives and read these back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads the row with the smallest id is the response and the others revisit it. Rows that repeat an id
    and its payload get a record each, of the same type; rows without an id are left out, as no record could name them.
    Null payloads count as empty. An empty table writes no archive and gives no rows. Other columns are not read,
    whatever their names. Gaps that reading put in quarantine are written beside the archives, below ``<archives>-gaps``,
    and told in a warning.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages.where(F.col(id_col).isNotNull()), path, id_col, url_col, payload_col, minimum)
    found = stage(read_archives(spark, path).drop("payload"), "read-back")
    gaps = found.where("kind = 'gap'").select("file", "start", "end", "reason")
    if not gaps.isEmpty():
        gaps.write.parquet(f"{path}-gaps")
        warnings.warn(f"archives below {path} have gaps; see {path}-gaps", stacklevel=2)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
