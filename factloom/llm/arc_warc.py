"""Conversion of legacy ARC archives to WARC.

An ARC archive starts with a version block, whose second line says how many
fields a header line has: version 1 has url, address, date, type and length;
version 2 adds result code, checksum, location, offset and file name before
the length. Records follow, each a header line and as many bytes as the line
declares. The converter synthesises what WARC asks for and ARC lacks: record
identifiers (derived from content, so reruns agree), timestamps in ISO form,
record types and payload digests. Of records with equal payloads one is the
response, and the others are revisits that name it and carry no payload. Which
is which is decided on ids and digests alone; payloads never meet by digest.
Files of either kind are bounded by bytes, so that large pages give more files,
not larger ones, and are read record by record.

Defined results: a null url is written as "urn:null" and a null html is an
empty payload; white space in urls is percent-encoded in the archives; pages
whose id is null are archived with an empty id and come back with null;
repeated pages are records of their own; an empty table gives an empty result.
Columns other than page_id, url and html are ignored. An archive that breaks
off inside a record raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Fields of a header line by archive version.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_FIELD_NAMES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Bytes after which a new archive begins; a larger record has one of its own.
ARC_BYTES = 4 << 20
#: Bytes of records that are written as one row, and rows of a WARC file; a larger record is a row of its own.
BUNDLE_BYTES, BUNDLES_PER_FILE = 8 << 20, 4
#: Pages and records that a task is sent at once, and bytes of payloads that it sends.
ROWS_READ, BYTES_SENT = 1_000, 8 << 20
RECORD_END = "\r\n\r\n"
DATE = "20200101000000"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC


def arc_record(version: int, url: str, body: bytes, kind: str = "text/html", date: str = DATE, ip: str = "0.0.0.0", offset: int = 0) -> bytes:
    values = {"url": url, "ip": ip, "date": date, "type": kind, "status": "200", "checksum": "-", "location": "-", "offset": str(offset), "filename": "pages.arc", "length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_head(version: int) -> bytes:
    block = b"%d 0 factloom\n%s\n" % (version, ARC_FIELD_NAMES[version])
    return arc_record(version, "filedesc://pages.arc", block, "text/plain")


def safe_url(url: str | None) -> str:
    return "urn:null" if url is None else re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "urn:empty"


def page_to_arc(version: int, page_id: int | None, url: str | None, html: str | None, offset: int) -> bytes:
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    return arc_record(version, safe_url(url), head.encode() + payload, offset=offset)


def write_arc(pages: DataFrame) -> DataFrame:
    """(arc binary): legacy archives of pages, in both versions by turns."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if not parts:
                    parts, size = [arc_head(version)], 0
                parts.append(page_to_arc(version, page_id, url, html, size))
                size += len(parts[-1])
                if size >= ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)])], ["arc"])
                    version, parts = 3 - version, []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)])], ["arc"])

    shared.bound_batches(pages.sparkSession, ROWS_READ)
    return pages.select("page_id", "url", "html").mapInArrow(archive, "arc binary")


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive: the fields of the header line, and body."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line breaks off")
        line = data[at:end].rstrip(b"\r")
        at = end + 1
        if not line:
            continue
        if fields is None:
            fields = ARC_FIELDS[1]
            length = int(line.rsplit(b" ", 1)[1])
            block = data[at : at + length]
            number = block.split(None, 1)[:1]
            version = int(number[0]) if number and number[0].isdigit() else 0
            if version not in ARC_FIELDS or not line.startswith(b"filedesc:"):
                raise ValueError(f"not an ARC version block: {line[:80]!r}")
            fields = ARC_FIELDS[version]
            at += length
            continue
        # A type or location may hold spaces in archives of old crawlers; the fields around it do not.
        values = line.split(b" ")
        if len(values) > len(fields):
            values = [*values[:3], b" ".join(values[3 : len(values) - len(fields) + 4]), *values[len(values) - len(fields) + 4 :]]
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in an ARC header line, not {len(fields)}")
        record = dict(zip(fields, (v.decode("utf-8", "replace") for v in values), strict=True))
        length = int(record["length"])
        record["body"] = data[at : at + length]
        if len(record["body"]) < length:
            raise ValueError("an ARC record breaks off")
        at += length
        yield record


def http_payload(body: bytes) -> tuple[bytes, bytes]:
    """Head, with its empty line, and payload of an HTTP response; all is payload if it is none."""
    cut = body.find(b"\r\n\r\n")
    return (body[: cut + 4], body[cut + 4 :]) if body.startswith(b"HTTP/") and cut >= 0 else (b"", body)


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


CONVERTED = "page_id long, digest string, uri string, date string, head binary, payload binary"
KEYS = "page_id long, digest string, size long"


def _records(data: bytes) -> Iterator[tuple]:
    """page_id, digest, record and the head and payload of each record of an archive."""
    for record in parse_arc(data):
        head, payload = http_payload(record["body"])
        given = re.search(rb"(?mi)^X-Page-Id: *(-?\d+)\r$", head)
        yield int(given[1]) if given else None, sha1_base32(payload), record, head, payload


def convert(archives: DataFrame) -> DataFrame:
    """Rows of CONVERTED from (arc binary)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("arc"):
                rows = ((i, digest, r["url"], iso_date(r["date"]), head, payload) for i, digest, r, head, payload in _records(data.as_py()))
                yield from _rows(rows, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()], CONVERTED)

    return archives.mapInArrow(parse, CONVERTED)


def digests(archives: DataFrame) -> DataFrame:
    """Rows of KEYS from (arc binary): what convert() finds, without the payloads."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("arc"):
                rows = ((i, digest, len(payload)) for i, digest, _, _, payload in _records(data.as_py()))
                yield from _rows(rows, [pa.int64(), pa.string(), pa.int64()], KEYS)

    return archives.mapInArrow(parse, KEYS)


def revisits(keys: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, first) of the records that revisit another; rows with the smallest id are responses, each of them."""
    large = keys.filter(F.col("size") >= least_bytes)
    repeated = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1 and first is not null").drop("_n")
    return large.join(repeated, "digest").filter("page_id != first").select("page_id", "digest", "first").distinct()


# WARC


def warc_record(page_id: int | None, digest: str, uri: str, date: str, head: bytes, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A record without the two line ends that close it."""
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(uri, str(page_id), digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: {'application/http; msgtype=response' if head else 'text/html'}",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {first}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(archives: DataFrame, path: str, revisit_bytes: int = 0) -> None:
    """Converts (arc binary) to WARC files in a folder; payloads of at least revisit_bytes are stored once."""
    spark = archives.sparkSession
    shared.bound_batches(spark, ROWS_READ)
    found = revisits(shared.staged(digests(archives), "warc-keys"), revisit_bytes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "uri", "date", "head", "payload", "first")), strict=True):
                bundle.append(warc_record(*row, revisit=row[-1] is not None))
                size += len(bundle[-1])
                if size >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(bundle)], pa.binary())], ["records"])
                    bundle, size = [], 0
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(bundle)], pa.binary())], ["records"])

    built = convert(archives).join(found, ["page_id", "digest"], "left").select("page_id", "digest", "uri", "date", "head", "payload", "first").mapInArrow(build, "records binary")
    # Spark's text writer puts the bytes of each bundle and the line ends that close its last record into a file as they are.
    built.select(F.col("records").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", BUNDLES_PER_FILE).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared lengths; data may be compressed and is read record by record."""
    with (gzip.open if data.startswith(b"\x1f\x8b") else io.BufferedReader)(io.BytesIO(data)) as file:
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := file.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            length = int(headers.get("content-length", -1))
            block = file.read(max(0, length))
            if length < 0 or len(block) < length or file.read(4) != RECORD_END.encode():
                raise ValueError("a WARC record breaks off")
            yield headers, block


READ = "page_id long, record_id string, uri string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of READ from the WARC files of a folder, compressed or not; payload is null for revisits. Digests of payloads are checked."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = (_row(h, block) for h, block in parse_warc(data.as_py()))
                yield from _rows(rows, [pa.int64()] + [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.binary()], READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, READ)


def _row(h: dict[str, str], block: bytes) -> tuple:
    """A row of READ from a record, its payload checked against its digest."""
    revisit = h["warc-type"] == "revisit"
    payload = None if revisit else http_payload(block)[1]
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (sha1_base32(payload) != digest or len(payload) != int(h["x-payload-length"])):
        raise ValueError(f"{h['warc-record-id']} has another payload than its header says")
    return int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-record-id"], h["warc-target-uri"], h["warc-date"], h["warc-type"], int(h["x-payload-length"]), digest, int(h["x-refers-to-page"]) if revisit else None, payload


def _rows(rows: Iterable[tuple], types: list[pa.DataType], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows of at most about BYTES_SENT bytes in binary columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= BYTES_SENT:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages, archived as ARC, converted to WARC, and read back."""
    spark = pages.sparkSession
    path = shared.new_path(spark, "warc")
    write_warc(write_arc(pages), path)
    return read_warc(spark, path)
