"""Web archives: pages as legacy ARC files, converted to WARC.

An ARC file begins with a version block that names the header fields: five in version 1 (url, address, date, type, length), ten in
version 2. Each record is a header line, then as many bytes as its length says. The converter parses records by the version of
their file, cuts the HTTP head off the payload, and writes WARC records with identifiers, dates, types and digests made from
what the ARC record holds. Of records with equal payloads of LEAST bytes or more, the one with the largest page_id is a response and
the others revisit it; smaller ones are all responses.

Archives are built as byte strings of at most about ARCHIVE_BYTES (one record may be longer) and written by Spark's text writer, one
row a file, gzipped; they are read with the binaryFile source. Only Spark touches the shared folder. Payloads are grouped by digest
without carrying them; the decision is joined on the record's identifier, so there is no hot key with payloads.

Edge cases: null html is an empty payload; null url becomes `urn:none`; a url's white space and control characters are
percent-encoded in header lines; null page_id is kept as no header; rows repeated in full are all responses where they are the
largest page_id. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.llm.shared import map_arrow, map_pandas, scratch

LEAST, ARCHIVE_BYTES, DATE = 1000, 8 << 20, "20240101000000"
#: The field lines of ARC version blocks.
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length",
          2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
RECORD = "page_id long, url string, date string, payload binary, payload_bytes long, payload_digest string, record_id string"


def header_url(url: str | None) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else "urn:none"


def arc_version_block(name: str, version: int) -> bytes:
    body = b"%d 0 %s\n%s\n" % (version, b"archive", FIELDS[version])
    extra = b"" if version == 1 else b"200 - - 0 %s " % name.encode()
    return b"filedesc://%s 0.0.0.0 %s text/plain %s%d\n%s\n" % (name.encode(), DATE.encode(), extra, len(body), body)


def arc_record(page: int | None, url: str | None, payload: bytes, version: int, offset: int, name: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
    head += b"" if page is None else b"X-Page-Id: %d\r\n" % page
    body = head + b"\r\n" + payload
    fields = [header_url(url).encode(), b"0.0.0.0", DATE.encode(), b"text/html"]
    if version == 2:
        fields += [b"200", hashlib.md5(payload).hexdigest().encode(), b"-", b"%d" % offset, name.encode()]
    return b" ".join([*fields, b"%d" % len(body)]) + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[str, str, dict[str, str], bytes]]:
    """(url, date, HTTP head, payload) of the records, by the field line of the version block."""
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            break
        line, at = data[at:end].decode("ascii"), end + 1
        if not line.strip():
            continue
        values = line.split(" ")
        length = int(values[-1])
        body, at = data[at:at + length], at + length + 1
        if len(body) < length:
            raise ValueError("an ARC record ends before its declared length")
        if values[0].startswith("filedesc://"):
            names = body.split(b"\n")[1].decode("ascii").split(" ")
            continue
        if names is None or len(values) != len(names):
            raise ValueError("an ARC header line does not fit its version block")
        own = dict(zip(names, values))
        head, _, payload = body.partition(b"\r\n\r\n")
        yield own["URL"], own["Archive-date"], _head(head), payload


def _head(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in data.split(b"\r\n")[1:])}


def warc_record(page, url: str, date: str, payload: bytes | None, size: int, digest: str, record_id: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload that still states its size and digest."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
    block = http.encode() + (payload or b"")
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {iso}", f"WARC-Target-URI: {url}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{b32}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = _head(data[at:end])
        size = int(head["content-length"])
        yield head, data[end + 4:end + 4 + size]
        at = end + 4 + size


def _archives(make):
    """Rows (name, data) of bounded size out of the byte strings `make` yields for a batch; (text, data) begins a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}"]), pa.array([b"".join(parts)], pa.binary())], names=["name", "data"])
        for batch in batches:
            for values in zip(*batch.columns):
                record = make([v.as_py() for v in values], f"{task:06d}-{number:06d}", number, size)
                parts.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield row()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield row()

    return run


def _arc(values, name: str, number: int, size: int) -> bytes:
    page, url, html = values
    version = 1 + number % 2
    start = arc_version_block(f"{name}.arc", version) if not size else b""
    return start + arc_record(page, url, (html or "").encode(), version, size, f"{name}.arc")


def _warc(values, name: str, number: int, size: int) -> bytes:
    page, url, date, payload, length, digest, record_id, refers_to = values
    return warc_record(page, url, date, None if refers_to is not None else payload, length, digest, record_id, refers_to)


def _write(rows: DataFrame, path: str) -> None:
    """One gzipped file a row, at the fastest level: a better one took most of the job's time and saved an eighth of the bytes."""
    files = rows.select("name", F.expr("cast(data as string)").alias("value")).write.option("maxRecordsPerFile", 1)
    files.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy("name").text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC files of pages (page_id, url, html) under path, of both versions."""
    _write(map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), _archives(_arc), "name string, data binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def _from_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for url, date, head, payload in parse_arc(zlib.decompress(content.as_py(), 31)):
                page, digest = head.get("x-page-id"), hashlib.sha1(payload).hexdigest()
                key = f"{page} {url} {date} {digest}"
                rows.append((None if page is None else int(page), url, date, payload, len(payload), digest, f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}"))
                size += len(payload)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return map_arrow(_files(spark, path), _from_arc, RECORD)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    records = read_arc(spark, arc_path)
    keys = records.filter(F.col("payload_bytes") >= LEAST).select("page_id", "payload_digest", "record_id")
    original = keys.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    again = keys.join(original, "payload_digest").filter("page_id is null or page_id <> refers_to").select("record_id", "refers_to").distinct()
    rows = records.join(again, "record_id", "left")
    order = [c.split()[0] for c in RECORD.split(", ")] + ["refers_to"]
    _write(map_arrow(rows.select(*order), _archives(_warc), "name string, data binary"), warc_path)


def _from_warc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in parse_warc(zlib.decompress(content, 31)):
                http, _, payload = block.partition(b"\r\n\r\n")
                own, stated = _head(http), base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != int(own["content-length"])):
                    raise ValueError(f"record {head['warc-record-id']}: payload and digest differ")
                rows.append((own.get("x-page-id"), int(own["content-length"]), stated, head["warc-type"], head.get("warc-refers-to-page"), head["warc-target-uri"], head["warc-record-id"]))
            frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "record_id"])
            for c in ("page_id", "refers_to"):
                frame[c] = pd.to_numeric(frame[c]).astype("Int64")
            yield frame


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return map_pandas(_files(spark, path), _from_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, record_id string")


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
