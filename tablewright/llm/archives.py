"""Conversion of legacy ARC archives to WARC.

An ARC file says in its first block which version it has and which fields its header lines hold; a record is a header
line, whose last field is the length, and that many bytes. Each record becomes a WARC response with an identifier made
from its page, a timestamp in ISO form, and payload and block digests. Of records with equal payloads the one with the
smallest page id stays a response, the others become revisits of it without payload.

Files are written by Spark's text sink with gzip and read with the binaryFile source, so any file system that Spark
reaches will do; readers decompress as a stream, one record at a time. Payloads are not shuffled: only digests are
grouped, and the digests that occur more than once go to the records (broadcast while small, else a join).

Rules for hard cases: a NULL html is an empty payload, a NULL url is written as ``-``, blanks and controls in urls are
percent-encoded. A NULL page id is written as ``-``; it never is the target of a revisit unless all its copies have
none. Rows that repeat a page id with the same payload are all responses if that id is the smallest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.tables import bounded_broadcast, stored
from tablewright.session import scratch_path

#: Header fields of the two versions of the legacy format, as their version blocks declare them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, ip string, date string, mime string, head binary, payload binary, payload_bytes long, payload_digest string"
WARC_RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, date string, record_id string, payload binary"


@dataclass(frozen=True)
class ArchiveOptions:
    """``records_per_file`` bounds the files; payloads under ``min_revisit_bytes`` are never revisits."""

    records_per_file: int = 2_000
    min_revisit_bytes: int = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tablewright\n{ARC_FIELDS[version]}\n".encode()
    rest = ["text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join([f"filedesc://{name}", "0.0.0.0", date, *rest]).encode() + b"\n" + body


def arc_record(version: int, page_id: int | None, url: str | None, date: str, html: str | None, name: str) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    extra = ["200", hashlib.md5(payload).hexdigest(), "-", "0", name] if version == 2 else []
    return " ".join([_plain(url), "0.0.0.0", date, "text/html", *extra, str(len(body))]).encode("utf-8", "surrogatepass") + b"\n" + body


def write_arc(pages: DataFrame, path: str, options: ArchiveOptions, date: str = "20240101000000", id_col="page_id", url_col="url", html_col="html") -> None:
    """Legacy archives of ``pages``; input partitions take turns with the two versions."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        for batch in batches:
            out = []
            for i, url, html in zip(*(batch.column(k) for k in range(3))):
                if n % options.records_per_file == 0:  # a file starts with its version block
                    out.append(version_block(version, name, date))
                    n += 1
                out.append(arc_record(version, i.as_py(), url.as_py(), date, html.as_py(), name))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, "value binary")
    _write(rows, path, "\n", options)


def _write(rows: DataFrame, path: str, separator: str, options: ArchiveOptions) -> None:
    rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", options.records_per_file).option("compression", "gzip").option("lineSep", separator).text(path)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[io.BufferedIOBase]:
    for batch in batches:
        for content in batch.column("content"):
            yield gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"record of {n} bytes ends after {len(data)}")
    return data


def arc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record, by the field list of the version block read last."""
    fields = ARC_FIELDS[1].split()
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        values = line.decode("utf-8", "surrogatepass").split(" ")
        if values[0].startswith("filedesc://"):
            body = _exactly(stream, int(values[-1])).decode().split("\n")
            if int(body[0].split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown archive version: {body[0]!r}")
            fields = body[1].split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"header line with {len(values)} fields instead of {len(fields)}: {line[:200]!r}")
        head = dict(zip(fields, values))
        yield head, _exactly(stream, int(head["Archive-length"]))


def _http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    head, gap, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + gap, payload


def _number(text: str | None) -> int | None:
    return int(text) if text and text != "-" else None


def _in_batches(records: Iterator[tuple], names: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 256 rows and some 16 MB."""
    schema, rows, size = pa.schema(names), [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], names=schema.names)

    for r in records:
        rows.append(r)
        size += sum(len(v) for v in r if isinstance(v, bytes))
        if len(rows) >= 256 or size > 16 << 20:
            yield batch()
            rows, size = [], 0
    yield batch()


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of legacy archives; without ``payloads`` their heads and payloads are NULL."""

    def records(batches):
        for stream in _streams(batches):
            for head, body in arc_records(stream):
                http, top, payload = _http(body)
                url = None if head["URL"] == "-" else head["URL"]
                yield (_number(http.get("x-page-id")), url, head["IP-address"], head["Archive-date"], head["Content-type"], top if payloads else None, payload if payloads else None, len(payload), digest(payload))

    names = [("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    return _files(spark, path).mapInArrow(lambda batches: _in_batches(records(batches), names), RECORDS)


def record_id(page_id: int | None, url: str | None, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'{url} {date}')}>"


def warc_record(page_id, url, ip, date14, head: bytes, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record without the two line ends that close it."""
    d = date14.ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, date14)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or "-"),
        ("WARC-IP-Address", ip),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, None, "")), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass") + block


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, options: ArchiveOptions | None = None) -> None:
    """Writes WARC files of the records of the legacy archives in ``arc_path``."""
    o = options or ArchiveOptions()
    equal = read_arc(spark, arc_path, payloads=False).where(F.col("payload_bytes") >= o.min_revisit_bytes)
    twins = equal.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    twins = stored(twins, "twins")
    rows = read_arc(spark, arc_path).join(bounded_broadcast(twins, twins.count(), 96), ["payload_digest", "payload_bytes"], "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                revisit = r["first"] is not None and r["first"] != r["page_id"]
                out.append(warc_record(r["page_id"], r["url"], r["ip"], r["date"], r["head"], r["payload"], r["payload_digest"], r["first"], revisit))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    _write(rows.mapInArrow(run, "value binary"), warc_path, "\r\n\r\n", o)


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record does not start with its version: {line[:80]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, _exactly(stream, int(head["content-length"]))


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of WARC files; block digests are checked. Size and digest are those of the full payload, also for revisits."""

    def records(batches):
        for stream in _streams(batches):
            for head, block in warc_records(stream):
                if head["warc-block-digest"] != f"sha1:{digest(block)}":
                    raise ValueError(f"block of {head['warc-record-id']} does not match its digest")
                http, _, payload = _http(block)
                revisit = head["warc-type"] == "revisit"
                size = int(http["content-length"]) if revisit else len(payload)
                url = None if head["warc-target-uri"] == "-" else head["warc-target-uri"]
                yield (_number(http.get("x-page-id")), head["warc-type"], _number(head.get("x-refers-to-page-id")), size, head["warc-payload-digest"].partition(":")[2], url, head["warc-date"], head["warc-record-id"], payload if payloads and not revisit else None)

    names = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())]
    return _files(spark, path).mapInArrow(lambda batches: _in_batches(records(batches), names), WARC_RECORDS)


def convert_pages(pages: DataFrame, options: ArchiveOptions | None = None) -> DataFrame:
    """Round trip of ``pages`` (page_id, url, html): legacy archives, WARC files, their records."""
    o, spark = options or ArchiveOptions(), pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, o)
    if pages.isEmpty():
        return spark.createDataFrame([], WARC_RECORDS)
    arc_to_warc(spark, arc, warc, o)
    return read_warc(spark, warc)
