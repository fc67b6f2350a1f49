"""Legacy web archives: write and parse ARC, convert to WARC, read WARC back.

An ARC file opens with a version block that declares the fields of the header lines; each record is one
such line, a block of the declared length (an HTTP response: headers and the payload) and a newline.
The converter parses the line by its version and makes a WARC record: id from the content (so that a
rerun gives the same archive), ISO date from the 14 digits, record type and digests. Of records with equal
payloads of at least ``min_revisit`` bytes, the one with the largest page id is the ``response``; the
others are ``revisit`` records that name it and keep only their HTTP headers.

Archives are files of whole records, written and compressed by Spark's text writer (headers and payloads
are valid UTF-8); a file holds at most ``FILE_RECORDS`` records. Reading goes by declared
lengths alone, so payloads may hold anything that looks like a header.

Edge cases: a null payload is empty; null urls and ids are ``-`` in headers and null again when read;
white space in header fields is percent-encoded; equal payloads that share the largest page id are all
responses, and a null page id is the largest only where all are null; repeated rows give repeated
records (equal ids); an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.common import row_batches, scratch_path

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_DECLARED = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION, REVISIT_PROFILE = "WARC/1.0", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SEPARATOR, HTTP_END = "\r\n\r\n", b"\r\n\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "signalbox.invalid")
#: Capture address, date and type of pages that come without them.
CAPTURE = {"ip": "0.0.0.0", "date": "20000101000000", "mime": "text/html", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "-"}
FILE_RECORDS = 4096

PARSED = "page_id bigint, version int, url string, ip string, date string, mime string, status string, http string, payload binary, payload_bytes bigint, payload_digest string"
WARC = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, page_id bigint, refers_to bigint, payload_bytes bigint, payload binary"


def _field(value: str | None) -> str:
    return quote(value, safe="!#$&'()*+,/:;=?@[]~%") if value else "-"


def _value(field: str) -> str | None:
    return None if field == "-" else field


def arc_version_block(version: int, date: str = CAPTURE["date"]) -> str:
    body = f"{version} 0 signalbox\n{ARC_DECLARED[version]}\n"
    head = {**CAPTURE, "url": "filedesc://signalbox.arc", "mime": "text/plain", "date": date, "length": str(len(body))}
    return " ".join(head[f] for f in ARC_FIELDS[version]) + "\n" + body


def arc_record(version: int, page_id: int | None, url: str | None, payload: str | None) -> str:
    """Header line and block, without the newline that ends a record."""
    body = payload or ""
    size = len(body.encode("utf-8", "surrogatepass"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'-' if page_id is None else page_id}\r\nContent-Length: {size}{SEPARATOR}"
    head = {**CAPTURE, "url": _field(url), "length": str(len(http) + size)}
    return " ".join(head[f] for f in ARC_FIELDS[version]) + "\n" + http + body


def arc_records(data: bytes) -> Iterator[tuple]:
    """(page id, version, url, ip, date, mime, status, HTTP headers, payload) of every record of an ARC stream."""
    at, version = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        values = data[at:end].decode().split(" ")
        # a file that goes on without a version block of its own tells its version by the number of fields
        known = version or next((v for v, names in ARC_FIELDS.items() if len(names) == len(values)), 0)
        if values[0].startswith("filedesc://"):
            known = int(data[end + 1 : end + 3].split()[0])
        if len(values) != len(ARC_FIELDS.get(known, ())):
            raise ValueError(f"ARC header line does not have the fields of its version: {data[at:end][:200]!r}")
        record = dict(zip(ARC_FIELDS[known], values, strict=True))
        stop = end + 1 + int(record["length"])
        if data[stop : stop + 1] != b"\n":
            raise ValueError(f"ARC record of {record['length']} bytes does not end where it should")
        if values[0].startswith("filedesc://"):
            version = known
        else:
            http, _, payload = data[end + 1 : stop].partition(HTTP_END)
            yield (_page_id(http.decode()), known, _value(record["url"]), _value(record["ip"]), _value(record["date"]), _value(record["mime"]), record.get("status"), http.decode(), payload)
        at = stop + 1


def _page_id(http: str) -> int | None:
    return next((_number(line[11:]) for line in http.split("\r\n") if line.startswith("X-Page-Id: ")), None)


def _number(field: str) -> int | None:
    return None if field == "-" else int(field)


def _arc_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    version = 1 + TaskContext.get().partitionId() % 2
    first = [arc_version_block(version)]
    for batch in row_batches(batches):
        columns = (batch.column(n).to_pylist() for n in ("page_id", "url", "payload"))
        out = first + [arc_record(version, *row) for row in zip(*columns, strict=True)]
        first = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _write(records: DataFrame, path: str, separator: str) -> None:
    records.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """A row per archive file; its size is bounded by what one task of the writer holds."""
    return spark.read.format("binaryFile").load(path).select("content")


def write_arc(pages: DataFrame, path: str) -> None:
    """``page_id``, ``url`` and ``payload`` to ARC files, version 1 and 2 by turns of the task."""
    _write(pages.select("page_id", "url", "payload").mapInArrow(_arc_texts, "value string"), path, "\n")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("version", pa.int32()), *((n, pa.string()) for n in ("url", "ip", "date", "mime", "status", "http")), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    for batch in row_batches(batches, 1):
        rows = []
        for record in arc_records(gzip.decompress(batch.column(0)[0].as_py())):
            rows.append((*record, len(record[-1]), hashlib.sha1(record[-1]).hexdigest()))
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files with bare lower-case hexadecimal SHA-1 of the payload."""
    return _files(spark, path).mapInArrow(_parsed, PARSED)


def with_revisits(records: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Adds ``refers_to``: the page id of the response that a record repeats, else null."""
    long = records.filter(F.col("payload_bytes") >= min_revisit)
    firsts = long.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # small payloads have no partner to look for
    key = F.when(F.col("payload_bytes") >= min_revisit, F.col("payload_digest"))
    joined = records.withColumn("_digest", key).join(firsts.withColumnRenamed("payload_digest", "_digest"), "_digest", "left")
    repeats = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("refers_to", F.when(repeats, F.col("_first"))).drop("_digest", "_first")


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}"


def warc_record(page_id: int | None, url: str | None, date: str | None, mime: str | None, http: str, digest: str, size: int, refers_to: int | None, payload: str) -> str:
    """Header lines, blank line and block, without the separator that ends a record."""
    d = (date or "").ljust(14, "0")
    revisit = refers_to is not None
    block = http + SEPARATOR + ("" if revisit else payload)
    head = [
        WARC_VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {url or '-'}",
        "Content-Type: application/http; msgtype=response", f"WARC-Identified-Payload-Type: {mime or '-'}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    length = len(http) + len(SEPARATOR) + (0 if revisit else size)
    return "\r\n".join([*head, f"Content-Length: {length}"]) + SEPARATOR + block


def warc_records(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(SEPARATOR.encode(), at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != WARC_VERSION:
            raise ValueError(f"not a WARC record: {first[:100]!r}")
        head = dict(line.split(": ", 1) for line in lines)
        start = end + len(SEPARATOR)
        stop = start + int(head["Content-Length"])
        if data[stop : stop + len(SEPARATOR)] != SEPARATOR.encode():
            raise ValueError(f"WARC record of {head['Content-Length']} bytes does not end where it should")
        http, _, block = data[start:stop].partition(HTTP_END)
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} has another digest than its header")
        uri = _value(head["WARC-Target-URI"])
        yield (
            head["WARC-Record-ID"].strip("<>"), kind, uri and unquote(uri), head["WARC-Date"], _value(head["WARC-Identified-Payload-Type"]), digest, _page_id(http.decode()),
            int(head["X-Refers-To-Page-Id"]) if kind == "revisit" else None, int(head["X-Payload-Length"]), block,
        )
        at = stop + len(SEPARATOR)


def _warc_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_batches(batches):
        columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "date", "mime", "http", "payload_digest", "payload_bytes", "refers_to", "payload")]
        out = [warc_record(*head, payload.decode("utf-8", "surrogatepass")) for *head, payload in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_warc(records: DataFrame, path: str) -> None:
    _write(records.mapInArrow(_warc_texts, "value string"), path, SEPARATOR)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int64()] * 3 + [pa.binary()]
    names = [c.split()[0] for c in WARC.split(", ")]
    for batch in row_batches(batches, 1):
        rows = []
        for record in warc_records(gzip.decompress(batch.column(0)[0].as_py())):
            rows.append(record)
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; payload digests of responses are checked against their blocks."""
    return _files(spark, path).mapInArrow(_read_back, WARC)


def converted(spark: SparkSession, pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``payload``) through an ARC archive into a WARC archive and back."""
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    write_warc(with_revisits(read_arc(spark, arc), min_revisit), warc)
    return read_warc(spark, warc)
