"""Legacy ARC archives to WARC: header lines and declared lengths, then new records.

An ARC file starts with a version block that says how header lines read (five
fields in version 1, ten in version 2). Each record is a header line, as many
bytes as it declares, and a line end. A record becomes a WARC record with an
identifier made from its content, an ISO timestamp from its digits, a type from
its URL and body, and SHA-256 digests. Records whose payload another record
holds become ``revisit`` records without the payload.

Archives are DataFrames ``name string, content binary``; records are rows of
:data:`RECORD`. WARC files are written by Spark's own text writer, one file for
each segment of about ``SEGMENT_BYTES``, and read as binary files, so both may
lie in any store that Spark reaches.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.llm.grouping import join_groups, written
from callsieve.llm.workers import bounded_batches
from callsieve.session import fresh_dir

#: Fixed values of the two formats.
FIELDS_V1 = ("url", "ip", "date", "type", "length")
FIELDS_V2 = ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")
HEADER_V1 = b"URL IP-address Archive-date Content-type Archive-length"
HEADER_V2 = (
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES = 32 << 20
ARCHIVE_BYTES = 8 << 20
#: Payloads of fewer bytes are stored each time.
LEAST_REVISIT = 100
KEY_HEADER = "X-Page-Id"

RECORD = (
    "key long, uri string, date string, ip string, kind string, head binary, payload binary, "
    "payload_bytes long, payload_digest string, truncated boolean"
)


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    type: str
    length: int
    body: bytes


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, in order.

    Only declared lengths say where a record ends, so bodies may hold anything.
    A body shorter than declared ends the file and is returned as it is. A
    header line that does not fit the version raises ``ValueError``.
    """
    at, fields = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            end = len(content)
        line = content[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not line:  # line ends between records
            at = end + 1
            continue
        names = fields or FIELDS_V1
        if fields is None and not line.startswith("filedesc:"):
            raise ValueError("no version block")
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) and fields is None:
            names = FIELDS_V2
            parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"header line at byte {at} does not fit the version")
        record = dict(zip(names, parts))
        length = int(record["length"])
        body = content[end + 1 : end + 1 + length]
        at = end + 1 + length
        if fields is None:
            version = body.split(b" ", 1)[0]
            if version not in (b"1", b"2"):
                raise ValueError("unknown version")
            fields = FIELDS_V1 if version == b"1" else FIELDS_V2
            continue
        yield ArcRecord(record["url"], record["ip"], record["date"], record["type"], length, body)


def write_arc(name: str, version: int, records: Iterator[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of ``(url, ip, date, type, body)`` records."""
    about = b"%d 0 callsieve\n%s\n\n" % (version, HEADER_V1 if version == 1 else HEADER_V2)
    fill = "" if version == 1 else " 200 - - 0 " + name
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain{fill} {len(about)}\n".encode(), about, b"\n"]
    for url, ip, date, kind, body in records:
        out += [f"{url} {ip} {date} {kind}{fill} {len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def iso_date(digits: str) -> str:
    """``YYYYMMDDhhmmss``, with trailing parts left out, as a WARC date."""
    d = re.sub(r"\D", "", digits)[:14]
    d = d + "00000101000000"[len(d) :] if len(d) >= 4 else "19960101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(uri: str, date: str, digest: str, key: int | None) -> str:
    """The same identifier whenever the same capture is converted."""
    made = hashlib.sha256("\n".join([uri, date, digest, str(key)]).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=made[:16], version=5)}>"


def converted(record: ArcRecord) -> tuple:
    """A row of :data:`RECORD`."""
    head, payload, kind = b"", record.body, "resource"
    if record.body.startswith(b"HTTP/"):
        kind = "response"
        cut = record.body.find(b"\r\n\r\n")
        cut = len(record.body) if cut < 0 else cut + 4
        head, payload = record.body[:cut], record.body[cut:]
    found = re.search(rb"(?i)\r\n" + KEY_HEADER.encode() + rb": (-?\d+)\r\n", head)
    return (
        int(found[1]) if found else None,
        record.url,
        iso_date(record.date),
        record.ip,
        kind,
        head,
        payload,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        len(record.body) < record.length,
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RECORD = pa.schema(
    [
        ("key", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("kind", pa.string()),
        ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("truncated", pa.bool_()), ("origin", pa.struct([("key", pa.int64()), ("uri", pa.string()), ("date", pa.string())])),
    ]
)
_DIGESTS = pa.schema(
    [
        ("name", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("uri", pa.string()), ("date", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Captured pages as ARC files of about ``ARCHIVE_BYTES``, versions 1 and 2 in turn.

    NULL pages have an empty body, NULL URLs read ``urn:no-url``. The capture time of
    page ``k`` is ``k`` seconds (of a 20-year span) after 1996.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, n = [], 0, 0

        def out() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arc"
            content = write_arc(name, n % 2 + 1, made)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["name", "content"])

        for batch in batches:
            for k, u, date, page in zip(*(c.to_pylist() for c in batch.columns)):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page)}\r\n"
                if k is not None:
                    head += f"{KEY_HEADER}: {k}\r\n"
                made.append((u, "0.0.0.0", date, "text/html", head.encode() + b"\r\n" + page))
                size += len(page)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    made, size, n = [], 0, n + 1
        if made:
            yield out()

    bounded_batches(pages.sparkSession)
    return _captures(pages, key, url, html).mapInArrow(run, "name string, content binary")


def _captures(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    seconds = F.coalesce(F.col(key).cast("long") % F.lit(631152000), F.lit(0)) + 820454400
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit("").cast("binary"))
    return pages.select(
        F.col(key).cast("long").alias("key"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("urn:no-url")), r"[\s]", "%20").alias("uri"),
        F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss").alias("date"),
        payload.alias("payload"),
    )


#: What tells which records repeat: where a record is, and what of it counts.
DIGESTS = "name string, n int, key long, uri string, date string, payload_bytes long, payload_digest string"
_ORIGIN = "struct<key: long, uri: string, date: string>"


def record_digests(archives: DataFrame) -> DataFrame:
    """The records of ARC files without their bodies, as rows of :data:`DIGESTS`; ``n`` counts within a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = [(n, *converted(r)) for n, r in enumerate(parse_arc(content))]
                rows = [(name, n, r[0], r[1], r[2], r[7], r[8]) for n, *r in found]
                if rows:
                    yield _batch(rows, _DIGESTS)

    bounded_batches(archives.sparkSession)
    return archives.select("name", "content").mapInArrow(run, DIGESTS)


def with_origins(archives: DataFrame, digests: DataFrame) -> DataFrame:
    """``archives`` with ``origins``: for each record that repeats another's payload its place and what it refers to.

    Only slim rows are grouped by payload. What was found out goes back to the archive that
    the record is in, as one short list, so a payload that a third of the records share is
    moved neither as a payload nor to one task.
    """
    large = digests.filter(F.col("payload_bytes") >= LEAST_REVISIT)
    firsts = written(origins(large), "origins")
    found = join_groups(large.select("name", "n", "key", "payload_digest"), firsts, "payload_digest", "_n")
    other = F.col("key").isNull() | (F.col("key") != F.col("_origin.key"))
    lists = found.filter(F.col("_origin").isNotNull() & other).groupBy("name").agg(F.collect_list(F.struct("n", "_origin")).alias("origins"))
    return archives.join(written(lists, "revisits"), "name", "left")  # of a known size: broadcast where that is small


def convert(archives: DataFrame) -> DataFrame:
    """ARC files as rows of :data:`RECORD`, whole bodies, with ``origin`` as :func:`with_origins` says (else NULL)."""
    if "origins" not in archives.columns:
        archives = archives.withColumn("origins", F.lit(None).cast(f"array<struct<n: int, _origin: {_ORIGIN}>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                refers = {x["n"]: x["_origin"] for x in batch.column("origins")[i].as_py() or ()}
                rows, size = [], 0
                for n, record in enumerate(parse_arc(batch.column("content")[i].as_py())):
                    rows.append((*converted(record), refers.get(n)))
                    size += record.length
                    if size >= ARCHIVE_BYTES:
                        yield _batch(rows, _RECORD)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _RECORD)

    bounded_batches(archives.sparkSession)
    return archives.select("name", "content", "origins").mapInArrow(run, f"{RECORD}, origin {_ORIGIN}")


def origins(digests: DataFrame) -> DataFrame:
    """For each payload that several records hold, the one with the smallest key.

    ``digests``: ``payload_digest, payload_bytes, key, uri, date``. One row for each
    repeated digest, combined before the shuffle: a payload that a third of the
    records share is one row from each task.
    """
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "uri", "date")))
    return (
        digests.filter(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("_n"), first.alias("_origin"))
        .filter("_n > 1 and _origin is not null")
        .select("payload_digest", "_origin", "_n")
    )


def warc_record(row: dict) -> bytes:
    """A WARC record without its two closing line ends."""
    origin, digest = row["origin"], row["payload_digest"]
    kind = "revisit" if origin else row["kind"]
    block = row["head"] if origin else row["head"] + row["payload"]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(row["uri"], row["date"], digest, row["key"])),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["uri"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response" if row["kind"] == "response" else "application/octet-stream"),
        ("X-Payload-Length", str(row["payload_bytes"])),
    ]
    if row["key"] is not None:
        fields.append((KEY_HEADER, str(row["key"])))
    if row["truncated"]:
        fields.append(("WARC-Truncated", "length"))
    if origin:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(origin["uri"], iso_date(origin["date"]), digest, origin["key"])),
            ("WARC-Refers-To-Target-URI", origin["uri"]),
            ("WARC-Refers-To-Date", iso_date(origin["date"])),
            ("X-Refers-To-Key", str(origin["key"])),
        ]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def write_warc(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Marked records as ``*.gz`` WARC files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(made)], pa.binary())], ["warc"])
        for batch in batches:
            for i in range(batch.num_rows):
                made.append(warc_record({n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}))
                size += len(made[-1])
                if size >= segment_bytes:
                    yield out()
                    made, size = [], 0
        if made:
            yield out()

    bounded_batches(records.sparkSession)
    (
        records.mapInArrow(run, "warc binary")
        .select(F.col("warc").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .text(path)
    )


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of each record of an uncompressed WARC file."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(fields["Content-Length"])
        block = content[start:at]
        if len(block) < int(fields["Content-Length"]) or not content.startswith(b"\r\n\r\n", at):
            raise ValueError("a record is not as long as it says")
        at += 4
        yield fields, block


READ = (
    "key long, record_id string, record_type string, uri string, date string, payload_bytes long, "
    "payload_digest string, refers_to long, refers_to_id string, block binary"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of :data:`READ`, one for each record; blocks are checked against their digests."""
    schema = pa.schema(
        [
            ("key", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()),
            ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("block", pa.binary()),
        ]
    )

    def long(text: str | None) -> int | None:
        return None if text is None else int(text)

    def row(fields: dict[str, str], block: bytes) -> tuple:
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
        return (
            long(fields.get(KEY_HEADER)), fields["WARC-Record-ID"], fields["WARC-Type"], fields["WARC-Target-URI"],
            fields["WARC-Date"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            long(fields.get("X-Refers-To-Key")), fields.get("WARC-Refers-To"), block,
        )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for fields, block in parse_warc(gzip.decompress(batch.column(0)[i].as_py())):
                rows.append(row(fields, block))
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: (out for b in batches for out in run(b)), READ)


def pages_to_warc(pages: DataFrame, path: str) -> None:
    """Pages through ARC archives into WARC files below ``path``.

    One record for each row, repeated rows and NULLs included (a NULL page has an
    empty payload); an empty table writes no record. Other columns are not read.
    """
    folder = fresh_dir(pages.sparkSession, "arc")
    archive_pages(pages).write.option("compression", "zstd").parquet(folder)
    archives_to_warc(pages.sparkSession.read.schema("name string, content binary").parquet(folder), path)


def archives_to_warc(archives: DataFrame, path: str) -> None:
    """ARC files (a table, as they are read twice) into WARC files below ``path``; names must be unique.

    Which record is the response of a payload is told from the converted records.
    """
    digests = written(record_digests(archives), "arc-digests")
    write_warc(convert(with_origins(archives, digests)), path)
