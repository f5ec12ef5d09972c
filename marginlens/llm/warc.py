"""Legacy archives to WARC: ARC volumes are written, parsed by their declared lengths, converted, and read back.

An ARC volume starts with a version block that names the fields of its record lines; version 1 has five fields, version 2
ten. A record is its line and as many bytes as the line declares. The converter turns each into a WARC record with an
identifier made of the volume and the record's place in it, the archive date as a WARC date, SHA-1 digests in base32, and
the type: of records with equal payloads the one of the smallest page is a response, the others revisit it.

Volumes are gzip-compressed text files of Spark's writer and are read as whole files, so any store that Spark reaches will
do; volumes hold about ``VOLUME_BYTES`` and are parsed as a stream. Which records revisit which is decided on digests alone;
the payloads are not shuffled, the decisions go to the volumes.
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
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.functions.staged import shared_dir, stage
from marginlens.llm.common import Batches, batch, map_batches

VOLUME_BYTES = 16 << 20
#: The archive formats' field names and the values that pages have none of.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ARCHIVE_DATE, NO_ADDRESS, CONTENT_TYPE = "20200101000000", "0.0.0.0", "text/html"
CRLF = b"\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

_VALUE = pa.schema([("value", pa.binary())])
_INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("volume", pa.string()), ("record", pa.int64()),
                    ("payload_bytes", pa.int64()), ("digest", pa.string())])
_READ = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                   ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("refers_to", pa.int64()), ("payload", pa.binary())])


@dataclass
class ArcRecord:
    number: int
    fields: dict[str, str]
    content: bytes

    def http(self) -> tuple[bytes, bytes]:
        """Header block (with its blank line) and body; content without a header block is body alone."""
        end = self.content.find(CRLF * 2) if self.content.startswith(b"HTTP/") else -1
        return (b"", self.content) if end < 0 else (self.content[: end + 4], self.content[end + 4 :])

    def page_id(self) -> int | None:
        found = re.search(rb"(?im)^X-Page-Id:[\x20\t]*(-?[0-9]+)[\x20\t]*\r?$", self.http()[0])
        return int(found[1]) if found else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def _version_block(version: int) -> bytes:
    body = f"{version} 0 marginlens\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": "filedesc://pages.arc", "IP-address": NO_ADDRESS, "Archive-date": ARCHIVE_DATE, "Content-type": "text/plain",
              "Result-code": "200", "Archive-length": str(len(body))}
    return _arc_line(version, values) + body


def _arc_batches(batches: Batches, per_volume: int) -> Batches:
    """Lines of volumes of ``per_volume`` rows each, the version block being the first; versions alternate."""
    n = 0
    for rows in batches:
        out = []
        for page, url, html in zip(rows.column("page_id").to_pylist(), rows.column("url").to_pylist(), rows.column("html"), strict=True):
            version = 1 + n // per_volume % 2
            if n % per_volume == 0:
                out.append(_version_block(version))
                n += 1
            named = b"" if page is None else b"X-Page-Id: %d\r\n" % page
            content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + CRLF + html.as_py()
            address = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
            values = {"URL": address, "IP-address": NO_ADDRESS, "Archive-date": ARCHIVE_DATE, "Content-type": CONTENT_TYPE,
                      "Result-code": "200", "Archive-length": str(len(content))}
            out.append(_arc_line(version, values) + content)
            n += 1
        yield batch(_VALUE, out)


def parse_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """Records of one volume after its version block; an empty file has none. Raises ValueError on what does not fit."""
    line = stream.readline()
    if not line:
        return
    head = line.split()
    if not head or not head[-1].isdigit():
        raise ValueError(f"no version block: {head!r}")
    block = stream.read(int(head[-1])).split(b"\n")
    fields = [f.decode() for f in block[1].split()]
    if tuple(fields) != ARC_FIELDS.get(int(block[0].split()[0])):
        raise ValueError(f"unknown version: {block!r}")
    number = 0
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"not a record line: {line[:200]!r}")
        record = dict(zip(fields, values, strict=True))
        content = stream.read(int(record["Archive-length"]))
        if len(content) != int(record["Archive-length"]):
            raise ValueError(f"cut off: {line[:200]!r}")
        yield ArcRecord(number, record, content)
        number += 1


def _volumes(rows: pa.RecordBatch) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for path, content in zip(rows.column("path").to_pylist(), rows.column("content"), strict=True):
        yield path.rpartition("/")[2], gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))


def record_id(volume: str, number: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{volume}#{number}')}"


def _index_batches(batches: Batches) -> Batches:
    for rows in batches:
        for volume, stream in _volumes(rows):
            found = [(r.page_id(), record_id(volume, r.number), volume, r.number, len(body), digest(body))
                     for r in parse_arc(stream) for body in (r.http()[1],)]
            yield batch(_INDEX, *(zip(*found, strict=True) if found else [[]] * len(_INDEX)))


def warc_date(archive_date: str) -> str:
    """ISO 8601 from the 14 digits of an ARC date; shorter ones are filled up, later digits dropped."""
    d = archive_date[:14] + "00000101000000"[len(archive_date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def _info(volume: str) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(volume, -1)}>"), ("WARC-Date", warc_date(ARCHIVE_DATE)),
               ("Content-Type", "application/warc-fields")]
    return _warc(headers, b"software: marginlens\r\nformat: WARC File Format 1.1\r\n")


def _converted(volume: str, record: ArcRecord, refers_to: dict | None) -> bytes:
    head, body = record.http()
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id(volume, record.number)}>"),
        ("WARC-Date", warc_date(record.fields["Archive-date"])), ("WARC-Target-URI", record.fields["URL"]),
        ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(body)}"),
        ("Content-Type", "application/http;msgtype=response"), ("X-Payload-Length", str(len(body))),
    ]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<{refers_to['record_id']}>")]
        if refers_to["page_id"] is not None:
            headers.append(("X-Refers-To-Page", str(refers_to["page_id"])))
    block = head if refers_to else head + body
    return _warc([*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block)


def _convert_batches(batches: Batches, per_volume: int) -> Batches:
    n = 0
    for rows in batches:
        for at, (volume, stream) in enumerate(_volumes(rows)):
            decided = {d["record"]: d for d in rows.column("revisits")[at].as_py() or ()}
            out = []
            for record in parse_arc(stream):
                if n % per_volume == 0:
                    out.append(_info(f"{volume}/{n}"))
                    n += 1
                out.append(_converted(volume, record, decided.get(record.number)))
                n += 1
            yield batch(_VALUE, out)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record. Raises ValueError on what is no record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record: {line[:200]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError(f"cut off: {headers!r}")
        yield headers, block


def _read_batches(batches: Batches, payloads: bool) -> Batches:
    for rows in batches:
        for _, stream in _volumes(rows):
            out = []
            for headers, block in parse_warc(stream):
                if headers["warc-type"] == "warcinfo":
                    continue
                record = ArcRecord(0, {}, block)
                body, declared = record.http()[1], headers["warc-payload-digest"].removeprefix("sha1:")
                response = headers["warc-type"] == "response"
                if response and digest(body) != declared:
                    raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
                refers = headers.get("x-refers-to-page")
                out.append((record.page_id(), headers["warc-record-id"].strip("<>"), headers["warc-target-uri"], headers["warc-date"],
                            headers["warc-type"], int(headers["x-payload-length"]), declared, int(refers) if refers else None,
                            body if response and payloads else None))
            yield batch(_READ, *(zip(*out, strict=True) if out else [[]] * len(_READ)))


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/marginlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _write(lines: DataFrame, folder: str, separator: str, per_volume: int) -> None:
    options = {"lineSep": separator, "compression": "gzip", "maxRecordsPerFile": str(per_volume)}
    lines.select(F.col("value").cast("string")).write.options(**options).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def write_arc(pages: DataFrame, folder: str, per_volume: int) -> None:
    """ARC volumes of ``pages`` (page_id, url, html): a null html is empty, a null url ``about:blank``."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    _write(map_batches(rows, partial(_arc_batches, per_volume=per_volume), "value binary"), folder, "\n", per_volume)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, per_volume: int) -> None:
    """WARC files of all ARC volumes in a folder."""
    files = _files(spark, arc_folder)
    index = map_batches(files, _index_batches,
                        "page_id bigint, record_id string, volume string, record bigint, payload_bytes bigint, digest string")
    index = stage(index, "arc-index")
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record_id")
    first = index.groupBy("digest", "payload_bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.filter("first != last").select(F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "first")
    equal = (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    again = index.join(first, equal).filter(F.col("record_id") != F.col("first.record_id"))
    decided = again.groupBy(F.col("volume").alias("_volume")).agg(
        F.collect_list(F.struct("record", F.col("first.record_id").alias("record_id"), F.col("first.page_id").alias("page_id"))).alias("revisits"))
    own = F.element_at(F.split("path", "/"), -1) == F.col("_volume")
    with_decisions = files.join(decided, own, "left").select("path", "content", "revisits")
    _write(map_batches(with_decisions, partial(_convert_batches, per_volume=per_volume), "value binary"), warc_folder, "\r\n\r\n", per_volume)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Response and revisit records of a folder's files: page_id, record_id, target_uri, date, record_type, payload_bytes,
    payload_digest, refers_to and payload (null for a revisit, or if ``payloads`` is false)."""
    schema = ("page_id bigint, record_id string, target_uri string, date string, record_type string, payload_bytes bigint, "
              "payload_digest string, refers_to bigint, payload binary")
    return map_batches(_files(spark, folder), partial(_read_batches, payloads=payloads), schema)


def archived(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """``pages`` (page_id, url, html) written as ARC, converted to WARC and read back, one row per page as of ``read_warc``.

    A null html is an empty payload, and empty payloads are equal like any others. Rows without page_id come after all
    others and are never referred to by number; of rows that repeat a page with its payload the first record is the response
    and the others revisit that page. No rows in, no rows out.
    """
    spark = pages.sparkSession
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    per_volume = max(16, int(VOLUME_BYTES / (mean + 512)))
    arc, warc = _folder(spark, "arc"), _folder(spark, "warc")
    write_arc(pages, arc, per_volume)
    convert(spark, arc, warc, per_volume)
    return read_warc(spark, warc, payloads)
