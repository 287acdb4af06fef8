"""Legacy ARC archives and their conversion to WARC.

ARC has two record headers. Version 1: URL, IP address, date, content type, length. Version 2 puts result code, checksum, location, offset
and file name before the length. The first record of a file (``filedesc:``) names the version. A record is its header line, as many bytes
as the line declares, and a line feed.

Archives are written by Spark's text writer (one gzip stream a file, committed as a whole) and read as ``binaryFile`` rows, so they may be in
any store that Spark reaches. A file is unpacked as a stream, record by record; what is in memory is its packed bytes and one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_PAYLOAD = 1000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs

_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


class Record(NamedTuple):
    """One archived record. ``page_id``: the fetcher's id of the page, if its headers name one."""

    record_id: str
    kind: str
    uri: str
    ip: str | None
    date: str
    content_type: str
    page_id: int | None
    payload_digest: str
    payload_bytes: int
    refers_to: str | None
    block: bytes


SCHEMA = "record_id string, kind string, uri string, ip string, date string, content_type string, page_id long, payload_digest string, payload_bytes long, refers_to string, block binary"


# ---- writing ARC ----------------------------------------------------------------------------------------------------------------------


def _first_row() -> Column:
    """True for the first row of each partition, thus of each file."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def write_arc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", date: str = "20080101000000", ip: str = "0.0.0.0") -> None:
    """One ARC file per partition of ``pages``; odd partitions are version 2, even ones version 1.

    Null html is an empty payload, a null url becomes ``unknown:``, white space in urls ``%20``; a null id is left out of the headers.
    """
    number = F.spark_partition_id()
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col(id).cast("string")), F.lit("")),
        F.lit("\r\n\r\n"),
        body,
    )
    uri = F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("unknown:"))
    rows = pages.select(F.when(uri == "", "unknown:").otherwise(uri).alias("uri"), block.alias("block"), (number % 2 + 1).alias("version"), F.format_string("pages-%06d.arc", number).alias("file"), _first_row().alias("first"))
    head = F.concat_ws(" ", "uri", F.lit(ip), F.lit(date), F.lit("text/html"))
    length = F.octet_length("block").cast("string")
    line = F.when(F.col("version") == 1, F.concat_ws(" ", head, length)).otherwise(F.concat_ws(" ", head, F.lit("200"), F.md5(F.col("block").cast("binary")), F.lit("-"), F.lit("0"), F.col("file"), length))
    fields = F.when(F.col("version") == 1, ARC_FIELDS[1]).otherwise(ARC_FIELDS[2])
    about = F.concat(F.col("version").cast("string"), F.lit(" 0 archive\n"), fields, F.lit("\n"))
    size = F.octet_length(about).cast("string")
    filedesc_head = F.concat(F.lit("filedesc://"), "file", F.lit(f" {ip} {date} text/plain "))
    filedesc = F.concat(filedesc_head, F.when(F.col("version") == 2, F.concat(F.lit("200 - - 0 "), "file", F.lit(" "))).otherwise(""), size, F.lit("\n"), about, F.lit("\n"))
    record = F.concat(F.when(F.col("first"), filedesc).otherwise(""), line, F.lit("\n"), "block")
    rows.select(record.alias("value")).write.options(**_GZIP, lineSep="\n").text(path)


# ---- reading ARC ----------------------------------------------------------------------------------------------------------------------


def _warc_date(date: str) -> str:
    """14 digits to ISO; missing digits are taken from the first instant of the period."""
    d = date if date.isdigit() else ""
    d = d[:14] + "00000101000000"[len(d[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _http(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and payload of an HTTP response; None if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return None
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def _page_id(headers: dict[str, str]) -> int | None:
    text = headers.get("x-page-id", "")
    return int(text) if text.lstrip("-").isdigit() else None


def arc_records(stream: io.BufferedIOBase, file: str) -> Iterator[Record]:
    """The records of an ARC file as WARC ones. Ids are derived from file and offset, so a repeated task makes them again."""
    offset, version = 0, 1
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.strip():
            continue
        fields = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if not fields[-1].isdigit():
            raise ValueError(f"{file}: no ARC header at byte {at}")
        block = stream.read(int(fields[-1]))
        if len(block) < int(fields[-1]):
            raise ValueError(f"{file}: the record at byte {at} is cut off")
        offset += len(block)
        if fields[0].startswith("filedesc:"):
            version = 2 if block[:1] == b"2" else 1
            if len(fields) not in (5, 10):
                raise ValueError(f"{file}: unknown header fields")
            continue
        if len(fields) != (5 if version == 1 else 10):
            raise ValueError(f"{file}: the header at byte {at} isn't of version {version}")
        uri, ip, date, kind = fields[:4]
        http = _http(block)
        headers, payload = http or ({}, block)
        yield Record(
            f"<urn:uuid:{uuid.uuid5(_SPACE, f'{file}#{at}')}>",
            "response" if http else "resource",
            uri,
            None if ip in ("-", "0.0.0.0") else ip,
            _warc_date(date),
            "application/http; msgtype=response" if http else kind,
            _page_id(headers),
            hashlib.sha1(payload).hexdigest(),
            len(payload),
            None,
            block,
        )


def warc_records(stream: io.BufferedIOBase, file: str) -> Iterator[Record]:
    """The records of a WARC file but for warcinfo. Digest and size are those of the payload read; of a revisit, those its headers state."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: no WARC record where one is due")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError(f"{file}: a record is cut off")
        kind = head["warc-type"]
        if kind == "warcinfo":
            continue
        http = _http(block) if head.get("content-type", "").startswith("application/http") else None
        headers, payload = http or ({}, block)
        stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        digest = stated if kind == "revisit" else hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"{file}: the payload of {head['warc-record-id']} doesn't match its digest")
        size = int(headers["content-length"]) if kind == "revisit" else len(payload)
        yield Record(head["warc-record-id"], kind, head["warc-target-uri"], head.get("warc-ip-address"), head["warc-date"], head.get("content-type", ""), _page_id(headers), digest, size, head.get("warc-refers-to"), block)


def read_archives(spark: SparkSession, path: str, parse: Callable[[io.BufferedIOBase, str], Iterator[Record]], blocks: bool = True) -> DataFrame:
    """The records of all archives below ``path``. Without ``blocks`` the block column is null and nothing of it leaves the task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(k, pa.int64() if k in ("page_id", "payload_bytes") else pa.binary() if k == "block" else pa.string()) for k in Record._fields])
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                name = file.as_py().rpartition("/")[2]
                rows: list[Record] = []
                held = 0
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for r in parse(stream, name):
                        rows.append(r if blocks else r._replace(block=None))
                        held += len(r.block)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist([x._asdict() for x in rows], schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([x._asdict() for x in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, SCHEMA)


# ---- converting -----------------------------------------------------------------------------------------------------------------------


def write_warc(records: DataFrame, path: str) -> None:
    """Writes rows of ``SCHEMA``, each file with a warcinfo record first."""
    digest = F.concat(F.lit("sha1:"), "digest32")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "uri"),
        F.concat(F.lit("WARC-IP-Address: "), "ip"),
        F.concat(F.lit("WARC-Payload-Digest: "), digest),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.when(F.col("kind") == "revisit", f"WARC-Profile: {REVISIT_PROFILE}"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    about = "software: paytrail\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC\r\n"
    info = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"),
        F.regexp_replace(F.md5(F.col("record_id").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.concat(F.lit(">\r\nWARC-Date: "), "date"),
        F.lit(f"\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"),
    )
    record = F.concat(F.when(_first_row(), info).otherwise(""), head, F.lit("\r\n\r\n"), F.col("block").cast("string"))
    records.withColumn("digest32", base32("payload_digest")).select(record.alias("value")).write.options(**_GZIP, lineSep="\r\n\r\n").text(path)


def base32(hexed: str) -> Column:
    """RFC 4648 base 32 of 40 hexadecimal digits: five bits a letter, each five hexadecimal digits being four letters."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.col(hexed), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(F.lower(bits), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_PAYLOAD) -> None:
    """ARC archives to WARC ones. Of responses with equal payloads of at least ``least`` bytes the one with the largest page id keeps its
    payload (ties: largest record id; null ids come last); the others become revisits that name it and keep their HTTP headers."""
    narrow = read_archives(spark, arc, arc_records, blocks=False).filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    kept = narrow.groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id")).alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = kept.filter("n > 1").select("payload_digest", F.col("kept.record_id").alias("_kept"))
    joined = read_archives(spark, arc, arc_records).join(kept, "payload_digest", "left")
    revisit = (F.col("kind") == "response") & F.col("_kept").isNotNull() & (F.col("_kept") != F.col("record_id"))
    headers = F.expr("substring(block, 1, octet_length(block) - cast(payload_bytes as int))")
    rows = joined.select(
        "record_id",
        F.when(revisit, "revisit").otherwise(F.col("kind")).alias("kind"),
        "uri", "ip", "date", "content_type", "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, F.col("_kept")).alias("refers_to"),
        F.when(revisit, headers).otherwise(F.col("block")).alias("block"),
    )
    write_warc(rows, warc)


def captures(spark: SparkSession, warc: str) -> DataFrame:
    """What the WARC archives hold: page_id, payload_bytes, payload_digest, record_type, refers_to (page id of the record a revisit names)."""
    rows = read_archives(spark, warc, warc_records, blocks=False)
    named = rows.filter("kind != 'revisit'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"))
    return rows.join(named, F.col("refers_to") == F.col("_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("_page").alias("refers_to")
    )
