"""WARC archives with revisit records.

Payload digests are computed column-wise; headers (digest, id, length) are shuffled by digest, the record of the largest id in each
group of equal payloads is the response, and the others join to it as revisits. Records are built as column
expressions and written as archive files by Spark's text writer, whose line separator is the blank lines that end a
WARC record; the payload of a revisit is not written. Archives are compressed files of a bounded number of records, and read as such.

Defined results: a null payload is empty; payloads under min_bytes are all responses; among repeated rows of the largest id one
is the response and the others revisit it; a null id is smaller than any id, and is no id when read back; control signs and spaces in a URL are
percent-encoded; a null URL is written as urn:none; a damaged record is left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import dropped, place, written

#: Bytes of payload in an archive file, about.
ARCHIVE_BYTES = 16 << 20
_END = "\r\n\r\n"
#: The base32 alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, payload binary, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four signs for each five hexadecimal digits."""
    number = lambda k: F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 10).cast("int")
    sign = lambda v, shift: F.substring(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(sign(number(k), shift) for k in range(8) for shift in (15, 10, 5, 0)))


def resolve_headers(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """rid, record_type, and of a revisit the response's rid, page_id and url. headers: rid, page_id, url, digest, size."""
    able = headers.filter(F.col("size") >= min_bytes)
    first = able.groupBy("digest").agg(F.max(F.struct("page_id", "rid", "url")).alias("o"), F.count("*").alias("copies")).filter("copies > 1")
    joined = able.join(first, "digest").filter(F.col("rid") != F.col("o.rid"))
    return joined.select("rid", F.col("o.rid").alias("of_rid"), F.col("o.page_id").alias("of_page"), F.col("o.url").alias("of_url"))


def _record_id(rid: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", rid.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    """The URL without signs that would break a header line."""
    safe = F.coalesce(url, F.lit("urn:none"))
    for sign in ("%", "\r", "\n", "\t", " "):
        safe = F.when(F.instr(safe, sign) > 0, F.replace(safe, F.lit(sign), F.lit(f"%{ord(sign):02X}"))).otherwise(safe)
    return safe


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row to archive files under path. date: of the records, the time of writing if there's none."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("size"), base32_sha1(body.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    rows = written(rows, "warc-rows")  # a row's number must stay the same for what follows
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    per_file = max(1, int(archive_bytes * total["n"] / max(1, total["bytes"] or 1)))
    revisits = resolve_headers(rows.select("rid", "page_id", "url", "digest", "size"), min_bytes)
    both = rows.join(revisits, "rid", "left")
    again = F.col("of_rid").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("rid"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))),
        maybe(again, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        maybe(again, line("WARC-Refers-To", _record_id(F.col("of_rid"), F.col("digest")))),
        maybe(again, line("WARC-Refers-To-Target-URI", _uri(F.col("of_url")))),
        maybe(again, line("WARC-Refers-To-Date", F.lit(date))),
        maybe(F.col("url").isNull(), line("X-No-URL", F.lit("1"))),
        maybe(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))),
        maybe(again & F.col("of_page").isNotNull(), line("X-Refers-To-Page-ID", F.col("of_page").cast("string"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    both.select(F.concat(head, block).alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    dropped(rows)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, found by Content-Length; it goes on at the next record after a damaged one."""
    at = data.find(b"WARC/1.")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = head.get("content-length", "")
        stop = end + 4 + int(size) if size.isdigit() else -1
        if stop >= 0 and data[stop : stop + 4] == b"\r\n\r\n":
            yield head, data[end + 4 : stop]
            at = stop + 4 if data[stop + 4 : stop + 11] == b"WARC/1." else data.find(b"WARC/1.", stop + 4)
        else:
            at = data.find(b"\r\n\r\nWARC/1.", at)
            at = at + 4 if at >= 0 else -1


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parsed(head: dict[str, str], block: bytes) -> dict:
    _, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(head[name]) if name in head else None
    revisit = head.get("warc-type") == "revisit"
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    intact = head.get("warc-block-digest", "").removeprefix("sha1:") == _digest(block) and (revisit or _digest(payload) == digest)
    return {
        "page_id": number("x-page-id"), "url": None if "x-no-url" in head else unquote(head.get("warc-target-uri", "")), "record_type": head.get("warc-type"),
        "payload_digest": digest, "payload_bytes": number("x-payload-length") if revisit else len(payload), "refers_to": number("x-refers-to-page-id"),
        "record_id": head.get("warc-refers-to" if revisit else "warc-record-id"), "payload": None if revisit else payload, "intact": intact,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; record_id of a revisit is that of its response, payload is null there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in records(gzip.decompress(data.as_py())):
                    rows.append(_parsed(head, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """The records with every revisit's payload taken from its response."""
    of = records.filter("record_type = 'response'").select("record_id", F.col("payload").alias("own"))
    return records.join(of, "record_id", "left").withColumn("payload", F.coalesce("payload", "own")).drop("own")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = place(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
