"""WARC archives in which equal payloads are stored once.

Headers (page, digest, length) are shuffled by payload digest; each digest's smallest page is the original, and the other
pages' records become revisits that refer to it. Records are built and written by Spark's own writer, so the archives can
lie in any store Spark reaches and a lost task is written again. Reading parses each file by its content lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are stored each time.
LEAST_BYTES = 100
#: Records of one archive file; a file is read as a whole.
RECORDS_PER_FILE = 2000

_CRLF = "\r\n"
#: The WARC 1.1 names.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Each page's digest, length, record type and, for revisits, the page it refers to.

    Only headers are shuffled. Originals are found with map-side minima, so a digest that many pages share is no hot spot
    there; the join back to the headers is one that Spark splits where a digest is too frequent.
    """
    heads = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    originals = (
        heads.where(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"))
        .where(F.col("last") > F.col("original"))
        .select("digest", "original")
    )
    revisit = F.col("original").isNotNull() & (F.col("page_id") > F.col("original"))
    return (
        heads.distinct()
        .join(originals, "digest", "left")
        .select("page_id", "digest", "bytes", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), F.when(revisit, F.col("original")).alias("original"))
    )


def _header(name: str, value: Column) -> Column:
    """One header line, nothing for NULL. A value's own line ends become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(_CRLF)), F.lit(""))


def _record(date: str) -> Column:
    is_revisit = F.col("kind") == "revisit"
    page = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), _header("Content-Length", F.col("bytes")), F.lit(_CRLF))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"{_VERSION}{_CRLF}"),
        _header("WARC-Type", F.col("kind")),
        _header("WARC-Record-ID", page),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(is_revisit, F.lit(_PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        _header("Content-Length", F.octet_length(block)),
        F.lit(_CRLF),
        block,
    )


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE, date: str | None = None, compression: str = "gzip") -> None:
    """Writes one record per row of `pages` (page_id, url, html; other columns are ignored) as archives below `path`.

    The payload is the html in UTF-8, empty for NULL. Of payloads with at least `least_bytes` bytes that are equal, the
    one of the smallest page_id is a response and those of larger ones revisit it. Rows that repeat a page_id and its
    payload get the same type. A page without page_id is always a response. An empty table gives no records. `compression`
    is `gzip` or `none`.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    kinds = resolve(rows, least_bytes).withColumnRenamed("page_id", "of_page").withColumnRenamed("digest", "of_digest")
    full = rows.withColumn("digest", F.sha2("payload", 256))
    records = full.join(kinds, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    (
        records.select(_record(stamp).alias("value"))
        .write.option("lineSep", _CRLF * 2)
        .option("maxRecordsPerFile", records_per_file)
        .option("compression", compression)
        .text(path)
    )


def _number(value: str | None) -> int | None:
    """The page of a record id."""
    return int(value[len("<urn:page:") : -1]) if value and value != "<urn:page:>" else None


def records(stream: BinaryIO) -> Iterator[dict]:
    """The records of one archive, one at a time: headers by lower-case name, and `block`."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where {first[:40]!r} stands")
        head = {}
        while line := stream.readline().decode("utf-8").rstrip(_CRLF):
            name, _, value = line.partition(": ")
            head[name.lower()] = value
        yield head | {"block": stream.read(int(head["content-length"]))}
        stream.read(len(_CRLF * 2))


def _parsed(stream: BinaryIO) -> Iterator[tuple]:
    for r in records(stream):
        http, _, payload = r["block"].partition(b"\r\n\r\n")
        stated = next(int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
        digest = r["warc-payload-digest"].removeprefix("sha256:")
        if r["warc-type"] == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {r['warc-record-id']}")
        yield _number(r["warc-record-id"]), stated, digest, r["warc-type"], _number(r.get("warc-refers-to")), r.get("warc-target-uri")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`; responses are checked against their digest and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_py())
                # Unpacked as it is read: a task holds the packed file and one record.
                rows = list(_parsed(gzip.GzipFile(fileobj=raw) if raw.getvalue()[:2] == b"\x1f\x8b" else raw))
                if rows:
                    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, SCHEMA)
