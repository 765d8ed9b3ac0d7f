"""WARC archives with revisit resolution.

Headers (id, address, payload digest, length) are written down once and shuffled by digest: a grouped
minimum finds each repeated payload's original, and the records that repeat it become revisit records,
built from headers alone.  Responses are the pages without the revisits; their payloads move once, by
id and digest, into as many archives as the headers' lengths ask for at ``ARCHIVE_BYTES`` each.
Archives are written as plain record streams by Spark's own writer (any store, atomic commit, safe
re-runs of lost tasks) and parsed back by Content-Length, one record in memory at a time.

Defined cases: a null payload is empty; payloads under ``min_bytes`` are always responses; a null
page id is never an original nor a revisit; rows that share id and payload are alike (all responses
when they hold the smallest id); line breaks in an address are percent-encoded and a null address has
no target header; an empty table writes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.common import ARROW_BYTES, materialize, scratch, small_batches, workspace
from studyloom.llm.graph import join_hot

#: Payloads below this size are never replaced by a revisit record.
MIN_BYTES = 100
#: Bytes of records that an archive holds, by the mean over archives, and the most records in one file;
#: a reading task holds one file as it is stored (compressed) and one record.
ARCHIVE_BYTES, RECORDS_PER_FILE = 64 << 20, 50_000
#: Bytes of a record besides its payload, as an estimate.
HEADER_BYTES = 500
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def headers_of(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))


def revisits_of(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, digest, size, original) of the records that repeat an earlier payload; ``headers`` is a written table without payloads."""
    large = headers.filter(F.col("size") >= min_bytes).select("page_id", "url", "digest", "size")
    groups = materialize(large.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    return join_hot(large, groups, ["digest"], "copies", total).filter("page_id <> original").select("page_id", "url", "digest", "size", "original")


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the deduplicated archives of ``pages`` under ``path`` with fresh headers; returns the path."""
    with workspace(pages.sparkSession):
        _write_archives(pages, path, id_col, url_col, html_col, min_bytes, archive_bytes)
    return path


def _write_archives(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str, min_bytes: int, archive_bytes: int) -> None:
    spark = pages.sparkSession
    records = headers_of(pages, id_col, url_col, html_col)
    headers = materialize(records.drop("payload"))
    revisits = materialize(revisits_of(headers, min_bytes))
    total = headers.agg(F.sum(F.col("size") + HEADER_BYTES)).first()[0] or 0
    archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    keys = ["page_id", "digest"]
    responses = records.repartition(archives, *keys)
    if not revisits.isEmpty():
        responses = responses.join(revisits.select(*keys).distinct().repartition(archives, *keys).hint("shuffle_hash"), keys, "left_anti")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = [("WARC-Record-ID", urn("page_id")), ("WARC-Target-URI", address), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Payload-Length", F.col("size"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [*common, kind], F.concat(http, F.col("payload").cast("string")))
    revisit = _record("revisit", [*common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", urn("original")), kind], http)
    records = responses.select(response.alias("value")).unionByName(revisits.select(revisit.alias("value")))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of one archive, read as they come."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {stream.tell() - len(first)}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        yield headers, block
        stream.read(4)


def _bare(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") or None if urn else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, intact) of every record; the ids are text.

    ``intact`` says whether a response's payload still has the digest and length of its headers.
    """
    small_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                stream = io.BytesIO(data.as_buffer())
                packed = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                rows, held = [], 0
                for headers, block in parse_records(gzip.GzipFile(fileobj=stream) if packed else stream):
                    body = block.partition(b"\r\n\r\n")[2]
                    kind, size, digest = headers["warc-type"], int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha256:")
                    found = (len(body), hashlib.sha256(body).hexdigest()) if kind == "response" else (size, digest)
                    rows.append((_bare(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, _bare(headers.get("warc-refers-to")), body if payload and kind == "response" else None, *found, found == (size, digest)))
                    held += len(body) if payload else 0
                    if len(rows) == 500 or held > ARROW_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "intact"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, intact boolean")


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The records of the archives of ``pages``, read back; without a ``path`` the archives are deleted after that."""
    spark = pages.sparkSession
    id_type = pages.schema["page_id"].dataType.simpleString()
    with workspace(spark) as finish:
        records = read_archives(spark, write_archives(pages, path or scratch(spark)), payload=False)
        return finish(records.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type), "intact"))


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS g FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
  CASE WHEN n >= {MIN_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_BYTES} AND page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM m
"""
