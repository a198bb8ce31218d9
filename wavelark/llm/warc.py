"""Content-addressed WARC archive.

An archive is two tables in the shared folder: `payloads` holds the bytes of
every distinct payload once, under their SHA-256; `headers` holds the exact
header block of every record and the digest of its payload. Records come back
through a join on the digest; a digest is verified when it is stored (all
payloads that share it must agree in length and in a second hash) and again
from the stored bytes whenever they are read.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: Payloads below this many bytes are never made revisits.
LEAST_BYTES = 100
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the values, the same in every run."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    pieces = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; control characters that
    would end the line are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives one record per row below path.

    The payload is the text in UTF-8 (null: empty). Of equal payloads of at
    least LEAST_BYTES bytes the row with the smallest id becomes the response,
    every other row a revisit that refers to it; rows that repeat that
    smallest id are responses as well. Smaller payloads are all responses. A
    row without an id is a revisit if another row has the payload and an id,
    else a response. A null url leaves its header line out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    second = F.xxhash64("payload")
    store = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("id").alias("first_id"), F.min(second).alias("low"), F.max(second).alias("high"), F.min(F.octet_length("payload")).alias("short"), F.max(F.octet_length("payload")).alias("long"))
    sound = (F.col("low") == F.col("high")) & (F.col("short") == F.col("long"))
    store = store.withColumn("digest", F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("different payloads share the digest "), F.col("digest")))))
    store.select("digest", "payload", "first_id").write.option("compression", "zstd").parquet(f"{path}/payloads")

    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    rows = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes")).join(first, "digest")
    again = (F.col("bytes") >= LEAST_BYTES) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(again, "revisit").otherwise("response")
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", record_id(F.lit("record"), F.col("id"), F.col("url"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Profile", F.when(again, PROFILE)),
        field("X-Page-Id", F.col("id")),
        field("X-Refers-To-Page-Id", F.when(again, F.col("first_id"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    rows.select(header.cast("binary").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archived records: header, its fields, and the payload in full.

    payload_bytes and payload_digest come from the stored bytes; a payload
    that doesn't match the digest it is stored under fails the query.
    """
    text = F.col("header").cast("string")
    value = lambda name: F.nullif(F.regexp_extract(text, f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    heads = spark.read.parquet(f"{path}/headers").select(
        "header",
        "digest",
        value("X-Page-Id").cast("long").alias("page_id"),
        value("WARC-Type").alias("record_type"),
        value("WARC-Target-URI").alias("url"),
        value("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
    )
    found = F.sha2("payload", 256)
    store = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest"))).alias("payload_digest"),
    )
    return heads.join(store, "digest").drop("digest")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record binary): every record as it stands in a WARC file, but for the
    two line ends that close it."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read(spark, path).select(F.concat("header", body).alias("record"))


def export(spark: SparkSession, path: str, to: str) -> None:
    """Plain WARC files: records are the lines of a text file whose line end
    is the pair of line ends that closes a record."""
    records(spark, path).select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(to)


def load(spark: SparkSession, paths: str) -> DataFrame:
    """(header, content) of the records in WARC files, plain or gzipped.

    A file is read by one task, as its record lengths chain; archives are
    cut into files for that reason. Bytes that start no record are an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                stream = io.BytesIO(data)
                stream = gzip.open(stream) if data[:2] == b"\x1f\x8b" else stream
                heads, bodies = [], []
                while line := stream.readline():
                    if line == b"\r\n":
                        continue
                    if not line.startswith(b"WARC/"):
                        raise ValueError("no WARC record starts here")
                    lines = [line]
                    while (line := stream.readline()) not in (b"\r\n", b""):
                        lines.append(line)
                    head = b"".join([*lines, b"\r\n"])
                    size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    heads.append(head)
                    bodies.append(stream.read(int(size[1])) if size else b"")
                yield pd.DataFrame({"header": heads, "content": bodies})

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(parse, "header binary, content binary")


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages to a new archive in the shared folder and reads it back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **columns)
    return read(pages.sparkSession, path)
