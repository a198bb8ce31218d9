"""Records, references and summaries as CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_FIELDS = ("archive_path", "offset", "capture_time_ns", "device", "sequence", "kind", "payload_size")
REF_FIELDS = ("archive_path", "archive_ordinal", "offset", "capture_time_ns", "device", "sequence", "payload_size")


def csv_line(*columns: str) -> Column:
    """Values joined by commas, unquoted."""
    return F.concat_ws(",", *[F.col(c).cast("string") for c in columns])


def record_csv(df: DataFrame, kind: bool = True, size: bool = True) -> DataFrame:
    """SNK2: a line per record."""
    fields = ["capture_time_ns", "device", "sequence"] + ["kind"] * kind + ["payload_size"] * size
    return df.select(csv_line(*fields).alias("line"))


def record_json(df: DataFrame) -> DataFrame:
    """SNK4: a JSON object per record, fields in a fixed order."""
    return df.select(F.to_json(F.struct(*RECORD_FIELDS)).alias("line"))


def ref_json(df: DataFrame) -> DataFrame:
    """SNK4: a JSON object per reference: it has the ordinal but no kind."""
    return df.select(F.to_json(F.struct(*REF_FIELDS)).alias("line"))


def ref_csv(df: DataFrame) -> DataFrame:
    """SNK4: a line per reference; its kind column says unknown."""
    return df.select(F.concat_ws(",", "archive_path", *[F.col(c).cast("string") for c in ("offset", "capture_time_ns", "device", "sequence")], F.lit("unknown"), F.col("payload_size").cast("string")).alias("line"))


def manifest_json(devices: DataFrame) -> DataFrame:
    """SNK5: an object per archive with its devices, which are as many as the
    archive has, in order of records and id."""
    entry = F.struct((-F.col("records")).alias("order"), "device", "records", "payload_bytes")
    rows = devices.groupBy("archive_path").agg(F.sum("records").cast("long").alias("records"), F.array_sort(F.collect_list(entry)).alias("devices"))
    plain = F.transform("devices", lambda d: F.struct(d["device"].alias("device"), d["records"].alias("records"), d["payload_bytes"].alias("payload_bytes")))
    return rows.select(F.to_json(F.struct("archive_path", "records", plain.alias("devices"))).alias("line"))


def text_table(df: DataFrame, most: int = 100) -> str:
    """SNK7: the first rows as a table with padded columns."""
    rows = [[str(x) for x in df.columns]] + [["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])
