"""AGG16, PLN14: all statistics of archives as one long table, from one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch
from . import joins
from .sequences import _in_time

#: The report's columns and types; a part leaves those null that it hasn't.
COLUMNS = {
    "part": "string", "device": "long", "kind": "string", "archive_path": "string", "other_path": "string", "start_ns": "long", "end_ns": "long", "records": "long", "payload_bytes": "long", "archives": "long",
    "average": "double", "share": "double", "least": "long", "p50": "long", "p90": "long", "p99": "long", "most": "long", "previous_sequence": "long", "sequence": "long", "detail": "string",
}
_KEY = "part string, device long, kind string, archive_path string, at_ns long, payload_size long, previous_ns long, previous_path string, previous_sequence long, sequence long, detail string"


def partials(df: DataFrame, width: int, gap: int) -> DataFrame:
    """The scan: every record counts in a cell (device and kind), a slice (bucket
    of time and archive), its archive and its payload size, and is a gap or an
    anomaly by the record of its device before it. Tasks combine what they have
    before anything is exchanged."""
    w = _in_time()
    s, before = F.col("sequence"), F.col("previous_sequence")
    rows = df.select("*", F.lag("capture_time_ns").over(w).alias("previous_ns"), F.lag("archive_path").over(w).alias("previous_path"), F.lag("sequence").over(w).alias("previous_sequence"))
    # the fixed reasons
    reason = F.when(s == before, "duplicate sequence").when(s < before, "sequence moved backwards").when(s > before + 1, "sequence gap")
    bucket = F.col("capture_time_ns") - F.pmod(F.col("capture_time_ns"), F.lit(max(width, 1)))
    names = {c.split()[0]: c.split()[1] for c in _KEY.split(", ")}

    def entry(part: str, **own: Column) -> Column:
        return F.struct(*[(F.lit(part) if c == "part" else own.get(c, F.lit(None)).cast(kind)).alias(c) for c, kind in names.items()])

    col = F.col
    entries = F.array(
        entry("cell", device=col("device"), kind=col("kind")),
        entry("slice", at_ns=bucket, archive_path=col("archive_path")),
        entry("archive", archive_path=col("archive_path")),
        entry("size", payload_size=col("payload_size")),
        F.when(col("capture_time_ns") - col("previous_ns") > gap, entry("gap", device=col("device"), at_ns=col("capture_time_ns"), previous_ns=col("previous_ns"), archive_path=col("archive_path"), previous_path=col("previous_path"))),
        F.when(reason.isNotNull(), entry("anomaly", device=col("device"), at_ns=col("capture_time_ns"), archive_path=col("archive_path"), previous_sequence=before, sequence=s, detail=reason)),
    )
    each = rows.select(F.explode(F.array_compact(entries)).alias("e"), "capture_time_ns", col("payload_size").alias("bytes"))
    return each.groupBy("e").agg(F.count("*").alias("records"), F.sum("bytes").cast("long").alias("payload_bytes"), F.min("capture_time_ns").alias("first_ns"), F.max("capture_time_ns").alias("last_ns")).select("e.*", "records", "payload_bytes", "first_ns", "last_ns")


def _part(rows: DataFrame, part: str, **own: str | Column) -> DataFrame:
    cells = [(F.lit(part) if c == "part" else (F.col(own[c]) if isinstance(own[c], str) else own[c]) if c in own else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    return rows.select(*cells)


def statistics(df: DataFrame, width: int, gap: int, overlaps: bool = False) -> DataFrame:
    """The report: rows of the parts summary (with the density as its averages:
    records and bytes an archive are quotients of its columns), archive, bucket,
    device (ranking and timeline), cell, percentiles, gap and anomaly; with
    overlaps also overlap, which takes a second scan for the records in them.

    df is read once: what is combined from it is written, and all parts come
    from that. An empty df gives a summary of zeros only.
    """
    held = scratch.kept(partials(df, width, gap), "statistics")
    part = lambda name: held.where(F.col("part") == name)
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    per = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    archives = part("archive")
    one = archives.agg(F.count("*").alias("archives"), add("records"), add("payload_bytes"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    devices = part("cell").groupBy("device").agg(add("records"), add("payload_bytes"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    total = one.select(F.col("payload_bytes").alias("total"))
    ranked = devices.crossJoin(F.broadcast(total))  # one row
    buckets = part("slice").groupBy("at_ns").agg(F.count("*").alias("archives"), add("records"), add("payload_bytes"))
    # sizes are few: a packet has a largest one
    by_size = W.partitionBy("part").orderBy("payload_size")
    sizes = part("size").withColumn("upto", F.sum("records").over(by_size)).withColumn("n", F.sum("records").over(W.partitionBy("part")))
    rank = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1) + 0.5), F.col("payload_size")))
    percentiles = sizes.groupBy("part").agg(F.min("payload_size").alias("least"), F.max("payload_size").alias("most"), rank(0.5).alias("p50"), rank(0.9).alias("p90"), rank(0.99).alias("p99"), add("records"), add("payload_bytes"))
    parts = [
        _part(one, "summary", archives="archives", records="records", payload_bytes="payload_bytes", start_ns="first_ns", end_ns="last_ns", average=per("payload_bytes", "records")),
        _part(archives, "archive", archive_path="archive_path", records="records", payload_bytes="payload_bytes", start_ns="first_ns", end_ns="last_ns"),
        _part(buckets, "bucket", start_ns="at_ns", end_ns=F.col("at_ns") + (max(width, 1) - 1), records="records", payload_bytes="payload_bytes", archives="archives"),
        _part(ranked, "device", device="device", records="records", payload_bytes="payload_bytes", start_ns="first_ns", end_ns="last_ns", share=per("payload_bytes", "total"), average=per("payload_bytes", "records")),
        _part(part("cell"), "cell", device="device", kind="kind", records="records"),
        _part(percentiles, "percentiles", records="records", least="least", p50="p50", p90="p90", p99="p99", most="most", average=per("payload_bytes", "records")),
        _part(part("gap"), "gap", device="device", start_ns="previous_ns", end_ns="at_ns", archive_path="archive_path", other_path="previous_path", records="records"),
        _part(part("anomaly"), "anomaly", device="device", start_ns="at_ns", archive_path="archive_path", previous_sequence="previous_sequence", sequence="sequence", detail="detail", records="records"),
    ]
    if overlaps:
        catalog = archives.select("archive_path", F.col("first_ns").alias("first_time_ns"), F.col("last_ns").alias("last_time_ns"))
        met = joins.overlaps(df, catalog)
        parts.append(_part(met, "overlap", archive_path="left_archive_path", other_path="right_archive_path", start_ns="start_ns", end_ns="end_ns", records=F.col("left_records") + F.col("right_records"), least=F.least("left_records", "right_records"), most=F.greatest("left_records", "right_records")))
    return reduce(DataFrame.unionByName, parts)
