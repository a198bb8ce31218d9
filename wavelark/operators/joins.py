"""Correlations between archives, snapshots, plans and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.adapters import KINDS
from .intervals import levels_of, overlapping


def overlaps(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """JN1: archives whose time ranges overlap, with the records of either in
    the overlap. The catalog has one row per archive. A side's records are the
    difference of two running counts over its archive's times, so that records
    meet the bounds of overlaps in order, not every overlap."""
    c = catalog.select("archive_path", "first_time_ns", (F.col("last_time_ns") + 1).alias("end_ns"))
    left, right = (c.select(*[F.col(x).alias(f"{side}_{x}") for x in c.columns]) for side in ("left", "right"))
    pairs = overlapping(left, right, ("left_first_time_ns", "left_end_ns"), ("right_first_time_ns", "right_end_ns"), levels=levels_of((c, "first_time_ns", "end_ns"))).where("left_archive_path < right_archive_path")
    key = ["left_archive_path", "right_archive_path", "start_ns", "end_ns"]
    pairs = pairs.select(*key[:2], F.greatest("left_first_time_ns", "right_first_time_ns").alias("start_ns"), (F.least("left_end_ns", "right_end_ns") - 1).alias("end_ns"))
    # at one time a start comes before the records and an end behind them
    bound = lambda side, at, rank: F.struct(F.lit(side).alias("side"), F.col(f"{side}_archive_path").alias("archive_path"), F.col(at).alias("at"), F.lit(rank).alias("rank"))
    bounds = pairs.select(F.struct(*key).alias("pair"), F.explode(F.array(*[bound(s, at, r) for s in ("left", "right") for at, r in (("start_ns", 0), ("end_ns", 2))])).alias("b")).select("pair", "b.*")
    times = df.groupBy("archive_path", F.col("capture_time_ns").alias("at")).agg(F.count("*").alias("n")).withColumn("rank", F.lit(1))
    by = W.partitionBy("archive_path").orderBy("at", "rank").rowsBetween(W.unboundedPreceding, 0)
    seen = bounds.withColumn("n", F.lit(0).cast("long")).unionByName(times, allowMissingColumns=True).withColumn("seen", F.sum("n").over(by)).where("pair IS NOT NULL")
    count = lambda side: F.sum(F.when(F.col("side") == side, F.when(F.col("rank") == 2, F.col("seen")).otherwise(-F.col("seen")))).alias(f"{side}_records")
    out = seen.groupBy("pair").agg(count("left"), count("right")).select("pair.*", "left_records", "right_records")
    return out.withColumn("span_ns", F.col("end_ns") - F.col("start_ns"))


def _change(part: str, a: str, b: str) -> Column:
    return F.when(F.col(a).isNull(), f"{part}_added").when(F.col(b).isNull(), f"{part}_removed").otherwise(f"{part}_changed")


def device_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN2: devices added, removed or changed between two manifests."""
    per = lambda df, side: df.groupBy("device").agg(F.count("*").alias(f"{side}_records"), F.sum("payload_size").cast("long").alias(f"{side}_bytes"))
    both = per(left, "left").join(per(right, "right"), "device", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = both.where(~(F.col("left_records").eqNullSafe(F.col("right_records")) & F.col("left_bytes").eqNullSafe(F.col("right_bytes"))))
    return both.select("device", _change("device", "left_records", "right_records").alias("change"), (zero("right_records") - zero("left_records")).alias("records_delta"), (zero("right_bytes") - zero("left_bytes")).alias("bytes_delta"))


def kind_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN2: kind counts that differ between two manifests."""
    per = lambda df, side: df.groupBy("kind").agg(F.count("*").alias(f"{side}_records"))
    both = per(left, "left").join(per(right, "right"), "kind", "full_outer").where(~F.col("left_records").eqNullSafe(F.col("right_records")))
    return both.select("kind", _change("kind", "left_records", "right_records").alias("change"), (F.coalesce("right_records", F.lit(0)) - F.coalesce("left_records", F.lit(0))).alias("records_delta"))


def summary_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN2: a row summary_changed if the records or the time range of two
    manifests differ."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    one = lambda df, side: df.agg(F.count("*").alias(f"{side}_n"), zero(F.min("capture_time_ns")).alias(f"{side}_first"), zero(F.max("capture_time_ns")).alias(f"{side}_last"), zero(F.sum("payload_size")).alias(f"{side}_bytes"))
    both = one(left, "left").crossJoin(one(right, "right"))  # one row each
    text = lambda side: F.format_string("records=%d first=%d last=%d", f"{side}_n", f"{side}_first", f"{side}_last")
    same = (F.col("left_n") == F.col("right_n")) & (F.col("left_first") == F.col("right_first")) & (F.col("left_last") == F.col("right_last"))
    return both.where(~same).select(F.lit("summary_changed").alias("change"), text("left").alias("before"), text("right").alias("after"), (F.col("right_n") - F.col("left_n")).alias("records_delta"), (F.col("right_bytes") - F.col("left_bytes")).alias("bytes_delta"))


def warning_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET7: distinct warnings that only one side has."""
    gone = left.select("warning").subtract(right.select("warning")).withColumn("change", F.lit("warning_removed"))
    return gone.unionByName(right.select("warning").subtract(left.select("warning")).withColumn("change", F.lit("warning_added")))


def device_archives(df: DataFrame) -> DataFrame:
    """JN15: a finding each time a device turns up in a further archive."""
    seen = df.select("device", "archive_ordinal", "archive_path").distinct()
    w = W.partitionBy("device").orderBy("archive_ordinal")
    return seen.withColumn("before", F.lag("archive_path").over(w)).where("before IS NOT NULL").select("device", F.col("before").alias("previous_path"), "archive_path")


def compare_snapshots(before: DataFrame, after: DataFrame, key: str = "series") -> DataFrame:
    """JN3: latest value of every series on either side, change and trend."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by("value", F.struct("time_ns", "ordinal")).alias(name))
    both = last(before, "previous").join(last(after, "current"), key, "full_outer")
    change = F.col("current") - F.col("previous")
    flat = F.abs(F.col("previous")) < 1e-6
    relative = F.when(flat, F.when(F.col("current") == 0, 0.0).otherwise(1.0)).otherwise(change / F.abs(F.col("previous")))
    trend = F.when(F.col("previous").isNull() | F.col("current").isNull(), "missing").when(F.abs(change) < 1e-6, "flat").when(change > 0, "rising").otherwise("falling")
    return both.select(key, "previous", "current", F.round(change, 6).alias("change"), F.round(relative, 6).alias("relative"), trend.alias("trend"))


def superseded(df: DataFrame) -> DataFrame:
    """JN13: records below their device's highest sequence."""
    top = df.groupBy("device").agg(F.max("sequence").alias("highest"))
    return df.join(top, "device").where("sequence < highest")


def all_kinds(df: DataFrame) -> DataFrame:
    """A row for every kind name with its rank."""
    return df.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(KINDS)], "kind string, rank int")
