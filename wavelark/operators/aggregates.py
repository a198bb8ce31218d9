"""Aggregations over packets and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.adapters import kind_rank


def _total(name: str) -> Column:
    return F.sum(name).cast("long")


def device_summary(df: DataFrame) -> DataFrame:
    """AGG1: records, time range and payload of every device."""
    return df.groupBy("device").agg(F.count("*").alias("records"), F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"), _total("payload_size").alias("payload_bytes")).orderBy(F.desc("records"), "device")


def manifest_archives(df: DataFrame) -> DataFrame:
    """AGG2: what a manifest observes of every archive."""
    return df.groupBy("archive_path").agg(F.count("*").alias("records"), F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"), F.countDistinct("device").alias("devices"), _total("payload_size").alias("payload_bytes")).orderBy("archive_path")


def manifest_kinds(df: DataFrame) -> DataFrame:
    """AGG2: kind counts per archive, most frequent first."""
    return df.groupBy("archive_path", "kind").agg(F.count("*").alias("records")).orderBy("archive_path", F.desc("records"), kind_rank(F.col("kind")))


def manifest_devices(df: DataFrame) -> DataFrame:
    """SNK3: device rows of every archive's manifest."""
    return df.groupBy("archive_path", "device").agg(F.count("*").alias("records"), F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"), _total("payload_size").alias("payload_bytes"))


def manifest_order_warnings(df: DataFrame) -> DataFrame:
    """AGG2: one warning per record older than the one before it."""
    before = F.lag("capture_time_ns").over(W.partitionBy("archive_path").orderBy("offset"))
    late = df.withColumn("before", before).where(F.col("capture_time_ns") < F.col("before"))
    return late.select("archive_path", "offset", F.lit("record out of time order").alias("warning"))


def catalog(df: DataFrame) -> DataFrame:
    """One row per archive: path, time range, records."""
    return df.groupBy("archive_path").agg(F.count("*").alias("records"), F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"), _total("payload_size").alias("payload_bytes"))


def catalog_summary(df: DataFrame) -> DataFrame:
    """AGG3: totals over all archives."""
    return df.agg(F.countDistinct("archive_path").alias("archives"), F.count("*").alias("records"), F.countDistinct("device").alias("devices"), F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"))


def device_coverage(df: DataFrame) -> DataFrame:
    """AGG4: per device its records and in how many archives they are."""
    return df.groupBy("device").agg(F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"), F.count("*").alias("records"), F.countDistinct("archive_ordinal").alias("archives")).orderBy(F.desc("records"), "device")


def archives_for_device(df: DataFrame, device: int) -> DataFrame:
    """AGG5: a device's archives in order of first appearance."""
    first = F.min(F.struct("capture_time_ns", "archive_ordinal", "offset")).alias("first")
    return df.where(F.col("device") == device).groupBy("archive_path").agg(first).orderBy("first").select("archive_path", F.col("first.capture_time_ns").alias("first_time_ns"))


def time_buckets(df: DataFrame, width: int) -> DataFrame:
    """AGG6/STR4: counts per bucket of integer nanoseconds."""
    width = max(width, 1)
    start = F.col("capture_time_ns") - F.pmod(F.col("capture_time_ns"), F.lit(width))
    return df.groupBy(start.alias("start_ns")).agg(F.count("*").alias("records"), _total("payload_size").alias("payload_bytes"), F.countDistinct("archive_ordinal").alias("archives")).withColumn("end_ns", F.col("start_ns") + (width - 1)).orderBy("start_ns")


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], group: list[str]) -> DataFrame:
    """Values at the rounded position share * (n - 1), from counts per distinct
    value, so that no group's values are gathered in one place."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*group).orderBy(value)
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*group)))
    at = lambda p: F.floor(F.lit(p) * (F.col("total") - 1) + 0.5)
    picked = [F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()]
    return counts.groupBy(*group).agg(*picked)


def payload_percentiles(df: DataFrame) -> DataFrame:
    """AGG7: payload statistics per kind, percentiles by nearest rank."""
    ranks = nearest_rank(df, "payload_size", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["kind"])
    whole = df.groupBy("kind").agg(F.min("payload_size").alias("least"), F.max("payload_size").alias("most"), F.round(F.avg("payload_size"), 6).alias("average"))
    return whole.join(ranks, "kind")


def payload_ranking(df: DataFrame) -> DataFrame:
    """AGG8: devices by payload, with their share of all payload."""
    per = df.groupBy("device").agg(F.count("*").alias("records"), _total("payload_size").alias("payload_bytes"))
    total = per.agg(F.sum("payload_bytes").alias("total"))
    share = F.when(F.col("total") > 0, F.round(F.col("payload_bytes") / F.col("total"), 6)).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select("device", "records", "payload_bytes", share.alias("share"), F.round(F.col("payload_bytes") / F.col("records"), 6).alias("average")).orderBy(F.desc("payload_bytes"), F.desc("records"), "device")  # total is one row


def density(df: DataFrame) -> DataFrame:
    """AGG9: records and bytes per archive and record."""
    one = df.agg(F.countDistinct("archive_path").alias("archives"), F.count("*").alias("records"), F.coalesce(_total("payload_size"), F.lit(0)).alias("payload_bytes"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return one.select("*", ratio("records", "archives").alias("records_per_archive"), ratio("payload_bytes", "archives").alias("bytes_per_archive"), ratio("payload_bytes", "records").alias("bytes_per_record"))


def device_kinds(df: DataFrame) -> DataFrame:
    """AGG10: counts per device and kind."""
    return df.groupBy("device", "kind").agg(F.count("*").alias("records")).orderBy("device", kind_rank(F.col("kind")))


def payload_histogram(df: DataFrame, width: int) -> DataFrame:
    """AGG11: payload sizes in buckets of equal width."""
    bucket = F.expr(f"payload_size div {max(width, 1)}")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("records")).select((F.col("bucket") * width).alias("low"), (F.col("bucket") * width + (width - 1)).alias("high"), "records").orderBy("low")


def batch_summary(df: DataFrame) -> DataFrame:
    """AGG12: totals of a batch of packets."""
    return df.agg(F.count("*").alias("packets"), _total("payload_size").alias("payload_bytes"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def running_stats(df: DataFrame, value: Column, group: list[str]) -> DataFrame:
    """AGG13: count, range, mean and sample deviation (0 below two samples);
    m2 is the sum of squared deviations."""
    v = value.cast("double")
    return df.groupBy(*group).agg(
        F.count(v).alias("n"),
        F.round(F.min(v), 6).alias("least"),
        F.round(F.max(v), 6).alias("most"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.var_pop(v) * F.count(v), 3).alias("m2"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("deviation"),
    )


def observation_stats(readings: DataFrame) -> DataFrame:
    """AGG14: per channel, over scaled readings; degraded ones are not good."""
    scaled = readings.withColumn("scaled", F.col("value") * F.pow(F.lit(10.0), F.col("scale")))
    stats = running_stats(scaled, F.col("scaled"), ["channel"])
    degraded = readings.groupBy("channel").agg(F.count_if(F.col("quality") != "good").alias("degraded"))
    return stats.join(degraded, "channel").drop("m2").orderBy("channel")


def spectrum_stats(bins: DataFrame) -> DataFrame:
    """AGG15: power and noise of every frame; the first strongest and weakest
    bin."""
    p = F.col("power_dbm")
    return bins.groupBy("frame_id").agg(
        F.count("*").alias("bins"),
        F.round(F.min(p), 6).alias("power_min"),
        F.round(F.max(p), 6).alias("power_max"),
        F.round(F.avg(p), 6).alias("power_mean"),
        F.round(F.coalesce(F.stddev_samp(p), F.lit(0.0)), 6).alias("power_deviation"),
        F.round(F.avg("noise_dbm"), 6).alias("noise_mean"),
        F.min_by("bin", F.struct(-p, F.col("bin"))).cast("int").alias("strongest_bin"),
        F.min_by("bin", F.struct(p, F.col("bin"))).cast("int").alias("weakest_bin"),
    )


def manifest_payload(df: DataFrame) -> DataFrame:
    """AGG17: payload bytes of every archive."""
    return df.groupBy("archive_path").agg(_total("payload_size").alias("payload_bytes"))


def extremes(df: DataFrame) -> DataFrame:
    """SRT2: the smallest payload (earliest of ties) and the largest (latest)."""
    cols = ["capture_time_ns", "device", "sequence", "payload_size", "offset"]
    low = df.orderBy("payload_size", "capture_time_ns", "offset").limit(1).select(F.lit("smallest").alias("which"), *cols)
    high = df.orderBy(F.desc("payload_size"), F.desc("capture_time_ns"), "offset").limit(1).select(F.lit("largest").alias("which"), *cols)
    return low.union(high)


def top_batch(df: DataFrame, n: int) -> DataFrame:
    """SRT1: packets by timestamp, device and sequence."""
    return df.select("timestamp_ns", "device", "sequence", "offset").orderBy("timestamp_ns", "device", "sequence", "offset").limit(n)


#: States of a registered device (fixed values).
LIFECYCLES = ("unknown", "provisioned", "active", "quarantined", "retired")


def fleet(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """RT6: every device that is registered (device, lifecycle) or was seen: when,
    how often, and its last packet's kind. The lifecycle is the registered one;
    a device that was only seen is active."""
    last = F.max_by("kind", F.struct("capture_time_ns", "offset"))
    seen = df.groupBy("device").agg(F.min("capture_time_ns").alias("first_seen_ns"), F.max("capture_time_ns").alias("last_seen_ns"), F.count("*").alias("packets"), last.alias("last_kind"))
    if registry is None:
        return seen.withColumn("lifecycle", F.lit("active"))
    known = registry.select("device", F.coalesce("lifecycle", F.lit("unknown")).alias("registered"))
    both = seen.join(known, "device", "full_outer").na.fill(0, ["packets"])
    return both.withColumn("lifecycle", F.coalesce("registered", F.lit("active"))).drop("registered")


def fleet_summary(devices: DataFrame) -> DataFrame:
    """AGG26: all devices, those of three states, and all packets."""
    of = lambda s: F.count_if(F.col("lifecycle") == s).alias(f"{s}_devices")
    return devices.agg(F.count("*").alias("total_devices"), of("active"), of("quarantined"), of("retired"), F.coalesce(_total("packets"), F.lit(0)).alias("packets_seen"))
