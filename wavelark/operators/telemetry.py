"""Scalar observations: anomalies, calibration, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def observation_anomalies(readings: DataFrame, degraded_share: float = 0.25, z: float = 6.0) -> DataFrame:
    """TEL1: per device the degraded share and, per channel, the largest
    distance from the mean in deviations (none where they are 0)."""
    v = F.col("value").cast("double")
    per = readings.groupBy("device", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("quality") != "good").alias("bad"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("dev"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    score = F.when(F.col("dev") > 0, F.greatest(F.abs(F.col("lo") - F.col("mean")), F.abs(F.col("hi") - F.col("mean"))) / F.col("dev")).otherwise(0.0)
    rows = per.withColumn("score", score)
    return rows.groupBy("device").agg(F.round(F.sum("bad") / F.sum("n"), 6).alias("degraded"), F.round(F.max("score"), 6).alias("score")).withColumn("anomalous", (F.col("degraded") > degraded_share) | (F.col("score") > z))


def spectrum_anomalies(bins: DataFrame) -> DataFrame:
    """TEL2: frames whose power barely exceeds the noise, or saturates."""
    per = bins.groupBy("frame_id").agg(F.avg("power_dbm").alias("power"), F.avg("noise_dbm").alias("noise"), F.max("power_dbm").alias("top"))
    found = F.array_compact(F.array(F.when(F.col("power") - F.col("noise") < 3, "spectrum.low_snr"), F.when(F.col("top") >= 0, "spectrum.saturated")))
    return per.select("frame_id", F.explode(found).alias("code"))


def observation_findings(readings: DataFrame, degraded_share: float = 0.25, z: float = 6.0) -> DataFrame:
    """TEL1: (device, channel, code, score) of a device's readings: too large a
    share of degraded ones (no channel), and channels with a value further from
    their mean than z deviations."""
    v = F.col("value").cast("double")
    per = readings.groupBy("device", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("quality") != "good").alias("bad"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("dev"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    share = per.groupBy("device").agg((F.sum("bad") / F.sum("n")).alias("score")).where(F.col("score") > degraded_share)
    share = share.select("device", F.lit(None).cast("long").alias("channel"), F.lit("observation.degraded_ratio").alias("code"), F.round("score", 6).alias("score"))
    far = F.greatest(F.abs((F.col("lo") - F.col("mean")) / F.col("dev")), F.abs((F.col("hi") - F.col("mean")) / F.col("dev")))
    outliers = per.where("dev <> 0").withColumn("score", far).where(F.col("score") > z)
    return share.unionByName(outliers.select("device", F.col("channel").cast("long").alias("channel"), F.lit("observation.channel_outlier").alias("code"), F.round("score", 6).alias("score")))


def spectrum_findings(bins: DataFrame, least_snr: float = 3.0) -> DataFrame:
    """TEL2: (frame_id, code, score): frames without power or noise values, and
    otherwise those whose mean power barely exceeds the noise or that report
    power of 0 dBm and more."""
    per = bins.groupBy("frame_id").agg(F.count("power_dbm").alias("powers"), F.count("noise_dbm").alias("noises"), F.avg("power_dbm").alias("power"), F.avg("noise_dbm").alias("noise"), F.max("power_dbm").alias("top"))
    empty = (F.col("powers") == 0) | (F.col("noises") == 0)
    snr = F.col("power") - F.col("noise")
    made = lambda test, code, score: F.when(test, F.struct(F.lit(code).alias("code"), F.round(score, 6).alias("score")))
    found = F.array_compact(F.array(made(empty, "spectrum.empty", F.lit(1.0)), made(~empty & (snr < least_snr), "spectrum.low_snr", least_snr - snr), made(~empty & (F.col("top") >= 0), "spectrum.saturated", F.col("top"))))
    return per.select("frame_id", F.explode(found).alias("f")).select("frame_id", "f.*")


def calibrate(readings: DataFrame, table: DataFrame) -> DataFrame:
    """JN7/TEL3: gain and offset of the first entry of table (entry, channel,
    valid_from, valid_until: 0 open, gain, shift) that is valid at the
    reading; without one the quality says so. Values round half away from 0."""
    t = table.withColumnsRenamed({"channel": "cal_channel"})
    valid = (F.col("channel") == F.col("cal_channel")) & (F.col("time_ns") >= F.col("valid_from")) & ((F.col("valid_until") == 0) | (F.col("time_ns") < F.col("valid_until")))
    met = readings.select("reading_id", "channel", "time_ns").join(t, valid).groupBy("reading_id").agg(F.min(F.struct("entry", "gain", "shift")).alias("c"))
    rows = readings.join(met, "reading_id", "left")
    exact = F.col("value") * F.col("c.gain") + F.col("c.shift")
    whole = F.signum(exact) * F.floor(F.abs(exact) + 0.5)
    return rows.select("reading_id", "channel", F.coalesce(whole, F.col("value")).cast("int").alias("value"), F.when(F.col("c").isNull(), "missing_calibration").otherwise(F.col("quality")).alias("quality"))


def extract(readings: DataFrame, width: int) -> DataFrame:
    """TEL4: readings per tumbling window and channel."""
    start = F.expr(f"time_ns div {width} * {width}")
    return readings.groupBy(start.alias("start_ns"), "channel").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


def zero_crossings(iq: DataFrame) -> DataFrame:
    """WIN12: changes of sign of the in-phase component per window."""
    w = W.partitionBy("window_id").orderBy("n")
    rows = iq.select("window_id", ((F.col("i") >= 0) != (F.lag("i").over(w) >= 0)).alias("crosses"))
    return rows.groupBy("window_id").agg(F.count_if("crosses").alias("crossings"))
