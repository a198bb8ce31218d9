"""Spectra, bands and I/Q windows, a row per bin or sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The monitoring band plan. Name, lower and upper kHz, service,
# status, guard kHz; then rasters as first centre kHz, spacing Hz, bandwidth
# Hz, first and last channel.
BANDS = (
    ("FM broadcast", 87_500, 108_000, "broadcast", "primary", 100, ((87_600, 200_000, 180_000, 1, 102),)),
    ("VHF airband voice", 118_000, 137_000, "aeronautical", "primary", 25, ((118_000, 25_000, 8_000, 0, 759),)),
    ("NOAA weather radio", 162_400, 162_560, "weather", "primary", 5, ((162_400, 25_000, 16_000, 1, 7),)),
    ("VHF marine", 156_000, 163_000, "maritime", "primary", 25, ((156_000, 25_000, 16_000, 1, 280),)),
    ("VHF public safety", 150_000, 174_000, "public_safety", "shared", 12, ((150_000, 12_500, 11_000, 0, 1919),)),
    ("UHF land mobile", 420_000, 470_000, "land_mobile", "shared", 12, ((420_000, 12_500, 11_000, 0, 4000),)),
    ("2 m amateur", 144_000, 148_000, "amateur", "primary", 20, ((144_000, 12_500, 11_000, 0, 319),)),
    ("70 cm amateur", 430_000, 440_000, "amateur", "primary", 25, ((430_000, 25_000, 12_000, 0, 399),)),
    ("433 MHz ISM", 433_050, 434_790, "ism", "shared", 25, ((433_075, 25_000, 20_000, 0, 68),)),
    ("868 MHz SRD/LoRa", 863_000, 870_000, "telemetry", "shared", 100, ((863_100, 100_000, 125_000, 0, 68), (868_100, 200_000, 125_000, 70, 79))),
    ("900 MHz cellular downlink", 925_000, 960_000, "cellular", "primary", 100, ((925_100, 200_000, 180_000, 1, 174),)),
    ("900 MHz cellular uplink", 880_000, 915_000, "cellular", "primary", 100, ((880_100, 200_000, 180_000, 1, 174),)),
    ("1800 MHz cellular downlink", 1_805_000, 1_880_000, "cellular", "primary", 100, ((1_805_000, 100_000, 5_000_000, 0, 749),)),
    ("2.4 GHz ISM", 2_400_000, 2_483_500, "ism", "shared", 100, ((2_412_000, 5_000_000, 20_000_000, 1, 14),)),
    ("5.8 GHz ISM", 5_725_000, 5_875_000, "ism", "shared", 1_000, ((5_745_000, 20_000_000, 20_000_000, 0, 6),)),
    ("GNSS L1", 1_559_000, 1_610_000, "navigation", "protected_passive", 500, ((1_575_420, 1_000_000, 2_000_000, 0, 34),)),
    ("1090 MHz ADS-B", 1_089_000, 1_091_000, "aeronautical", "primary", 50, ((1_090_000, 1_000_000, 1_000_000, 0, 0),)),
    ("S-band satellite downlink", 2_200_000, 2_290_000, "satellite", "primary", 500, ((2_200_000, 500_000, 1_000_000, 0, 179),)),
    ("L-band radar", 1_000_000, 1_400_000, "radar", "primary", 1_000, ((1_000_000, 5_000_000, 5_000_000, 0, 79),)),
    ("1400 MHz passive weather", 1_400_000, 1_427_000, "weather", "protected_passive", 500, ((1_400_000, 1_000_000, 1_000_000, 0, 26),)),
)
#: Allocation statuses in rank order (fixed values).
STATUSES = ("primary", "shared", "protected_passive", "secondary", "experimental")


def allocations(spark: SparkSession) -> DataFrame:
    """RF9: the plan's allocations, twenty rows."""
    rows = [(b[0], b[1] * 1000, b[2] * 1000, b[3], b[4], b[5] * 1000, STATUSES.index(b[4])) for b in BANDS]
    return spark.createDataFrame(rows, "name string, lower_hz long, upper_hz long, service string, status string, guard_hz long, status_rank int")


def channels(spark: SparkSession) -> DataFrame:
    """RF9: raster channels that lie inside their allocation as a whole."""
    rows = [(b[0], b[1] * 1000, b[2] * 1000, b[3], r[0] * 1000, *r[1:]) for b in BANDS for r in b[6]]
    t = spark.createDataFrame(rows, "name string, lower_hz long, upper_hz long, service string, first_hz long, spacing_hz long, bandwidth_hz long, first_channel int, last_channel int")
    t = t.withColumn("number", F.explode(F.sequence("first_channel", "last_channel")))
    t = t.withColumn("center_hz", F.col("first_hz") + (F.col("number") - F.col("first_channel")) * F.col("spacing_hz"))
    half = F.expr("bandwidth_hz div 2")
    inside = (F.col("center_hz") - half >= F.col("lower_hz")) & (F.col("center_hz") + half + F.col("bandwidth_hz") % 2 <= F.col("upper_hz")) & (F.col("center_hz") < F.col("upper_hz"))
    return t.where(inside).select("name", "service", "number", "center_hz", "bandwidth_hz")


def guards(spark: SparkSession) -> DataFrame:
    """JN10: the guard ranges at either end of an allocation."""
    a = allocations(spark)
    low = a.select("name", F.col("lower_hz").alias("from_hz"), F.least(F.col("lower_hz") + F.col("guard_hz"), F.col("upper_hz")).alias("to_hz"))
    return low.union(a.select("name", F.greatest(F.col("upper_hz") - F.col("guard_hz"), F.col("lower_hz")), F.col("upper_hz")))


def best_allocation(points: DataFrame, frequency: str) -> DataFrame:
    """JN4: the allocation of every point: best status, then narrowest."""
    a = F.broadcast(allocations(points.sparkSession))  # twenty rows
    found = points.join(a, (F.col(frequency) >= F.col("lower_hz")) & (F.col(frequency) < F.col("upper_hz")), "left")
    best = F.min_by("name", F.struct("status_rank", F.col("upper_hz") - F.col("lower_hz"), "lower_hz"))
    return found.groupBy(*points.columns).agg(best.alias("allocation"))


def nearest_channel(points: DataFrame, frequency: str) -> DataFrame:
    """JN5: the raster channel nearest to every point, at any distance: ties go
    to the first allocation of the plan, then to the lower centre. A point lies
    between two of the plan's sorted centres, which a binary search in Arrow
    batches finds: neither a join nor a shuffle. A null frequency has no
    channel."""
    plan = sorted(range(len(BANDS)), key=lambda i: (BANDS[i][1], BANDS[i][2], BANDS[i][0]))
    found: dict[int, tuple[int, int, str]] = {}
    for order, (name, low, high, *_, rasters) in enumerate(BANDS[i] for i in plan):
        for first_khz, spacing, width, first, last in rasters:
            start = first_khz * 1000
            for n in range(last - first + 1):
                center = start + n * spacing
                if center - width // 2 >= low * 1000 and center + width // 2 + width % 2 <= high * 1000 and center < high * 1000:
                    found[center] = min(found.get(center, (order, first + n, name)), (order, first + n, name))
    centers = np.array(sorted(found), np.int64)
    orders = np.array([found[c][0] for c in centers.tolist()], np.int64)
    numbers = np.array([found[c][1] for c in centers.tolist()], np.int32)
    names = pa.array([found[c][2] for c in centers.tolist()], pa.string())

    def near(at: pa.Array) -> pa.Array:
        there = at.is_valid()
        f = at.fill_null(0).to_numpy(zero_copy_only=False)
        above = np.minimum(np.searchsorted(centers, f), len(centers) - 1)
        below = np.maximum(np.searchsorted(centers, f, "right") - 1, 0)
        off = [np.abs(centers[k] - f).astype(np.int64) for k in (below, above)]
        best = np.where((off[1] < off[0]) | ((off[1] == off[0]) & (orders[above] < orders[below])), above, below)
        delta = np.minimum(off[0], off[1])
        fields = [names.take(pa.array(best)), pa.array(numbers[best]), pa.array(delta)]
        return pa.StructArray.from_arrays(fields, ["name", "number", "delta_hz"], mask=pa.compute.invert(there))

    found_ = F.arrow_udf(near, "struct<name: string, number: int, delta_hz: long>")(F.col(frequency))
    best = points.withColumn("_best", found_)
    return best.select(*points.columns, F.col("_best.name").alias("channel_of"), F.col("_best.number").alias("channel"), F.col("_best.delta_hz").alias("delta_hz"))


def channel_number(frequency: Column, first_hz: int, spacing_hz: int, first: int, last: int) -> Column:
    """RF10: the raster channel nearest to a frequency, null outside."""
    n = F.lit(first) + F.floor((frequency - first_hz + spacing_hz // 2) / spacing_hz)
    return F.when((frequency >= first_hz) & (n <= last), n.cast("int"))


def guard_hits(points: DataFrame, frequency: str) -> DataFrame:
    """JN10: points inside a guard range."""
    from .intervals import overlapping

    met = overlapping(points.withColumn("next hz", F.col(frequency) + 1), guards(points.sparkSession), (frequency, "next hz"), ("from_hz", "to_hz"))
    return met.select(*points.columns, "name")


def _mw(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), dbm / 10)


def _dbm(mw: Column) -> Column:
    return F.when(mw <= 1e-18, -180.0).otherwise(F.log10(mw) * 10)


def _around(radius: int):
    return W.partitionBy("frame_id").orderBy("bin").rowsBetween(-radius, radius)


def smooth(bins: DataFrame, window: int = 5) -> DataFrame:
    """RF6/WIN11: power averaged in milliwatts over an odd window of bins."""
    return bins.withColumn("smooth_dbm", _dbm(F.avg(_mw(F.col("power_dbm"))).over(_around((window | 1) // 2))))


ESTIMATORS = ("median", "trimmed_mean", "percentile", "rolling_percentile")


def floor_by_bin(bins: DataFrame, window: int = 31, percentile: float = 20.0, smoothing: int = 5, estimator: str = "rolling_percentile", trim: float = 0.15) -> DataFrame:
    """RF2/WIN11: the rolling percentile floor, smoothed in milliwatts, or one of
    the constant ones of a frame: its median, the mean without a share `trim` of
    either end, its percentile; held to 3 dB over the reported noise where a
    frame reports any."""
    frame = W.partitionBy("frame_id")
    if estimator == "rolling_percentile":
        rows = bins.withColumn("rolled", F.percentile("power_dbm", percentile / 100).over(_around(max(1, window // 2))))
        rows = rows.withColumn("level", _dbm(F.avg(_mw(F.col("rolled"))).over(_around((smoothing | 1) // 2)))).drop("rolled")
    elif estimator == "trimmed_mean":
        rows = bins.withColumn("place", F.row_number().over(frame.orderBy("power_dbm"))).withColumn("size", F.count("*").over(frame))
        cut = F.floor(F.col("size") * min(max(trim, 0.0), 0.45))
        rows = rows.withColumn("level", F.avg(F.when((F.col("place") > cut) & (F.col("place") <= F.col("size") - cut), F.col("power_dbm"))).over(frame)).drop("place", "size")
    elif estimator in ESTIMATORS:
        share = 0.5 if estimator == "median" else percentile / 100
        rows = bins.withColumn("level", F.percentile("power_dbm", share).over(frame))
    else:
        raise ValueError(f"no estimator {estimator}")
    reported = F.max((F.abs("noise_dbm") > 1e-6).cast("int")).over(frame) == 1
    rows = rows.withColumn("reported", reported)
    held = F.when(F.col("reported"), F.least("level", F.col("noise_dbm") + 3)).otherwise(F.col("level"))
    return rows.withColumn("floor_dbm", held)


def noise_floor(bins: DataFrame, **how: object) -> DataFrame:
    """RF2: the floor, its deviation and slope per frame; how says which, as for
    floor_by_bin."""
    rows = floor_by_bin(bins, **how)
    per = rows.groupBy("frame_id").agg(
        F.avg("level").alias("level"),
        F.avg("noise_dbm").alias("noise"),
        F.max("reported").alias("reported"),
        F.percentile("power_dbm", 0.5).alias("median"),
        F.count("*").alias("n"),
        F.sum("floor_dbm").alias("s"),
        F.sum(F.col("floor_dbm") * F.col("floor_dbm")).alias("ss"),
        F.min_by("floor_dbm", "bin").alias("first"),
        F.max_by("floor_dbm", "bin").alias("last"),
        ((F.max("frequency_hz") - F.min("frequency_hz")) / 1e6).alias("span"),
    )
    f = F.when(F.col("reported"), F.least("level", F.col("noise") + 3)).otherwise(F.col("level"))
    per = per.withColumn("floor", f)
    spread = F.sqrt(F.greatest(F.col("ss") - F.col("floor") * 2 * F.col("s") + F.col("n") * F.col("floor") * F.col("floor"), F.lit(0.0)) / (F.col("n") - 1))
    return per.select("frame_id", F.round("floor", 6).alias("floor_dbm"), F.round("median", 6).alias("median_dbm"), F.round(F.when(F.col("n") > 1, spread).otherwise(0.0), 4).alias("deviation_db"), F.round(F.when(F.col("span") > 1e-9, (F.col("last") - F.col("first")) / F.col("span")).otherwise(0.0), 6).alias("slope_db_per_mhz"))


def occupancy(bins: DataFrame, margin: float = 6.0) -> DataFrame:
    """RF4: the share of bins above the floor, their margins; the largest
    margin is never negative."""
    rows = floor_by_bin(bins).withColumn("margin", F.col("power_dbm") - F.col("floor_dbm"))
    m = F.col("margin")
    return rows.groupBy("frame_id").agg(F.count("*").alias("bins"), F.count_if(m >= margin).alias("occupied"), F.round(F.count_if(m >= margin) / F.count("*"), 6).alias("ratio"), F.round(F.avg(m), 6).alias("mean_margin_db"), F.round(F.greatest(F.max(m), F.lit(0.0)), 6).alias("max_margin_db"))


def integrated_power(bins: DataFrame) -> DataFrame:
    """RF5: the power of all bins together, in dBm."""
    return bins.groupBy("frame_id").agg(F.round(_dbm(F.sum(_mw(F.col("power_dbm")))), 6).alias("power_dbm"))


def peaks(bins: DataFrame, snr: float = 6.0, most: int = 64, prominence: float = 6.0, edge_drop: float = 3.0, merge_gap_hz: float = 0.0, least_width: int = 1) -> DataFrame:
    """RF3/SRT4: local maxima that rise above the floor, the strongest `most`
    of a frame with their rank. A peak reaches on either side to the last bin
    before one that is under both the floor plus snr and the level edge_drop
    under the peak (never under the peak's own floor plus snr). With a
    merge_gap_hz peaks that are no further apart become one, of the strongest's
    centre. A frame's bins, one transform's length, are held in one array."""
    w = W.partitionBy("frame_id").orderBy("bin")
    p, left, right = F.col("power_dbm"), F.coalesce(F.lag("power_dbm").over(w), F.lit(float("-inf"))), F.coalesce(F.lead("power_dbm").over(w), F.lit(float("-inf")))
    top = (p >= left) & (p >= right) & ((p > left) | (p > right))
    point = F.struct("bin", F.col("frequency_hz").alias("hz"), p.alias("p"), F.col("floor_dbm").alias("f"), top.alias("top"))
    frames = floor_by_bin(bins).withColumn("point", point).groupBy("frame_id", "receiver", "time_ns").agg(F.sort_array(F.collect_list("point")).alias("all"))
    rows = frames.select("*", F.posexplode("all").alias("at", "c")).where(F.col("c.top") & (F.col("c.p") - F.col("c.f") >= max(snr, prominence)))
    size, c = F.size("all"), F.col("c")
    level = F.greatest(c["f"] + snr, c["p"] - edge_drop)
    under = F.transform("all", lambda x, i: F.when((x["p"] < level) & (x["p"] < x["f"] + snr), i))
    rows = rows.withColumn("under", F.array_compact(under))
    rows = rows.withColumn("lo", F.coalesce(F.array_max(F.filter("under", lambda i: i < F.col("at"))), F.lit(-1)) + 1)
    rows = rows.withColumn("hi", F.coalesce(F.array_min(F.filter("under", lambda i: i > F.col("at"))), size) - 1)
    span = F.slice("all", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)
    width_hz = F.coalesce(F.expr("(all[size(all) - 1].hz - all[0].hz) div nullif(size(all) - 1, 0)"), F.lit(0))
    rows = rows.withColumn("a", F.expr("all[lo]")).withColumn("z", F.expr("all[hi]")).withColumn("width", F.col("hi") - F.col("lo") + 1)
    mw = F.aggregate(span, F.lit(0.0), lambda t, x: t + _mw(x["p"]))
    tones = F.size(F.filter(span, lambda x: x["top"] & (x["p"] > x["f"] + 3)))
    uneven = F.abs((c["p"] - F.col("a.p")) - (c["p"] - F.col("z.p"))) > 6
    shape = F.when(F.col("width") <= 2, "narrowband").when(F.col("width") >= 12, F.when(c["p"] - (F.col("a.p") + F.col("z.p")) / 2 < 3, "flat_top").otherwise("wideband")).when(tones >= 3, "multi_tone").when(uneven, "shoulder").otherwise("narrowband")
    rows = rows.where(F.col("width") >= least_width).select(
        "frame_id", "receiver", "time_ns", c["bin"].alias("bin"), c["hz"].alias("frequency_hz"), c["p"].alias("power"), (c["p"] - c["f"]).alias("snr"), c["f"].alias("floor"),
        F.col("a.bin").alias("lower_bin"), F.col("z.bin").alias("upper_bin"), F.col("a.hz").alias("lower_hz"), F.col("z.hz").alias("upper_hz"), mw.alias("mw"), (F.col("z.hz") - F.col("a.hz") + width_hz).alias("bandwidth_hz"), shape.alias("shape"),
    )
    if merge_gap_hz > 0:
        by = W.partitionBy("frame_id").orderBy("lower_hz", "bin")
        apart = F.col("lower_hz") - F.max("upper_hz").over(by.rowsBetween(W.unboundedPreceding, -1)) > merge_gap_hz
        rows = rows.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
        first = F.min_by(F.struct("bin", "frequency_hz", "power", "snr", "floor"), F.struct(-F.col("power"), "lower_hz", "bin"))
        rows = rows.groupBy("frame_id", "receiver", "time_ns", "run").agg(
            first.alias("s"), F.min("lower_bin").alias("lower_bin"), F.max("upper_bin").alias("upper_bin"), F.min("lower_hz").alias("lower_hz"), F.max("upper_hz").alias("upper_hz"), F.sum("mw").alias("mw"),
            F.when(F.count("*") > 1, F.max("upper_hz") - F.min("lower_hz")).otherwise(F.max("bandwidth_hz")).alias("bandwidth_hz"), F.when(F.count("*") > 1, "wideband").otherwise(F.max("shape")).alias("shape"),
        ).select("*", "s.*")
    rows = rows.withColumn("snr_db", F.round("snr", 6))
    place = F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc("snr_db"), F.desc("power"), "bin"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(
        "frame_id", "receiver", "time_ns", "bin", "frequency_hz", F.round("power", 6).alias("power_dbm"), "snr_db", "place",
        "lower_bin", "upper_bin", "lower_hz", "upper_hz", F.round("floor", 6).alias("floor_dbm"), F.round(_dbm(F.col("mw")), 6).alias("integrated_dbm"), "bandwidth_hz", "shape",
    )


def intermodulation(found: DataFrame, tolerance: int = 2_000) -> DataFrame:
    """JN9: peaks near a second or third order product of two others; pairs
    are formed within a frame, whose peaks are capped."""
    p = found.select("frame_id", F.col("frequency_hz").alias("f"))
    a, b, c = p.alias("a"), p.alias("b"), p.alias("c")
    pairs = a.join(b, "frame_id").where("a.f < b.f").select("frame_id", F.col("a.f").alias("f1"), F.col("b.f").alias("f2"))
    products = F.array(F.col("f1") * 2 - F.col("f2"), F.col("f2") * 2 - F.col("f1"), F.col("f1") + F.col("f2"), F.col("f2") - F.col("f1"))
    made = pairs.select("frame_id", "f1", "f2", F.explode(products).alias("product")).where("product > 0")
    met = made.join(c, "frame_id").where((F.abs(F.col("f") - F.col("product")) <= tolerance) & (F.col("f") != F.col("f1")) & (F.col("f") != F.col("f2")))
    return met.select("frame_id", "f1", "f2", "product", F.col("f").alias("peak_hz"))


def calibration_best(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """JN6: the profile (id, receiver, lower_hz, upper_hz, valid_from,
    valid_until, points, source_bonus, uncertainty) with the best score for
    (receiver, frequency_hz, time_ns); ties to the lower range, then id."""
    met = points.join(profiles.withColumnRenamed("receiver", "p_receiver"), (F.col("receiver") == F.col("p_receiver")) & (F.col("frequency_hz") >= F.col("lower_hz")) & (F.col("frequency_hz") < F.col("upper_hz")))
    valid = (F.col("time_ns") >= F.col("valid_from")) & ((F.col("valid_until") == 0) | (F.col("time_ns") < F.col("valid_until")))
    score = F.lit(100.0) - F.when(valid, 0).otherwise(35) - F.when(F.col("points") < 2, 15).otherwise(0) + F.col("source_bonus") - F.least(F.col("uncertainty") * 4, F.lit(25.0))
    best = met.withColumn("score", score).groupBy(*points.columns).agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("lower_hz"), F.col("id"))).alias("b"))
    return points.join(best, points.columns, "left").select(*points.columns, F.col("b.id").alias("profile"), F.round("b.score", 6).alias("score"))


def iq_summary(iq: DataFrame, rate: float = 48_000.0, clip: float = 0.98) -> DataFrame:
    """RF14: size, offsets, imbalance and frequency offset of every window,
    over samples without their mean."""
    mean = W.partitionBy("window_id")
    rows = iq.withColumn("mi", F.avg("i").over(mean)).withColumn("mq", F.avg("q").over(mean))
    rows = rows.withColumn("ci", F.col("i") - F.col("mi")).withColumn("cq", F.col("q") - F.col("mq"))
    rows = rows.withColumn("mag", F.hypot("ci", "cq")).withColumn("phase", F.atan2("cq", "ci"))
    step = F.col("phase") - F.lag("phase").over(W.partitionBy("window_id").orderBy("n"))
    rows = rows.withColumn("step", F.when(step > F.pi(), step - F.pi() * 2).when(step < -F.pi(), step + F.pi() * 2).otherwise(step))
    clipped = (F.abs("ci") >= clip) | (F.abs("cq") >= clip) | (F.col("mag") >= clip)
    per = rows.groupBy("window_id").agg(
        F.count("*").alias("samples"),
        F.sqrt(F.avg(F.col("mag") * F.col("mag"))).alias("rms"),
        F.max("mag").alias("peak"),
        F.avg("i").alias("mi"),
        F.avg("q").alias("mq"),
        F.sum(F.col("ci") * F.col("ci")).alias("ii"),
        F.sum(F.col("cq") * F.col("cq")).alias("qq"),
        F.sum(F.col("ci") * F.col("cq")).alias("iq"),
        (F.count_if(clipped) / F.count("*")).alias("clipped"),
        F.avg("step").alias("step"),
    )
    spread = F.sqrt(F.col("ii") * F.col("qq"))
    corr = F.when(spread > 0, F.greatest(F.least(F.try_divide(F.col("iq"), spread), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    # a window without its mean may be silent: a ratio of nothing is -120 dB
    decibel = lambda a, b: F.when((a > 0) & (b > 0), F.log10(F.try_divide(a, b)) * 20).otherwise(-120.0)
    r = lambda c: F.round(c, 6)
    return per.select(
        "window_id",
        "samples",
        r(F.col("rms")).alias("rms"),
        r(F.col("peak")).alias("peak"),
        r(decibel(F.col("peak"), F.col("rms"))).alias("crest_db"),
        r(F.hypot("mi", "mq")).alias("dc_offset"),
        r(decibel(F.sqrt("ii"), F.sqrt("qq"))).alias("gain_imbalance_db"),
        r(F.degrees(F.asin(corr))).alias("phase_error_deg"),
        r(F.col("clipped")).alias("clipping_ratio"),
        F.round(F.col("step") * rate / (F.pi() * 2), 4).alias("frequency_offset_hz"),
    )


def iq_segments(iq: DataFrame, size: int) -> DataFrame:
    """RF15: rms and peak per segment of equal size."""
    mag = F.col("i") * F.col("i") + F.col("q") * F.col("q")
    return iq.groupBy("window_id", F.expr(f"n div {size}").cast("long").alias("segment")).agg(F.count("*").alias("samples"), F.round(F.sqrt(F.avg(mag)), 6).alias("rms"), F.round(F.sqrt(F.max(mag)), 6).alias("peak"))


def iq_normalised(iq: DataFrame, target: float = 0.5) -> DataFrame:
    """RF15: samples scaled so that their rms without the mean is target."""
    w = W.partitionBy("window_id")
    rows = iq.withColumn("v", F.var_pop("i").over(w) + F.var_pop("q").over(w))
    k = F.when(F.col("v") > 0, F.lit(target) / F.sqrt("v")).otherwise(1.0)
    return rows.select("window_id", "n", F.round(F.col("i") * k, 6).alias("i"), F.round(F.col("q") * k, 6).alias("q"))


def quality(spectra: DataFrame, usable: float = 10.0, excellent: float = 30.0, good_occupancy: float = 0.35) -> DataFrame:
    """RF16: a score from snr_db, occupancy, dynamic_db and penalty, with its
    grade."""
    clamp = lambda c: F.greatest(F.least(c, F.lit(100.0)), F.lit(0.0))
    snr = F.when(F.col("snr_db") <= usable, clamp(F.col("snr_db") / max(usable, 1.0) * 45)).otherwise(clamp((F.col("snr_db") - usable) / max(excellent - usable, 1.0) * 55 + 45))
    occ = F.when(F.col("occupancy") <= good_occupancy, 100.0).otherwise(clamp(100 - (F.col("occupancy") - good_occupancy) / max(1 - good_occupancy, 0.01) * 80))
    dyn = clamp(F.col("dynamic_db") / max(excellent, 1.0) * 100)
    rows = spectra.withColumn("score", F.round(clamp(snr * 0.45 + occ * 0.25 + dyn * 0.20 + 10 - F.col("penalty")), 6))
    s = F.col("score")
    return rows.withColumn("grade", F.when(s >= 90, "excellent").when(s >= 75, "good").when(s >= 60, "fair").when(s >= 40, "poor").otherwise("unusable"))


def trends(samples: DataFrame) -> DataFrame:
    """RF18: the slope per hour of (track, time_ns, value) and its direction;
    intermittent is the share of samples that are missing."""
    hours = F.col("time_ns") / 3.6e12
    per = samples.groupBy("track").agg(F.count("value").alias("n"), F.coalesce(F.regr_slope("value", hours), F.lit(0.0)).alias("slope"), F.min_by("value", "time_ns").alias("first"), F.max_by("value", "time_ns").alias("last"), (1 - F.count("value") / F.count("*")).alias("missing"))
    change = F.col("last") - F.col("first")
    direction = (
        F.when(F.col("missing") > 0.55, "intermittent")
        .when((F.col("first") == 0) & (F.col("last") != 0), "new_signal")
        .when((F.col("first") != 0) & (F.col("last") == 0), "disappeared")
        .when((F.col("slope") > 1) | (change > 3), "rising")
        .when((F.col("slope") < -1) | (change < -3), "falling")
        .otherwise("stable")
    )
    return per.select("track", "n", F.round("slope", 6).alias("slope"), direction.alias("trend"))


def sweep_segments(ranges: DataFrame, step_hz: int, dwell_us: int) -> DataFrame:
    """RF12: ranges (priority, lower_hz, upper_hz) cut into segments of at
    most step_hz, in the order of the sweep, with their dwell times."""
    rows = ranges.withColumn("at", F.explode(F.sequence("lower_hz", F.col("upper_hz") - 1, F.lit(step_hz).cast("long"))))
    return rows.select("priority", F.col("at").alias("from_hz"), F.least(F.col("at") + step_hz, F.col("upper_hz")).alias("to_hz"), F.lit(dwell_us).alias("dwell_us")).orderBy(F.desc("priority"), "from_hz")


def covered_width(ranges: DataFrame) -> DataFrame:
    """SET4: the length of the union of half-open ranges, per priority."""
    w = W.partitionBy("priority").orderBy("from_hz", "to_hz")
    reach = F.coalesce(F.max("to_hz").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("from_hz"))
    more = F.greatest(F.col("to_hz") - F.greatest(reach, F.col("from_hz")), F.lit(0))
    return ranges.withColumn("more", more).groupBy("priority").agg(F.sum("more").cast("long").alias("covered_hz"))


def format_hz(f: Column) -> Column:
    """RF19: a frequency in its unit."""
    return F.when(f >= 1_000_000_000, F.format_string("%.6f GHz", f / 1e9)).when(f >= 1_000_000, F.format_string("%.3f MHz", f / 1e6)).when(f >= 1_000, F.format_string("%.3f kHz", f / 1e3)).otherwise(F.format_string("%d Hz", f))


def apply_calibration(bins: DataFrame, profile: list[tuple[int, float, float]]) -> DataFrame:
    """RF11: gain and noise corrections of a profile (frequency, gain, noise),
    interpolated between its points and held beyond them."""
    points = sorted(profile)

    def at(k: int) -> Column:
        f = F.col("frequency_hz")
        value = F.lit(points[-1][k])
        for (f0, *a), (f1, *b) in reversed(list(zip(points, points[1:], strict=False))):
            value = F.when(f < f1, F.lit(a[k - 1]) + (f - f0) / (f1 - f0) * (b[k - 1] - a[k - 1])).otherwise(value)
        return F.when(f <= points[0][0], F.lit(points[0][k])).otherwise(value)

    return bins.select("frame_id", F.col("bin").cast("long").alias("bin"), F.round(F.col("power_dbm") + at(1), 6).alias("power_dbm"), F.round(F.col("noise_dbm") + at(2), 6).alias("noise_dbm"))
