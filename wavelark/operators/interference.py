"""Findings of interference from a frame's peaks, occupancy and noise floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals
from .rf import BANDS, STATUSES, intermodulation

#: The allocations of the band plan in which nobody may answer.
RECEIVE_ONLY = ("FM broadcast", "NOAA weather radio", "GNSS L1", "1090 MHz ADS-B", "S-band satellite downlink", "1400 MHz passive weather")
#: Services that only listen.
PASSIVE_SERVICES = ("navigation", "weather")
OVERLOAD_DBM, NARROWBAND_DB, PASSIVE_DB, BROADBAND_RATIO, BROADBAND_RISE_DB = -5.0, 12.0, 6.0, 0.55, 8.0
#: The fixed summaries of findings.
SUMMARIES = {
    "broadband_noise": "broadband energy raises occupancy or apparent noise floor",
    "overload": "very high RF power suggests receiver overload risk",
    "narrowband_carrier": "unexpected narrowband carrier",
    "adjacent_channel": "energy falls in allocation guard range",
    "co_channel": "emission observed in protected or receive-only allocation",
    "expected": "expected signal deviates from nominal power",
    "intermodulation": "peak aligns with two-tone intermodulation product",
}
COLUMNS = ("frame_id", "bin", "kind", "severity", "lower_hz", "upper_hz", "excess_db", "confidence", "allocation", "summary")


def severity(excess: Column) -> Column:
    return F.when(excess >= 30, "critical").when(excess >= 20, "high").when(excess >= 10, "medium").when(excess >= 3, "low").otherwise("info")


def _certain(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 9)


def allocation_of(frequency: Column) -> Column:
    """The plan's allocation of a frequency: best status, then narrowest, then
    lowest. Twenty comparisons, so neither a join nor an exchange."""
    best = sorted(BANDS, key=lambda b: (STATUSES.index(b[4]), b[2] - b[1], b[1]))
    out = F.when(F.lit(False), F.lit(""))
    for name, low, high, *_ in best:
        out = out.when((frequency >= low * 1000) & (frequency < high * 1000), name)
    return out


def in_guard(allocation: Column, low: Column, high: Column) -> Column:
    """Whether a range overlaps a guard range of its allocation."""
    out = F.lit(False)
    for name, lower, upper, _, _, guard, _ in BANDS:
        lower, upper, guard = lower * 1000, upper * 1000, guard * 1000
        start = upper - guard if upper > guard else lower
        near = (low < min(lower + guard, upper)) & (high > lower)
        if upper > start > lower:
            near |= (low < upper) & (high > start)
        out = F.when(allocation == name, near).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_passive(allocation: Column) -> Column:
    names = [b[0] for b in BANDS if b[4] == "protected_passive" or b[3] in PASSIVE_SERVICES or b[0] in RECEIVE_ONLY]
    return F.coalesce(allocation.isin(*names), F.lit(False))


def _finding(rows: DataFrame, kind: str | Column, level: Column, excess: Column, confidence: Column, allocation: Column, summary: str | Column) -> DataFrame:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        "frame_id", F.col("bin").cast("int").alias("bin"), column(kind).alias("kind"), level.alias("severity"), F.col("lower_hz").cast("long").alias("lower_hz"), F.col("upper_hz").cast("long").alias("upper_hz"),
        F.round(excess, 6).alias("excess_db"), _certain(confidence).alias("confidence"), allocation.cast("string").alias("allocation"), column(summary).alias("summary"),
    )


def _ranged(peaks: DataFrame) -> DataFrame:
    """Peaks with half-open ranges."""
    return peaks.withColumn("upper_hz", F.col("upper_hz") + 1)


def broadband(bins: DataFrame, occupied: DataFrame, noise: DataFrame) -> DataFrame:
    """Frames whose occupancy or risen floor shows energy all over them."""
    width = F.coalesce(F.expr("(max(frequency_hz) - min(frequency_hz)) div nullif(count(1) - 1, 0)"), F.lit(0))
    spans = bins.groupBy("frame_id").agg(F.min("frequency_hz").alias("lower_hz"), (F.max("frequency_hz") + width).alias("upper_hz"))
    rise = F.col("floor_dbm") - F.col("median_dbm")
    rows = occupied.join(noise, "frame_id").where((F.col("ratio") >= BROADBAND_RATIO) | (rise >= BROADBAND_RISE_DB)).join(spans, "frame_id").withColumn("bin", F.lit(-1))
    excess = F.greatest(rise, F.col("mean_margin_db"))
    return _finding(rows, "broadband_noise", severity(excess), excess, F.col("ratio") + F.greatest(F.lit(0.0), rise) / 25, F.lit(None), SUMMARIES["broadband_noise"])


def of_peaks(peaks: DataFrame) -> DataFrame:
    """A peak's overload, or else whichever apply: an unexpected narrowband
    carrier, energy in a guard range of its allocation, an emission in a passive
    one. Its allocation is that of its centre, or of its lower or upper edge."""
    rows = _ranged(peaks).withColumn("allocation", F.coalesce(allocation_of(F.col("frequency_hz")), allocation_of(F.col("lower_hz")), allocation_of(F.col("upper_hz") - 1)))
    over, snr, allocation = F.col("power_dbm") >= OVERLOAD_DBM, F.col("snr_db"), F.col("allocation")
    named = lambda test, kind, level: F.when(test, F.struct(F.lit(kind).alias("kind"), level.alias("severity"), F.lit(SUMMARIES[kind]).alias("summary")))
    kinds = F.array(
        named(over, "overload", F.lit("critical")),
        named(~over & (F.col("shape") == "narrowband") & (snr >= NARROWBAND_DB), "narrowband_carrier", severity(snr)),
        named(~over & in_guard(allocation, F.col("lower_hz"), F.col("upper_hz")), "adjacent_channel", F.lit("medium")),
        named(~over & is_passive(allocation) & (snr >= PASSIVE_DB), "co_channel", F.lit("high")),
    )
    rows = rows.withColumn("found", F.explode(F.array_compact(kinds)))
    return _finding(rows, F.col("found.kind"), F.col("found.severity"), snr, 0.35 + snr / 40, allocation, F.col("found.summary"))


def expected_ranges(expected: DataFrame) -> DataFrame:
    """expected signals (signal, nominal_dbm, tolerance_db, and low_hz, high_hz or
    center_hz, bandwidth_hz) with the range that they occupy."""
    have = set(expected.columns)
    if "center_hz" not in have:
        return expected.select("signal", "nominal_dbm", "tolerance_db", "low_hz", "high_hz")
    half = F.expr("bandwidth_hz div 2")
    own = [F.greatest(F.col("center_hz") - half, F.lit(0)), F.col("center_hz") + half + F.col("bandwidth_hz") % 2]
    if "low_hz" in have:
        given = F.coalesce(F.col("low_hz") < F.col("high_hz"), F.lit(False))
        own = [F.when(given, F.col(c)).otherwise(x) for c, x in zip(("low_hz", "high_hz"), own, strict=True)]
    return expected.select("signal", "nominal_dbm", "tolerance_db", own[0].alias("low_hz"), own[1].alias("high_hz"))


def mismatches(peaks: DataFrame, expected: DataFrame) -> DataFrame:
    """JN8: peaks whose range overlaps an expected signal's and whose power is off
    by more than its tolerance; off_db is the deviation, excess_db what exceeds
    the tolerance."""
    met = intervals.overlapping(_ranged(peaks), expected_ranges(expected), ("lower_hz", "upper_hz"), ("low_hz", "high_hz"))
    off = F.round(F.col("power_dbm") - F.col("nominal_dbm"), 6)
    return met.withColumn("off_db", off).withColumn("excess_db", F.round(F.abs(off) - F.col("tolerance_db"), 6)).where("excess_db > 0")


def findings(bins: DataFrame, peaks: DataFrame, occupied: DataFrame, noise: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """RF8: all findings of frames: broadband noise, those of single peaks,
    deviations from expected signals and intermodulation products. peaks are
    read several times."""
    out = broadband(bins, occupied, noise).unionByName(of_peaks(peaks))
    if expected is not None:
        off = mismatches(peaks, expected)
        out = out.unionByName(_finding(off, "co_channel", severity(F.col("excess_db")), F.col("excess_db"), 0.5 + F.col("excess_db") / 30, F.lit(None), SUMMARIES["expected"]))
    products = intermodulation(peaks).select("frame_id", F.col("peak_hz").alias("frequency_hz"))
    rows = _ranged(peaks).join(products, ["frame_id", "frequency_hz"])
    return out.unionByName(_finding(rows, "intermodulation", F.lit("medium"), F.col("snr_db"), 0.55 + F.col("snr_db") / 50, F.lit(None), SUMMARIES["intermodulation"]))
