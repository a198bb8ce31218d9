"""Spectrum history: the last observations of every receiver, peaks joined into
tracks over them, occupancy trends and findings.

A receiver's history is a ring of so many observations, so its rows are few
however long it has listened: the ring is cut by rank before anything else is
computed, which Spark does in every task before the exchange.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rf

MOST, TOLERANCE_HZ = 128, 25_000
HOUR_NS = 3_600_000_000_000
PEAK = "struct<frequency_hz:long,power_dbm:double,snr_db:double>"
POINT = "receiver int, track int, frame_id long, time_ns long, frequency_hz long, power_dbm double, snr_db double"
TRACK = "receiver int, track int, nominal_hz long, lower_hz long, upper_hz long, points int, persistence double, mean_dbm double, slope_db_per_hour double, drift_hz long, trend string"


def latest(frames: DataFrame, most: int = MOST) -> DataFrame:
    """The ring: rows of the last `most` frames of every receiver; of equal times
    the larger frame_id is the later. frames may have several rows a frame."""
    one = frames.select("receiver", "time_ns", "frame_id").distinct()
    place = F.row_number().over(W.partitionBy("receiver").orderBy(F.desc("time_ns"), F.desc("frame_id")))
    kept = one.withColumn("place", place).where(F.col("place") <= max(most, 1))
    return frames.join(kept.select("receiver", "frame_id"), ["receiver", "frame_id"], "left_semi")


def observations(bins: DataFrame, most: int = MOST) -> DataFrame:
    """(receiver, frame_id, time_ns, ratio, peaks) of the ring's frames: the share
    of occupied bins, and the peaks, strongest first."""
    ring = latest(bins, most)
    frames = ring.select("receiver", "frame_id", "time_ns").distinct()
    cell = F.struct("place", F.col("frequency_hz").cast("long").alias("frequency_hz"), "power_dbm", "snr_db")
    peaks = rf.peaks(ring).groupBy("frame_id").agg(F.array_sort(F.collect_list(cell)).alias("peaks"))
    peaks = peaks.select("frame_id", F.transform("peaks", lambda p: p.dropFields("place")).alias("peaks"))
    rows = frames.join(rf.occupancy(ring).select("frame_id", "ratio"), "frame_id", "left").join(peaks, "frame_id", "left")
    return rows.select("receiver", "frame_id", "time_ns", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("peaks", F.array().cast(f"array<{PEAK}>")).alias("peaks"))


def follow(rows: Iterable[tuple[int, int, list[tuple[int, float, float]]]], tolerance: int = TOLERANCE_HZ) -> list[tuple[int, list[tuple]]]:
    """Tracks of one receiver's observations (frame, time, peaks): (nominal
    frequency, points). In order of time every peak goes to the track whose
    nominal frequency, the upper median of its points', is nearest and within
    tolerance, the oldest of equal ones; else it opens one."""
    seen: list[list[int]] = []
    points: list[list[tuple]] = []
    nominal = np.zeros(0, np.int64)
    for frame, time, peaks in sorted(rows, key=lambda r: (r[1], r[0])):
        for frequency, power, snr in peaks:
            apart = np.abs(nominal - frequency)
            best = int(apart.argmin()) if len(apart) else -1
            if best < 0 or apart[best] > tolerance:
                best = len(seen)
                seen.append([])
                points.append([])
                nominal = np.append(nominal, frequency)
            insort(seen[best], frequency)
            nominal[best] = seen[best][len(seen[best]) // 2]
            points[best].append((frame, time, frequency, power, snr))
    return list(zip(nominal.tolist(), points, strict=True))


def slope_per_hour(samples: list[tuple[int, float]]) -> float:
    """The least-squares slope of (time, value) samples."""
    if len(samples) < 2:
        return 0.0
    x = np.array([max(0, t - samples[0][0]) / HOUR_NS for t, _ in samples])
    y = np.array([v for _, v in samples])
    below = len(x) * (x * x).sum() - x.sum() ** 2
    return float((len(x) * (x * y).sum() - x.sum() * y.sum()) / below) if abs(below) >= 1e-12 else 0.0


def direction(slope: float, first: float, last: float, missing: float = 0.0) -> str:
    if missing > 0.55:
        return "intermittent"
    if first == 0 and last != 0:
        return "new_signal"
    if first != 0 and last == 0:
        return "disappeared"
    if slope > 1 or last - first > 3:
        return "rising"
    return "falling" if slope < -1 or last - first < -3 else "stable"


def summaries(receiver: int, rows: list[tuple[int, int, list]], tolerance: int = TOLERANCE_HZ) -> tuple[list[tuple], list[tuple]]:
    """SUP21: a receiver's finished tracks, most persistent and then strongest
    first, and their points."""
    tracks = []
    for nominal, points in follow(rows, tolerance):
        powers, frequencies = [p[3] for p in points], [p[2] for p in points]
        share, slope = len(points) / len(rows), slope_per_hour([(p[1], p[3]) for p in points])
        trend = direction(slope, powers[0], powers[-1], 1 - share)
        tracks.append((nominal, min(frequencies), max(frequencies) + 1, len(points), share, sum(powers) / len(powers), slope, max(frequencies) - min(frequencies), trend, points))
    tracks.sort(key=lambda t: (-t[4], -t[5]))
    told = [(receiver, n, *t[:-1]) for n, t in enumerate(tracks)]
    return told, [(receiver, n, *p) for n, t in enumerate(tracks) for p in t[-1]]


def _rows(part: pd.DataFrame) -> list[tuple[int, int, list]]:
    peaks = [[(p["frequency_hz"], p["power_dbm"], p["snr_db"]) for p in x] for x in part["peaks"]]
    return list(zip(part["frame_id"].tolist(), part["time_ns"].tolist(), peaks, strict=True))


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def points(observed: DataFrame, tolerance: int = TOLERANCE_HZ) -> DataFrame:
    """RF17: which track every peak of the ring is on."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(summaries(int(part["receiver"].iloc[0]), _rows(part), tolerance)[1], columns=_columns(POINT))

    return observed.groupBy("receiver").applyInPandas(run, POINT)


def tracks(observed: DataFrame, tolerance: int = TOLERANCE_HZ) -> DataFrame:
    """RF17, SUP21: the finished tracks of every receiver's ring. A group holds
    one ring, MOST observations of 64 peaks at most."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(summaries(int(part["receiver"].iloc[0]), _rows(part), tolerance)[0], columns=_columns(TRACK))

    return observed.groupBy("receiver").applyInPandas(run, TRACK)


def strongest(tracks_: DataFrame, limit: int, least_persistence: float = 0.0) -> DataFrame:
    """SRT5: a receiver's tracks of the largest mean power among persistent ones;
    ties to the more persistent."""
    place = F.row_number().over(W.partitionBy("receiver").orderBy(F.desc("mean_dbm"), F.desc("persistence"), "track"))
    return tracks_.where(F.col("persistence") >= least_persistence).withColumn("place", place).where(F.col("place") <= limit)


def in_range(tracks_: DataFrame, lower_hz: int, upper_hz: int) -> DataFrame:
    """SRT6: tracks whose observed range overlaps [lower_hz, upper_hz), most
    persistent first, then by nominal frequency."""
    meets = (F.col("lower_hz") < upper_hz) & (F.col("upper_hz") > lower_hz) | F.col("nominal_hz").between(lower_hz, upper_hz - 1)
    return tracks_.where(meets).orderBy(F.desc("persistence"), "nominal_hz", "receiver", "track")


def with_trend(tracks_: DataFrame, trend: str) -> DataFrame:
    """SRT6: tracks of a trend, steepest first, then strongest."""
    return tracks_.where(F.col("trend") == trend).orderBy(F.desc(F.abs("slope_db_per_hour")), F.desc("mean_dbm"), "receiver", "track")


def occupancy_trend(observed: DataFrame, value: str = "ratio") -> DataFrame:
    """The first, last and mean share of a receiver's ring, its slope an hour and
    its direction."""
    at = F.struct("time_ns", "frame_id")
    per = observed.groupBy("receiver").agg(
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.avg(value).alias("mean"), F.coalesce(F.regr_slope(value, F.col("time_ns") / HOUR_NS), F.lit(0.0)).alias("slope"), F.count("*").alias("observations"),
    )
    change = F.col("last") - F.col("first")
    trend = F.when((F.col("first") == 0) & (F.col("last") != 0), "new_signal").when((F.col("first") != 0) & (F.col("last") == 0), "disappeared")
    trend = trend.when((F.col("slope") > 1) | (change > 3), "rising").when((F.col("slope") < -1) | (change < -3), "falling").otherwise("stable")
    return per.select("receiver", "observations", "first", "last", "mean", F.col("slope").alias("slope_per_hour"), trend.alias("trend"))


def findings(tracks_: DataFrame, occupancy: DataFrame, quality: DataFrame | None = None, tolerance: int = TOLERANCE_HZ) -> DataFrame:
    """RF17: (receiver, finding), in the fixed texts. quality is the trend of
    quality scores, as occupancy_trend gives it."""
    near, text = rf.format_hz(F.col("nominal_hz")), lambda x: F.format_string("%.6f", x)
    line = lambda rows, *parts: rows.select("receiver", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("finding"))
    slope = F.col("slope_db_per_hour")
    rising = tracks_.where("trend = 'rising'")
    out = [
        line(tracks_.where("trend = 'new_signal'"), "new persistent peak near ", near),
        line(rising.where(slope > 6), "rapidly rising peak near ", near),
        line(tracks_.where(F.col("drift_hz") > tolerance), "frequency drift exceeds match tolerance near ", near),
        line(occupancy.where("trend = 'rising'"), "spectrum occupancy is rising"),
        line(strongest(tracks_, 3, 0.75), "persistent carrier near ", near, " at ", text(F.col("mean_dbm")), " dBm mean"),
        line(rising, "rising carrier near ", near, " slope ", text(slope), " dB/hour"),
        line(occupancy.where("trend <> 'stable'"), "occupancy is ", F.col("trend"), " from ", text(F.col("first")), " to ", text(F.col("last"))),
    ]
    if quality is not None:
        out.append(line(quality.where("slope_per_hour < -5"), "quality score is degrading over time"))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows
