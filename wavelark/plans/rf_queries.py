"""Spectrum, band and I/Q queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import interference as I
from ..operators import intervals
from ..operators import rf as R
from ..operators import sweeps
from ..operators import telemetry as T
from ..sources import adapters as A
from ..sources import scratch

TABLE: dict = {}


def bins(name, build, sql, more="") -> None:
    TABLE[name] = (lambda s, d: build(A.bins(s, d)), None if sql is None else f"WITH {A.BINS_SQL}{', ' + more if more else ''} {sql}")


def iq(name, build, sql) -> None:
    TABLE[name] = (lambda s, d: build(A.iq(s, d)), f"WITH {A.IQ_SQL} {sql}")


_ALLOC = "alloc(name, lower_hz, upper_hz, service, status, guard_hz, status_rank) AS (VALUES " + ", ".join(f"('{b[0]}', {b[1] * 1000}, {b[2] * 1000}, '{b[3]}', '{b[4]}', {b[5] * 1000}, {R.STATUSES.index(b[4])})" for b in R.BANDS) + ")"
_RASTER = "raster(name, lower_hz, upper_hz, service, first_hz, spacing_hz, bandwidth_hz, a, z) AS (VALUES " + ", ".join(f"('{b[0]}', {b[1] * 1000}, {b[2] * 1000}, '{b[3]}', {r[0] * 1000}, {r[1]}, {r[2]}, {r[3]}, {r[4]})" for b in R.BANDS for r in b[6]) + ")"
_CHAN = f"{_RASTER}, chan AS (SELECT name, service, CAST(n AS INTEGER) AS number, CAST(first_hz + (n - a) * spacing_hz AS BIGINT) AS center_hz, CAST(bandwidth_hz AS BIGINT) AS bandwidth_hz FROM (SELECT *, unnest(range(a, z + 1)) AS n FROM raster) WHERE first_hz + (n - a) * spacing_hz - bandwidth_hz // 2 >= lower_hz AND first_hz + (n - a) * spacing_hz + bandwidth_hz // 2 + bandwidth_hz % 2 <= upper_hz AND first_hz + (n - a) * spacing_hz < upper_hz)"
_FLOOR = """rolled AS (SELECT *, quantile_cont(power_dbm, 0.2) OVER (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS r FROM bins),
    levels AS (SELECT *, log10(avg(pow(10.0, r / 10)) OVER (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) * 10 AS level FROM rolled), floors AS (SELECT *, least(level, noise_dbm + 3) AS floor_dbm FROM levels)"""

bins("rf1_slice", lambda b: b.select("frame_id", F.col("bin").cast("long").alias("bin"), "frequency_hz", F.round("power_dbm", 3).alias("power_dbm")), "SELECT frame_id, bin, frequency_hz, round(power_dbm, 3) AS power_dbm FROM bins")
bins(
    "rf2_noise_floor",
    R.noise_floor,
    """SELECT frame_id, round(f, 6) AS floor_dbm, round(median, 6) AS median_dbm, round(sqrt(sum_sq / (n - 1)), 4) AS deviation_db, round((z - a) / span, 6) AS slope_db_per_mhz FROM (SELECT frame_id, any_value(f) AS f, quantile_cont(power_dbm, 0.5) AS median, sum((floor_dbm - f) * (floor_dbm - f)) AS sum_sq, count(*) AS n,
    last(floor_dbm ORDER BY bin) AS z, first(floor_dbm ORDER BY bin) AS a, (max(frequency_hz) - min(frequency_hz)) / 1e6 AS span FROM (SELECT *, least(avg(level) OVER (PARTITION BY frame_id), avg(noise_dbm) OVER (PARTITION BY frame_id) + 3) AS f FROM floors) GROUP BY frame_id)""",
    _FLOOR,
)
_ESTIMATORS = {"median": "quantile_cont(power_dbm, 0.5)", "percentile": "quantile_cont(power_dbm, 0.2)", "trimmed_mean": "list_avg(list_sort(list(power_dbm))[CAST(floor(count(*) * 0.15) AS BIGINT) + 1 : count(*) - CAST(floor(count(*) * 0.15) AS BIGINT)])"}


def _estimated(b):
    out = None
    for name in _ESTIMATORS:
        rows = R.noise_floor(b, estimator=name).select(F.lit(name).alias("estimator"), "frame_id", "floor_dbm", "median_dbm", "slope_db_per_mhz")
        out = rows if out is None else out.unionByName(rows)
    return out


bins(
    "rf2_estimators",
    _estimated,
    " UNION ALL ".join(f"SELECT '{k}' AS estimator, frame_id, round(least({v}, avg(noise_dbm) + 3), 6) AS floor_dbm, round(quantile_cont(power_dbm, 0.5), 6) AS median_dbm, CAST(0 AS DOUBLE) AS slope_db_per_mhz FROM bins GROUP BY frame_id" for k, v in _ESTIMATORS.items()),
)
bins("win11_rolling_floor", lambda b: R.floor_by_bin(b).select("frame_id", F.col("bin").cast("long").alias("bin"), F.round("floor_dbm", 6).alias("floor_dbm")), "SELECT frame_id, bin, round(floor_dbm, 6) AS floor_dbm FROM floors", _FLOOR)
_PEAKS = """peaks AS (SELECT frame_id, receiver, time_ns, bin, frequency_hz, round(power_dbm, 6) AS power_dbm, snr_db, row_number() OVER (PARTITION BY frame_id ORDER BY snr_db DESC, power_dbm DESC, bin) AS place FROM (SELECT *, round(power_dbm - floor_dbm, 6) AS snr_db FROM (SELECT *, coalesce(lag(power_dbm) OVER w, -1e9) AS l, coalesce(lead(power_dbm) OVER w, -1e9) AS r2 FROM floors
    WINDOW w AS (PARTITION BY frame_id ORDER BY bin)) WHERE power_dbm >= l AND power_dbm >= r2 AND (power_dbm > l OR power_dbm > r2) AND power_dbm - floor_dbm >= 6))"""
_EDGES = """edges AS (SELECT p.*, f.floor_dbm AS fl, f.power_dbm AS pw, coalesce((SELECT max(x.bin) FROM floors x WHERE x.frame_id = p.frame_id AND x.bin < p.bin AND x.power_dbm < greatest(f.floor_dbm + 6, f.power_dbm - 3) AND x.power_dbm < x.floor_dbm + 6), -1) + 1 AS lo,
    coalesce((SELECT min(x.bin) FROM floors x WHERE x.frame_id = p.frame_id AND x.bin > p.bin AND x.power_dbm < greatest(f.floor_dbm + 6, f.power_dbm - 3) AND x.power_dbm < x.floor_dbm + 6), 64) - 1 AS hi FROM peaks p JOIN floors f USING (frame_id, bin)),
    tops AS (SELECT frame_id, bin FROM (SELECT *, power_dbm - floor_dbm AS m, coalesce(lag(power_dbm) OVER w, -1e9) AS l, coalesce(lead(power_dbm) OVER w, -1e9) AS r2 FROM floors WINDOW w AS (PARTITION BY frame_id ORDER BY bin)) WHERE power_dbm >= l AND power_dbm >= r2 AND (power_dbm > l OR power_dbm > r2) AND power_dbm > floor_dbm + 3),
    spans AS (SELECT e.frame_id, e.bin, sum(pow(10.0, x.power_dbm / 10)) AS mw, count(t.bin) AS tones, any_value(x.power_dbm) FILTER (x.bin = lo) AS pa, any_value(x.power_dbm) FILTER (x.bin = hi) AS pz, min(x.frequency_hz) AS lower_hz, max(x.frequency_hz) AS upper_hz FROM edges e JOIN floors x ON x.frame_id = e.frame_id AND x.bin BETWEEN lo AND hi LEFT JOIN tops t ON t.frame_id = x.frame_id AND t.bin = x.bin GROUP BY ALL)"""
bins(
    "rf3_peaks",
    R.peaks,
    """SELECT e.frame_id, receiver, time_ns, e.bin, frequency_hz, power_dbm, snr_db, place, lo AS lower_bin, hi AS upper_bin, lower_hz, upper_hz, round(fl, 6) AS floor_dbm, round(log10(mw) * 10, 6) AS integrated_dbm, upper_hz - lower_hz + 10000 AS bandwidth_hz,
    CASE WHEN hi - lo < 2 THEN 'narrowband' WHEN hi - lo >= 11 THEN CASE WHEN pw - (pa + pz) / 2 < 3 THEN 'flat_top' ELSE 'wideband' END WHEN tones >= 3 THEN 'multi_tone' WHEN abs((pw - pa) - (pw - pz)) > 6 THEN 'shoulder' ELSE 'narrowband' END AS shape FROM edges e JOIN spans USING (frame_id, bin) WHERE place <= 64""",
    f"{_FLOOR}, {_PEAKS}, {_EDGES}",
)
bins("srt4_peak_cap", lambda b: R.peaks(b, 6.0, 3).groupBy("frame_id").agg(F.count("*").alias("peaks")), "SELECT frame_id, count(*) AS peaks FROM peaks WHERE place <= 3 GROUP BY frame_id", f"{_FLOOR}, {_PEAKS}")
_OCC = "SELECT frame_id, count(*) AS bins, count(*) FILTER (m >= 6) AS occupied, round(count(*) FILTER (m >= 6) / count(*), 6) AS ratio, round(avg(m), 6) AS mean_margin_db, round(greatest(max(m), 0.0), 6) AS max_margin_db FROM (SELECT *, power_dbm - floor_dbm AS m FROM floors) GROUP BY frame_id"
bins("rf4_occupancy", R.occupancy, _OCC, _FLOOR)
bins("rf5_integrated_power", R.integrated_power, "SELECT frame_id, round(log10(sum(pow(10.0, power_dbm / 10))) * 10, 6) AS power_dbm FROM bins GROUP BY frame_id")
bins("rf6_smooth", lambda b: R.smooth(b, 5).select("frame_id", F.col("bin").cast("long").alias("bin"), F.round("smooth_dbm", 6).alias("smooth_dbm")), "SELECT frame_id, bin, round(log10(avg(pow(10.0, power_dbm / 10)) OVER (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) * 10, 6) AS smooth_dbm FROM bins")
bins("rf6_subtract_floor", lambda b: R.floor_by_bin(b).select("frame_id", F.col("bin").cast("long").alias("bin"), F.round(F.col("power_dbm") - F.col("floor_dbm"), 6).alias("above_db")), "SELECT frame_id, bin, round(power_dbm - floor_dbm, 6) AS above_db FROM floors", _FLOOR)
bins("jn9_intermodulation", lambda b: R.intermodulation(R.peaks(b), 2_000), """SELECT p.frame_id, p.f1, p.f2, p.product, c.frequency_hz AS peak_hz FROM (SELECT a.frame_id, a.frequency_hz AS f1, b.frequency_hz AS f2, unnest([a.frequency_hz * 2 - b.frequency_hz, b.frequency_hz * 2 - a.frequency_hz, a.frequency_hz + b.frequency_hz, b.frequency_hz - a.frequency_hz]) AS product
    FROM peaks a JOIN peaks b ON a.frame_id = b.frame_id AND a.frequency_hz < b.frequency_hz AND a.place <= 64 AND b.place <= 64) p JOIN peaks c ON c.frame_id = p.frame_id AND c.place <= 64 AND abs(c.frequency_hz - product) <= 2000 AND c.frequency_hz <> f1 AND c.frequency_hz <> f2 WHERE product > 0""", f"{_FLOOR}, {_PEAKS}")
TABLE["rf9_band_plan"] = (lambda s, d: R.allocations(s), f"WITH {_ALLOC} SELECT name, CAST(lower_hz AS BIGINT) AS lower_hz, CAST(upper_hz AS BIGINT) AS upper_hz, service, status, CAST(guard_hz AS BIGINT) AS guard_hz, status_rank FROM alloc")
TABLE["srt9_allocations"] = (lambda s, d: R.allocations(s).orderBy("lower_hz", "upper_hz", "name").limit(7).select("name", "lower_hz"), f"WITH {_ALLOC} SELECT name, CAST(lower_hz AS BIGINT) AS lower_hz FROM alloc ORDER BY lower_hz, upper_hz, name LIMIT 7")
TABLE["rf9_channels"] = (lambda s, d: R.channels(s), f"WITH {_CHAN} SELECT * FROM chan")
TABLE["jn10_guards"] = (lambda s, d: R.guards(s), f"WITH {_ALLOC} SELECT name, CAST(lower_hz AS BIGINT) AS from_hz, CAST(least(lower_hz + guard_hz, upper_hz) AS BIGINT) AS to_hz FROM alloc UNION ALL SELECT name, CAST(greatest(upper_hz - guard_hz, lower_hz) AS BIGINT), CAST(upper_hz AS BIGINT) FROM alloc")
_PTS = lambda b: b.select("frame_id", (F.col("frequency_hz") + F.col("frame_id") % 97 * 10_000_000).alias("hz"))
_PTSQL = "pts AS (SELECT frame_id, frequency_hz + frame_id % 97 * 10000000 AS hz FROM bins)"
bins("jn4_best_allocation", lambda b: R.best_allocation(_PTS(b), "hz"), "SELECT frame_id, hz, (SELECT name FROM alloc WHERE hz >= lower_hz AND hz < upper_hz ORDER BY status_rank, upper_hz - lower_hz, lower_hz LIMIT 1) AS allocation FROM pts", f"{_ALLOC}, {_PTSQL}")
bins("jn10_guard_hits", lambda b: R.guard_hits(_PTS(b), "hz"), "SELECT frame_id, hz, name FROM pts JOIN (SELECT name, lower_hz AS f, least(lower_hz + guard_hz, upper_hz) AS t FROM alloc UNION ALL SELECT name, greatest(upper_hz - guard_hz, lower_hz), upper_hz FROM alloc) ON hz >= f AND hz < t", f"{_ALLOC}, {_PTSQL}")
_NEAREST = """asked AS (SELECT DISTINCT hz FROM pts), ranked AS (SELECT *, dense_rank() OVER (ORDER BY lower_hz, upper_hz, name) AS place FROM alloc), centers AS (SELECT center_hz AS c, arg_min(c.name, place * 100000 + number) AS name, arg_min(number, place * 100000 + number) AS number, min(place) AS place FROM chan c JOIN ranked USING (name) GROUP BY center_hz),
    below AS (SELECT hz, c, name, number, place FROM asked ASOF JOIN centers ON hz >= c), above AS (SELECT hz, c, name, number, place FROM asked ASOF JOIN centers ON hz <= c),
    near AS (SELECT hz, name, number, abs(c - hz) AS delta_hz FROM (SELECT *, row_number() OVER (PARTITION BY hz ORDER BY abs(c - hz), place, c) AS n FROM (SELECT * FROM below UNION ALL SELECT * FROM above)) WHERE n = 1)"""
bins("jn5_nearest_channel", lambda b: R.nearest_channel(_PTS(b), "hz"), "SELECT frame_id, hz, name AS channel_of, number AS channel, delta_hz FROM pts JOIN near USING (hz)", f"{_ALLOC}, {_CHAN}, {_PTSQL}, {_NEAREST}")
bins("rf10_channel_number", lambda b: b.select("frame_id", F.col("bin").cast("long").alias("bin"), R.channel_number(F.col("frequency_hz"), 433_075_000, 25_000, 0, 68).alias("channel")), "SELECT frame_id, bin, CASE WHEN frequency_hz >= 433075000 AND (frequency_hz - 433075000 + 12500) // 25000 <= 68 THEN CAST((frequency_hz - 433075000 + 12500) // 25000 AS INTEGER) END AS channel FROM bins")
_PROF = [("p1", 1, 433_000_000, 434_500_000, 0, 0, 3, 10.0, 1.5), ("p2", 1, 433_900_000, 434_100_000, 0, 0, 1, 10.0, 0.5), ("p3", 2, 434_000_000, 436_000_000, 3_600_000_000_000 * 50, 0, 4, 5.0, 9.0), ("p4", 2, 433_000_000, 436_000_000, 0, 0, 4, -8.0, 2.0)]
TABLE["jn6_calibration_lookup"] = (
    lambda s, d: R.calibration_best(A.bins(s, d).select("frame_id", F.col("receiver").cast("long").alias("receiver"), "frequency_hz", "time_ns"), s.createDataFrame(_PROF, "id string, receiver long, lower_hz long, upper_hz long, valid_from long, valid_until long, points int, source_bonus double, uncertainty double")),
    f"""WITH {A.BINS_SQL}, prof(id, receiver, lo, hi, f, u, points, bonus, unc) AS (VALUES {", ".join(str(p) for p in _PROF)}), met AS (SELECT b.frame_id, b.receiver, frequency_hz, time_ns, id, lo, 100.0 - CASE WHEN time_ns >= f AND (u = 0 OR time_ns < u) THEN 0 ELSE 35 END - CASE WHEN points < 2 THEN 15 ELSE 0 END + bonus - least(unc * 4, 25.0) AS score
    FROM bins b LEFT JOIN prof p ON b.receiver = p.receiver AND frequency_hz >= lo AND frequency_hz < hi)
    SELECT frame_id, CAST(receiver AS BIGINT) AS receiver, frequency_hz, time_ns, id AS profile, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, frequency_hz ORDER BY score DESC, lo, id) AS place FROM met) WHERE place = 1""",
)
iq(
    "rf14_iq_summary",
    R.iq_summary,
    """SELECT window_id, count(*) AS samples, round(sqrt(avg(m * m)), 6) AS rms, round(max(m), 6) AS peak, round(log10(max(m) / sqrt(avg(m * m))) * 20, 6) AS crest_db, round(sqrt(avg(i) * avg(i) + avg(q) * avg(q)), 6) AS dc_offset, round(log10(sqrt(sum(ci * ci)) / sqrt(sum(cq * cq))) * 20, 6) AS gain_imbalance_db,
    round(degrees(asin(sum(ci * cq) / sqrt(sum(ci * ci) * sum(cq * cq)))), 6) AS phase_error_deg, round(count(*) FILTER (abs(ci) >= 0.98 OR abs(cq) >= 0.98 OR m >= 0.98) / count(*), 6) AS clipping_ratio, round(avg(CASE WHEN s > pi() THEN s - pi() * 2 WHEN s < -pi() THEN s + pi() * 2 ELSE s END) * 48000.0 / (pi() * 2), 4) AS frequency_offset_hz
    FROM (SELECT *, p - lag(p) OVER (PARTITION BY window_id ORDER BY n) AS s FROM (SELECT *, sqrt(ci * ci + cq * cq) AS m, atan2(cq, ci) AS p FROM (SELECT *, i - avg(i) OVER (PARTITION BY window_id) AS ci, q - avg(q) OVER (PARTITION BY window_id) AS cq FROM iq))) GROUP BY window_id""",
)
iq("rf15_iq_segments", lambda x: R.iq_segments(x, 8), "SELECT window_id, n // 8 AS segment, count(*) AS samples, round(sqrt(avg(i * i + q * q)), 6) AS rms, round(sqrt(max(i * i + q * q)), 6) AS peak FROM iq GROUP BY ALL")
iq("rf15_iq_normalised", lambda x: R.iq_normalised(x).withColumn("n", F.col("n").cast("long")), "SELECT window_id, n, round(i * 0.5 / sqrt(v), 6) AS i, round(q * 0.5 / sqrt(v), 6) AS q FROM (SELECT *, var_pop(i) OVER (PARTITION BY window_id) + var_pop(q) OVER (PARTITION BY window_id) AS v FROM iq)")
_QIN = lambda b: b.groupBy("frame_id").agg(F.round(F.avg("power_dbm") + 104, 6).alias("snr_db"), F.round(F.count_if(F.col("power_dbm") > -95) / 64, 6).alias("occupancy"), F.round(F.max("power_dbm") + 104, 6).alias("dynamic_db"), F.round((F.col("frame_id") % 5) * 3.0, 6).alias("penalty"))
bins(
    "rf16_signal_quality",
    lambda b: R.quality(_QIN(b)),
    """SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'unusable' END AS grade FROM (SELECT *, round(greatest(least(CASE WHEN snr_db <= 10 THEN greatest(least(snr_db / 10.0 * 45, 100.0), 0.0) ELSE greatest(least((snr_db - 10) / 20.0 * 55 + 45, 100.0), 0.0) END * 0.45
    + CASE WHEN occupancy <= 0.35 THEN 100.0 ELSE greatest(least(100 - (occupancy - 0.35) / 0.65 * 80, 100.0), 0.0) END * 0.25 + greatest(least(dynamic_db / 30.0 * 100, 100.0), 0.0) * 0.20 + 10 - penalty, 100.0), 0.0), 6) AS score FROM (SELECT frame_id, round(avg(power_dbm) + 104, 6) AS snr_db, round(count(*) FILTER (power_dbm > -95) / 64, 6) AS occupancy, round(max(power_dbm) + 104, 6) AS dynamic_db,
    round((frame_id % 5) * CAST(3.0 AS DOUBLE), 6) AS penalty FROM bins GROUP BY frame_id))""",
)
bins(
    "rf18_trends",
    lambda b: R.trends(b.select((F.col("receiver") * 64 + F.col("bin")).alias("track"), "time_ns", F.col("power_dbm").alias("value"))),
    """SELECT track, n, round(slope, 6) AS slope, CASE WHEN a = 0 AND z <> 0 THEN 'new_signal' WHEN a <> 0 AND z = 0 THEN 'disappeared' WHEN slope > 1 OR z - a > 3 THEN 'rising' WHEN slope < -1 OR z - a < -3 THEN 'falling' ELSE 'stable' END AS trend
    FROM (SELECT receiver * 64 + bin AS track, count(*) AS n, coalesce(regr_slope(power_dbm, time_ns / 3.6e12), 0) AS slope, first(power_dbm ORDER BY time_ns) AS a, last(power_dbm ORDER BY time_ns) AS z FROM bins GROUP BY receiver, bin)""",
)
_TRACKS = lambda b: H.tracks(H.observations(b))
_rounded = lambda rows: rows.withColumns({c: F.round(c, 6) for c in ("persistence", "mean_dbm", "slope_db_per_hour")})
bins("rf17_tracks", lambda b: H.points(H.observations(b)), None)
bins("sup21_tracks", lambda b: _rounded(_TRACKS(b)), None)
bins("srt5_strongest_tracks", lambda b: _rounded(H.strongest(_TRACKS(b), 10, 0.1)), None)
bins("srt6_tracks_in_range", lambda b: _rounded(H.in_range(_TRACKS(b), 433_900_000, 434_400_000)), None)
bins("srt6_rising_tracks", lambda b: _rounded(H.with_trend(_TRACKS(b), "rising")), None)
bins(
    "rf17_occupancy_trend",
    lambda b: H.occupancy_trend(H.observations(b)).withColumns({c: F.round(c, 6) for c in ("first", "last", "mean", "slope_per_hour")}),
    f"""SELECT receiver, count(*) AS observations, round(first(ratio ORDER BY time_ns), 6) AS "first", round(last(ratio ORDER BY time_ns), 6) AS "last", round(avg(ratio), 6) AS mean,
        round(coalesce(regr_slope(ratio, time_ns / 3.6e12), 0), 6) AS slope_per_hour,
        CASE WHEN first(ratio ORDER BY time_ns) = 0 AND last(ratio ORDER BY time_ns) <> 0 THEN 'new_signal' WHEN first(ratio ORDER BY time_ns) <> 0 AND last(ratio ORDER BY time_ns) = 0 THEN 'disappeared'
            WHEN coalesce(regr_slope(ratio, time_ns / 3.6e12), 0) > 1 THEN 'rising' WHEN coalesce(regr_slope(ratio, time_ns / 3.6e12), 0) < -1 THEN 'falling' ELSE 'stable' END AS trend
    FROM (SELECT *, row_number() OVER (PARTITION BY receiver ORDER BY time_ns DESC) AS place FROM (SELECT DISTINCT receiver, frame_id, time_ns FROM bins) JOIN ({_OCC}) USING (frame_id))
    WHERE place <= 128 GROUP BY receiver""",
    _FLOOR,
)


def _history(spark, sf_dir):
    observed = scratch.kept(H.observations(A.bins(spark, sf_dir)), "observations")
    return H.findings(scratch.kept(H.tracks(observed), "tracks"), H.occupancy_trend(observed))


TABLE["rf17_findings"] = (_history, None)
_SWEEP = lambda s: R.allocations(s).select((F.lit(4) - F.col("status_rank")).alias("priority"), "lower_hz", "upper_hz")
_SEG = "seg AS (SELECT priority, s AS from_hz, least(s + 2000000, upper_hz) AS to_hz, 250 AS dwell_us FROM (SELECT CAST(4 - status_rank AS INTEGER) AS priority, CAST(upper_hz AS BIGINT) AS upper_hz, unnest(range(CAST(lower_hz AS BIGINT), CAST(upper_hz AS BIGINT), 2000000)) AS s FROM alloc))"
TABLE["rf12_sweep_segments"] = (lambda s, d: R.sweep_segments(_SWEEP(s), 2_000_000, 250), f"WITH {_ALLOC}, {_SEG} SELECT * FROM seg")
TABLE["set4_covered_width"] = (
    lambda s, d: R.covered_width(R.sweep_segments(_SWEEP(s), 2_000_000, 250)),
    f"WITH {_ALLOC}, {_SEG} SELECT priority, CAST(sum(greatest(to_hz - greatest(coalesce(r, from_hz), from_hz), 0)) AS BIGINT) AS covered_hz FROM (SELECT *, max(to_hz) OVER (PARTITION BY priority ORDER BY from_hz, to_hz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM seg) GROUP BY priority",
)
bins("set3_range_merge", lambda b: b.groupBy("receiver").agg(F.min("frequency_hz").alias("lower_hz"), F.max("frequency_hz").alias("upper_hz")), "SELECT receiver, min(frequency_hz) AS lower_hz, max(frequency_hz) AS upper_hz FROM bins GROUP BY receiver")
bins("rf19_format", lambda b: b.select("frame_id", F.col("bin").cast("long").alias("bin"), R.format_hz(F.col("frequency_hz")).alias("text")), "SELECT frame_id, bin, format('{:.3f} MHz', frequency_hz / 1e6) AS text FROM bins")
_SIGNALS = [("beacon", 433_600_000, 434_000_000, -80.0, 12.0), ("link", 434_100_000, 435_900_000, -95.0, 25.0)]
_SIGSQL = f"sig(signal, lo, hi, nominal, tol) AS (VALUES {', '.join(str(x) for x in _SIGNALS)})"
_FOUND = """found AS (SELECT e.frame_id, e.bin, frequency_hz, power_dbm, snr_db, lower_hz, upper_hz + 1 AS upper_hz, place,
    CASE WHEN hi - lo < 2 THEN 'narrowband' WHEN hi - lo >= 11 THEN CASE WHEN pw - (pa + pz) / 2 < 3 THEN 'flat_top' ELSE 'wideband' END
        WHEN tones >= 3 THEN 'multi_tone' WHEN abs((pw - pa) - (pw - pz)) > 6 THEN 'shoulder' ELSE 'narrowband' END AS shape
    FROM edges e JOIN spans USING (frame_id, bin) WHERE place <= 64)"""


def _expected(spark):
    return spark.createDataFrame(_SIGNALS, "signal string, low_hz long, high_hz long, nominal_dbm double, tolerance_db double")


TABLE["jn8_expected_mismatches"] = (
    lambda s, d: I.mismatches(R.peaks(A.bins(s, d)), _expected(s)).select("frame_id", "bin", "signal", "off_db", "excess_db"),
    f"""WITH {A.BINS_SQL}, {_FLOOR}, {_PEAKS}, {_EDGES}, {_FOUND}, {_SIGSQL}
    SELECT frame_id, bin, signal, off_db, excess_db FROM (
        SELECT frame_id, bin, signal, round(power_dbm - nominal, 6) AS off_db, round(abs(round(power_dbm - nominal, 6)) - tol, 6) AS excess_db
        FROM found JOIN sig ON lower_hz < hi AND lo < upper_hz)
    WHERE excess_db > 0""",
)


def _interference(spark, sf_dir):
    b = A.bins(spark, sf_dir)
    return I.findings(b, scratch.kept(R.peaks(b), "peaks"), R.occupancy(b), R.noise_floor(b), _expected(spark))


_BEST = "(SELECT name FROM alloc WHERE {x} >= alloc.lower_hz AND {x} < alloc.upper_hz ORDER BY status_rank, alloc.upper_hz - alloc.lower_hz, alloc.lower_hz LIMIT 1)"
_SEV = "CASE WHEN {x} >= 30 THEN 'critical' WHEN {x} >= 20 THEN 'high' WHEN {x} >= 10 THEN 'medium' WHEN {x} >= 3 THEN 'low' ELSE 'info' END"
_SURE = "round(greatest(0.0, least(1.0, {x})), 9)"
_NOISE = """noise AS (SELECT frame_id, round(f, 6) AS floor_dbm, round(median, 6) AS median_dbm FROM (
        SELECT frame_id, any_value(f) AS f, quantile_cont(power_dbm, 0.5) AS median FROM (
            SELECT *, least(avg(level) OVER (PARTITION BY frame_id), avg(noise_dbm) OVER (PARTITION BY frame_id) + 3) AS f FROM floors) GROUP BY frame_id))"""
TABLE["rf8_interference"] = (
    _interference,
    f"""WITH {A.BINS_SQL}, {_FLOOR}, {_PEAKS}, {_EDGES}, {_FOUND}, {_SIGSQL}, {_ALLOC}, occ AS ({_OCC}), {_NOISE}, broad AS (
        SELECT frame_id, ratio, floor_dbm - median_dbm AS rise, greatest(floor_dbm - median_dbm, mean_margin_db) AS excess FROM occ JOIN noise USING (frame_id)),
    guards AS (SELECT name, lower_hz AS f, least(lower_hz + guard_hz, upper_hz) AS t FROM alloc UNION ALL SELECT name, upper_hz - guard_hz, upper_hz FROM alloc),
    placed AS (SELECT *, coalesce({_BEST.format(x="found.frequency_hz")}, {_BEST.format(x="found.lower_hz")}, {_BEST.format(x="(found.upper_hz - 1)")}) AS allocation FROM found),
    named AS (SELECT *, power_dbm >= -5 AS over, EXISTS (SELECT 1 FROM guards g WHERE g.name = allocation AND placed.lower_hz < g.t AND g.f < placed.upper_hz) AS guarded,
        EXISTS (SELECT 1 FROM alloc a WHERE a.name = allocation AND (status = 'protected_passive' OR service IN ('navigation', 'weather') OR name IN {I.RECEIVE_ONLY})) AS passive FROM placed),
    single AS (SELECT *, unnest(list_filter([
            CASE WHEN over THEN {{'kind': 'overload', 'severity': 'critical', 'summary': 'very high RF power suggests receiver overload risk'}} END,
            CASE WHEN NOT over AND shape = 'narrowband' AND snr_db >= 12 THEN {{'kind': 'narrowband_carrier', 'severity': {_SEV.format(x="snr_db")}, 'summary': 'unexpected narrowband carrier'}} END,
            CASE WHEN NOT over AND guarded THEN {{'kind': 'adjacent_channel', 'severity': 'medium', 'summary': 'energy falls in allocation guard range'}} END,
            CASE WHEN NOT over AND passive AND snr_db >= 6 THEN {{'kind': 'co_channel', 'severity': 'high', 'summary': 'emission observed in protected or receive-only allocation'}} END
        ], lambda x: x IS NOT NULL)) AS k FROM named),
    off AS (SELECT *, round(abs(round(power_dbm - nominal, 6)) - tol, 6) AS excess FROM found JOIN sig ON lower_hz < hi AND lo < upper_hz),
    products AS (SELECT a.frame_id, a.frequency_hz AS f1, b.frequency_hz AS f2, unnest([a.frequency_hz * 2 - b.frequency_hz, b.frequency_hz * 2 - a.frequency_hz, a.frequency_hz + b.frequency_hz, b.frequency_hz - a.frequency_hz]) AS product
        FROM found a JOIN found b ON a.frame_id = b.frame_id AND a.frequency_hz < b.frequency_hz)
    SELECT frame_id, -1 AS bin, 'broadband_noise' AS kind, {_SEV.format(x="excess")} AS severity, (SELECT min(frequency_hz) FROM bins b WHERE b.frame_id = broad.frame_id) AS lower_hz,
        (SELECT max(frequency_hz) FROM bins b WHERE b.frame_id = broad.frame_id) + 10000 AS upper_hz, round(excess, 6) AS excess_db, {_SURE.format(x="ratio + greatest(0.0, rise) / 25")} AS confidence,
        CAST(NULL AS VARCHAR) AS allocation, 'broadband energy raises occupancy or apparent noise floor' AS summary FROM broad WHERE ratio >= 0.55 OR rise >= 8
    UNION ALL SELECT frame_id, bin, k.kind, k.severity, lower_hz, upper_hz, round(snr_db, 6), {_SURE.format(x="0.35 + snr_db / 40")}, allocation, k.summary FROM single
    UNION ALL SELECT frame_id, bin, 'co_channel', {_SEV.format(x="excess")}, lower_hz, upper_hz, excess, {_SURE.format(x="0.5 + excess / 30")}, NULL, 'expected signal deviates from nominal power' FROM off WHERE excess > 0
    UNION ALL SELECT c.frame_id, c.bin, 'intermodulation', 'medium', c.lower_hz, c.upper_hz, c.snr_db, {_SURE.format(x="0.55 + c.snr_db / 50")}, NULL, 'peak aligns with two-tone intermodulation product'
        FROM products p JOIN found c ON c.frame_id = p.frame_id AND abs(c.frequency_hz - product) <= 2000 AND c.frequency_hz <> f1 AND c.frequency_hz <> f2 WHERE product > 0""",
)


_RECEIVER = sweeps.Receiver(min_hz=433_300_000, max_hz=436_000_000, max_span_hz=400_000)


def _followup(spark, sf_dir):
    """Plans for the findings of frames that have one."""
    return sweeps.followup_requests(scratch.kept(_interference(spark, sf_dir), "findings"))


def _survey(spark, sf_dir):
    """A request per receiver for all that it has heard, on channels where the
    plan has some: of land mobile radio for even receivers, any for odd ones."""
    b = A.bins(spark, sf_dir).groupBy("receiver").agg(F.min("frequency_hz").alias("lower_hz"), (F.max("frequency_hz") + 10_000).alias("upper_hz"))
    even = F.col("receiver") % 2 == 0
    return b.select(
        F.col("receiver").cast("long").alias("plan"), F.lit("survey").alias("intent"), "lower_hz", "upper_hz", F.when(even, "land_mobile").alias("service"), F.lit(25_000).alias("resolution_hz"), F.lit(20_000).alias("dwell_us"),
        F.lit("normal").alias("priority"), (F.col("receiver") % 3 == 0).alias("guards"), (F.col("receiver") % 4 < 3).alias("channels"),
    )


# each request's pieces by walking, each plan's merges one row after the other
_SWEEP_SQL = f"""bound AS (SELECT *, row_number() OVER () AS request, greatest(resolution_hz, 1000) AS bw, greatest(lower_hz, 433300000) AS lo, least(upper_hz, 436000000) AS hi FROM requests WHERE lower_hz < upper_hz),
    usable AS (SELECT * FROM bound WHERE lo < hi),
    onchan AS (SELECT u.plan, u.request, u.priority, u.intent, bw, dwell_us, greatest(c.center_hz - c.bandwidth_hz // 2, 433300000) AS lo, least(c.center_hz + c.bandwidth_hz // 2 + c.bandwidth_hz % 2, 436000000) AS hi, c.name AS allocation, concat('known channel ', c.name, ' ch ', c.number) AS reason
        FROM usable u JOIN chan c ON u.channels AND (u.service IS NULL OR u.service = c.service) AND c.center_hz - c.bandwidth_hz // 2 < u.upper_hz AND c.center_hz + c.bandwidth_hz // 2 + c.bandwidth_hz % 2 > u.lower_hz),
    kept AS (SELECT * FROM onchan WHERE lo < hi),
    guarded AS (SELECT name, service, lower_hz AS f, least(lower_hz + guard_hz, upper_hz) AS t FROM alloc UNION ALL SELECT name, service, upper_hz - guard_hz, upper_hz FROM alloc),
    ranged AS (SELECT plan, priority, intent, bw, dwell_us, lo, hi, CAST(NULL AS VARCHAR) AS allocation, 'range survey' AS reason FROM usable WHERE request NOT IN (SELECT request FROM kept)
        UNION ALL SELECT plan, 'high', intent, bw, dwell_us, greatest(lo, f), least(hi, t), g.name, concat('guard range for ', g.name) FROM usable u JOIN guarded g ON u.guards AND (u.service IS NULL OR u.service = g.service) AND g.f < u.hi AND u.lo < g.t),
    walked AS (SELECT *, lo AS a, CASE WHEN lo + 320000 >= hi THEN hi ELSE least(hi, ((lo + 320000 + bw - 1) // bw) * bw) END AS z FROM ranged
        UNION ALL SELECT * REPLACE (z AS a, CASE WHEN z + 320000 >= hi THEN hi ELSE least(hi, ((z + 320000 + bw - 1) // bw) * bw) END AS z) FROM walked WHERE z < hi),
    pieces AS (SELECT plan, priority, intent, bw, dwell_us, a AS lo, z AS hi, allocation, reason FROM walked UNION ALL SELECT plan, priority, intent, bw, dwell_us, lo, hi, allocation, reason FROM kept),
    weighed AS (SELECT *, CASE priority WHEN 'urgent' THEN 4.0 WHEN 'high' THEN 2.0 WHEN 'normal' THEN 1.0 ELSE 0.5 END AS weight FROM pieces),
    sorted AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY weight DESC, lo, hi, intent, reason) AS n FROM weighed),
    folded AS (SELECT plan, n, 1 AS g, priority, intent, bw, dwell_us, lo, hi, allocation, reason, 1 AS merged FROM sorted WHERE n = 1
        UNION ALL SELECT s.plan, s.n, CASE WHEN joined THEN g ELSE g + 1 END, s.priority, s.intent, CASE WHEN joined THEN fbw ELSE s.bw END, CASE WHEN joined THEN greatest(fdwell, s.dwell_us) ELSE s.dwell_us END,
            CASE WHEN joined THEN flo ELSE s.lo END, CASE WHEN joined THEN greatest(fhi, s.hi) ELSE s.hi END, CASE WHEN joined THEN falloc ELSE s.allocation END, CASE WHEN joined THEN freason || '; ' || s.reason ELSE s.reason END, CASE WHEN joined THEN fmerged + 1 ELSE 1 END
        FROM (SELECT s.*, f.g, f.bw AS fbw, f.dwell_us AS fdwell, f.lo AS flo, f.hi AS fhi, f.allocation AS falloc, f.reason AS freason, f.merged AS fmerged,
                f.priority = s.priority AND f.intent = s.intent AND NOT coalesce(f.allocation <> s.allocation, false) AND s.lo - f.hi <= 2 * f.bw AND greatest(f.hi, s.hi) - f.lo <= 320000 AS joined
            FROM folded f JOIN sorted s ON s.plan = f.plan AND s.n = f.n + 1) s),
    done AS (SELECT plan, g AS place, last(priority ORDER BY n) AS priority, last(intent ORDER BY n) AS intent, last(lo ORDER BY n) AS lower_hz, last(hi ORDER BY n) AS upper_hz, last(bw ORDER BY n) AS bin_width_hz, last(dwell_us ORDER BY n) AS dwell_us,
        last(allocation ORDER BY n) AS allocation, last(reason ORDER BY n) AS reason, last(merged ORDER BY n) AS merged FROM folded GROUP BY plan, g)"""
_PLAN_SQL = "SELECT plan, place, priority, intent, lower_hz, upper_hz, lower_hz + (upper_hz - lower_hz) // 2 AS center_hz, upper_hz - lower_hz AS span_hz, bin_width_hz, dwell_us, allocation, reason, merged FROM done"
_SURVEY_SQL = f"""WITH RECURSIVE {A.BINS_SQL}, {_ALLOC}, {_CHAN}, requests AS (
    SELECT receiver AS plan, 'survey' AS intent, min(frequency_hz) AS lower_hz, max(frequency_hz) + 10000 AS upper_hz, CASE WHEN receiver % 2 = 0 THEN 'land_mobile' END AS service, 25000 AS resolution_hz, 20000 AS dwell_us,
        'normal' AS priority, receiver % 3 = 0 AS guards, receiver % 4 < 3 AS channels FROM bins GROUP BY receiver), {_SWEEP_SQL}"""
TABLE["rf12_sweep_plan"] = (lambda s, d: sweeps.plan(_survey(s, d), _RECEIVER), f"{_SURVEY_SQL} {_PLAN_SQL}")
TABLE["rf12_sweep_totals"] = (
    lambda s, d: sweeps.totals(scratch.kept(sweeps.plan(_survey(s, d), _RECEIVER), "sweep"), _RECEIVER),
    f"""{_SURVEY_SQL}, reach AS (SELECT *, max(upper_hz) OVER (PARTITION BY plan ORDER BY lower_hz, upper_hz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM done)
    SELECT plan, count(*) AS segments, CAST(sum(dwell_us + 2000) AS BIGINT) AS duration_us, CAST(sum(greatest(upper_hz - greatest(coalesce(r, lower_hz), lower_hz), 0)) AS BIGINT) AS covered_hz, round(sum(dwell_us) / sum(dwell_us + 2000), 6) AS duty_cycle
    FROM reach GROUP BY plan""",
)
TABLE["rf12_sweep_warnings"] = (
    lambda s, d: sweeps.warnings(_survey(s, d), sweeps.Receiver(min_hz=434_500_000)),
    f"{_SURVEY_SQL} SELECT plan, format('request outside receiver tuning range: {{:.3f}} MHz - {{:.3f}} MHz', lower_hz / 1e6, upper_hz / 1e6) AS warning FROM requests WHERE upper_hz <= 434500000",
)
TABLE["rf13_followup"] = (
    lambda s, d: sweeps.plan(_followup(s, d), _RECEIVER),
    TABLE["rf8_interference"][1].replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT frame_id, -1 AS bin, 'broadband_noise'", "findings AS (SELECT frame_id, -1 AS bin, 'broadband_noise'", 1).replace("off AS (SELECT", f"{_CHAN}, off AS (SELECT", 1).replace("ON a.frame_id = b.frame_id AND a.frequency_hz < b.frequency_hz)", "ON a.frame_id = b.frame_id AND a.frequency_hz < b.frequency_hz),", 1)
    + f"""), padded AS (SELECT *, greatest(upper_hz - lower_hz, 50000) AS pad FROM findings), requests AS (
    SELECT frame_id AS plan, 'interference_hunt' AS intent, CASE WHEN allocation IS NULL THEN lower_hz ELSE greatest(lower_hz - pad, 0) END AS lower_hz, CASE WHEN allocation IS NULL THEN upper_hz ELSE upper_hz + pad END AS upper_hz,
        (SELECT service FROM alloc WHERE name = allocation) AS service, 5000 AS resolution_hz, CASE severity WHEN 'critical' THEN 100000 ELSE 50000 END AS dwell_us, CASE severity WHEN 'critical' THEN 'urgent' ELSE 'high' END AS priority, true AS guards, false AS channels
    FROM padded), {_SWEEP_SQL} {_PLAN_SQL}""",
)


def _ranges(spark, sf_dir, even: bool):
    """A receiver's peaks as ranges, those of even or odd frames."""
    rows = R.peaks(A.bins(spark, sf_dir)).where(F.col("frame_id") % 2 == (0 if even else 1))
    return rows.select("receiver", "lower_hz", (F.col("upper_hz") + F.when(F.col("bin") % 7 == 0, 0).otherwise(10_000)).alias("upper_hz"))


# by elementary stretches between neighbouring bounds, not by a sweep
_SETS = f"""WITH {A.BINS_SQL}, {_FLOOR}, {_PEAKS}, {_EDGES}, {_FOUND}, given AS (
    SELECT p.receiver, p.frame_id % 2 AS side, f.lower_hz AS lo, f.upper_hz - 1 + CASE WHEN f.bin % 7 = 0 THEN 0 ELSE 10000 END AS hi
    FROM found f JOIN peaks p ON p.frame_id = f.frame_id AND p.bin = f.bin), ranges AS (SELECT DISTINCT * FROM given WHERE lo < hi),
    points AS (SELECT receiver, lo AS pt FROM ranges UNION SELECT receiver, hi FROM ranges),
    pieces AS (SELECT receiver, pt AS lo, lead(pt) OVER (PARTITION BY receiver ORDER BY pt) AS hi FROM points),
    held AS (SELECT p.receiver, p.lo, p.hi, count(DISTINCT side) AS sides FROM pieces p JOIN ranges r ON r.receiver = p.receiver AND r.lo <= p.lo AND p.hi <= r.hi GROUP BY ALL),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY receiver ORDER BY lo) AS run FROM (
        SELECT *, CASE WHEN lo = lag(hi) OVER (PARTITION BY receiver ORDER BY lo) THEN 0 ELSE 1 END AS fresh FROM held WHERE sides >= {{least}}))
    SELECT receiver, min(lo) AS lower_hz, max(hi) AS upper_hz FROM runs GROUP BY receiver, run"""
for _name, _least in (("set2_range_union", 1), ("set3_range_intersection", 2)):
    TABLE[_name] = (
        lambda s, d, least=_least: intervals.covered([(_ranges(s, d, True), "lower_hz", "upper_hz"), (_ranges(s, d, False), "lower_hz", "upper_hz")], ["receiver"], least, ("lower_hz", "upper_hz")),
        _SETS.format(least=_least),
    )
_POINTS = [(433_700_000, 2.0, -1.0), (434_000_000, 4.0, -2.0), (434_900_000, 1.0, 0.5)]
_INTER = "CASE WHEN frequency_hz <= 433700000 THEN {a} WHEN frequency_hz < 434000000 THEN {a} + (frequency_hz - 433700000) / 300000 * ({b} - {a}) WHEN frequency_hz < 434900000 THEN {b} + (frequency_hz - 434000000) / 900000 * ({c} - {b}) ELSE {c} END"
bins("rf11_apply_calibration", lambda b: R.apply_calibration(b, _POINTS), f"SELECT frame_id, bin, round(power_dbm + {_INTER.format(a=2.0, b=4.0, c=1.0)}, 6) AS power_dbm, round(noise_dbm + {_INTER.format(a=-1.0, b=-2.0, c=0.5)}, 6) AS noise_dbm FROM bins")
TABLE["rf7_analysis"] = (
    lambda s, d: (lambda b: R.occupancy(b).join(R.noise_floor(b).select("frame_id", "floor_dbm", "median_dbm"), "frame_id").join(R.peaks(b).groupBy("frame_id").agg(F.count("*").alias("peaks")), "frame_id", "left").join(T.spectrum_findings(b).groupBy("frame_id").agg(F.count("*").alias("anomalies")), "frame_id", "left").na.fill(0))(A.bins(s, d)),
    f"""WITH {A.BINS_SQL}, {_FLOOR}, {_PEAKS}, occ AS ({_OCC}), {_NOISE} SELECT occ.*, floor_dbm, median_dbm, coalesce(p.n, 0) AS peaks,
        (SELECT CASE WHEN avg(power_dbm) - avg(noise_dbm) < 3 THEN 1 ELSE 0 END + CASE WHEN max(power_dbm) >= 0 THEN 1 ELSE 0 END FROM bins b WHERE b.frame_id = occ.frame_id) AS anomalies
    FROM occ JOIN noise USING (frame_id) LEFT JOIN (SELECT frame_id, count(*) AS n FROM peaks WHERE place <= 64 GROUP BY frame_id) p ON p.frame_id = occ.frame_id""",
)
