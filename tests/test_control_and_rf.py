"""Order-dependent and RF operators on small cases worked out by hand."""

from wavelark.operators import control as C
from wavelark.operators import planning as P
from wavelark.operators import history as H
from wavelark.operators import interference as I
from wavelark.operators import rf as R

MS = 1_000_000


def test_admission(spark):
    steps = [
        # time, kind, level -> action, delay, factor
        (0, "observation", "throttle", "delay", 2 * MS, 1),
        (MS, "observation", "nominal", "delay", MS, 1),
        (MS, "heartbeat", "shed", "accept", 0, 1),
        (2 * MS, "observation", "shed", "downsample", 0, 2),
        (2 * MS, "observation", "shed", "downsample", 0, 4),
        (3 * MS, "observation", "throttle", "delay", 6 * MS, 4),
        (9 * MS, "observation", "watch", "accept", 0, 1),
        (9 * MS, "control", "stop", "reject", 0, 16),
        (10 * MS, "observation", "nominal", "delay", 999 * MS, 16),
        (10 * MS, "control", "watch", "accept", 0, 1),
    ]
    df = spark.createDataFrame([(1, t, n, k, level) for n, (t, k, level, *_) in enumerate(steps)], "device long, capture_time_ns long, offset long, kind string, level string")
    got = sorted(C.admission(df, C.Admission(MS, 1000 * MS)).collect(), key=lambda r: r.offset)
    assert [(r.action, r.delay_ns, r.factor) for r in got] == [s[3:] for s in steps]


def test_pressure_gate_needs_four_places(spark):
    rows = [(1, 8, 3, 0), (2, 8, 2, 0), (3, 3, 3, 0), (4, 8, 0, 1)]
    df = spark.createDataFrame([(d, 0, cap, 0, 100, stalled, inflight) for d, cap, inflight, stalled in rows], "device int, packets int, packet_capacity int, bytes int, byte_capacity int, stalled int, inflight int")
    assert {r.device: r.level for r in C.pressure(df).collect()} == {1: "watch", 2: "nominal", 3: "nominal", 4: "throttle"}


def test_retention_floors_are_exclusive(spark):
    df = spark.createDataFrame([("a", 0, 0, 0), ("b", 9, 5, 50), ("c", 10, 5, 50)], "archive_path string, records long, last_time_ns long, payload_bytes long")
    got = {r.archive_path: (r.action, r.reason) for r in P.retention(df, P.Retention(record_floor=10, delete_before=6)).collect()}
    assert got == {"a": ("delete", "empty archive"), "b": ("keep", "below minimum record floor"), "c": ("delete", "older than delete threshold")}


def test_constant_iq_window(spark):
    df = spark.createDataFrame([(1, n, 0.5, -0.25) for n in range(8)], "window_id long, n int, i double, q double")
    r = R.iq_summary(df).first()
    assert (r.crest_db, r.gain_imbalance_db, r.phase_error_deg, r.rms) == (-120.0, -120.0, 0.0, 0.0)


def test_interference_kinds(spark):
    rows = [
        (1, 1, 1_575_420_000, 0.0, 40.0, "narrowband", 0, 0),
        (1, 2, 1_575_420_000, -60.0, 13.0, "narrowband", 0, 0),
        (1, 3, 600_000_000, -60.0, 31.0, "narrowband", 0, 0),
        (1, 4, 87_500_500, -60.0, 5.0, "narrowband", 0, 0),
        (1, 5, 610_000_000, -60.0, 31.0, "wideband", 0, 0),
        (1, 6, 100_000_000, -60.0, 7.0, "flat_top", 0, 0),
        # the centre lies in no allocation, the upper edge does, in its guard
        (1, 7, 862_990_000, -60.0, 7.0, "wideband", 5_000, 20_000),
        # the centre is outside the guard, the range reaches into it
        (1, 8, 869_890_000, -60.0, 7.0, "wideband", 5_000, 10_000),
    ]
    rows = [(f, b, hz, p, snr, hz - lo, hz + hi, shape) for f, b, hz, p, snr, shape, lo, hi in rows]
    peaks = spark.createDataFrame(rows, "frame_id long, bin int, frequency_hz long, power_dbm double, snr_db double, lower_hz long, upper_hz long, shape string")
    occupied = spark.createDataFrame([(1, 0.1, 2.0), (2, 0.1, 2.0)], "frame_id long, ratio double, mean_margin_db double")
    noise = spark.createDataFrame([(1, -90.0, -100.0), (2, -99.0, -100.0)], "frame_id long, floor_dbm double, median_dbm double")
    bins = spark.createDataFrame([(f, 1_000 * n) for f in (1, 2) for n in range(4)], "frame_id long, frequency_hz long")
    expected = spark.createDataFrame([("a", -70.0, 4.0, 600_000_000, 3, None, None), ("b", -60.0, 4.0, 0, 0, 610_000_000, 610_000_001)], "signal string, nominal_dbm double, tolerance_db double, center_hz long, bandwidth_hz long, low_hz long, high_hz long")
    got = sorted((r.bin, r.kind, r.severity, r.excess_db, round(r.confidence, 4)) for r in I.findings(bins, peaks, occupied, noise, expected).collect())
    assert got == [
        (-1, "broadband_noise", "medium", 10.0, 0.5), (1, "overload", "critical", 40.0, 1.0), (2, "co_channel", "high", 13.0, 0.675), (2, "narrowband_carrier", "medium", 13.0, 0.675),
        (3, "co_channel", "low", 6.0, 0.7), (3, "narrowband_carrier", "critical", 31.0, 1.0), (4, "adjacent_channel", "medium", 5.0, 0.475), (6, "co_channel", "high", 7.0, 0.525),
        (7, "adjacent_channel", "medium", 7.0, 0.525), (8, "adjacent_channel", "medium", 7.0, 0.525),
    ]
    broad = I.findings(bins, peaks.where("false"), occupied, noise).first()
    assert (broad.lower_hz, broad.upper_hz) == (0, 4_000)


def _bins(spark, power, noise=-100.0):
    return spark.createDataFrame([(1, 7, 0, n, 1_000_000 + n * 10_000, p, noise) for n, p in enumerate(power)], "frame_id long, receiver int, time_ns long, bin int, frequency_hz long, power_dbm double, noise_dbm double")


def _brute_peaks(power, floor, snr=6.0, drop=3.0):
    """Edges and shapes by walking from every local maximum."""
    n, out = len(power), {}
    at = lambda i: power[i] if 0 <= i < n else float("-inf")
    top = [at(i) >= at(i - 1) and at(i) >= at(i + 1) and (at(i) > at(i - 1) or at(i) > at(i + 1)) for i in range(n)]
    for c in range(n):
        if not top[c] or power[c] - floor[c] < snr:
            continue
        level = max(floor[c] + snr, power[c] - drop)
        ends = []
        for step in (-1, 1):
            i = c
            while 0 <= i + step < n and not (power[i + step] < level and power[i + step] < floor[i + step] + snr):
                i += step
            ends.append(i)
        lo, hi = ends
        wide = hi - lo + 1
        tones = sum(top[i] and power[i] > floor[i] + 3 for i in range(lo, hi + 1))
        if wide <= 2:
            shape = "narrowband"
        elif wide >= 12:
            shape = "flat_top" if power[c] - (power[lo] + power[hi]) / 2 < 3 else "wideband"
        else:
            shape = "multi_tone" if tones >= 3 else "shoulder" if abs(power[hi] - power[lo]) > 6 else "narrowband"
        out[c] = (lo, hi, shape)
    return out


def test_peak_edges_and_shapes(spark):
    import random

    rng = random.Random(5)
    shapes = set()
    for power in ([-100.0] * 20 + [-60.0] + [-100.0] * 20, [-100.0] * 20 + [-60.0 - (i % 2) for i in range(16)] + [-100.0] * 20, [-100.0] * 20 + [-60.0, -80.0, -61.0, -82.0, -62.0] + [-100.0] * 20, [-100.0] * 20 + [-90.0, -80.0, -60.0] + [-100.0] * 20, [rng.choice([-100.0, -90.0, -70.0, -60.0]) for _ in range(64)], [-100.0], [-5.0, -100.0]):
        df = _bins(spark, power)
        floor = [r.floor_dbm for r in sorted(R.floor_by_bin(df).collect(), key=lambda r: r.bin)]
        got = {r.bin: (r.lower_bin, r.upper_bin, r.shape) for r in R.peaks(df).collect()}
        assert got == _brute_peaks(power, floor)
        shapes |= {x[2] for x in got.values()}
    assert shapes >= {"narrowband", "flat_top", "multi_tone"}


def test_close_peaks_merge(spark):
    df = _bins(spark, [-100.0] * 20 + [-60.0, -100.0, -50.0] + [-100.0] * 20)
    assert R.peaks(df).count() == 2
    (one,) = R.peaks(df, merge_gap_hz=20_000).collect()
    assert (one.bin, one.lower_bin, one.upper_bin, one.shape, one.bandwidth_hz, one.power_dbm) == (22, 20, 22, "wideband", 20_000, -50.0)


def test_tracks_follow_the_nearest_median():
    rows = list(enumerate([100_000, 110_000, 200_000, 124_000, 140_000, 126_000, 150_001, 149_999]))
    got = [sorted(p[2] for p in points) for _, points in H.follow([(n, n, [(f, -50.0, 9.0)]) for n, f in rows])]
    members = []
    for _, f in rows:
        near, i = min(((abs(sorted(m)[len(m) // 2] - f), i) for i, m in enumerate(members)), default=(25_001, -1))
        if near > 25_000:
            members.append([])
            i = len(members) - 1
        members[i].append(f)
    assert got == [sorted(m) for m in members]


def test_nearest_channel_has_no_radius(spark):
    df = spark.createDataFrame([(1, 550_000_000), (2, 1), (3, None), (4, 99_000_000_000), (5, 433_087_500)], "id int, hz long")
    channels = R.channels(spark).collect()
    for r in R.nearest_channel(df, "hz").collect():
        assert r.delta_hz == (None if r.hz is None else min(abs(c.center_hz - r.hz) for c in channels))
