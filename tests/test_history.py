"""Spectrum history against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from wavelark.operators import history as H
from wavelark.plans import rf_queries
from wavelark.sources import adapters


def model(observations, tolerance):
    """Tracks by the words of the definition, with lists scanned from the front."""
    tracks = []
    for frame, time, peaks in sorted(observations, key=lambda o: (o[1], o[0])):
        for hz, dbm, _ in peaks:
            best, least = None, tolerance + 1
            for t in tracks:
                at = sorted(p[1] for p in t)[len(t) // 2]
                if abs(at - hz) < least:
                    best, least = t, abs(at - hz)
            if best is None:
                best = []
                tracks.append(best)
            best.append((time, hz, dbm, frame))
    out = []
    for t in tracks:
        share, n = len(t) / len(observations), len(t)
        x = [(p[0] - t[0][0]) / 3.6e12 for p in t]
        y = [p[2] for p in t]
        mx, my = sum(x) / n, sum(y) / n
        xx = sum((a - mx) ** 2 for a in x)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / xx if n > 1 and xx > 1e-9 else 0.0
        change = y[-1] - y[0]
        if 1 - share > 0.55:
            trend = "intermittent"
        elif y[0] == 0 and y[-1] != 0:
            trend = "new_signal"
        elif y[0] != 0 and y[-1] == 0:
            trend = "disappeared"
        else:
            trend = "rising" if slope > 1 or change > 3 else "falling" if slope < -1 or change < -3 else "stable"
        hz = sorted(p[1] for p in t)
        out.append((hz[n // 2], hz[0], hz[-1] + 1, n, round(share, 9), round(my, 6), round(slope, 5), hz[-1] - hz[0], trend))
    return sorted(out)


@pytest.fixture(scope="module")
def observed(spark):
    rng = random.Random(3)
    rows = []
    for receiver in (1, 2, 3):
        for n in range(150):
            carriers = [100_000 * k + rng.choice([0, 0, 4_000, -9_000, 26_000]) for k in range(1, 7) if rng.random() < k / 7]
            peaks = [(hz, float(rng.choice([0, -50, -80])) + (0.1 * n if hz > 500_000 else 0), 9.0) for hz in carriers]
            rows.append((receiver, n, n * rng.choice([1, 2]) * 60_000_000_000, 0.1 * receiver if n < 100 else 0.0, rng.sample(peaks, len(peaks))))
    return rows, spark.createDataFrame(rows, f"receiver int, frame_id long, time_ns long, ratio double, peaks array<{H.PEAK}>")


def test_tracks(observed):
    rows, df = observed
    ring = {r: sorted((o for o in rows if o[0] == r), key=lambda o: (o[2], o[1]))[-128:] for r in (1, 2, 3)}
    kept = H.latest(df)
    assert {(r.receiver, r.frame_id) for r in kept.collect()} == {(o[0], o[1]) for x in ring.values() for o in x}
    got = H.tracks(kept).collect()
    for r, part in ring.items():
        want = model([(o[1], o[2], o[4]) for o in part], H.TOLERANCE_HZ)
        own = [t for t in got if t.receiver == r]
        assert sorted((t.nominal_hz, t.lower_hz, t.upper_hz, t.points, round(t.persistence, 9), round(t.mean_dbm, 6), round(t.slope_db_per_hour, 5), t.drift_hz, t.trend) for t in own) == want
        assert [t.track for t in sorted(own, key=lambda t: (-t.persistence, -t.mean_dbm))] == list(range(len(own)))
    assert {"intermittent", "rising"} <= {t.trend for t in got}
    assert H.points(kept).count() == sum(len(o[4]) for x in ring.values() for o in x)


def test_choices_and_findings(observed):
    _, df = observed
    kept = H.latest(df)
    tracks = H.tracks(kept).cache()
    best = H.strongest(tracks, 2, 0.3).orderBy("receiver", "place").collect()
    assert len(best) == 6 and all(a.mean_dbm >= b.mean_dbm for a, b in zip(best[::2], best[1::2], strict=True))
    assert all(r.lower_hz < 320_000 and r.upper_hz > 280_000 for r in H.in_range(tracks, 280_000, 320_000).collect())
    assert {r.trend for r in H.with_trend(tracks, "rising").collect()} == {"rising"}
    told = {r.receiver: r for r in H.occupancy_trend(kept).collect()}
    assert told[1].trend == "disappeared" and told[1].observations == 128 and told[1]["last"] == 0
    said = [r.finding for r in H.findings(tracks, H.occupancy_trend(kept), H.occupancy_trend(kept.withColumn("score", 100 - F.col("time_ns") / 3.6e12 * 6), "score")).collect()]
    for text in ("rising carrier near ", "occupancy is disappeared from 0.100000 to 0.000000", "quality score is degrading over time", "frequency drift exceeds match tolerance near "):
        assert any(x.startswith(text) for x in said)
    assert H.tracks(kept.where("false")).count() == 0


def test_queries_on_tables(spark, data):
    observed = H.observations(adapters.bins(spark, data)).collect()
    want = {}
    for r in {o.receiver for o in observed}:
        want[r] = model([(o.frame_id, o.time_ns, [tuple(p) for p in o.peaks]) for o in observed if o.receiver == r], H.TOLERANCE_HZ)
    got = rf_queries.TABLE["sup21_tracks"][0](spark, data).collect()
    for r, tracks in want.items():
        assert sorted((t.nominal_hz, t.lower_hz, t.upper_hz, t.points, t.drift_hz, t.trend) for t in got if t.receiver == r) == sorted((*t[:4], *t[7:]) for t in tracks)
