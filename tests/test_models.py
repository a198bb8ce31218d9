"""Registered queries that SQL doesn't express, against plain models of their
results on the test tables."""

import collections

import pytest

from wavelark.plans import diagnostic_queries, planning_queries, rf_queries
from wavelark.sources import adapters

HOUR = 3_600_000_000_000


@pytest.fixture(scope="module")
def packets(spark, data):
    return sorted((r.device, r.capture_time_ns, r.archive_path, r.offset, r.payload_size) for r in adapters.packets(spark, data).collect())


def test_token_bucket(spark, data, packets):
    got = {(r.device, r.offset): r.allowed for r in diagnostic_queries.TABLE["ctl4_token_bucket"][0](spark, data).collect()}
    start, own = diagnostic_queries.T0, collections.defaultdict(list)
    for device, time, _, offset, _ in packets:
        own[device].append((start + (time - start) // 10_000, offset))
    want = {}
    for device, rows in own.items():
        tokens, last = 2, None
        for now, offset in sorted(rows):
            last = now if last is None else last
            gained = (now - last) // 1_000_000_000
            if gained:
                tokens, last = min(2, tokens + gained), now
            want[device, offset] = tokens > 0
            tokens -= tokens > 0
    assert got == want and set(got.values()) == {True, False}


def test_mixed_rotation(spark, data, packets):
    got = {(r.device, r.archive_path, r.offset): (r.shard, r.opened_by) for r in planning_queries.TABLE["pln3_rotation_mixed"][0](spark, data).collect()}
    want, state = {}, {}
    for device, time, path, offset, size in packets:
        shard, n, payload, start, before = state.get(device, (0, 0, 0, 0, 0))
        limits = (("max_records", n >= 25), ("max_payload_bytes", payload + size > 20_000), ("max_span_ns", time - start > 9 * 24 * HOUR), ("idle_gap", time - before > 2 * 24 * HOUR))
        why = next((name for name, over in limits if n and over), None)
        if why:
            shard, n, payload = shard + 1, 0, 0
        state[device] = (shard, n + 1, payload + size, start if n else time, time)
        want[device, path, offset] = (shard, why)
    assert got == want and len({why for _, why in want.values()}) > 2


def test_track_choices(spark, data):
    tracks = [r.asDict() for r in rf_queries.TABLE["sup21_tracks"][0](spark, data).collect()]
    best = collections.defaultdict(list)
    for t in sorted(tracks, key=lambda t: (-t["mean_dbm"], -t["persistence"], t["track"])):
        if t["persistence"] >= 0.1 and len(best[t["receiver"]]) < 10:
            best[t["receiver"]].append(t["track"])
    got = collections.defaultdict(list)
    for r in sorted(rf_queries.TABLE["srt5_strongest_tracks"][0](spark, data).collect(), key=lambda r: (r.receiver, r.place)):
        got[r.receiver].append(r.track)
    assert dict(got) == {k: v for k, v in best.items() if v}
    inside = [(t["receiver"], t["track"]) for t in tracks if t["lower_hz"] < 434_400_000 and t["upper_hz"] > 433_900_000]
    rows = rf_queries.TABLE["srt6_tracks_in_range"][0](spark, data).collect()
    assert sorted((r.receiver, r.track) for r in rows) == sorted(inside) and [r.persistence for r in rows] == sorted((r.persistence for r in rows), reverse=True)
    rising = [(t["receiver"], t["track"]) for t in tracks if t["trend"] == "rising"]
    assert sorted((r.receiver, r.track) for r in rf_queries.TABLE["srt6_rising_tracks"][0](spark, data).collect()) == sorted(rising)
    whole = rf_queries.TABLE["rf17_tracks"][0](spark, data).groupBy("receiver", "track").count().collect()
    assert {(r.receiver, r.track): r["count"] for r in whole} == {(t["receiver"], t["track"]): t["points"] for t in tracks}
