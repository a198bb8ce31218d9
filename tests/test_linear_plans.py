"""Passes and windows whose work grows with their rows, against brute force."""

import random

import pyarrow as pa

from wavelark.functions import udfs
from wavelark.operators import planning, rf, sequences, sweeps


def executed(df):
    return df._jdf.queryExecution().toString()


def test_sliding_windows_overlap_in_no_frame(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), n, rng.choice([None, *range(-40, 200, 7)]), rng.choice([None, *range(-9, 9)])) for n in range(300)]
    df = spark.createDataFrame(rows, "channel long, reading_id long, time_ns long, value int")
    got = sequences.sliding(df, 20)
    want = []
    for channel, reading, time, _ in rows:
        inside = [r for r in rows if r[0] == channel and ((r[2] is None and time is None) or (r[2] is not None and time is not None and time - 20 <= r[2] <= time))]
        values = [r[3] for r in inside if r[3] is not None]
        want.append((channel, reading, time, min((r[2] for r in inside if r[2] is not None), default=None), len(inside), round(sum(values) / len(values), 6) if values else None, min(values, default=None), max(values, default=None)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "RangeFrame, -" not in executed(got)


def test_rotation_is_one_pass_without_groups(spark):
    rng = random.Random(3)
    rows = [(d, f"a{rng.randrange(2)}", n * 10 + d, rng.randrange(5_000), rng.randrange(60)) for d in range(7) for n in range(40)]
    policy = planning.Rotation(max_records=6, max_payload=150, max_span=900, idle_gap=300)
    want = []
    for d in range(7):
        shard = (0, 0, 0, 0, 0)
        for _, path, offset, time, size in sorted((r for r in rows if r[0] == d), key=lambda r: (r[3], r[1], r[2])):
            shard, why = planning.place(policy, shard, time, size)
            want.append((d, path, offset, shard[0], why))
    got = planning.rotation(spark.createDataFrame(rows, "device long, archive_path string, offset long, capture_time_ns long, payload_size long"), policy)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroupsIn" not in executed(got) and "Window" not in executed(got)


def test_sweeps_merge_in_one_pass_without_groups(spark):
    rows = [(p, "high", "survey", 1_000 * k + 37 * p, 1_000 * k + 1_500, 1_000, 10 + k, None, f"r{k}") for p in range(40) for k in (0, 1, 9, 10, 11)]
    got = sweeps.merged(spark.createDataFrame(rows, "plan long, priority string, intent string, lower_hz long, upper_hz long, bin_width_hz long, dwell_us long, allocation string, reason string"), sweeps.Receiver())
    assert "FlatMapGroupsIn" not in executed(got)
    assert sorted((r.plan, r.merged, r.upper_hz, r.reason) for r in got.collect()) == sorted((p, n, u, r) for p in range(40) for n, u, r in ((2, 2_500, "r0; r1"), (3, 12_500, "r9; r10; r11")))


def test_nearest_channel_is_a_search_in_sorted_centers(spark):
    hz = [None, -5, 0, 87_700_000, 118_012_500, 433_075_000, 433_087_500, 150_006_250, 10**10]
    got = rf.nearest_channel(spark.createDataFrame([(x,) for x in hz], "hz long"), "hz")
    assert len(executed(got)) < 10_000
    channels = [(r.center_hz, r.name) for r in rf.channels(spark).collect()]
    for r in got.collect():
        want = None if r.hz is None else min(abs(c - r.hz) for c, _ in channels)
        assert r.delta_hz == want
        assert (r.channel_of is None) if r.hz is None else any(n == r.channel_of and abs(c - r.hz) == want for c, n in channels)


def test_payloads_are_python_values_by_parts():
    cells = [{"power_x10": -n, "noise_x10": -1040} for n in range(64)]
    sent = pa.array([{"format": "spectrum", "center_hz": n, "span_hz": 1, "bin_width_hz": 2, "bins": cells} for n in range(1_000)])
    assert [len(p) for p in udfs._parts(sent)] == [256, 256, 256, 232]
    back = udfs.decode_payload(udfs.encode_payload(sent)).to_pylist()
    assert [r["center_hz"] for r in back] == list(range(1_000)) and all(r["bins"] == cells for r in back[::100])
