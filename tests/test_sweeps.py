"""Sweep segments and merges against a walk over them."""

import random

from pyspark.sql import functions as F

from wavelark.operators import sweeps

REQUEST = "plan long, intent string, lower_hz long, upper_hz long, service string, resolution_hz int, dwell_us int, priority string, guards boolean, channels boolean"


def walk(low, high, span, width):
    out, at = [], low
    while at < high:
        top = min(high, at + span)
        if top < high:
            top = min(high, -(-top // width) * width)
        out.append((at, top))
        at = top
    return out


def test_pieces(spark):
    rng = random.Random(1)
    receiver = sweeps.Receiver(min_hz=2_000_000_000, max_hz=2_100_000_000, max_span_hz=1_000_000, usable_fraction=0.37)
    rows = [(n, "survey", (lo := rng.randint(1_999_000_000, 2_100_500_000)), lo + rng.choice([-1, 0, 1, 369_999, 370_000, 370_001, 400_000, 740_000, 3_333_333, 10_000_000]), None, rng.choice([1, 7_000, 25_000]), 20_000, "low", False, False) for n in range(60)]
    requests = spark.createDataFrame(rows, REQUEST)
    got = {}
    for r in sweeps.candidates(requests, receiver).collect():
        got.setdefault(r.plan, []).append((r.lower_hz, r.upper_hz))
    want = {}
    for n, _, lo, hi, _, step, *_ in rows:
        lo, hi = max(lo, 2_000_000_000), min(hi, 2_100_000_000)
        if rows[n][2] < rows[n][3] and lo < hi:
            want[n] = walk(lo, hi, 370_000, max(step, 1_000))
    assert {k: sorted(v) for k, v in got.items()} == want
    told = {r.plan: r.warning for r in sweeps.warnings(requests, receiver).collect()}
    assert set(told) == {n for n in range(60)} - set(want)
    assert any(w == "ignored empty sweep request" for w in told.values())


def test_merges(spark):
    rng = random.Random(2)
    rows = [(p, rng.choice(["high", "urgent"]), rng.choice(["survey"] * 6 + ["occupancy"]), (lo := rng.randint(0, 400) * 10), lo + rng.randint(1, 40) * 5, 20, rng.randint(1, 9), rng.choice([None, None, "a", "b"]), f"r{n}") for p in range(4) for n in range(90)]
    rows += [(9, "low", "survey", 10, 20, 5, 1, None, "alone")]
    table = spark.createDataFrame(rows, "plan long, priority string, intent string, lower_hz long, upper_hz long, bin_width_hz long, dwell_us long, allocation string, reason string").repartition(5)
    receiver = sweeps.Receiver(max_span_hz=400, min_step_hz=1, usable_fraction=1.0)
    want = []
    for plan in (0, 1, 2, 3, 9):
        last = None
        for s in sorted((r for r in rows if r[0] == plan), key=lambda r: (-sweeps.WEIGHTS[r[1]], r[3], r[4], r[2], r[8])):
            fits = last and last[1:3] == list(s[1:3]) and not (last[7] and s[7] and last[7] != s[7]) and s[3] - last[4] <= 2 * last[5] and max(last[4], s[4]) - last[3] <= 400
            if fits:
                last[4], last[6], last[8], last[9] = max(last[4], s[4]), max(last[6], s[6]), f"{last[8]}; {s[8]}", last[9] + 1
            else:
                last = [*s, 1]
                want.append(last)
    got = sweeps.merged(table, receiver).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, want))
    assert sweeps.merged(table.where("false"), receiver).count() == 0


def test_followup_requests(spark):
    rows = [(1, 100_000, 100_010, "critical", None), (2, 433_900_000, 434_000_000, "low", "433 MHz ISM"), (3, 20_000, 20_010, "low", "FM broadcast")]
    found = spark.createDataFrame(rows, "frame_id long, lower_hz long, upper_hz long, severity string, allocation string")
    got = {r.plan: (r.lower_hz, r.upper_hz, r.service, r.priority, r.dwell_us) for r in sweeps.followup_requests(found).collect()}
    assert got == {1: (100_000, 100_010, None, "urgent", 100_000), 2: (433_800_000, 434_100_000, "ism", "high", 50_000), 3: (0, 70_010, "broadcast", "high", 50_000)}
    whole = sweeps.plan(sweeps.followup_requests(found)).where(F.col("reason").contains("guard range for 433 MHz ISM")).count()
    assert whole == 0
