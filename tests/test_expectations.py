"""Expectations of acks against a tracker that takes one event after the other."""

import random

from wavelark.operators import expectations as E

EXPECTED = "command_id long, device long, created_ns long, deadline_ns long, required_accepts int"
ACK = "command_id long, device long, time_ns long, status string, ordinal long"


def track(expected, acks, cancels, now):
    events = [(t, 0, 0, ("expect", c, d, t, dl or 0, max(r or 1, 1))) for c, d, t, dl, r in expected if c]
    events += [(t, 1, n, ("ack", c, d, t, s, n)) for c, d, t, s, n in acks] + [(t, 2, 0, ("cancel", c)) for c, t in cancels]
    open_, told, done = {}, [], []
    for at, _, _, e in sorted(events, key=lambda e: e[:3]):
        if at > now:
            continue
        if e[0] == "expect":
            open_[e[1]] = r = {"id": e[1], "device": e[2], "created": e[3], "deadline": e[4], "required": e[5], "state": "waiting", "accepts": 0, "rejects": 0, "n": 0}
            done.append(r)
            continue
        r = open_.get(e[1])
        if e[0] == "cancel":
            if r and r["state"] == "waiting":
                r["state"], r["n"] = "cancelled", r["n"] + 1
                told.append((e[1], r["created"], at, "cancelled"))
            continue
        _, command, device, time, status, _ = e
        if r is None:
            told.append((command, None, at, "unexpected"))
            continue
        if r["state"] != "waiting":
            kind = "duplicate"
        elif device != r["device"]:
            kind = "unexpected"
        elif r["deadline"] and time > r["deadline"]:
            kind = "stale"
        elif status in E.REJECTED:
            kind, r["rejects"], r["state"] = "rejected", r["rejects"] + 1, "satisfied"
        else:
            kind, r["accepts"] = "matched", r["accepts"] + 1
            if r["accepts"] >= r["required"]:
                r["state"] = "satisfied"
        r["n"] += 1
        told.append((command, r["created"], at, kind))
    for r in done:
        if r["state"] == "waiting" and r["deadline"] and r["deadline"] <= now:
            r["state"], r["n"] = "timed_out", r["n"] + 1
    return told, sorted((r["id"], r["created"], r["state"], r["accepts"], r["rejects"], r["n"]) for r in done)


def test_random_events(spark):
    rng = random.Random(6)
    times = rng.sample(range(1, 4000), 900)
    expected = [(rng.randint(0, 12), rng.randint(1, 2), t, rng.choice([0, None, t + 30, t + 400]), rng.choice([None, 0, 1, 2, 3])) for t in times[:200]]
    acks = [(rng.randint(0, 14), rng.randint(1, 2), rng.choice([t, expected[n % 200][2], (expected[n % 200][3] or t)]), rng.choice(["accepted", "accepted", "busy", "rejected", "unknown_command"]), n) for n, t in enumerate(times[200:800])]
    cancels = [(rng.randint(0, 12), t) for t in times[800:]]
    a, b, c = spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(acks, ACK), spark.createDataFrame(cancels, "command_id long, time_ns long")
    for now in (3_000, 10_000):
        told, states = track(expected, acks, cancels, now)
        seen = E.observations(a, b, c, now)
        assert sorted(map(str, ((r.command_id, r.created_ns, r.at_ns, r.kind) for r in seen.collect()))) == sorted(map(str, told))
        shots = E.snapshots(a, seen, now)
        assert sorted((r.command_id, r.created_ns, r.state, r.accepts, r.rejects, r.observations) for r in shots.collect()) == states
        assert {r[2] for r in states} == set(E.STATES)


def test_matches_duplicates_and_timeouts(spark):
    expected = spark.createDataFrame([(77, 60, 100, 500, 1), (99, 61, 100, 150, 1)], EXPECTED)
    acks = spark.createDataFrame([(77, 60, 200, "accepted", 1), (77, 60, 201, "accepted", 2), (88, 60, 250, "accepted", 3)], ACK)
    seen = E.observations(expected, acks, None, 300)
    assert [r.kind for r in seen.orderBy("at_ns").collect()] == ["matched", "duplicate", "unexpected"]
    shots = E.snapshots(expected, seen, 300)
    assert {r.command_id: (r.state, r.last_ns, r.observations) for r in shots.collect()} == {77: ("satisfied", 201, 2), 99: ("timed_out", 300, 1)}
    assert E.totals(shots, seen).first().asDict() == {"registered": 2, "timed_out": 1, "cancelled": 0, "matched": 1, "duplicate": 1, "unexpected": 1, "stale": 0, "rejected": 0}
    assert sorted((r.device, r.satisfied, r.timed_out) for r in E.device_summary(shots).collect()) == [(60, 1, 0), (61, 0, 1)]
