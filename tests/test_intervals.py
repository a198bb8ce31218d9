"""Overlap joins and range sets against all pairs and all points."""

import random

from wavelark.operators import intervals


def test_overlapping(spark):
    rng = random.Random(4)
    side = lambda n: [(i, rng.choice("ab"), (lo := rng.choice([rng.randint(-50, 50), rng.randint(-(10**12), 10**12)])), lo + rng.choice([0, 1, 2, 16, 17, 300, 10**6, 2 * 10**12, -3])) for i in range(n)]
    a, b = side(120), side(100)
    a += [(900, "a", None, 5), (901, None, 0, 5), (902, "a", -(10**12), 10**12)]
    left = spark.createDataFrame(a, "i int, k string, lo long, hi long")
    right = spark.createDataFrame(b, "j int, k string, f long, t long")
    got = sorted((r.i, r.j) for r in intervals.overlapping(left, right, ("lo", "hi"), ("f", "t"), ["k"]).collect())
    want = sorted((i, j) for i, k, lo, hi in a for j, m, f, t in b if k is not None and k == m and lo is not None and lo < hi and f < t and lo < t and f < hi)
    assert got == want and len(want) > 100
    assert intervals.overlapping(left.where("false"), right, ("lo", "hi"), ("f", "t"), ["k"]).count() == 0
    plan = intervals.overlapping(left, right.drop("k"), ("lo", "hi"), ("f", "t"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_covered(spark):
    rng = random.Random(5)
    sets = [[(rng.choice("xy"), lo := rng.randint(0, 60), lo + rng.randint(-1, 9)) for _ in range(12)] for _ in range(3)]
    frames = [(spark.createDataFrame(s, "k string, lo long, hi long"), "lo", "hi") for s in sets]
    for least in (1, 2, 3):
        got = sorted(tuple(r) for r in intervals.covered(frames, ["k"], least).collect())
        want = []
        for k in "xy":
            at = [sum(any(m == k and lo <= p < hi for m, lo, hi in s) for s in sets) >= least for p in range(-1, 80)]
            starts = [p - 1 for p in range(1, 81) if at[p] and not at[p - 1]]
            ends = [p - 1 for p in range(1, 81) if not at[p] and at[p - 1]]
            want += [(k, a, z) for a, z in zip(starts, ends, strict=True)]
        assert got == sorted(want)
