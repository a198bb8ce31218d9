"""Calibration profiles: empty tables, bad profiles, merges at one frequency."""

from wavelark.operators import calibration

SCHEMA = (
    "key long, id string, receiver string, antenna string, lower_hz long, upper_hz long, valid_from_ns long, valid_until_ns long, "
    "points array<struct<frequency_hz: long, gain_db: double, noise_db: double, uncertainty_db: double>>, tags array<string>"
)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_empty(spark):
    none = table(spark, [])
    assert calibration.summary(none).first()[:4] == (0, 0, None, None)
    assert calibration.issues(none).count() == 0


def test_issues(spark):
    bad = table(spark, [(1, "", "", "a", 5, 5, 0, 0, [], []), (2, "p", "r", "a", 0, 10, 0, 0, [(4, 0.0, 0.0, -1.0), (4, 1.0, 0.0, 0.0), (10, 0.0, 0.0, 0.0)], [])])
    assert sorted(r.issue for r in calibration.issues(bad).collect()) == [
        "calibration point outside profile range: p",
        "calibration points are not strictly increasing: p",
        "calibration profile  has empty frequency range",
        "calibration profile  has empty receiver id",
        "calibration profile  has no correction points",
        "calibration profile has empty id",
        "negative calibration uncertainty: p",
    ]


def test_merge(spark):
    base = table(spark, [(1, "b", "r", "a", 0, 10, 5, 0, [(1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], ["y", "x"])])
    over = table(spark, [(1, "o", "r", "a", 20, 30, 7, 90, [(2, 9.0, 0.0, 0.0)], ["y"])])
    got = calibration.merged(base, over, "key", base["id"]).first()
    assert (got.lower_hz, got.upper_hz, got.valid_from_ns, got.valid_until_ns, got.tags) == (0, 30, 7, 90, ["x", "y"])
    assert [(p.frequency_hz, p.gain_db) for p in got.points] == [(1, 1.0), (2, 9.0)]
