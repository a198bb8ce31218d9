"""Incidents as nested rows: order of events, empty parts, durations."""

import pytest

from wavelark.operators import diagnostics as D
from wavelark.operators import incidents as N

ALERT = "incident string, id string, kind string, severity string, state string, reason string"


@pytest.fixture(scope="module")
def reports(spark):
    ids = spark.createDataFrame([("a", "t", "high", "mitigating", 100, 500, None), ("b", "t", "low", "resolved", 300, 500, 200), ("c", "t", "low", "resolved", 100, 500, 400)], "incident string, title string, severity string, status string, opened_ns long, updated_ns long, resolved_ns long")
    alerts = spark.createDataFrame([("a", "r1", "threshold", "critical", "active", "threshold condition matched"), ("a", "r2", "stale", "info", "active", "metric is stale"), ("a", "r3", "missing", "warning", "inactive", "metric is present"), ("x", "r1", "missing", "warning", "active", "metric is absent")], ALERT)
    slos = spark.createDataFrame([("a", "1h", "exhausted", 2.0), ("a", "6h", "healthy", 0.1), ("c", "1h", "warning", 0.8)], "incident string, label string, status string, used double")
    deltas = spark.createDataFrame([("a", "s1", 1.0, 3.0, 2.0, "rising"), ("a", "s2", 1.0, 1.5, 0.5, "rising"), ("a", "s3", None, 1.0, None, "missing"), ("c", "s4", 1.0, 1.1, 0.1, "rising")], "incident string, series string, previous double, current double, relative double, trend string")
    impacts = spark.createDataFrame([("c", "core", "r", "d", 3, 2, 1)], "incident string, component string, region string, description string, affected_devices long, dropped_packets long, delayed_packets long")
    actions = spark.createDataFrame([("a", "me", "do", "why", False), ("a", "me", "done", "why", True)], "incident string, owner string, action string, rationale string, completed boolean")
    found = N.findings(alerts, slos, deltas, 0.5, 450)
    return N.report(ids, found, alerts, slos, impacts, actions).cache(), N.report(ids, found.where("false"), alerts.where("false"), slos.where("false"), impacts.where("false"))


def test_summaries(reports):
    got = {r.incident: (r.duration_ns, r.impacts, r.findings, r.actions, r.open_actions, r.firing_alerts, r.exhausted_slos) for r in N.summary(reports[0]).collect()}
    assert got == {"a": (400, 0, 5, 2, 1, 2, 1), "b": (0, 0, 0, 0, 0, 0, 0), "c": (300, 1, 1, 0, 0, 0, 0)}
    assert {r.status: r.incidents for r in N.status_counts(reports[0]).collect()} == {"investigating": 0, "identified": 0, "mitigating": 1, "resolved": 2}


def test_timeline(reports):
    events = N.timeline(reports[0])
    a = [(r.time_ns, r.level, r.source) for r in events.where("incident = 'a'").orderBy("place").collect()]
    assert a == [(0, "error", "metric:s1"), (0, "warning", "metric:s2"), (100, "info", "incident"), (450, "error", "alert:r1"), (450, "error", "slo:1h"), (450, "info", "alert:r2"), (500, "error", "alert:r1"), (500, "info", "alert:r2")]
    assert [r.message for r in events.where("incident = 'b'").orderBy("place").collect()] == ["resolved b", "opened b"]
    assert N.at_or_above(events, "warning").where("level = 'info'").count() == 0
    assert N.between(events, 100, 450).where("incident = 'a'").count() == 4


def test_exploded_arrays_are_the_tables(reports):
    steps = {(r.incident, r.step, r.action) for r in reports[0].selectExpr("incident", "inline(recommended)").collect()}
    assert steps == {("a", 1, D.ACTIONS[0][1]), ("a", 2, D.ACTIONS[1][1]), ("a", 4, D.ACTIONS[3][1]), ("b", 4, D.ACTIONS[3][1])}
    kinds = sorted(r.kind for r in reports[0].selectExpr("incident", "inline(findings)").where("incident = 'a'").collect())
    assert kinds == ["alert", "alert", "metric_anomaly", "metric_anomaly", "slo_burn"]


def test_incident_without_parts(reports):
    got = {r.incident: (len(r.findings), len(r.alerts), len(r.budgets), len(r.impacts), len(r.actions), len(r.timeline)) for r in reports[1].collect()}
    assert got == {"a": (0, 0, 0, 0, 0, 1), "b": (0, 0, 0, 0, 0, 2), "c": (0, 0, 0, 0, 0, 2)}
