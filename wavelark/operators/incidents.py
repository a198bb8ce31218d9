"""DIA15, DIA16, AGG29: an incident as one nested row, out of findings, alerts,
budgets, actions and impacts that carry its id.

The arrays are as long as an incident has rules, windows, changed series and
impacts. Exploding one gives the table again that it was built from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diagnostics

#: States of an incident, kinds of findings and timeline levels,
#: the last in rank order.
STATUSES = ("investigating", "identified", "mitigating", "resolved")
FINDING_KINDS = ("metric_anomaly", "alert", "slo_burn", "timeline_event", "operator_note")
LEVELS = diagnostics.TIMELINE_LEVELS


def level_of(severity: Column) -> Column:
    """The timeline level of a severity."""
    return F.when(severity.isin("high", "critical"), "error").when(severity == "medium", "warning").otherwise("info")


def _alert_severity(severity: Column) -> Column:
    return F.when(severity == "critical", "high").when(severity == "warning", "medium").otherwise("low")


def findings(alerts: DataFrame, slos: DataFrame, deltas: DataFrame, threshold: float, at_ns: int) -> DataFrame:
    """DIA13 in full: (incident, kind, severity, time_ns, source, summary, detail)
    of active alerts, strained budgets and metrics that changed by `threshold` or
    more; all three carry the incident. A change has no time of its own: 0."""
    make = lambda rows, kind, severity, at, source, summary, detail: rows.select("incident", F.lit(kind).alias("kind"), severity.alias("severity"), F.lit(at).cast("long").alias("time_ns"), source.alias("source"), summary.alias("summary"), detail.cast("string").alias("detail"))
    firing = alerts.where("state = 'active'")
    strained = slos.where("status IN ('warning', 'exhausted')")
    changed = deltas.where(F.abs("relative") >= threshold)
    detail = F.concat(F.lit("previous="), F.col("previous").cast("string"), F.lit(" current="), F.col("current").cast("string"))
    return (
        make(firing, "alert", _alert_severity(F.col("severity")), at_ns, F.concat(F.lit("alert:"), "id"), F.col("id"), F.col("reason"))
        .unionByName(make(strained, "slo_burn", F.when(F.col("status") == "exhausted", "critical").otherwise("medium"), at_ns, F.concat(F.lit("slo:"), "label"), F.concat("label", F.lit(" is "), "status"), F.lit(None)))
        .unionByName(make(changed, "metric_anomaly", F.when(F.abs("relative") >= 2 * threshold, "high").otherwise("medium"), 0, F.concat(F.lit("metric:"), "series"), F.concat("series", F.lit(" changed "), "trend"), detail))
    )


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def report(incidents: DataFrame, found: DataFrame, alerts: DataFrame, slos: DataFrame, impacts: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """A row per incident (incident, title, severity, status, opened_ns,
    updated_ns, resolved_ns) with the arrays findings, alerts, budgets, impacts
    (component, region, description, affected_devices, dropped_packets,
    delayed_packets), actions, recommended and timeline. What belongs to no
    incident is left out; an incident without any has empty arrays.

    The timeline tells when the incident was opened and resolved, its findings
    and its firing alerts, by time, graver ones first.
    """
    parts = [
        _listed(found, "findings", "time_ns", "kind", "severity", "source", "summary", "detail"),
        _listed(alerts, "alerts", "id", "kind", "severity", "state", "reason"),
        _listed(slos, "budgets", "label", "status", "used"),
        _listed(impacts, "impacts", "component", "region", "description", "affected_devices", "dropped_packets", "delayed_packets"),
    ]
    if actions is not None:
        parts.append(_listed(actions, "actions", "owner", "action", "rationale", "completed"))
    rows = incidents
    for part in parts:
        rows = rows.join(part, "incident", "left")
    if actions is None:
        rows = rows.withColumn("actions", F.expr("cast(array() AS array<struct<owner:string,action:string,rationale:string,completed:boolean>>)"))
    for name in ("findings", "alerts", "budgets", "impacts", "actions"):
        rows = rows.withColumn(name, F.coalesce(name, F.expr(f"slice({name}, 1, 0)"), F.from_json(F.lit("[]"), rows.schema[name].dataType)))
    n = {"exhausted_slos": F.size(F.filter("budgets", lambda b: b["status"] == "exhausted")), "firing_alerts": F.size(F.filter("alerts", lambda a: a["state"] == "active")), "open_actions": F.size(F.filter("actions", lambda a: ~a["completed"])), "impact_count": F.size("impacts")}
    rows = rows.withColumns(n)
    called = diagnostics.recommended(rows.select("incident", "status", "exhausted_slos", "firing_alerts", "open_actions", F.col("impact_count").alias("impacts")))
    rows = rows.join(_listed(called, "recommended", "step", "owner", "action", "reason"), "incident", "left")
    event = lambda at, level, source, message: F.struct(at.cast("long").alias("time_ns"), level.alias("level"), source.alias("source"), message.alias("message"))
    told = F.concat(
        F.array(event(F.col("opened_ns"), F.lit("info"), F.lit("incident"), F.concat(F.lit("opened "), F.col("incident").cast("string")))),
        F.when(F.col("resolved_ns").isNotNull(), F.array(event(F.col("resolved_ns"), F.lit("info"), F.lit("incident"), F.concat(F.lit("resolved "), F.col("incident").cast("string"))))).otherwise(F.array()),
        F.transform("findings", lambda f: event(f["time_ns"], level_of(f["severity"]), f["source"], f["summary"])),
        F.transform(F.filter("alerts", lambda a: a["state"] == "active"), lambda a: event(F.col("updated_ns"), level_of(_alert_severity(a["severity"])), F.concat(F.lit("alert:"), a["id"]), a["reason"])),
    )
    placed = F.transform(told, lambda e: F.struct(e["time_ns"].alias("time_ns"), (-_rank(e["level"])).alias("rank"), e["source"].alias("source"), e["message"].alias("message"), e["level"].alias("level")))
    timeline = F.transform(F.array_sort(placed), lambda e: F.struct(e["time_ns"].alias("time_ns"), e["level"].alias("level"), e["source"].alias("source"), e["message"].alias("message")))
    return rows.withColumn("timeline", timeline)


def _rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int")


def summary(reports: DataFrame) -> DataFrame:
    """AGG29: an incident's duration, to when it was resolved or else updated and
    never negative, and how much it has of everything."""
    end = F.coalesce("resolved_ns", "updated_ns")
    return reports.select(
        "incident", "severity", "status", "opened_ns", "updated_ns", F.greatest(end - F.col("opened_ns"), F.lit(0)).cast("long").alias("duration_ns"), F.col("impact_count").cast("long").alias("impacts"), F.size("findings").cast("long").alias("findings"),
        F.size("actions").cast("long").alias("actions"), F.col("open_actions").cast("long").alias("open_actions"), F.col("firing_alerts").cast("long").alias("firing_alerts"), F.col("exhausted_slos").cast("long").alias("exhausted_slos"),
    )


def status_counts(reports: DataFrame) -> DataFrame:
    """Incidents per status, statuses without any too."""
    known = reports.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(reports.groupBy("status").agg(F.count("*").alias("incidents")), "status", "left").na.fill(0)


def timeline(reports: DataFrame) -> DataFrame:
    """DIA15: the events of every incident, place being their order."""
    return reports.select("incident", F.posexplode("timeline").alias("place", "e")).select("incident", "place", "e.*")


def at_or_above(events: DataFrame, level: str) -> DataFrame:
    """FLT13: events of a level or a graver one."""
    return events.where(F.col("level").isin(*LEVELS[LEVELS.index(level) :]))


def between(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """FLT13: events from start to end, both included."""
    return events.where(F.col("time_ns").between(start_ns, end_ns))
