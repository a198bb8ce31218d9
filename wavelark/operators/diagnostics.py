"""Metrics, alerts, service levels and incidents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sequences import trend


def canonical(name: Column, tags: Column) -> Column:
    """AGG19: name and tags, sorted by key, as one text."""
    return F.concat(name, F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), e["value"])), ""))


def with_series(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("series", canonical(F.col("name"), F.col("tags")))


def tagged(metrics: DataFrame, required: dict[str, str]) -> DataFrame:
    """JN14/FLT12: metrics that have all the required tags."""
    for k, v in required.items():
        metrics = metrics.where(F.col("tags")[k] == v)
    return metrics


def select_metrics(metrics: DataFrame, prefix: str = "", start: int | None = None, end: int | None = None) -> DataFrame:
    """FLT12: by name prefix and inclusive time range."""
    out = metrics.where(F.col("name").startswith(prefix))
    out = out if start is None else out.where(F.col("time_ns") >= start)
    return out if end is None else out.where(F.col("time_ns") <= end)


def rollup(metrics: DataFrame) -> DataFrame:
    """AGG18: first, last, range, sum and change of every series."""
    at = F.struct("time_ns", "ordinal")
    v = F.col("value")
    rows = with_series(metrics).groupBy("series").agg(F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"), F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.sum(v), 6).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.max_by(v, at).alias("latest"), F.min_by(v, at).alias("earliest"))
    return rows.withColumn("delta", F.round(F.col("latest") - F.col("earliest"), 6)).drop("earliest")


def series_sizes(metrics: DataFrame) -> DataFrame:
    """AGG19: samples per series."""
    return with_series(metrics).groupBy("series").agg(F.count("*").alias("samples"))


def snapshot_summary(metrics: DataFrame) -> DataFrame:
    """AGG20: counts per kind and the sum of counters and bytes."""
    total = lambda k: F.round(F.sum(F.when(F.col("kind") == k, F.col("value")).otherwise(0.0)), 6)
    return metrics.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("counter", "gauge", "latency", "bytes")], total("counter").alias("counters"), total("bytes").alias("bytes"))


def latest(metrics: DataFrame) -> DataFrame:
    """AGG20: the latest sample of every series; the last inserted wins ties."""
    last = F.max_by(F.struct("value", "time_ns"), F.struct("time_ns", "ordinal")).alias("r")
    return with_series(metrics).groupBy("series").agg(last).select("series", "r.value", "r.time_ns")


#: Default latency bounds in nanoseconds (fixed values).
LATENCY_BOUNDS = (1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000, 1_000_000_000)


def latency_buckets(df: DataFrame, value: Column) -> DataFrame:
    """AGG21: observations per bound (the first at or above the value), null
    for the overflow."""
    bounds = F.array(*[F.lit(b).cast("long") for b in LATENCY_BOUNDS])
    bound = F.array_min(F.filter(bounds, lambda b: b >= value))
    return df.groupBy(bound.alias("bound_ns")).agg(F.count("*").alias("n"))


def latency_stats(df: DataFrame, value: Column) -> DataFrame:
    """AGG21/AGG28: count, range, mean and interpolated percentiles."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    return df.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@dataclass(frozen=True)
class Alert:
    """A rule over the metric `name`; which fields count depends on `kind`:
    threshold, missing, stale, rate_of_change or trend."""

    id: str
    kind: str
    name: str
    severity: str = "warning"
    comparator: str = ">"
    value: float = 0.0
    window_ns: int = 0
    min_duration_ns: int = 0
    max_age_ns: int = 0
    expected: str = "rising"
    floor: float = 0.0
    enabled: bool = True
    suppressed: tuple[tuple[int, int], ...] = field(default=())


#: Comparators as written (fixed values).
COMPARATORS = {"=": "==", "==": "==", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def compare(a: Column, sign: str, b: Column | float) -> Column:
    """DIA9: a comparison by its sign."""
    sign = COMPARATORS[sign]
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def evaluate(metrics: DataFrame, rules: list[Alert], now_ns: int) -> DataFrame:
    """DIA2-DIA8: the state of every rule, active, inactive, suppressed or
    no_data, and the reason. `Current` samples are those of the last window before
    now (all, without a window). One aggregation answers all rules."""
    spark = metrics.sparkSession
    table = spark.createDataFrame([(r.id, r.kind, r.name, r.severity, r.comparator, r.value, r.window_ns, r.min_duration_ns, r.max_age_ns, r.expected, r.floor, r.enabled, any(a <= now_ns <= b for a, b in r.suppressed)) for r in rules], "id string, kind string, name string, severity string, comparator string, limit double, window_ns long, min_duration_ns long, max_age_ns long, expected string, floor double, enabled boolean, suppressed boolean")
    rows = metrics.select("name", "value", "time_ns", "ordinal").where(F.col("time_ns") <= now_ns)
    rows = rows.join(F.broadcast(table.select("id", "name", "comparator", "limit", "window_ns", "floor")), "name")  # as many rows as rules
    rows = rows.where((F.col("window_ns") == 0) | (F.col("time_ns") >= now_ns - F.col("window_ns")))
    order = F.struct("time_ns", "ordinal")
    hit = F.coalesce(*[F.when(F.col("comparator") == c, compare(F.col("value"), c, F.col("limit"))) for c in COMPARATORS])
    step = F.col("value") - F.lag("value").over(W.partitionBy("id").orderBy("time_ns", "ordinal"))
    rows = rows.withColumn("step", step)
    seen = rows.groupBy("id").agg(
        F.count("*").alias("n"),
        F.bool_or(hit).alias("hit"),
        F.min("time_ns").alias("oldest_ns"),
        F.max("time_ns").alias("newest_ns"),
        F.min_by("value", order).alias("oldest"),
        F.max_by("value", order).alias("newest"),
        F.count("step").alias("steps"),
        F.count_if(F.col("step") > F.col("floor")).alias("ups"),
        F.count_if(F.col("step") < -F.col("floor")).alias("downs"),
    )
    r = table.join(seen, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    span = F.col("newest_ns") - F.col("oldest_ns")
    rate = (F.col("newest") - F.col("oldest")) / (span / 1e9)
    rate_hit = F.coalesce(*[F.when(F.col("comparator") == c, compare(rate, c, F.col("limit"))) for c in COMPARATORS])
    gate = (F.col("min_duration_ns") == 0) | (span >= F.col("min_duration_ns"))
    said = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    kind, n = F.col("kind"), F.col("n")

    def matched(test: Column, name: str, gated: bool = True) -> Column:
        held = F.when(~test, said("inactive", f"{name} condition did not match"))
        if gated:
            held = held.when(~gate, said("inactive", "condition active but below minimum duration"))
        return held.otherwise(said("active", f"{name} condition matched"))

    # the fixed reasons
    told = (
        F.when(~F.col("enabled"), said("inactive", "rule disabled"))
        .when(F.col("suppressed"), said("suppressed", "rule suppressed"))
        .when((kind == "missing") & (n == 0), said("active", "metric is absent"))
        .when(kind == "missing", said("inactive", "metric is present"))
        .when((kind == "threshold") & (n == 0), said("no_data", "metric not present in current snapshot"))
        .when(kind == "threshold", matched(F.col("hit"), "threshold"))
        .when((kind == "stale") & (n == 0), said("no_data", "metric has no samples"))
        .when((kind == "stale") & (now_ns - F.col("newest_ns") > F.col("max_age_ns")), said("active", "metric is stale"))
        .when(kind == "stale", said("inactive", "metric is fresh"))
        .when((kind == "rate_of_change") & (n < 2), said("no_data", "rate condition needs at least two samples"))
        .when((kind == "rate_of_change") & (span == 0), said("no_data", "rate condition has zero elapsed time"))
        .when(kind == "rate_of_change", matched(rate_hit, "rate"))
        .when((kind == "trend") & (n < 2), said("no_data", "trend condition needs at least two samples"))
        .when(kind == "trend", matched(trend(F.col("steps"), F.col("ups"), F.col("downs")) == F.col("expected"), "trend"))
        .otherwise(said("no_data", "unknown condition"))
    )
    return r.select("id", "kind", "severity", told.alias("told"), "n").select("id", "kind", "severity", "told.state", "told.reason", "n")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """AGG24: rules by state, disabled ones (which count as inactive, too) and
    active ones by severity."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    active = lambda s: F.count_if((F.col("state") == "active") & (F.col("severity") == s)).alias(f"{s}_active")
    return alerts.agg(F.count("*").alias("total_rules"), *[of("state", s).alias(f"{s}_rules") for s in ("active", "inactive", "suppressed", "no_data")], of("reason", "rule disabled").alias("disabled_rules"), *[active(s) for s in ("critical", "warning", "info")])


def slo_slice(events: DataFrame, group: list[Column]) -> DataFrame:
    """AGG23: counts and weights; ignored events weigh nothing."""
    k = F.col("kind")
    weight = lambda c: F.round(F.sum(F.when(c, F.col("weight")).otherwise(0.0)), 6)
    return events.groupBy(*group).agg(F.count_if(k == "good").alias("good"), F.count_if(k == "bad").alias("bad"), F.count_if(k == "ignored").alias("ignored"), weight(k != "ignored").alias("total_weight"), weight(k == "bad").alias("bad_weight"))


def merge_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET5: the events (ordinal, time_ns, kind, weight) of both, place being their
    order by time and then by kind: a rank within a day and the counts of the
    days before, so that no task holds all events."""
    both = left.unionByName(right).withColumn("day", F.expr("time_ns div 86400000000000"))
    sizes = both.groupBy("day").agg(F.count("*").alias("n"))
    before = sizes.select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a day
    within = F.row_number().over(W.partitionBy("day").orderBy("time_ns", "kind", "ordinal")) - 1
    return both.withColumn("within", within).join(before, "day").select("time_ns", "kind", "weight", (F.col("before") + F.col("within")).cast("long").alias("place"))


def partitions(start: int, end: int, width: int, spark: SparkSession) -> DataFrame:
    """WIN10: closed slices from start to end, each width + 1 long."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(width + 1))).alias("slice_start"))
    return rows.withColumn("slice_end", F.least(F.col("slice_start") + width, F.lit(end)))


def slo_partition(events: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """WIN10: AGG23 per slice; slices without events have zeros."""
    at = F.expr(f"{start} + (time_ns - {start}) div {width + 1} * {width + 1}")
    per = slo_slice(events.where(F.col("time_ns").between(start, end)), [at.alias("slice_start")])
    return partitions(start, end, width, events.sparkSession).join(per, "slice_start", "left").na.fill(0)


def budget(slices: DataFrame, target: float) -> DataFrame:
    """DIA10: how much of the error budget a slice uses, and its status."""
    allowed = min(max(1 - target, 0.0), 1.0)
    ratio = F.when(F.col("total_weight") > 0, F.col("bad_weight") / F.col("total_weight")).otherwise(0.0)
    used = ratio / allowed if allowed > 0 else F.when(ratio > 0, 1.0).otherwise(0.0)
    status = F.when(F.col("total_weight") == 0, "unknown").when(F.col("used") >= 1, "exhausted").when(F.col("used") >= 0.75, "warning").otherwise("healthy")
    rows = slices.withColumn("error_ratio", F.round(ratio, 9)).withColumn("used", F.round(used, 9))
    return rows.withColumn("remaining", F.round(F.greatest(1 - F.col("used"), F.lit(0.0)), 9)).withColumn("status", status)


def duration_label(ns: int) -> str:
    """DIA11: a window length in its largest whole unit."""
    for unit, size in (("d", 86_400_000_000_000), ("h", 3_600_000_000_000), ("m", 60_000_000_000), ("s", 1_000_000_000)):
        if ns and ns % size == 0:
            return f"{ns // size}{unit}"
    return f"{ns}ns" if ns else "all"


def burn(events: DataFrame, now_ns: int, windows: list[int], target: float) -> DataFrame:
    """DIA11: the budget over several windows that end now."""
    table = events.sparkSession.createDataFrame([(duration_label(w), now_ns - w if w else 0) for w in windows], "label string, since long")
    rows = events.where(F.col("time_ns") <= now_ns).join(F.broadcast(table), F.col("time_ns") >= F.col("since"))  # a row per window
    return budget(slo_slice(rows, [F.col("label")]), target)


def slo_from_values(metrics: DataFrame, limit: float) -> DataFrame:
    """DIA12: samples as events, good up to the limit."""
    return metrics.select("ordinal", "time_ns", F.when(F.col("value") <= limit, "good").otherwise("bad").alias("kind"), F.lit(1.0).alias("weight"))


def findings(alerts: DataFrame, slos: DataFrame, deltas: DataFrame, threshold: float) -> DataFrame:
    """DIA13/SUP7: findings from active alerts, strained budgets and metrics
    that changed much."""
    a = alerts.where("state = 'active'").select(F.lit("alert").alias("source"), F.col("id").alias("subject"), F.when(F.col("severity") == "critical", "high").when(F.col("severity") == "warning", "medium").otherwise("low").alias("severity"))
    s = slos.where("status IN ('warning', 'exhausted')").select(F.lit("slo"), F.col("label"), F.when(F.col("status") == "exhausted", "critical").otherwise("medium"))
    d = deltas.where(F.abs(F.col("relative")) >= threshold).select(F.lit("metric"), F.col("series"), F.when(F.abs(F.col("relative")) >= 2 * threshold, "high").otherwise("medium"))
    return a.union(s).union(d)


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), c)


def top_findings(found: DataFrame, limit: int) -> DataFrame:
    """SRT7: the gravest findings first; ties by subject."""
    rows = found.orderBy(severity_rank(F.col("severity")).desc(), "source", "subject")
    return rows.limit(limit) if limit else rows


#: Timeline levels in rank order (fixed values).
TIMELINE_LEVELS = ("debug", "info", "warning", "error")


def timeline(df: DataFrame) -> DataFrame:
    """DIA15/SRT8: packets of note as timeline entries."""
    level = F.when(F.col("kind") == "control", "warning").when(F.col("payload_size") == 0, "debug").otherwise("info")
    return df.select(F.col("capture_time_ns").alias("time_ns"), level.alias("level"), F.concat(F.col("kind"), F.lit(" from "), F.col("device").cast("string")).alias("text"), "offset")


def findings_by_severity(found: DataFrame) -> DataFrame:
    """Findings per source and severity."""
    return found.groupBy("source", "severity").agg(F.count("*").alias("findings"))


#: Recommendations in order (fixed values): owner, action, reason.
ACTIONS = (
    ("oncall", "freeze risky deploys for affected components", "one or more SLO error budgets are exhausted"),
    ("oncall", "inspect firing alert evidence and correlate with timeline", "active alerts identify the highest-signal failure modes"),
    ("incident-commander", "assign owners for mitigation and customer impact", "unresolved incidents should have explicit next actions"),
    ("support", "confirm customer and device impact", "impact fields are empty and reporting may be incomplete"),
)


def recommended(reports: DataFrame) -> DataFrame:
    """DIA14: a row per action that a report (incident, status, exhausted_slos,
    firing_alerts, open_actions, impacts) calls for, with its step. Null counts
    are as none, a null status is as unresolved."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("exhausted_slos", "firing_alerts", "open_actions", "impacts")}
    resolved = F.coalesce(F.col("status") == "resolved", F.lit(False))
    calls = (n["exhausted_slos"] > 0, n["firing_alerts"] > 0, (n["open_actions"] == 0) & ~resolved, n["impacts"] == 0)
    steps = [F.when(test, F.struct(F.lit(i + 1).alias("step"), F.lit(a[0]).alias("owner"), F.lit(a[1]).alias("action"), F.lit(a[2]).alias("reason"))) for i, (test, a) in enumerate(zip(calls, ACTIONS, strict=True))]
    return reports.select("incident", F.explode(F.array_compact(F.array(*steps))).alias("a")).select("incident", "a.*")


def collector_stats(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """RT7: what a collector accepts, warns of and rejects: a packet is rejected
    for any error."""
    per = findings.groupBy("offset").agg(F.bool_or(F.col("severity") == "error").alias("bad"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    seen = sessions.agg(F.count("*").alias("devices"))
    return per.agg(F.count_if(~F.col("bad")).alias("accepted"), F.count_if("bad").alias("rejected"), F.sum("warnings").cast("long").alias("warnings")).crossJoin(seen)  # one row each
