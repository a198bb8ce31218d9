"""Sweep plans: requests cut to what a receiver can tune to and take at once,
known channels and guard ranges, merged where neighbours allow it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import intervals, rf

#: Priorities with their weights, and intents (fixed values).
WEIGHTS = {"low": 0.5, "normal": 1.0, "high": 2.0, "urgent": 4.0}
INTENTS = ("survey", "occupancy", "interference_hunt", "calibration", "compliance")
SEGMENT = "plan long, priority string, intent string, lower_hz long, upper_hz long, bin_width_hz long, dwell_us long, allocation string, reason string, merged int"
_COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]


@dataclass(frozen=True)
class Receiver:
    min_hz: int = 0
    max_hz: int = 6_000_000_000
    max_span_hz: int = 20_000_000
    min_step_hz: int = 1_000
    settle_us: int = 2_000
    usable_fraction: float = 0.8

    @property
    def span_hz(self) -> int:
        """What one segment can hold."""
        return max(math.floor(self.max_span_hz * min(max(self.usable_fraction, 0.1), 1.0)), self.min_step_hz)


def _clip(receiver: Receiver) -> tuple[Column, Column]:
    return F.greatest("lower_hz", F.lit(receiver.min_hz)), F.least("upper_hz", F.lit(receiver.max_hz))


def _aligned(value: Column, step: Column) -> Column:
    rest = value % step
    return F.when(rest == 0, value).otherwise(value + step - rest)


def _cut(rows: DataFrame, receiver: Receiver) -> DataFrame:
    """Ranges cut into segments: the first ends a span behind its start, on a
    whole bin, and so does every other, until the range ends."""
    span, width = F.lit(receiver.span_hz), F.col("bin_width_hz")
    lower, upper = F.col("lower_hz"), F.col("upper_hz")
    first, step = _aligned(lower + span, width), _aligned(span.cast("long"), width)
    # how many of the cuts lie before the end, where a whole span no longer fits
    whole = F.when(upper <= lower + span, 0).otherwise(1 + F.greatest(F.ceil((upper - first - span) / step), F.lit(0)))
    at = lambda k: F.when(k == 0, lower).otherwise(F.least(first + (k - 1) * step, upper))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), whole.cast("long"))))
    k = F.col("k")
    rows = rows.select("*", at(k).alias("from"), F.when(k == whole, upper).otherwise(at(k + 1)).alias("to"))
    return rows.withColumn("lower_hz", F.col("from")).withColumn("upper_hz", F.col("to")).drop("k", "from", "to").where("lower_hz < upper_hz")


def followup_requests(findings: DataFrame, resolution_hz: int = 5_000) -> DataFrame:
    """RF13: a request for every finding of interference: (plan, intent,
    lower_hz, upper_hz, service, resolution_hz, dwell_us, priority, guards,
    channels), plan being the finding's frame. A finding inside an allocation is
    looked for around it as well."""
    urgent, inside = F.col("severity") == "critical", F.col("allocation").isNotNull()
    pad = F.greatest(F.col("upper_hz") - F.col("lower_hz"), F.lit(resolution_hz * 10))
    service = F.lit(None).cast("string")
    for name, kind in ((b[0], b[3]) for b in rf.BANDS):
        service = F.when(F.col("allocation") == name, kind).otherwise(service)
    return findings.select(
        F.col("frame_id").cast("long").alias("plan"), F.lit("interference_hunt").alias("intent"),
        F.when(inside, F.greatest(F.col("lower_hz") - pad, F.lit(0))).otherwise(F.col("lower_hz")).alias("lower_hz"), F.when(inside, F.col("upper_hz") + pad).otherwise(F.col("upper_hz")).alias("upper_hz"),
        service.alias("service"), F.lit(resolution_hz).alias("resolution_hz"), F.when(urgent, 100_000).otherwise(50_000).alias("dwell_us"), F.when(urgent, "urgent").otherwise("high").alias("priority"),
        F.lit(True).alias("guards"), F.lit(False).alias("channels"),
    )


def warnings(requests: DataFrame, receiver: Receiver) -> DataFrame:
    """RF12: (plan, warning) of requests that give no segment, in the fixed
    texts."""
    lower, upper = _clip(receiver)
    shown = F.concat(rf.format_hz(F.col("lower_hz")), F.lit(" - "), rf.format_hz(F.col("upper_hz")))
    text = F.when(F.col("lower_hz") >= F.col("upper_hz"), "ignored empty sweep request").when(lower >= upper, F.concat(F.lit("request outside receiver tuning range: "), shown))
    return requests.select("plan", text.alias("warning")).where("warning IS NOT NULL")


def candidates(requests: DataFrame, receiver: Receiver) -> DataFrame:
    """The segments of all requests, not merged yet: known channels where they are
    preferred and there are any, else the range in pieces, and guard ranges."""
    spark = requests.sparkSession
    lower, upper = _clip(receiver)
    rows = requests.where("lower_hz < upper_hz").select("*", F.monotonically_increasing_id().alias("request"), F.greatest("resolution_hz", F.lit(receiver.min_step_hz)).cast("long").alias("bin_width_hz"), lower.alias("low"), upper.alias("high"))
    rows = rows.where("low < high")
    plain = ["plan", "request", "priority", "intent", "bin_width_hz", "dwell_us"]
    fits = F.col("service").isNull() | (F.col("service") == F.col("its_service"))

    half = F.expr("bandwidth_hz div 2")
    known = rf.channels(spark).select(F.col("name").alias("allocation"), F.col("service").alias("its_service"), "number", F.greatest(F.col("center_hz") - half, F.lit(0)).alias("from_hz"), (F.col("center_hz") + half + F.col("bandwidth_hz") % 2).alias("to_hz"))
    met = intervals.overlapping(rows.where("channels"), known, ("lower_hz", "upper_hz"), ("from_hz", "to_hz")).where(fits)
    met = met.withColumn("lower_hz", F.col("from_hz")).withColumn("upper_hz", F.col("to_hz"))
    met = met.withColumn("lower_hz", lower).withColumn("upper_hz", upper).where("lower_hz < upper_hz")
    on_channels = met.select(*plain, "lower_hz", "upper_hz", "allocation", F.concat(F.lit("known channel "), "allocation", F.lit(" ch "), F.col("number").cast("string")).alias("reason"))

    clipped = rows.withColumn("lower_hz", F.col("low")).withColumn("upper_hz", F.col("high"))
    ranged = clipped.join(on_channels.select("request").distinct(), "request", "left_anti")
    ranged = _cut(ranged, receiver).select(*plain, "lower_hz", "upper_hz", F.lit(None).cast("string").alias("allocation"), F.lit("range survey").alias("reason"))

    services = rf.allocations(spark).select("name", F.col("service").alias("its_service"))
    guards = rf.guards(spark).join(services, "name").select(F.col("name").alias("allocation"), "its_service", "from_hz", "to_hz")
    near = intervals.overlapping(clipped.where("guards"), guards, ("lower_hz", "upper_hz"), ("from_hz", "to_hz")).where(fits)
    near = near.withColumn("lower_hz", F.greatest("lower_hz", "from_hz")).withColumn("upper_hz", F.least("upper_hz", "to_hz")).withColumn("priority", F.lit("high"))
    near = _cut(near, receiver).select(*plain, "lower_hz", "upper_hz", "allocation", F.concat(F.lit("guard range for "), "allocation").alias("reason"))
    return on_channels.unionByName(ranged).unionByName(near).drop("request")


def merged(segments: DataFrame, receiver: Receiver) -> DataFrame:
    """Neighbours of one plan, priority and intent become one while they overlap
    or lie within two bins, don't name two allocations and fit the receiver's
    span. By priority, then by lower end; equal ones by upper end, intent, reason.

    A merge depends on the one before, so it is one ordered pass over plans and
    priorities, which holds a batch of rows and the segment at hand.
    """
    order = ["plan", "priority", "lower_hz", "upper_hz", "intent", "reason"]
    rows = segments.select(*order, "bin_width_hz", "dwell_us", "allocation").repartition("plan", "priority").sortWithinPartitions(*order)
    span, schema = receiver.span_hz, to_arrow_schema(StructType.fromDDL(SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            out: list[list] = []
            columns = (batch.column(c).to_pylist() for c in ("plan", "priority", "intent", "lower_hz", "upper_hz", "bin_width_hz", "dwell_us", "allocation", "reason"))
            for plan, priority, intent, lower, upper, width, dwell, name, reason in zip(*columns, strict=True):
                if last and last[:3] == [plan, priority, intent] and not (last[7] and name and last[7] != name) and lower - last[4] <= 2 * last[5] and max(last[4], upper) - last[3] <= span:
                    last[4], last[6], last[9] = max(last[4], upper), max(last[6], dwell), last[9] + 1
                    last[8].append(reason)
                else:
                    if last:
                        out.append(last)
                    last = [plan, priority, intent, lower, upper, width, dwell, name, [reason], 1]
            yield rows_of(out)
        yield rows_of([last] if last else [])

    def rows_of(out: list[list]) -> pa.RecordBatch:
        done = [[*s[:8], "; ".join(s[8]), s[9]] for s in out]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], schema.field(c).type) for i, c in enumerate(_COLUMNS)], schema=schema)

    return rows.mapInArrow(run, SEGMENT)


def plan(requests: DataFrame, receiver: Receiver = Receiver()) -> DataFrame:
    """RF12: the segments of every plan, place being their order in it."""
    done = merged(candidates(requests, receiver), receiver)
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("priority"))
    place = F.row_number().over(W.partitionBy("plan").orderBy(weight.desc(), "lower_hz", "upper_hz", "intent", "reason"))
    width = F.col("upper_hz") - F.col("lower_hz")
    return done.select("plan", place.alias("place"), "priority", "intent", "lower_hz", "upper_hz", (F.col("lower_hz") + F.expr("(upper_hz - lower_hz) div 2")).alias("center_hz"), width.alias("span_hz"), "bin_width_hz", "dwell_us", "allocation", "reason", "merged")


def totals(segments: DataFrame, receiver: Receiver = Receiver()) -> DataFrame:
    """A plan's duration, the width that it covers and the share of its time that
    it listens. segments are read twice."""
    active = F.sum("dwell_us").alias("active_us")
    per = segments.groupBy("plan").agg(F.count("*").alias("segments"), active, F.sum(F.col("dwell_us") + receiver.settle_us).cast("long").alias("duration_us"))
    width = intervals.covered([(segments, "lower_hz", "upper_hz")], ["plan"], 1).groupBy("plan").agg(F.sum(F.col("upper") - F.col("lower")).cast("long").alias("covered_hz"))
    duty = F.when(F.col("duration_us") > 0, F.round(F.col("active_us") / F.col("duration_us"), 6)).otherwise(0.0)
    return per.join(width, "plan").select("plan", "segments", "duration_us", "covered_hz", duty.alias("duty_cycle"))
