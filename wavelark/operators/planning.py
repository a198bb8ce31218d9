"""Compaction, segments, rotation, retention, capacity and audits. Plans are
pure: they say what would be done and change nothing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .query import Query


def compaction(df: DataFrame, query: Query, drop_empty: bool = True, keep_latest: bool = True) -> DataFrame:
    """PLN1: why each record would be dropped, null for the kept ones. The
    highest sequence of a device is taken before the query; its ties stay."""
    top = df.groupBy("device").agg(F.max("sequence").alias("highest"))
    why = F.when(~query.matches(), "query")
    if drop_empty:
        why = why.when(F.col("payload_size") == 0, "empty_payload")
    if keep_latest:
        why = why.when(F.col("sequence") < F.col("highest"), "superseded")
    return df.join(top, "device").select("archive_path", "offset", "device", "sequence", why.alias("dropped_by"))


def compaction_stats(plan: DataFrame) -> DataFrame:
    """PLN1: records per outcome."""
    return plan.groupBy(F.coalesce("dropped_by", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("records"))


def segments(catalog: DataFrame, width: int, prefix: str = "segment", extension: str = "ath") -> DataFrame:
    """PLN2: buckets that the archives cross, named by their time range."""
    first, last = (F.expr(f"{c} div {width} * {width}") for c in ("first_time_ns", "last_time_ns"))
    rows = catalog.select("archive_path", F.explode(F.sequence(first, last, F.lit(width))).alias("start_ns"))
    digits = lambda c: F.lpad(c.cast("string"), 20, "0")
    per = rows.groupBy("start_ns").agg(F.count("*").alias("archives"), F.array_join(F.array_sort(F.collect_set("archive_path")), ",").alias("paths"))
    end = F.col("start_ns") + (width - 1)
    return per.select("start_ns", end.alias("end_ns"), "archives", "paths", F.concat(F.lit(f"{prefix}-"), digits(F.col("start_ns")), F.lit("-"), digits(end), F.lit(f".{extension}")).alias("name"))


@dataclass(frozen=True)
class Rotation:
    """Limits of one output file; 0 means none."""

    max_records: int = 0
    max_payload: int = 0
    max_span: int = 0
    max_bytes: int = 0
    idle_gap: int = 0


def shard_name(number: Column, prefix: str = "shard") -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lpad(number.cast("string"), 6, "0"), F.lit(".ath"))


def rotation_by_count(df: DataFrame, n: int) -> DataFrame:
    """PLN3 with a record limit only: a closed form per device."""
    w = W.partitionBy("device").orderBy("capture_time_ns", "archive_path", "offset")
    number = F.expr(f"(n - 1) div {n}")
    rows = df.select("device", "archive_path", "offset", F.row_number().over(w).alias("n"))
    return rows.select("device", "archive_path", "offset", number.cast("long").alias("shard"), shard_name(number).alias("output"))


def rotation_by_idle(df: DataFrame, gap: int) -> DataFrame:
    """PLN3/STR8 with an idle gap only: sessionisation per device."""
    w = W.partitionBy("device").orderBy("capture_time_ns", "archive_path", "offset")
    new = F.coalesce(F.col("capture_time_ns") - F.lag("capture_time_ns").over(w) > gap, F.lit(False))
    rows = df.select("device", "archive_path", "capture_time_ns", "offset", new.alias("new"))
    return rows.select("device", "archive_path", "offset", F.sum(F.col("new").cast("long")).over(w).alias("shard"))


def place(policy: Rotation, shard: tuple[int, int, int, int, int], time: int, size: int) -> tuple[tuple[int, int, int, int, int], str | None]:
    """(shard, records, payload, start, last time) after one more record, and the
    limit that opened a new shard for it."""
    number, n, payload, start, before = shard
    why = None
    if n:
        if policy.max_records and n >= policy.max_records:
            why = "max_records"
        elif policy.max_payload and payload + size > policy.max_payload:
            why = "max_payload_bytes"
        elif policy.max_span and time - start > policy.max_span:
            why = "max_span_ns"
        elif policy.max_bytes and 36 + payload + 16 * n + 16 + size > policy.max_bytes:
            why = "max_file_bytes"
        elif policy.idle_gap and time - before > policy.idle_gap:
            why = "idle_gap"
    if why:
        number, n, payload = number + 1, 0, 0
    return (number, n + 1, payload + size, start if n else time, time), why


def rotation(df: DataFrame, policy: Rotation, key: str = "device") -> DataFrame:
    """PLN3: shards by any mix of limits, in time order within a key. The
    limits depend on where the last shard closed, so records are one ordered
    pass over keys, which holds a batch of rows and a few numbers however many
    keys, or rows of one, there are."""
    order = ["capture_time_ns", "archive_path", "offset"]
    rows = df.select(key, *order, "payload_size").repartition(key).sortWithinPartitions(key, *order)
    schema = pa.schema([(key, pa.int64()), ("archive_path", pa.string()), ("offset", pa.int64()), ("shard", pa.int64()), ("opened_by", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, begun = (0, 0, 0, 0, 0), None, False
        for batch in batches:
            keys, numbers, reasons = batch.column(key).to_pylist(), [], []
            for k, time, size in zip(keys, batch.column("capture_time_ns").to_pylist(), batch.column("payload_size").to_pylist(), strict=True):
                if not begun or k != now:
                    shard, now, begun = (0, 0, 0, 0, 0), k, True
                shard, why = place(policy, shard, time, size)
                numbers.append(shard[0])
                reasons.append(why)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("archive_path").cast(pa.string()), batch.column("offset"), pa.array(numbers, pa.int64()), pa.array(reasons, pa.string())], schema=schema)

    return rows.mapInArrow(cut, f"{key} long, archive_path string, offset long, shard long, opened_by string")


def rotation_checks(plan: DataFrame, df: DataFrame) -> DataFrame:
    """PLN4: whether every record has exactly one shard."""
    placed = plan.groupBy("archive_path", "offset").agg(F.count("*").alias("n"))
    both = df.select("archive_path", "offset").join(placed, ["archive_path", "offset"], "left")
    return both.agg(F.count("*").alias("records"), F.count_if(F.col("n") == 1).alias("placed_once"))


@dataclass(frozen=True)
class Retention:
    """Thresholds in nanoseconds and floors; 0 disables each."""

    keep_after: int = 0
    delete_before: int = 0
    archive_before: int = 0
    compact_before: int = 0
    record_floor: int = 0
    payload_floor: int = 0


def _retention(record_floor, payload_floor, keep_after, delete, archive, compact) -> Column:
    """The action as a struct of action and reason."""
    said = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    on = lambda c: c != 0
    last = F.col("last_time_ns")
    return (
        F.when(F.col("records") == 0, said("delete", "empty archive"))
        .when(on(record_floor) & (F.col("records") < record_floor), said("keep", "below minimum record floor"))
        .when(on(payload_floor) & (F.col("payload_bytes") < payload_floor), said("keep", "below minimum payload floor"))
        .when(on(keep_after) & (last >= keep_after), said("keep", "inside active retention window"))
        .when(on(delete) & (last < delete), said("delete", "older than delete threshold"))
        .when(on(archive) & (last < archive), said("archive", "older than archive threshold"))
        .when(on(compact) & (last < compact), said("compact", "older than compact threshold"))
        .otherwise(said("keep", "no retention rule matched"))
    )


def retention(catalog: DataFrame, p: Retention) -> DataFrame:
    """PLN5: what happens to every archive, and why."""
    n = lambda v: F.lit(v).cast("long")
    decided = _retention(n(p.record_floor), n(p.payload_floor), n(p.keep_after), n(p.delete_before), n(p.archive_before), n(p.compact_before))
    return catalog.withColumn("d", decided).select("archive_path", "records", "d.action", "d.reason")


def retention_simulation(catalog: DataFrame, p: Retention, steps: int, step: int) -> DataFrame:
    """PLN6: files and records per action as thresholds advance."""
    moved = lambda v: F.lit(v).cast("long") + (F.col("snapshot") * step if v else F.lit(0))
    decided = _retention(F.lit(p.record_floor), F.lit(p.payload_floor), moved(p.keep_after), moved(p.delete_before), moved(p.archive_before), moved(p.compact_before))
    rows = catalog.withColumn("snapshot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(steps, 1) - 1).cast("long")))).withColumn("d", decided)
    return rows.groupBy("snapshot", "d.action").agg(F.count("*").alias("files"), F.sum("records").cast("long").alias("records"))


def capacity(samples: DataFrame, horizon: int, most_bytes: int) -> DataFrame:
    """PLN7: growth between first and last sample, carried to the horizon."""
    order = F.struct("time_ns", "archive_path")
    one = samples.agg(*[f(c, order).alias(f"{n}_{c}") for c in ("time_ns", "records", "payload_bytes") for n, f in (("first", F.min_by), ("last", F.max_by))])
    seconds = (F.col("last_time_ns") - F.col("first_time_ns")) / 1e9
    out = [F.col("last_records").alias("records"), F.col("last_payload_bytes").alias("payload_bytes")]
    for c in ("records", "payload_bytes"):
        grown = F.col(f"last_{c}") - F.col(f"first_{c}")
        rate = F.when((seconds > 0) & (grown > 0), grown / seconds).otherwise(0.0)
        out += [F.round(rate, 9).alias(f"{c}_rate"), (F.col(f"last_{c}") + F.floor(rate * (horizon / 1e9))).cast("long").alias(f"projected_{c}")]
    return one.select(*out).withColumn("exceeds", F.col("projected_payload_bytes") > most_bytes)


def catalog_select(df: DataFrame, catalog: DataFrame, start: int, end: int, device: int | None = None, kind: str | None = None) -> DataFrame:
    """PLN8: archives that may hold matches: by time range, device and kind."""
    out = catalog.where((F.col("last_time_ns") >= start) & (F.col("first_time_ns") <= end))
    for name, value in (("device", device), ("kind", kind)):
        if value is not None:
            out = out.join(df.where(F.col(name) == value).select("archive_path").distinct(), "archive_path", "left_semi")
    return out


FINDING = ("archive_path", "severity", "code", "device", "offset")


def audit(df: DataFrame, least: int, most: int, sparse: int) -> DataFrame:
    """PLN9: time order, sequence, payload, duplicate offset and sparse device
    findings with one schema."""
    from . import sequences

    none = F.lit(None).cast("long")
    line = lambda rows, severity, code, device=None, offset=None: rows.select("archive_path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col(device) if device else none).alias("device"), (F.col(offset) if offset else none).alias("offset"))
    order = line(sequences.order_audit(df), "error", "ordered_timestamps", offset="offset")
    back = line(sequences.regression_audit(df), "warning", "monotonic_device_sequences", "device", "offset")
    small = line(df.where((F.col("payload_size") < least) | (F.col("payload_size") > most)), "warning", "payload_bounds", "device", "offset")
    twice = line(df.groupBy("archive_path", "offset").agg(F.count("*").alias("n")).where("n > 1"), "error", "duplicate_offsets", offset="offset")
    few = line(df.groupBy("archive_path", "device").agg(F.count("*").alias("n")).where(F.col("n") < sparse), "info", "sparse_devices", "device")
    return order.unionByName(back).unionByName(small).unionByName(twice).unionByName(few)


def audit_summary(findings: DataFrame) -> DataFrame:
    """PLN9/PLN10: findings per archive and severity; ok without errors."""
    per = findings.groupBy("archive_path").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])
    return per.withColumn("ok", F.col("errors") == 0)


#: Health findings in the order of a report (fixed values): code, severity,
#: message.
HEALTH = {
    "archive.too_small": ("error", "archive does not contain the minimum required number of records"),
    "archive.empty": ("warning", "archive has no readable records"),
    "archive.time_inverted": ("error", "archive summary has first timestamp after last timestamp"),
    "archive.too_many_devices": ("warning", "archive contains more devices than the configured limit"),
    "device.empty": ("warning", "device aggregate contains no records"),
    "device.time_inverted": ("error", "device aggregate has inverted timestamp range"),
    "archive.device_skew": ("warning", "one device dominates the archive record distribution"),
    "archive.low_payload_density": ("warning", "average payload size is below the configured threshold"),
    "manifest.warning": ("warning", ""),
    "archive.ok": ("info", "archive health checks passed"),
}


@dataclass(frozen=True)
class HealthRules:
    least_records: int = 1
    most_devices: int = 4096
    most_of_one_device: float = 0.95
    least_average_payload: float = 1.0
    device_times: bool = True


def health(catalog: DataFrame, devices: DataFrame, warnings: DataFrame, rules: HealthRules = HealthRules()) -> DataFrame:
    """PLN13: (archive_path, severity, code, message, device) of manifests: their
    archives (archive_path, records, first_time_ns, last_time_ns), devices
    (archive_path, device, records, first_time_ns, last_time_ns, payload_bytes)
    and warnings (archive_path, warning); archive.ok where nothing is found."""
    held = devices.groupBy("archive_path").agg(F.count("*").alias("devices"), F.max("records").alias("largest"), F.sum("payload_bytes").alias("bytes"))
    rows = catalog.select("archive_path", "records", "first_time_ns", "last_time_ns").join(held, "archive_path", "left").na.fill(0, ["devices", "largest", "bytes"])
    some = F.col("records") > 0
    tests = {
        "archive.too_small": F.col("records") < rules.least_records,
        "archive.empty": F.col("records") == 0,
        "archive.time_inverted": F.col("first_time_ns") > F.col("last_time_ns"),
        "archive.too_many_devices": F.col("devices") > rules.most_devices,
        "archive.device_skew": some & (F.col("devices") > 1) & (F.col("largest") / F.col("records") > rules.most_of_one_device),
        "archive.low_payload_density": some & (F.col("bytes") / F.col("records") < rules.least_average_payload),
    }
    none = F.lit(None).cast("long").alias("device")
    own = rows.select("archive_path", F.explode(F.array_compact(F.array(*[F.when(test, code) for code, test in tests.items()]))).alias("code"), none)
    inverted = F.lit(rules.device_times) & (F.col("first_time_ns") > F.col("last_time_ns"))
    of_devices = devices.select("archive_path", F.explode(F.array_compact(F.array(F.when(F.col("records") == 0, "device.empty"), F.when(inverted, "device.time_inverted")))).alias("code"), "device")
    noted = warnings.select("archive_path", F.lit("manifest.warning").alias("code"), none, F.col("warning").alias("message"))
    severity = F.create_map(*[F.lit(x) for code, (s, _) in HEALTH.items() for x in (code, s)])
    text = F.create_map(*[F.lit(x) for code, (_, m) in HEALTH.items() for x in (code, m)])
    found = own.unionByName(of_devices).withColumn("message", F.element_at(text, F.col("code"))).unionByName(noted)
    well = catalog.select("archive_path").join(found.select("archive_path").distinct(), "archive_path", "left_anti")
    found = found.unionByName(well.select("archive_path", F.lit("archive.ok").alias("code"), none, F.lit(HEALTH["archive.ok"][1]).alias("message")))
    return found.select("archive_path", F.element_at(severity, F.col("code")).alias("severity"), "code", "message", "device")


def health_ok(found: DataFrame) -> DataFrame:
    """Per archive whether it has no error."""
    return found.groupBy("archive_path").agg((F.count_if(F.col("severity") == "error") == 0).alias("ok"))


def repair_plan(state: DataFrame) -> DataFrame:
    """PLN11: the action for archives (archive_path, ok, readable, salvaged,
    header_ok, ordered)."""
    rewrite = (~F.col("header_ok") | ~F.col("ordered")) & (F.col("readable") > 0)
    action = F.when(F.col("ok"), "no_op").when(F.col("salvaged") > F.col("readable"), "rebuild_from_salvage").when(rewrite, "rewrite_from_readable_records").when(F.col("readable") == 0, "quarantine_file").otherwise("no_op")
    return state.select("archive_path", action.alias("action"), action.isin("rebuild_from_salvage", "rewrite_from_readable_records").alias("verify"))
