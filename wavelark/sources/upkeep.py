"""Audit and repair of archive files: what is wrong with each of a folder, what
to do about it, and doing it.

An audit is a few aggregations and windows per archive over the records that
format("ath") reads; a repair writes through its two-phase commit, so that an
archive that can't be read back never appears.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import archives, ath, scratch

#: Bytes of a record besides its payload, as sizes are estimated.
OVERHEAD = 16
_READ = "archive_path string, archive_ordinal long, offset long, capture_time_ns long, corrupt string, device long, sequence long, payload_size long"
#: Suffixes of repaired and of quarantined files.
REPAIRED, QUARANTINED = ".repaired.ath", ".quarantine"


@dataclass(frozen=True)
class Rules:
    """What an audit looks for; 0 is no bound."""

    time_order: bool = True
    sequence_order: bool = False
    least_payload: int = 0
    most_payload: int = 0
    sparse_records: int = 0
    sparse_bytes: int = 0


def store(files: DataFrame, folder: str) -> int:
    """Writes files (path, content) below folder as they are; how many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = ath.opened(folder)
        where.create_dir(at, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with where.open_output_stream(f"{at}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(work, "written long").agg(F.sum("written")).first()[0] or 0


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's archives, read once and kept: each with the
    capture time before it, its device's highest sequence before it, and where
    its archive's first damaged record is, if there is one."""
    rows = ath.load(spark, folder, columns=_READ).repartition("archive_path")
    whole = W.partitionBy("archive_path")
    placed = whole.orderBy("offset")
    # damaged records have neither a time nor a sequence of their own
    sound = F.col("corrupt").isNull()
    rows = rows.withColumn("damaged_at", F.min(F.when(~sound, F.col("offset"))).over(whole))
    rows = rows.withColumn("time before", F.last(F.when(sound, F.col("capture_time_ns")), ignorenulls=True).over(placed.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("high", F.max("sequence").over(W.partitionBy("archive_path", "device").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)))
    return scratch.kept(rows, "records")


def _damage(records: DataFrame) -> DataFrame:
    """(archive_path, message) of archives with a damaged record: the first
    one."""
    return records.where("corrupt IS NOT NULL AND offset = damaged_at").select("archive_path", F.col("corrupt").alias("message")).dropDuplicates(["archive_path"])


def _readable(records: DataFrame) -> DataFrame:
    return records.where("corrupt IS NULL AND (damaged_at IS NULL OR offset < damaged_at)")


def audit(spark: SparkSession, folder: str, rules: Rules = Rules()) -> DataFrame:
    """PLN9: findings (archive_path, severity, check, message, offset,
    capture_time_ns, device, sequence) of a folder's archives.

    An archive with a damaged record isn't readable: it has findings of records
    up to that one, none of its header, its manifest or its devices.
    """
    return _audit(spark, folder, rules, _records(spark, folder))


def _audit(spark: SparkSession, folder: str, rules: Rules, records: DataFrame) -> DataFrame:
    damage, read = _damage(records), _readable(records)
    none = F.lit(None).cast("long")

    def finding(rows: DataFrame, severity: str, check: str, message: str | Column, record: bool = False, **more: str) -> DataFrame:
        own = {c: c for c in ("offset", "capture_time_ns", "device", "sequence")} if record else more
        cells = [(F.col(own[c]) if c in own else none).alias(c) for c in ("offset", "capture_time_ns", "device", "sequence")]
        said = F.lit(message) if isinstance(message, str) else message
        return rows.select("archive_path", F.lit(severity).alias("severity"), F.lit(check).alias("check"), said.alias("message"), *cells)

    late = read.where(F.col("capture_time_ns") < F.col("time before"))
    whole = read.where("damaged_at IS NULL")
    seen = whole.groupBy("archive_path").agg(F.count("*").alias("n"), F.min("capture_time_ns").alias("first"), F.max("capture_time_ns").alias("last"))
    heads = ath.headers(spark, folder).join(damage, "archive_path", "left_anti").join(seen, "archive_path", "left").na.fill(0, ["n"])
    count, first, last = F.col("records") != F.col("n"), (F.col("n") > 0) & (F.col("first_time_ns") != F.col("first")), (F.col("n") > 0) & (F.col("last_time_ns") != F.col("last"))
    # the fixed texts of findings
    parts = [
        finding(damage, "error", "readable", F.col("message")),
        finding(heads.where(count), "error", "header_matches_records", "archive header record count differs from readable records"),
        finding(heads.where(first), "warning", "header_matches_records", "archive header first timestamp differs from observed first timestamp"),
        finding(heads.where(last), "warning", "header_matches_records", "archive header last timestamp differs from observed last timestamp"),
        finding(heads.where(count), "warning", "manifest_consistency", "archive header record count differs from readable records"),
        finding(heads.where(first), "warning", "manifest_consistency", "archive header first timestamp differs from readable records"),
        finding(heads.where(last), "warning", "manifest_consistency", "archive header last timestamp differs from readable records"),
        finding(late.where("damaged_at IS NULL"), "warning", "manifest_consistency", "archive records are not ordered by capture time"),
    ]
    if rules.time_order:
        parts.append(finding(late, "error", "ordered_timestamps", "record capture timestamp moved backwards", record=True))
    if rules.sequence_order:
        parts.append(finding(read.where("sequence < high"), "warning", "monotonic_device_sequences", "device sequence moved backwards", record=True))
    if rules.least_payload:
        parts.append(finding(read.where(F.col("payload_size") < rules.least_payload), "warning", "payload_bounds", "record payload is below configured minimum", record=True))
    if rules.most_payload:
        parts.append(finding(read.where(F.col("payload_size") > rules.most_payload), "error", "payload_bounds", "record payload exceeds configured maximum", record=True))
    if rules.sparse_records or rules.sparse_bytes:
        devices = whole.groupBy("archive_path", "device").agg(F.count("*").alias("n"), F.sum("payload_size").alias("bytes"), F.max("capture_time_ns").alias("last"))
        few = devices.where((F.col("n") < rules.sparse_records) | (F.col("bytes") < rules.sparse_bytes))
        parts.append(finding(few, "info", "sparse_devices", "device has sparse archive coverage", device="device", capture_time_ns="last"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fleet(spark: SparkSession, folder: str, rules: Rules = Rules()) -> DataFrame:
    """PLN10: per archive readable, records, first_offset, last_offset,
    least_payload, most_payload, bytes_estimated, shared_devices (of the
    manifest's devices those that an archive before it has, too), errors,
    warnings, infos, ok; archives without records too."""
    records = _records(spark, folder)
    return _fleet(spark, folder, records, _audit(spark, folder, rules, records))


def _fleet(spark: SparkSession, folder: str, records: DataFrame, findings: DataFrame) -> DataFrame:
    damage, read = _damage(records), _readable(records)
    told = read.groupBy("archive_path").agg(
        F.count("*").alias("records"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.min("payload_size").alias("least_payload"),
        F.max("payload_size").alias("most_payload"),
        F.sum(F.col("payload_size") + OVERHEAD).alias("bytes_estimated"),
    )
    devices = read.where("damaged_at IS NULL").select("archive_path", "archive_ordinal", "device").distinct()
    again = devices.withColumn("nth", F.row_number().over(W.partitionBy("device").orderBy("archive_ordinal"))).where("nth > 1")
    shared = again.groupBy("archive_path").agg(F.count("*").alias("shared_devices"))
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")]
    found = findings.groupBy("archive_path").agg(*counts)
    rows = ath.headers(spark, folder).select("archive_path")
    for part in (told, shared, found, damage.select("archive_path", F.lit(False).alias("readable"))):
        rows = rows.join(part, "archive_path", "left")
    rows = rows.na.fill(0, ["records", "bytes_estimated", "shared_devices", "errors", "warnings", "infos"]).na.fill(True, ["readable"])
    return rows.withColumn("ok", F.col("readable") & (F.col("errors") == 0))


def plan(spark: SparkSession, folder: str, rules: Rules = Rules()) -> DataFrame:
    """PLN11: per archive action, reason, output, readable_records,
    salvaged_records, expected_records and verify.

    A sound archive stays. One in which a salvage scan finds more packets than
    reading does is built from these; a readable one whose header is wrong is
    written again; any other is put aside. Only unsound files are scanned.
    """
    records = _records(spark, folder)
    findings = scratch.kept(_audit(spark, folder, rules, records), "findings")
    state = scratch.kept(_fleet(spark, folder, records, findings), "fleet")
    unsound = state.where("NOT ok").select("archive_path")
    header = findings.where("check = 'header_matches_records'").select("archive_path", F.lit(True).alias("header_wrong")).distinct()
    scanned = archives.salvage(spark, _contents(unsound, folder)).where("packet.ok")
    found = scanned.groupBy("archive_path").agg(F.count("*").alias("salvaged_records"))
    rows = state.join(found, "archive_path", "left").join(header, "archive_path", "left").na.fill(0, ["salvaged_records"]).na.fill(False, ["header_wrong"])
    more = F.col("salvaged_records") > F.col("records")
    kind = F.when(F.col("ok"), "no_op").when(more, "rebuild_from_salvage").when(F.col("readable") & F.col("header_wrong"), "rewrite_from_readable_records").otherwise("quarantine_file")
    rows = rows.withColumn("action", kind)
    # the fixed reasons
    reason = F.when(F.col("ok"), "archive passed integrity audit").when(more, "salvage scan found more packets than readable archive scan")
    reason = reason.when(F.col("action") == "quarantine_file", "archive could not be safely repaired").otherwise("rewrite archive to refresh inconsistent header")
    writes = F.col("action").isin("rebuild_from_salvage", "rewrite_from_readable_records")
    output = F.when(writes, F.concat("archive_path", F.lit(REPAIRED))).when(F.col("action") == "quarantine_file", F.concat("archive_path", F.lit(QUARANTINED)))
    expected = F.when(F.col("action") == "rebuild_from_salvage", F.col("salvaged_records")).when(F.col("action") == "quarantine_file", 0).otherwise(F.col("records"))
    return rows.select("archive_path", "action", reason.alias("reason"), output.alias("output"), F.col("records").alias("readable_records"), "salvaged_records", expected.alias("expected_records"), writes.alias("verify"))


def repair(spark: SparkSession, folder: str, out: str, plans: DataFrame) -> DataFrame:
    """PLN11, PLN12: carries plans out and returns them with written_records
    and verified (null where nothing is verified): repaired archives appear below
    out, each verified as it is written, and are audited again; what is put aside
    moves there. plans is read several times: write it first.
    """
    readable = ath.load(spark, folder, columns=f"archive_path string, offset long, capture_time_ns long, corrupt string, {ath.FRAME}").where("corrupt IS NULL")
    again = readable.join(plans.where("action = 'rewrite_from_readable_records'").select("archive_path"), "archive_path", "left_semi").select("archive_path", "offset", "capture_time_ns", "frame")
    rebuilt = plans.where("action = 'rebuild_from_salvage'").select("archive_path")
    time = F.when(F.col("capture_time_ns") == 0, F.col("packet.timestamp_ns")).otherwise(F.col("capture_time_ns"))
    salvaged = archives.salvage(spark, _contents(rebuilt, folder)).where("packet.ok").select("archive_path", "offset", time.alias("capture_time_ns"), "frame")
    rows = again.unionByName(salvaged).withColumn("archive_path", F.concat("archive_path", F.lit(REPAIRED)))
    ath.write(rows.withColumnRenamed("offset", "place"), out)
    _put_aside(plans.where("action = 'quarantine_file'").select("archive_path"), folder, out)
    state = fleet(spark, out).select(F.col("archive_path").alias("output"), F.col("records").alias("written_records"), F.col("ok").alias("sound"))
    done = plans.join(state, "output", "left")
    verified = F.when(F.col("verify"), F.coalesce(F.col("sound") & (F.col("written_records") == F.col("expected_records")), F.lit(False)))
    return done.select(*plans.columns, F.coalesce("written_records", F.lit(0)).alias("written_records"), verified.alias("verified"))


def _contents(names: DataFrame, folder: str) -> DataFrame:
    """(path, content) of the named archives of a folder and of no others. Names
    are few bytes, so they are dealt to a stated number of tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, source = ath.opened(folder)
        for batch in batches:
            held, size = {"path": [], "content": []}, 0
            for name in batch["archive_path"].to_pylist():
                with where.open_input_file(f"{source}/{name}") as f:
                    held["path"].append(name)
                    held["content"].append(f.read())
                size += len(held["content"][-1])
                if size >= archives.HELD:
                    yield pa.RecordBatch.from_pydict(held, archives.FILE)
                    held, size = {"path": [], "content": []}, 0
            yield pa.RecordBatch.from_pydict(held, archives.FILE)

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(tasks, "archive_path").mapInArrow(work, "path string, content binary")


def _put_aside(names: DataFrame, folder: str, out: str) -> None:
    """Moves files; one that is gone already (a task that ran again) is done."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, source = ath.opened(folder)
        _, target = ath.opened(out)
        for batch in batches:
            for name in batch["archive_path"].to_pylist():
                if where.get_file_info(f"{source}/{name}").type == fs.FileType.File:
                    where.create_dir(target, recursive=True)
                    where.move(f"{source}/{name}", f"{target}/{name}{QUARANTINED}")
            yield batch

    names.mapInArrow(work, "archive_path string").count()
