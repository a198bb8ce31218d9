"""Joins, samples, plans and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import joins as J
from ..operators import planning as P
from ..operators import sampling as M
from ..operators import sequences as S
from ..operators.query import Query
from ..sources import adapters as A
from .archive_queries import DAY, HOUR, T0

TABLE: dict = {}

_RANGE = "min(capture_time_ns) AS first_time_ns, max(capture_time_ns) AS last_time_ns"
_BYTES = "CAST(sum(payload_size) AS BIGINT) AS payload_bytes"
_CATALOG = f"catalog AS (SELECT archive_path, count(*) AS records, {_RANGE}, {_BYTES} FROM packets GROUP BY archive_path)"
# archives of one day each, which makes time ranges that differ
_DAILY = f"daily AS (SELECT * REPLACE (concat('d', lpad(CAST((capture_time_ns - {T0}) // {DAY} AS VARCHAR), 2, '0'), '.ath') AS archive_path) FROM packets), catalog AS (SELECT archive_path, count(*) AS records, {_RANGE}, {_BYTES} FROM daily GROUP BY archive_path)"


def daily(p: DataFrame) -> DataFrame:
    day = F.expr(f"(capture_time_ns - {T0}) div {DAY}")
    return p.withColumn("archive_path", F.concat(F.lit("d"), F.lpad(day.cast("string"), 2, "0"), F.lit(".ath")))


def add(name, build, sql, more: str = "") -> None:
    TABLE[name] = (lambda s, d: build(A.packets(s, d)), None if sql is None else f"WITH {A.PACKETS_SQL}{', ' + more if more else ''} {sql}")


add(
    "jn1_archive_overlaps",
    lambda p: J.overlaps(p, G.catalog(p)),
    """SELECT x.*, end_ns - start_ns AS span_ns, (SELECT count(*) FROM packets WHERE archive_path = left_archive_path AND capture_time_ns BETWEEN start_ns AND end_ns) AS left_records,
    (SELECT count(*) FROM packets WHERE archive_path = right_archive_path AND capture_time_ns BETWEEN start_ns AND end_ns) AS right_records
    FROM (SELECT l.archive_path AS left_archive_path, r.archive_path AS right_archive_path, greatest(l.first_time_ns, r.first_time_ns) AS start_ns, least(l.last_time_ns, r.last_time_ns) AS end_ns
    FROM catalog l JOIN catalog r ON l.archive_path < r.archive_path AND l.first_time_ns <= r.last_time_ns AND r.first_time_ns <= l.last_time_ns) x""",
    _CATALOG,
)
_SIDE = "SELECT {k}, count(*) AS n, sum(payload_size) AS b FROM packets WHERE archive_ordinal = {o} AND payload_size > {m} GROUP BY {k}"
_PARTS = lambda p: (p.where("archive_ordinal = 0 AND payload_size > 0"), p.where("archive_ordinal = 1 AND payload_size > 300"))
add(
    "jn2_device_diff",
    lambda p: J.device_diff(*_PARTS(p)),
    f"""SELECT coalesce(l.device, r.device) AS device, CASE WHEN l.device IS NULL THEN 'device_added' WHEN r.device IS NULL THEN 'device_removed' ELSE 'device_changed' END AS change, coalesce(r.n, 0) - coalesce(l.n, 0) AS records_delta,
    CAST(coalesce(r.b, 0) - coalesce(l.b, 0) AS BIGINT) AS bytes_delta FROM ({_SIDE.format(k='device', o=0, m=0)}) l FULL JOIN ({_SIDE.format(k='device', o=1, m=300)}) r ON l.device = r.device
    WHERE l.n IS DISTINCT FROM r.n OR l.b IS DISTINCT FROM r.b""",
)
add(
    "jn2_kind_diff",
    lambda p: J.kind_diff(*_PARTS(p)),
    f"""SELECT coalesce(l.kind, r.kind) AS kind, CASE WHEN l.kind IS NULL THEN 'kind_added' WHEN r.kind IS NULL THEN 'kind_removed' ELSE 'kind_changed' END AS change, coalesce(r.n, 0) - coalesce(l.n, 0) AS records_delta
    FROM ({_SIDE.format(k='kind', o=0, m=0)}) l FULL JOIN ({_SIDE.format(k='kind', o=1, m=300)}) r ON l.kind = r.kind WHERE l.n IS DISTINCT FROM r.n""",
)
add(
    "jn2_summary_diff",
    lambda p: J.summary_diff(*_PARTS(p)).unionByName(J.summary_diff(_PARTS(p)[0], _PARTS(p)[0])),
    """SELECT 'summary_changed' AS change, format('records={} first={} last={}', a.n, a.f, a.l) AS before, format('records={} first={} last={}', b.n, b.f, b.l) AS after, b.n - a.n AS records_delta, b.b - a.b AS bytes_delta
    FROM (SELECT count(*) AS n, min(capture_time_ns) AS f, max(capture_time_ns) AS l, CAST(sum(payload_size) AS BIGINT) AS b FROM packets WHERE archive_ordinal = 0 AND payload_size > 0) a,
        (SELECT count(*) AS n, min(capture_time_ns) AS f, max(capture_time_ns) AS l, CAST(sum(payload_size) AS BIGINT) AS b FROM packets WHERE archive_ordinal = 1 AND payload_size > 300) b WHERE (a.n, a.f, a.l) <> (b.n, b.f, b.l)""",
)
_WARN = lambda p, o: p.where(f"archive_ordinal = {o} AND payload_size > 3000").select(F.concat(F.lit("large payload from "), F.col("device").cast("string")).alias("warning"))
_WARN_SQL = "SELECT concat('large payload from ', device) AS warning FROM packets WHERE archive_ordinal = {} AND payload_size > 3000"
add(
    "set7_warning_diff",
    lambda p: J.warning_diff(_WARN(p, 0), _WARN(p, 1)),
    f"SELECT warning, 'warning_removed' AS change FROM ({_WARN_SQL.format(0)} EXCEPT {_WARN_SQL.format(1)}) UNION ALL SELECT warning, 'warning_added' FROM ({_WARN_SQL.format(1)} EXCEPT {_WARN_SQL.format(0)})",
)
add(
    "jn13_superseded",
    lambda p: J.superseded(p).select("archive_path", "offset", "device", "sequence", "highest"),
    """SELECT archive_path, "offset", device, sequence, highest FROM (SELECT *, max(sequence) OVER (PARTITION BY device) AS highest FROM packets) WHERE sequence < highest""",
)
add(
    "jn15_device_archives",
    J.device_archives,
    "SELECT device, b AS previous_path, archive_path FROM (SELECT *, lag(archive_path) OVER (PARTITION BY device ORDER BY archive_ordinal) AS b FROM (SELECT DISTINCT device, archive_ordinal, archive_path FROM packets)) WHERE b IS NOT NULL",
)

_ORD = 'capture_time_ns, archive_ordinal, "offset"'
_OUT = f'row_number() OVER (ORDER BY {_ORD}) - 1 AS sample_rank, archive_path, capture_time_ns, device, sequence, payload_size, "offset"'
add("smp1_first", lambda p: M.first(p, 100), f"SELECT {_OUT} FROM (SELECT * FROM packets ORDER BY {_ORD} LIMIT 100)")
add("smp2_every", lambda p: M.every(p, 17, 200), f"SELECT {_OUT} FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_ORD}) - 1 AS n FROM packets) WHERE n % 17 = 0 ORDER BY n LIMIT 200)")
add("smp3_per_bucket", lambda p: M.per_bucket(p, 5 * HOUR, 0), f"SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY capture_time_ns // {5 * HOUR} ORDER BY {_ORD}) AS n FROM packets) WHERE n = 1")
# one multiplication a word, then one a byte of the path, modulo 2^64
_HASHED = """list_reduce(list_concat([1469598103934665603::UBIGINT, archive_ordinal::UBIGINT, "offset"::UBIGINT, capture_time_ns::UBIGINT, payload_size::UBIGINT, device::UBIGINT, sequence::UBIGINT],
        list_transform(string_split(archive_path, ''), lambda c: ascii(c)::UBIGINT)), lambda h, x: CAST(CAST(xor(h, x) AS UHUGEINT) * 1099511628211 % 18446744073709551616 AS UBIGINT))"""
add("smp4_hashed", lambda p: M.hashed(p, 16, 3), f"SELECT {_OUT} FROM (SELECT *, {_HASHED} AS hash FROM packets) WHERE hash % 16 = 3")
add(
    "smp5_extremes",
    lambda p: M.extremes(p, 61),
    f"""SELECT {_OUT} FROM (SELECT *, row_number() OVER (ORDER BY payload_size, {_ORD}) AS lo, row_number() OVER (ORDER BY payload_size DESC, capture_time_ns DESC, archive_ordinal DESC, "offset" DESC) AS hi FROM packets) WHERE lo <= 31 OR hi <= 30""",
)

_KEEP = Query(start=T0 + DAY, end=T0 + 25 * DAY)
_DROP = f"""CASE WHEN NOT (capture_time_ns BETWEEN {T0 + DAY} AND {T0 + 25 * DAY}) THEN 'query' WHEN payload_size = 0 THEN 'empty_payload' WHEN sequence < max(sequence) OVER (PARTITION BY device) THEN 'superseded' END AS dropped_by"""
add("pln1_compaction", lambda p: P.compaction(p, _KEEP), f'SELECT archive_path, "offset", device, sequence, {_DROP} FROM packets')
add("pln1_compaction_stats", lambda p: P.compaction_stats(P.compaction(p, _KEEP)), f"SELECT coalesce(dropped_by, 'kept') AS outcome, count(*) AS records FROM (SELECT {_DROP} FROM packets) GROUP BY ALL")
add(
    "pln2_segments",
    lambda p: P.segments(G.catalog(daily(p)), 18 * HOUR),
    f"""SELECT s AS start_ns, s + {18 * HOUR - 1} AS end_ns, count(*) AS archives, string_agg(DISTINCT archive_path, ',' ORDER BY archive_path) AS paths,
    concat('segment-', lpad(CAST(s AS VARCHAR), 20, '0'), '-', lpad(CAST(s + {18 * HOUR - 1} AS VARCHAR), 20, '0'), '.ath') AS name
    FROM (SELECT archive_path, unnest(range(first_time_ns // {18 * HOUR} * {18 * HOUR}, last_time_ns // {18 * HOUR} * {18 * HOUR} + 1, {18 * HOUR})) AS s FROM catalog) GROUP BY s""",
    _DAILY,
)
_IN = 'PARTITION BY device ORDER BY capture_time_ns, archive_path, "offset"'
add(
    "pln3_rotation_count",
    lambda p: P.rotation_by_count(p, 20),
    f"""SELECT device, archive_path, "offset", (n - 1) // 20 AS shard, concat('shard_', lpad(CAST((n - 1) // 20 AS VARCHAR), 6, '0'), '.ath') AS output FROM (SELECT *, row_number() OVER ({_IN}) AS n FROM packets)""",
)
add(
    "pln3_rotation_idle",
    lambda p: P.rotation_by_idle(p, 12 * HOUR),
    f"""SELECT device, archive_path, "offset", CAST(sum(n) OVER ({_IN}) AS BIGINT) AS shard FROM (SELECT *, CASE WHEN capture_time_ns - lag(capture_time_ns) OVER ({_IN}) > {12 * HOUR} THEN 1 ELSE 0 END AS n FROM packets)""",
)
_MIX = P.Rotation(max_records=25, max_payload=20_000, max_span=9 * DAY, idle_gap=2 * DAY)
add("pln3_rotation_mixed", lambda p: P.rotation(p, _MIX), None)
add("pln4_rotation_checks", lambda p: P.rotation_checks(P.rotation(p, _MIX), p), "SELECT count(*) AS records, count(*) AS placed_once FROM packets")
_RET = P.Retention(keep_after=T0 + 27 * DAY, delete_before=T0 + 5 * DAY, archive_before=T0 + 12 * DAY, compact_before=T0 + 20 * DAY, record_floor=100)
_ACT = f"""CASE WHEN records = 0 THEN 'delete' WHEN records < 100 THEN 'keep' WHEN last_time_ns >= {_RET.keep_after} + {{a}} THEN 'keep' WHEN last_time_ns < {_RET.delete_before} + {{a}} THEN 'delete' WHEN last_time_ns < {_RET.archive_before} + {{a}} THEN 'archive' WHEN last_time_ns < {_RET.compact_before} + {{a}} THEN 'compact' ELSE 'keep' END"""
_WHY = f"""CASE WHEN records = 0 THEN 'empty archive' WHEN records < 100 THEN 'below minimum record floor' WHEN last_time_ns >= {_RET.keep_after} THEN 'inside active retention window' WHEN last_time_ns < {_RET.delete_before} THEN 'older than delete threshold' WHEN last_time_ns < {_RET.archive_before} THEN 'older than archive threshold' WHEN last_time_ns < {_RET.compact_before} THEN 'older than compact threshold' ELSE 'no retention rule matched' END"""
add("pln5_retention", lambda p: P.retention(G.catalog(daily(p)), _RET), f"SELECT archive_path, records, {_ACT.format(a=0)} AS action, {_WHY} AS reason FROM catalog", _DAILY)
add(
    "pln6_retention_simulation",
    lambda p: P.retention_simulation(G.catalog(daily(p)), _RET, 4, 2 * DAY),
    f"SELECT snapshot, action, count(*) AS files, CAST(sum(records) AS BIGINT) AS records FROM (SELECT snapshot, records, {_ACT.format(a=f"snapshot * {2 * DAY}")} AS action FROM catalog, range(4) t(snapshot)) GROUP BY ALL",
    _DAILY,
)
_SAMPLES = "samples AS (SELECT last_time_ns AS t, archive_path, sum(records) OVER w AS r, sum(payload_bytes) OVER w AS b FROM catalog WINDOW w AS (ORDER BY first_time_ns, archive_path ROWS UNBOUNDED PRECEDING)), ends AS (SELECT min(t) AS t0, max(t) AS t1, first(r ORDER BY t, archive_path) AS r0, last(r ORDER BY t, archive_path) AS r1, first(b ORDER BY t, archive_path) AS b0, last(b ORDER BY t, archive_path) AS b1 FROM samples), rates AS (SELECT *, CASE WHEN t1 > t0 AND r1 > r0 THEN (r1 - r0) / ((t1 - t0) / 1e9) ELSE 0.0 END AS rr, CASE WHEN t1 > t0 AND b1 > b0 THEN (b1 - b0) / ((t1 - t0) / 1e9) ELSE 0.0 END AS br FROM ends)"
add(
    "pln7_capacity_forecast",
    lambda p: P.capacity(S.capacity_samples(G.catalog(daily(p))), 30 * DAY, 10_000_000),
    f"""SELECT CAST(r1 AS BIGINT) AS records, CAST(b1 AS BIGINT) AS payload_bytes, round(rr, 9) AS records_rate, CAST(r1 + floor(rr * {30 * DAY / 1e9}) AS BIGINT) AS projected_records, round(br, 9) AS payload_bytes_rate,
    CAST(b1 + floor(br * {30 * DAY / 1e9}) AS BIGINT) AS projected_payload_bytes, b1 + floor(br * {30 * DAY / 1e9}) > 10000000 AS exceeds FROM rates""",
    f"{_DAILY}, {_SAMPLES}",
)
add(
    "pln8_catalog_select",
    lambda p: P.catalog_select(daily(p), G.catalog(daily(p)), T0 + 3 * DAY, T0 + 14 * DAY, device=7),
    f"SELECT * FROM catalog WHERE last_time_ns >= {T0 + 3 * DAY} AND first_time_ns <= {T0 + 14 * DAY} AND archive_path IN (SELECT archive_path FROM daily WHERE device = 7)",
    _DAILY,
)
_AUDIT = """findings AS (
    SELECT archive_path, 'error' AS severity, 'ordered_timestamps' AS code, CAST(NULL AS BIGINT) AS device, "offset" FROM (SELECT *, lag(capture_time_ns) OVER (PARTITION BY archive_path ORDER BY "offset") AS b FROM moved) WHERE capture_time_ns < b
    UNION ALL SELECT archive_path, 'warning', 'monotonic_device_sequences', device, "offset" FROM (SELECT *, max(sequence) OVER (PARTITION BY archive_path, device ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM moved) WHERE sequence < h
    UNION ALL SELECT archive_path, 'warning', 'payload_bounds', device, "offset" FROM moved WHERE payload_size < 1 OR payload_size > 3000
    UNION ALL SELECT archive_path, 'error', 'duplicate_offsets', NULL, "offset" FROM moved GROUP BY archive_path, "offset" HAVING count(*) > 1
    UNION ALL SELECT archive_path, 'info', 'sparse_devices', device, NULL FROM moved GROUP BY archive_path, device HAVING count(*) < 10)"""
_MOVED = "moved AS (SELECT * REPLACE (timestamp_ns AS capture_time_ns) FROM packets)"
_moved = lambda p: p.withColumn("capture_time_ns", F.col("timestamp_ns"))
add("pln9_audit", lambda p: P.audit(_moved(p), 1, 3000, 10), "SELECT * FROM findings", f"{_MOVED}, {_AUDIT}")
add(
    "pln10_fleet_audit",
    lambda p: P.audit_summary(P.audit(_moved(p), 1, 3000, 10)),
    "SELECT archive_path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS ok FROM findings GROUP BY archive_path",
    f"{_MOVED}, {_AUDIT}",
)
add("flt14_findings_by_severity", lambda p: P.audit(_moved(p), 1, 3000, 10).where("severity = 'warning'"), "SELECT * FROM findings WHERE severity = 'warning'", f"{_MOVED}, {_AUDIT}")
# a manifest per day; some states that no reader makes: archives without
# records, devices with inverted times
_kept_days = lambda p: daily(p).withColumn("capture_time_ns", F.col("timestamp_ns"))


def _health(p):
    d = _kept_days(p)
    catalog = G.catalog(d).withColumn("records", F.when(F.col("archive_path") == "d03.ath", 0).otherwise(F.col("records")))
    devices = G.manifest_devices(d).withColumn("last_time_ns", F.when(F.col("device") % 31 == 0, 0).otherwise(F.col("last_time_ns"))).withColumn("records", F.when((F.col("device") == 3) & (F.col("archive_path") < "d05"), 0).otherwise(F.col("records")))
    warnings = G.manifest_order_warnings(d).where("offset % 5 = 0").select("archive_path", F.lit("archive records are not ordered by capture time").alias("warning"))
    rules = P.HealthRules(least_records=100, most_devices=120, most_of_one_device=0.03, least_average_payload=500)
    return P.health(catalog, devices, warnings, rules)


_HEALTHSQL = f"""{_DAILY}, moved AS (SELECT * REPLACE (timestamp_ns AS capture_time_ns) FROM daily), cat AS (SELECT archive_path, CASE archive_path WHEN 'd03.ath' THEN 0 ELSE count(*) END AS records FROM moved GROUP BY archive_path),
    dev AS (SELECT archive_path, device, CASE WHEN device = 3 AND archive_path < 'd05' THEN 0 ELSE count(*) END AS records, device % 31 = 0 AS inverted, sum(payload_size) AS bytes FROM moved GROUP BY archive_path, device),
    held AS (SELECT archive_path, count(*) AS devices, max(records) AS largest, sum(bytes) AS bytes FROM dev GROUP BY archive_path), hits(archive_path, severity, code, message, device) AS (
    SELECT archive_path, 'error', 'archive.too_small', 'archive does not contain the minimum required number of records', NULL::BIGINT FROM cat WHERE records < 100
    UNION ALL SELECT archive_path, 'warning', 'archive.empty', 'archive has no readable records', NULL FROM cat WHERE records = 0
    UNION ALL SELECT archive_path, 'warning', 'archive.too_many_devices', 'archive contains more devices than the configured limit', NULL FROM held WHERE devices > 120
    UNION ALL SELECT archive_path, 'warning', 'device.empty', 'device aggregate contains no records', device FROM dev WHERE records = 0
    UNION ALL SELECT archive_path, 'error', 'device.time_inverted', 'device aggregate has inverted timestamp range', device FROM dev WHERE inverted
    UNION ALL SELECT archive_path, 'warning', 'archive.device_skew', 'one device dominates the archive record distribution', NULL FROM cat JOIN held USING (archive_path) WHERE records > 0 AND devices > 1 AND largest / records > 0.03
    UNION ALL SELECT archive_path, 'warning', 'archive.low_payload_density', 'average payload size is below the configured threshold', NULL FROM cat JOIN held USING (archive_path) WHERE records > 0 AND bytes / records < 500
    UNION ALL SELECT archive_path, 'warning', 'manifest.warning', 'archive records are not ordered by capture time', NULL FROM (SELECT *, lag(capture_time_ns) OVER (PARTITION BY archive_path ORDER BY "offset") AS b FROM moved) WHERE capture_time_ns < b AND "offset" % 5 = 0),
    healths AS (SELECT * FROM hits UNION ALL SELECT archive_path, 'info', 'archive.ok', 'archive health checks passed', NULL FROM cat WHERE archive_path NOT IN (SELECT archive_path FROM hits))"""
add("pln13_health", _health, "SELECT * FROM healths", _HEALTHSQL)
add("pln13_health_ok", lambda p: P.health_ok(_health(p)), "SELECT archive_path, count(*) FILTER (severity = 'error') = 0 AS ok FROM healths GROUP BY archive_path", _HEALTHSQL)
_STATE = lambda p: G.catalog(daily(p)).select("archive_path", (F.col("records") % 3 == 0).alias("ok"), F.col("records").alias("readable"), (F.col("records") + F.col("records") % 2).alias("salvaged"), (F.col("records") % 5 != 0).alias("header_ok"), (F.col("records") % 7 != 0).alias("ordered"))
add(
    "pln11_repair_plan",
    lambda p: P.repair_plan(_STATE(p)),
    """SELECT archive_path, action, action IN ('rebuild_from_salvage', 'rewrite_from_readable_records') AS verify FROM (SELECT archive_path, CASE WHEN records % 3 = 0 THEN 'no_op' WHEN records % 2 > 0 THEN 'rebuild_from_salvage' WHEN (records % 5 = 0 OR records % 7 = 0) AND records > 0 THEN 'rewrite_from_readable_records' WHEN records = 0 THEN 'quarantine_file' ELSE 'no_op' END AS action FROM catalog)""",
    _DAILY,
)
