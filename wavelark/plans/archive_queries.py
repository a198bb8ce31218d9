"""Queries over packets and archives, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import exports as X
from ..operators import query as Q
from ..operators import sequences as S
from ..sources import adapters as A

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000
T0 = 1_704_067_200_000_000_000  # 2024-01-01

Run = Callable[[SparkSession, str], DataFrame]
TABLE: dict[str, tuple[Run, str | None]] = {}


def on_packets(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    TABLE[name] = (lambda s, d: build(A.packets(s, d)), None if sql is None else f"WITH {A.PACKETS_SQL} {sql}")


def on_readings(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    TABLE[name] = (lambda s, d: build(A.readings(s, d)), None if sql is None else f"WITH {A.READINGS_SQL} {sql}")


def on_bins(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    TABLE[name] = (lambda s, d: build(A.bins(s, d)), None if sql is None else f"WITH {A.BINS_SQL} {sql}")


_Q = Q.Query(start=T0 + 2 * DAY, end=T0 + 20 * DAY, kind="observation", min_payload=10, max_payload=2000)
_QL = Q.Query(start=T0 + 2 * DAY, end=T0 + 20 * DAY, kind="observation", min_payload=10, max_payload=2000, limit=50)
_QD = Q.Query(start=T0 + 2 * DAY, device=7, kind="control", max_payload=2000)
_IN = f"capture_time_ns >= {_Q.start} AND capture_time_ns <= {_Q.end}"
_WHY = f"""CASE WHEN NOT ({_IN}) THEN 'time' WHEN kind <> 'observation' THEN 'kind' WHEN NOT (payload_size BETWEEN 10 AND 2000) THEN 'payload' END"""
_COUNTS = """count(*) AS scanned, count(*) FILTER (why IS NULL) AS matched, count(*) FILTER (why = 'time') AS skipped_by_time, count(*) FILTER (why = 'device') AS skipped_by_device,
    count(*) FILTER (why = 'kind') AS skipped_by_kind, count(*) FILTER (why = 'payload') AS skipped_by_payload"""
_IDX = 'archive_ordinal, archive_path, capture_time_ns, "offset", payload_size, device, sequence'

on_packets("src2_index_scan", Q.index, f"SELECT {_IDX} FROM packets")
on_packets("src4_collection_scan", lambda p: Q.index(p).orderBy("capture_time_ns", "archive_ordinal", "offset"), f"SELECT {_IDX} FROM packets")
on_packets(
    "src5_point_lookup",
    lambda p: Q.lookup(p, p.where("offset % 97 = 0").select("archive_path", "offset", "capture_time_ns", "device", (F.col("sequence") + F.col("offset") % 2).alias("sequence"))),
    """SELECT archive_path, "offset", device, kind, "offset" % 2 = 0 AS same FROM packets WHERE "offset" % 97 = 0""",
)
on_packets("flt1_query", lambda p: Q.archive(p, _Q), f"SELECT * EXCLUDE (kind_rank) FROM packets WHERE {_WHY} IS NULL")
on_packets("flt1_query_limit", lambda p: Q.archive(p, _QL), f'SELECT * EXCLUDE (kind_rank) FROM packets WHERE {_WHY} IS NULL ORDER BY archive_ordinal, "offset" LIMIT 50')
on_packets("flt2_stats", lambda p: Q.stats(p, _Q), f"SELECT {_COUNTS} FROM (SELECT {_WHY} AS why FROM packets)")
on_packets(
    "flt2_stats_limit",
    lambda p: Q.stats(p, _QL),
    f"""SELECT {_COUNTS} FROM (SELECT why, coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY archive_ordinal, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
    FROM (SELECT *, {_WHY} AS why FROM packets)) WHERE seen < 50""",
)
_SHARE = ", ".join(f"CASE WHEN scanned > 0 THEN round({c} / scanned, 6) ELSE 0.0 END AS {c}_ratio" for c in ("matched", "skipped_by_time", "skipped_by_device", "skipped_by_kind", "skipped_by_payload"))
on_packets("flt3_selectivity", lambda p: Q.selectivity(Q.stats(p, _Q)), f"SELECT scanned, {_SHARE} FROM (SELECT {_COUNTS} FROM (SELECT {_WHY} AS why FROM packets))")
on_packets("flt4_index_filter", lambda p: Q.filter_index(p, _Q), f"SELECT {_IDX} FROM packets WHERE {_IN} AND payload_size BETWEEN 10 AND 2000")
on_packets("flt5_collection_filter", lambda p: Q.filter_index(p, Q.Query(start=T0 + DAY, device=7, limit=25)), f'SELECT {_IDX} FROM packets WHERE capture_time_ns >= {T0 + DAY} AND device = 7 ORDER BY capture_time_ns, archive_ordinal, "offset" LIMIT 25')
on_packets(
    "flt6_collection_search",
    lambda p: Q.search(p, _QD),
    f"SELECT {_COUNTS} FROM (SELECT CASE WHEN capture_time_ns < {_QD.start} THEN 'time' WHEN payload_size > 2000 THEN 'payload' WHEN kind <> 'control' THEN 'kind' END AS why FROM packets WHERE device = 7)",
)
on_packets(
    "flt7_parsed_query",
    lambda p: Q.archive(p, Q.parse(f"start={T0 + DAY} kind=4 min_payload = 1").query),
    f"SELECT * EXCLUDE (kind_rank) FROM packets WHERE capture_time_ns >= {T0 + DAY} AND kind = 'control' AND payload_size >= 1",
)
on_packets("flt8_at_or_after", lambda p: Q.at_or_after(p, T0 + 5 * DAY), f'SELECT {_IDX} FROM packets WHERE capture_time_ns >= {T0 + 5 * DAY} ORDER BY capture_time_ns, archive_ordinal, "offset" LIMIT 1')
on_readings("flt9_readings", lambda r: r.where("channel = 3 AND quality = 'good' AND value BETWEEN 1000 AND 20000"), "SELECT * FROM readings WHERE channel = 3 AND quality = 'good' AND value BETWEEN 1000 AND 20000")
on_packets("flt10_batch_device", lambda p: p.where("device = 11"), "SELECT * EXCLUDE (kind_rank) FROM packets WHERE device = 11")
on_packets("flt10_batch_kind", lambda p: p.where("kind = 'spectrum'"), "SELECT * EXCLUDE (kind_rank) FROM packets WHERE kind = 'spectrum'")
on_packets(
    "flt11_pipeline_steps",
    lambda p: Q.steps(p, p.where("device % 3 = 0").select("device"), 1500),
    """SELECT device, "offset", CASE WHEN payload_size > 1500 THEN 'payload_limit' WHEN device % 3 <> 0 THEN 'device_allowlist' END AS dropped_by FROM packets""",
)
on_packets("jn12_allowlist", lambda p: p.join(p.where("payload_size > 4000").select("device").distinct(), "device", "left_semi").groupBy("kind").agg(F.count("*").alias("records")), "SELECT kind, count(*) AS records FROM packets WHERE device IN (SELECT device FROM packets WHERE payload_size > 4000) GROUP BY kind")
on_packets("flt15_projection", lambda p: p.select("archive_path", "capture_time_ns", "device", "sequence", "payload_size"), "SELECT archive_path, capture_time_ns, device, sequence, payload_size FROM packets")
on_packets("snk8_replay_stats", lambda p: Q.replay(p, T0 + DAY, T0 + 9 * DAY), f"SELECT count(*) AS seen, count(*) FILTER (x) AS emitted, CAST(coalesce(sum(payload_size) FILTER (x), 0) AS BIGINT) AS bytes FROM (SELECT *, capture_time_ns BETWEEN {T0 + DAY} AND {T0 + 9 * DAY} AS x FROM packets)")

_RANGE = "min(capture_time_ns) AS first_time_ns, max(capture_time_ns) AS last_time_ns"
_BYTES = "CAST(sum(payload_size) AS BIGINT) AS payload_bytes"
on_packets("agg1_device_summary", G.device_summary, f"SELECT device, count(*) AS records, {_RANGE}, {_BYTES} FROM packets GROUP BY device")
on_packets("agg2_manifest", G.manifest_archives, f"SELECT archive_path, count(*) AS records, {_RANGE}, count(DISTINCT device) AS devices, {_BYTES} FROM packets GROUP BY archive_path")
on_packets("agg2_manifest_kinds", G.manifest_kinds, "SELECT archive_path, kind, count(*) AS records FROM packets GROUP BY ALL")
on_packets(
    "agg2_manifest_warnings",
    lambda p: G.manifest_order_warnings(p.withColumn("capture_time_ns", F.col("timestamp_ns"))),
    """SELECT archive_path, "offset", 'record out of time order' AS warning FROM (SELECT *, lag(timestamp_ns) OVER (PARTITION BY archive_path ORDER BY "offset") AS b FROM packets) WHERE timestamp_ns < b""",
)
on_packets("snk3_manifest_devices", G.manifest_devices, f"SELECT archive_path, device, count(*) AS records, {_RANGE}, {_BYTES} FROM packets GROUP BY ALL")
on_packets("agg3_catalog_summary", G.catalog_summary, f"SELECT count(DISTINCT archive_path) AS archives, count(*) AS records, count(DISTINCT device) AS devices, {_RANGE} FROM packets")
on_packets("agg4_device_coverage", G.device_coverage, f"SELECT device, {_RANGE}, count(*) AS records, count(DISTINCT archive_ordinal) AS archives FROM packets GROUP BY device")
on_packets("agg5_archives_for_device", lambda p: G.archives_for_device(p, 7), "SELECT archive_path, min(capture_time_ns) AS first_time_ns FROM packets WHERE device = 7 GROUP BY archive_path")
on_packets(
    "agg6_time_buckets",
    lambda p: G.time_buckets(p, 6 * HOUR),
    f"SELECT start_ns, count(*) AS records, {_BYTES}, count(DISTINCT archive_ordinal) AS archives, start_ns + {6 * HOUR - 1} AS end_ns FROM (SELECT *, capture_time_ns // {6 * HOUR} * {6 * HOUR} AS start_ns FROM packets) GROUP BY start_ns",
)
on_packets(
    "agg7_payload_percentiles",
    G.payload_percentiles,
    """SELECT kind, min(payload_size) AS least, max(payload_size) AS most, round(avg(payload_size), 6) AS average, v[CAST(floor(0.5 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p50,
    v[CAST(floor(0.9 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p90, v[CAST(floor(0.99 * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p99
    FROM packets JOIN (SELECT kind, list(payload_size ORDER BY payload_size) AS v FROM packets GROUP BY kind) USING (kind) GROUP BY kind, v""",
)
on_packets(
    "agg8_payload_ranking",
    G.payload_ranking,
    f"SELECT device, records, payload_bytes, CASE WHEN sum(payload_bytes) OVER () > 0 THEN round(payload_bytes / sum(payload_bytes) OVER (), 6) ELSE 0.0 END AS share, round(payload_bytes / records, 6) AS average FROM (SELECT device, count(*) AS records, {_BYTES} FROM packets GROUP BY device)",
)
on_packets("agg9_density", G.density, f"SELECT *, round(records / archives, 6) AS records_per_archive, round(payload_bytes / archives, 6) AS bytes_per_archive, round(payload_bytes / records, 6) AS bytes_per_record FROM (SELECT count(DISTINCT archive_path) AS archives, count(*) AS records, {_BYTES} FROM packets)")
on_packets("agg10_device_kinds", G.device_kinds, "SELECT device, kind, count(*) AS records FROM packets GROUP BY ALL")
on_packets("agg11_payload_histogram", lambda p: G.payload_histogram(p, 256), "SELECT payload_size // 256 * 256 AS low, payload_size // 256 * 256 + 255 AS high, count(*) AS records FROM packets GROUP BY ALL")
on_packets("agg12_batch_summary", G.batch_summary, f"SELECT count(*) AS packets, {_BYTES}, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM packets")
_STATS = "count(v) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean"
on_packets(
    "agg13_running_stats",
    lambda p: G.running_stats(p, F.col("payload_size"), ["device"]),
    f"SELECT device, {_STATS}, round(var_pop(v) * count(v), 3) AS m2, round(coalesce(stddev_samp(v), 0), 6) AS deviation FROM (SELECT device, CAST(payload_size AS DOUBLE) AS v FROM packets) GROUP BY device",
)
on_readings(
    "agg14_observation_stats",
    G.observation_stats,
    f"SELECT channel, {_STATS}, round(coalesce(stddev_samp(v), 0), 6) AS deviation, count(*) FILTER (quality <> 'good') AS degraded FROM (SELECT *, value * pow(10.0, scale) AS v FROM readings) GROUP BY channel",
)
on_bins(
    "agg15_spectrum_stats",
    G.spectrum_stats,
    """SELECT frame_id, count(*) AS bins, round(min(power_dbm), 6) AS power_min, round(max(power_dbm), 6) AS power_max, round(avg(power_dbm), 6) AS power_mean, round(coalesce(stddev_samp(power_dbm), 0), 6) AS power_deviation,
    round(avg(noise_dbm), 6) AS noise_mean, CAST(first(bin ORDER BY power_dbm DESC, bin) AS INTEGER) AS strongest_bin, CAST(first(bin ORDER BY power_dbm, bin) AS INTEGER) AS weakest_bin FROM bins GROUP BY frame_id""",
)
on_packets("agg17_manifest_payload", G.manifest_payload, f"SELECT archive_path, {_BYTES} FROM packets GROUP BY ALL")
#: The registry: customers as devices, a segment for each lifecycle.
_SEGMENTS = dict(zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), G.LIFECYCLES, strict=True))


def _fleet(spark, sf_dir):
    state = F.create_map(*[F.lit(x) for pair in _SEGMENTS.items() for x in pair])
    registered = A.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("long").alias("device"), F.element_at(state, F.col("c_mktsegment")).alias("lifecycle"))
    return G.fleet(A.packets(spark, sf_dir), registered)


_FLEET = f"""WITH {A.PACKETS_SQL}, registered AS (SELECT c_custkey AS device, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENTS.items())} END AS lifecycle FROM customer WHERE c_custkey % 3 > 0), seen AS (
    SELECT device, min(capture_time_ns) AS first_seen_ns, max(capture_time_ns) AS last_seen_ns, count(*) AS packets, last(kind ORDER BY capture_time_ns, "offset") AS last_kind FROM packets GROUP BY device), fleet AS (
    SELECT coalesce(s.device, r.device) AS device, first_seen_ns, last_seen_ns, coalesce(packets, 0) AS packets, last_kind, coalesce(lifecycle, 'active') AS lifecycle FROM seen s FULL JOIN registered r ON s.device = r.device)"""
TABLE["rt6_fleet_registry"] = (_fleet, f"{_FLEET} SELECT * FROM fleet")
TABLE["agg26_fleet_summary"] = (
    lambda s, d: G.fleet_summary(_fleet(s, d)),
    f"{_FLEET} SELECT count(*) AS total_devices, count(*) FILTER (lifecycle = 'active') AS active_devices, count(*) FILTER (lifecycle = 'quarantined') AS quarantined_devices, count(*) FILTER (lifecycle = 'retired') AS retired_devices, CAST(sum(packets) AS BIGINT) AS packets_seen FROM fleet",
)
on_packets("srt1_batch_order", lambda p: G.top_batch(p, 100), 'SELECT timestamp_ns, device, sequence, "offset" FROM packets ORDER BY timestamp_ns, device, sequence, "offset" LIMIT 100')
_EXT = 'capture_time_ns, device, sequence, payload_size, "offset"'
on_packets(
    "srt2_extremes",
    G.extremes,
    f"""(SELECT 'smallest' AS which, {_EXT} FROM packets ORDER BY payload_size, capture_time_ns, "offset" LIMIT 1) UNION ALL (SELECT 'largest', {_EXT} FROM packets ORDER BY payload_size DESC, capture_time_ns DESC, "offset" LIMIT 1)""",
)

_TIMED = 'PARTITION BY device ORDER BY capture_time_ns, sequence, archive_ordinal, "offset"'
_ARRIVED = 'PARTITION BY device ORDER BY capture_time_ns, "offset"'
on_packets("win1_timelines", S.timelines, f"SELECT device, count(*) AS points, {_RANGE}, {_BYTES} FROM packets GROUP BY device")
on_packets(
    "win2_gaps",
    lambda p: S.gaps(p, 12 * HOUR),
    f"""SELECT device, start_ns, end_ns, end_ns - start_ns AS gap_ns, before_path, after_path FROM (SELECT device, capture_time_ns AS end_ns, archive_path AS after_path, lag(capture_time_ns) OVER ({_TIMED}) AS start_ns,
    lag(archive_path) OVER ({_TIMED}) AS before_path FROM packets) WHERE end_ns - start_ns > {12 * HOUR}""",
)
on_packets(
    "win3_sequence_anomalies",
    S.anomalies,
    f"""SELECT device, capture_time_ns, "offset", b AS previous, sequence, CASE WHEN sequence = b THEN 'duplicate sequence' WHEN sequence < b THEN 'sequence moved backwards' ELSE 'sequence gap' END AS reason
    FROM (SELECT *, lag(sequence) OVER ({_TIMED}) AS b FROM packets) WHERE sequence <> b + 1""",
)
on_packets(
    "win4_order_audit",
    lambda p: S.order_audit(p.withColumn("capture_time_ns", F.col("timestamp_ns"))),
    """SELECT archive_path, "offset", timestamp_ns AS capture_time_ns, b AS previous_ns FROM (SELECT *, lag(timestamp_ns) OVER (PARTITION BY archive_path ORDER BY "offset") AS b FROM packets) WHERE timestamp_ns < b""",
)
on_packets(
    "win5_regression_audit",
    S.regression_audit,
    """SELECT archive_path, device, "offset", sequence, highest FROM (SELECT *, max(sequence) OVER (PARTITION BY archive_path, device ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM packets) WHERE sequence < highest""",
)
_STEP = f'(SELECT device, capture_time_ns, "offset", capture_time_ns - lag(capture_time_ns) OVER ({_ARRIVED}) AS step, sequence <= lag(sequence) OVER ({_ARRIVED}) AS back FROM packets)'
_LINK = f"""(SELECT device, capture_time_ns, "offset", CASE WHEN step > {24 * HOUR} THEN 'link.idle_gap' ELSE 'link.jitter' END AS code FROM {_STEP} WHERE step > {8 * HOUR}
    UNION ALL SELECT device, capture_time_ns, "offset", 'link.sequence_regression' FROM {_STEP} WHERE back)"""
on_packets("win6_link_findings", lambda p: S.link_findings(p, 24 * HOUR, 8 * HOUR), f"SELECT * FROM {_LINK}")
on_packets("str7_link_summary", lambda p: S.link_summary(p, 24 * HOUR, 8 * HOUR), f"SELECT device, code, count(*) AS findings FROM {_LINK} GROUP BY ALL")
on_readings(
    "win7_sliding_window",
    lambda r: S.sliding(r, 12 * HOUR),
    f"""SELECT channel, reading_id, time_ns, min(time_ns) OVER w AS start_ns, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean, min(value) OVER w AS least, max(value) OVER w AS most FROM readings
    WINDOW w AS (PARTITION BY channel ORDER BY time_ns RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)""",
)
_SESS = f"""(SELECT device, count(*) AS packets, count(*) FILTER (sequence <= l) AS duplicates, CAST(coalesce(sum(sequence - l - 1) FILTER (sequence > l), 0) AS BIGINT) AS missing, count(*) FILTER (sequence - l - 1 > 4) AS gap_events,
    count(*) FILTER (timestamp_ns < t) AS regressions, max(sequence) AS last_sequence
    FROM (SELECT *, max(sequence) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, max(timestamp_ns) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM packets WINDOW w AS ({_ARRIVED})) GROUP BY device)"""
on_packets("str1_sessions", S.sessions, f"SELECT * FROM {_SESS}")
on_packets("agg27_session_totals", lambda p: S.session_totals(S.sessions(p)), f"SELECT count(*) AS devices, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(regressions) AS BIGINT) AS regressions FROM {_SESS}")
on_packets(
    "str2_idle_sessions",
    lambda p: S.idle_sessions(p, 12 * HOUR),
    f"""SELECT device, session, min(capture_time_ns) AS opened_ns, max(capture_time_ns) AS last_seen_ns, count(*) AS packets FROM (SELECT *, CAST(sum(o) OVER ({_ARRIVED}) AS BIGINT) AS session FROM
    (SELECT *, CASE WHEN capture_time_ns - lag(capture_time_ns) OVER ({_ARRIVED}) < {12 * HOUR} THEN 0 ELSE 1 END AS o FROM packets)) GROUP BY device, session""",
)
_CAT = f"(SELECT archive_path, count(*) AS records, {_RANGE}, {_BYTES} FROM packets GROUP BY archive_path)"
on_packets(
    "win9_capacity_samples",
    lambda p: S.capacity_samples(G.catalog(p)),
    f"SELECT last_time_ns AS time_ns, archive_path, CAST(sum(records) OVER w AS BIGINT) AS records, CAST(sum(payload_bytes) OVER w AS BIGINT) AS payload_bytes FROM {_CAT} WINDOW w AS (ORDER BY first_time_ns, archive_path ROWS UNBOUNDED PRECEDING)",
)
_RANGES = f"(SELECT device % 5 AS site, capture_time_ns AS s, capture_time_ns + {HOUR} AS e FROM packets)"
on_packets(
    "set2_range_union",
    lambda p: S.merged_ranges(p.select((F.col("device") % 5).alias("site"), F.col("capture_time_ns").alias("start_ns"), (F.col("capture_time_ns") + HOUR).alias("end_ns")), ["site"]),
    f"""SELECT site, min(s) AS start_ns, max(e) AS end_ns FROM (SELECT *, sum(o) OVER (PARTITION BY site ORDER BY s, e) AS island FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY site ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS o FROM {_RANGES})) GROUP BY site, island""",
)

on_packets("snk2_record_csv", X.record_csv, "SELECT concat_ws(',', capture_time_ns, device, sequence, kind, payload_size) AS line FROM packets")
on_packets("snk4_record_json", X.record_json, """SELECT concat('{"archive_path":"', archive_path, '","offset":', "offset", ',"capture_time_ns":', capture_time_ns, ',"device":', device, ',"sequence":', sequence, ',"kind":"', kind, '","payload_size":', payload_size, '}') AS line FROM packets""")
on_packets("snk4_ref_json", X.ref_json, """SELECT concat('{"archive_path":"', archive_path, '","archive_ordinal":', archive_ordinal, ',"offset":', "offset", ',"capture_time_ns":', capture_time_ns, ',"device":', device, ',"sequence":', sequence, ',"payload_size":', payload_size, '}') AS line FROM packets""")
on_packets("snk4_ref_csv", X.ref_csv, """SELECT concat_ws(',', archive_path, "offset", capture_time_ns, device, sequence, 'unknown', payload_size) AS line FROM packets""")
on_packets(
    "snk5_manifest_json",
    lambda p: X.manifest_json(G.manifest_devices(p)),
    """SELECT concat('{"archive_path":"', archive_path, '","records":', sum(records), ',"devices":[', string_agg(concat('{"device":', device, ',"records":', records, ',"payload_bytes":', payload_bytes, '}'), ',' ORDER BY records DESC, device), ']}') AS line
    FROM (SELECT archive_path, device, count(*) AS records, CAST(sum(payload_size) AS BIGINT) AS payload_bytes FROM packets GROUP BY ALL) GROUP BY archive_path""",
)
