"""Protocol, telemetry, diagnostics and control queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import diagnostics as D
from ..operators import expectations as E
from ..operators import incidents as N
from ..operators import joins as J
from ..operators import protocol as X
from ..operators import report
from ..operators import sequences as S
from ..operators import telemetry as T
from ..sources import adapters as A
from ..sources import scratch
from .archive_queries import DAY, HOUR, T0

TABLE: dict = {}


def _add(name, view, view_sql, build, sql, more: str = "") -> None:
    TABLE[name] = (lambda s, d: build(view(s, d)), None if sql is None else f"WITH {view_sql}{', ' + more if more else ''} {sql}")


def packets(name, build, sql, more="") -> None:
    _add(name, A.packets, A.PACKETS_SQL, build, sql, more)


def readings(name, build, sql, more="") -> None:
    _add(name, A.readings, A.READINGS_SQL, build, sql, more)


def metrics(name, build, sql, more="") -> None:
    _add(name, A.metrics, A.METRICS_SQL, build, sql, more)


def slo(name, build, sql, more="") -> None:
    _add(name, A.slo_events, A.SLO_SQL, build, sql, more)


# protocol
_NOW = T0 + 29 * DAY
_PROBED = "probed AS (SELECT *, (\"offset\" - 36) // 64 AS n FROM packets)"
_RULES = [
    (f"timestamp_ns > {_NOW}", "warning", "packet.timestamp_future"),
    ("payload_size > 3000", "error", "packet.payload_too_large"),
    ("payload_size = 0 AND kind <> 'heartbeat'", "warning", "packet.empty_payload"),
    ("kind = 'control' AND n % 3 = 0", "warning", "route.missing_control_route"),
    ("n % 3 <> 0 AND n % 20 + 1 > 16", "warning", "route.long_relay_path"),
    ("n % 11 = 0 AND n % 4 = 0", "error", "fragment.zero_count"),
    ("n % 11 = 0 AND n % 5 >= n % 4", "error", "fragment.sequence_out_of_range"),
    ("kind = 'capabilities' AND n % 3 = 0", "warning", "capabilities.zero_payload"),
    ("kind = 'capabilities' AND n % 2 <> 0", "note", "capabilities.no_bands"),
]
_HITS = " UNION ALL ".join(f"SELECT device, \"offset\", '{s}' AS severity, '{c}' AS code FROM probed WHERE {w}" for w, s, c in _RULES)
_FOUND = f"hits AS ({_HITS}), found AS (SELECT * FROM hits UNION ALL SELECT device, \"offset\", 'note', 'packet.ok' FROM probed WHERE \"offset\" NOT IN (SELECT \"offset\" FROM hits))"
packets("pro1_validation", lambda p: X.validate(X.with_sections(p), _NOW, 3000), "SELECT * FROM found", f"{_PROBED}, {_FOUND}")
packets("pro1_validation_summary", lambda p: X.validation_summary(X.validate(X.with_sections(p), _NOW, 3000)), "SELECT code, severity, count(*) AS packets FROM found GROUP BY ALL", f"{_PROBED}, {_FOUND}")
_EXT = lambda p: p.select(F.col("offset").alias("packet"), F.explode(F.sequence(F.lit(0), (F.col("sequence") % 3).cast("int"))).alias("position"), "sequence", "payload_size").select("packet", "position", ((F.col("sequence") + F.col("position")) % 6 + 1 - F.when(F.col("position") == 2, 1).otherwise(0)).cast("int").alias("type"), (F.col("payload_size") % 80).alias("size"))
_EXTSQL = """ext AS (SELECT "offset" AS packet, CAST(k AS INTEGER) AS position, CAST((sequence + k) % 6 + 1 - CASE WHEN k = 2 THEN 1 ELSE 0 END AS INTEGER) AS type, payload_size % 80 AS size FROM (SELECT *, unnest(range(0, sequence % 3 + 1)) AS k FROM packets)),
    known(type, name, least, most, repeatable) AS (VALUES (1, 'collector_id', 1, 8, false), (2, 'site_name', 1, 128, false), (3, 'capture_tags', 0, 4096, true), (4, 'firmware_build', 1, 128, false), (5, 'operator_note', 0, 512, true)),
    issues AS (SELECT packet, position, type, unnest(list_filter([CASE WHEN name IS NULL THEN 'unknown extension type' END, CASE WHEN size < least THEN 'extension value is shorter than allowed' END, CASE WHEN size > most THEN 'extension value is larger than allowed' END,
    CASE WHEN NOT repeatable AND count(*) OVER (PARTITION BY packet, type) > 1 THEN 'extension type is not repeatable' END], lambda x: x IS NOT NULL)) AS issue FROM ext LEFT JOIN known USING (type))"""
packets("pro2_extension_issues", lambda p: X.extension_issues(_EXT(p)), "SELECT * FROM issues", _EXTSQL)
packets(
    "pro1_extension_findings",
    lambda p: X.validate_extensions(_EXT(p), 2),
    """SELECT packet, 'error' AS severity, 'extension.too_many' AS code, 'packet has more extensions than allowed' AS message FROM ext GROUP BY packet HAVING count(*) > 2
    UNION ALL SELECT packet, 'warning', 'extension.invalid', issue FROM issues""",
    _EXTSQL,
)
_PEERS = lambda p: p.groupBy("device").agg(F.count("*").alias("n")).select("device", (F.col("n") * 8).cast("int").alias("max_payload"), (F.col("n") % 3 > 0).alias("compression"), (F.col("n") % 2 == 0).alias("encryption"))
_PEERSQL = "peers AS (SELECT device, count(*) * 8 AS size, count(*) % 3 > 0 AS c, count(*) % 2 = 0 AS e FROM packets GROUP BY device)"
packets(
    "pro3_negotiation",
    lambda p: X.negotiate(_PEERS(p)),
    """SELECT device, size >= 256 AS accepted, 3 AS version, size >= 256 AND c AS compression, size >= 256 AND e AS encryption, CASE WHEN size < 256 THEN concat('rejected_payload_limit: remote max payload ', size, ' is below required 256') WHEN c AND e THEN 'accepted: negotiation accepted without downgrade'
    ELSE concat_ws('; ', CASE WHEN NOT c THEN 'disabled_compression: compression disabled by remote capabilities' END, CASE WHEN NOT e THEN 'disabled_encryption: encryption disabled by remote capabilities' END) END AS notes FROM peers""",
    _PEERSQL,
)
TABLE["pro4_version_matrix"] = (lambda s, d: X.version_matrix(s), "SELECT v AS version, f AS feature, v >= since AS supported FROM (VALUES (1), (2), (3)) a(v), (VALUES ('routing', 2), ('fragments', 2), ('capabilities', 3), ('extensions', 3), ('encryption', 3)) b(f, since)")
packets("pro5_inspection", X.inspect, """SELECT "offset", concat('0x', lpad(lower(hex(device)), 16, '0')) AS device_hex, concat(kind, '#', sequence) AS label, concat(payload_size, ' bytes') AS payload FROM packets""")
_FRAG = lambda p: p.select("device", F.expr("sequence div 3").alias("stream_id"), (F.col("sequence") % 3).cast("int").alias("sequence"), F.lit(3).alias("count"), F.col("offset").alias("arrival"), F.concat(F.lit("<"), F.col("offset").cast("string"), F.lit(">")).alias("payload"))
packets(
    "pro6_reassembly",
    lambda p: X.reassemble(_FRAG(p)),
    """SELECT device, stream_id, count(*) AS fragments, min(arrival) AS first_arrival, string_agg(payload, '' ORDER BY part) AS payload FROM (SELECT device, sequence // 3 AS stream_id, sequence % 3 AS part, min("offset") AS arrival, concat('<', min("offset"), '>') AS payload FROM packets GROUP BY ALL)
    GROUP BY device, stream_id HAVING count(*) = 3""",
)
packets(
    "cod8_payload_format",
    lambda p: X.payload_format(p.select("offset", "kind", F.when(F.col("payload_size") % 3 > 0, F.unhex(F.lpad(F.hex(F.col("payload_size") % 7), 2, "0"))).otherwise(F.lit(b"")).alias("payload"))).select("offset", "format"),
    """SELECT "offset", CASE WHEN payload_size % 3 > 0 AND payload_size % 7 BETWEEN 1 AND 4 THEN ['scalar', 'spectrum', 'control', 'capability'][payload_size % 7] WHEN kind = 'observation' THEN 'scalar' WHEN kind = 'spectrum' THEN 'spectrum' WHEN kind = 'control' THEN 'control' WHEN kind = 'capabilities' THEN 'capability' ELSE 'unknown' END AS format FROM packets""",
)
packets("cod11_hex", lambda p: p.select("offset", X.to_hex(F.concat("kind", F.col("sequence").cast("string")).cast("binary"), 8).alias("hex")), """SELECT "offset", concat(lower(hex(encode(substr(concat(kind, sequence), 1, 8)))), CASE WHEN length(concat(kind, sequence)) > 8 THEN '...' ELSE '' END) AS hex FROM packets""")
packets(
    "rt1_priority",
    lambda p: X.priority(X.with_sections(p), F.col("route.priority")).select("offset", "priority"),
    """SELECT "offset", CASE WHEN n % 3 <> 0 AND n % 256 >= 200 THEN 'critical' WHEN n % 3 <> 0 AND n % 256 >= 128 THEN 'high' WHEN kind = 'control' THEN 'critical' WHEN kind IN ('heartbeat', 'capabilities') THEN 'high' ELSE 'normal' END AS priority FROM probed""",
    _PROBED,
)

# telemetry
readings(
    "tel1_observation_anomalies",
    lambda r: T.observation_anomalies(r, 0.25, 3.0),
    """SELECT *, degraded > 0.25 OR score > 3.0 AS anomalous FROM (SELECT device, round(sum(bad) / sum(n), 6) AS degraded, round(max(CASE WHEN dev > 0 THEN greatest(abs(lo - mean), abs(hi - mean)) / dev ELSE 0.0 END), 6) AS score FROM (SELECT device, channel, count(*) AS n, count(*) FILTER (quality <> 'good') AS bad,
    avg(value) AS mean, coalesce(stddev_samp(value), 0) AS dev, min(value) AS lo, max(value) AS hi FROM readings GROUP BY ALL) GROUP BY device)""",
)
readings(
    "tel1_observation_findings",
    lambda r: T.observation_findings(r, 0.2, 2.5),
    """SELECT device, NULL::BIGINT AS channel, 'observation.degraded_ratio' AS code, round(count(*) FILTER (quality <> 'good') / count(*), 6) AS score FROM readings GROUP BY device HAVING count(*) FILTER (quality <> 'good') / count(*) > 0.2
    UNION ALL SELECT device, channel, 'observation.channel_outlier', round(z, 6) FROM (SELECT device, channel, greatest(abs(min(value) - avg(value)), abs(max(value) - avg(value))) / stddev_samp(value) AS z FROM readings GROUP BY device, channel HAVING stddev_samp(value) > 0) WHERE z > 2.5""",
)
_add(
    "tel2_spectrum_findings",
    A.bins,
    A.BINS_SQL,
    lambda b: T.spectrum_findings(b.withColumn("noise_dbm", F.when(F.col("frame_id") % 50 > 0, -93.0)).withColumn("power_dbm", F.col("power_dbm") + F.when(F.col("frame_id") % 7 == 0, 90).otherwise(0))),
    """SELECT frame_id, f.code, round(f.score, 6) AS score FROM (SELECT frame_id, unnest(list_filter([CASE WHEN frame_id % 50 = 0 THEN {'code': 'spectrum.empty', 'score': 1.0} END, CASE WHEN frame_id % 50 > 0 AND snr < 3 THEN {'code': 'spectrum.low_snr', 'score': 3 - snr} END,
        CASE WHEN frame_id % 50 > 0 AND top >= 0 THEN {'code': 'spectrum.saturated', 'score': top} END], lambda x: x IS NOT NULL)) AS f
    FROM (SELECT frame_id, avg(power_dbm + CASE WHEN frame_id % 7 = 0 THEN 90 ELSE 0 END) + 93.0 AS snr, max(power_dbm + CASE WHEN frame_id % 7 = 0 THEN 90 ELSE 0 END) AS top FROM bins GROUP BY frame_id))""",
)
_add("tel2_spectrum_anomalies", A.bins, A.BINS_SQL, lambda b: T.spectrum_anomalies(b.withColumn("noise_dbm", F.lit(-93.0))), "SELECT frame_id, unnest(list_filter([CASE WHEN avg(power_dbm) + 93.0 < 3 THEN 'spectrum.low_snr' END, CASE WHEN max(power_dbm) >= 0 THEN 'spectrum.saturated' END], lambda x: x IS NOT NULL)) AS code FROM bins GROUP BY frame_id")
_CAL = [(0, 3, T0 + 5 * DAY, T0 + 10 * DAY, 1.1, -20.0), (1, 3, T0, 0, 0.9, 5.5), (2, 5, T0 + 2 * DAY, 0, 1.003, 0.25), (3, 8, T0, T0 + 9 * DAY, -1.0, 0.5)]
TABLE["tel3_calibration"] = (
    lambda s, d: T.calibrate(A.readings(s, d), s.createDataFrame(_CAL, "entry int, channel long, valid_from long, valid_until long, gain double, shift double")),
    f"""WITH {A.READINGS_SQL}, cal(entry, channel, f, u, gain, shift) AS (VALUES {", ".join(f"({a}, {b}, {c}, {u}, CAST({g} AS DOUBLE), CAST({h} AS DOUBLE))" for a, b, c, u, g, h in _CAL)}), met AS (SELECT r.*, c.gain, c.shift, row_number() OVER (PARTITION BY reading_id ORDER BY entry) AS place
    FROM readings r LEFT JOIN cal c ON r.channel = c.channel AND time_ns >= f AND (u = 0 OR time_ns < u))
    SELECT reading_id, channel, CAST(CASE WHEN gain IS NULL THEN value ELSE sign(value * gain + shift) * floor(abs(value * gain + shift) + 0.5) END AS INTEGER) AS value, CASE WHEN gain IS NULL THEN 'missing_calibration' ELSE quality END AS quality FROM met WHERE place = 1""",
)
readings("tel4_extract", lambda r: T.extract(r, DAY), f"SELECT time_ns // {DAY} * {DAY} AS start_ns, channel, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM readings GROUP BY ALL")
_add("win12_zero_crossings", A.iq, A.IQ_SQL, T.zero_crossings, "SELECT window_id, count(*) FILTER (x) AS crossings FROM (SELECT window_id, (i >= 0) <> (lag(i) OVER (PARTITION BY window_id ORDER BY n) >= 0) AS x FROM iq) GROUP BY window_id")

# metrics
_KEY = "struct_pack(time_ns, ordinal)"
metrics("flt12_metric_filter", lambda m: D.tagged(D.select_metrics(m, "evt.p", T0 + DAY, T0 + 9 * DAY), {"zone": "1"}).select("ordinal", "name", "value"), f"SELECT ordinal, name, value FROM metrics WHERE name LIKE 'evt.p%' AND time_ns BETWEEN {T0 + DAY} AND {T0 + 9 * DAY} AND zone = '1'")
metrics("jn14_tag_match", lambda m: D.tagged(m, {"shard": "2", "zone": "0"}).groupBy("name").agg(F.count("*").alias("samples")), "SELECT name, count(*) AS samples FROM metrics WHERE shard = '2' AND zone = '0' GROUP BY name")
metrics(
    "agg18_metric_rollup",
    D.rollup,
    "SELECT series, min(time_ns) AS first_ns, max(time_ns) AS last_ns, count(*) AS n, min(value) AS least, max(value) AS most, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, last(value ORDER BY time_ns, ordinal) AS latest, round(last(value ORDER BY time_ns, ordinal) - first(value ORDER BY time_ns, ordinal), 6) AS delta FROM metrics GROUP BY series",
)
metrics("agg19_series", D.series_sizes, "SELECT series, count(*) AS samples FROM metrics GROUP BY series")
metrics(
    "agg20_snapshot_summary",
    D.snapshot_summary,
    "SELECT count(*) FILTER (kind = 'counter') AS n_counter, count(*) FILTER (kind = 'gauge') AS n_gauge, count(*) FILTER (kind = 'latency') AS n_latency, count(*) FILTER (kind = 'bytes') AS n_bytes, round(sum(value) FILTER (kind = 'counter'), 6) AS counters, round(sum(value) FILTER (kind = 'bytes'), 6) AS bytes FROM metrics",
)
metrics("agg20_latest", D.latest, "SELECT series, last(value ORDER BY time_ns, ordinal) AS value, max(time_ns) AS time_ns FROM metrics GROUP BY series")
_LAT = lambda c: F.floor(F.expr(f"{c} * 1000000")).cast("long")
_BOUNDS = ", ".join(f"({b})" for b in D.LATENCY_BOUNDS)
metrics(
    "agg21_latency_buckets",
    lambda m: D.latency_buckets(m.where("name = 'evt.error'"), _LAT("value")),
    f"SELECT bound_ns, count(*) AS n FROM (SELECT (SELECT min(b) FROM (VALUES {_BOUNDS}) t(b) WHERE b >= v) AS bound_ns FROM (SELECT CAST(floor(value * 1000000) AS BIGINT) AS v FROM metrics WHERE name = 'evt.error')) GROUP BY bound_ns",
)
_PCT = ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{n}" for q, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))
metrics("agg21_latency_stats", lambda m: D.latency_stats(m.where("name = 'evt.error'"), F.col("value")), f"SELECT count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, {_PCT} FROM (SELECT value AS v FROM metrics WHERE name = 'evt.error')")
metrics("agg28_percentile", lambda m: m.groupBy("name").agg(F.round(F.percentile("value", 0.2), 6).alias("p20"), F.round(F.percentile("value", 0.75), 6).alias("p75")), "SELECT name, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.75), 6) AS p75 FROM metrics GROUP BY name")
metrics("agg22_latency_between", lambda m: m.where(f"kind = 'latency' AND time_ns BETWEEN {T0 + DAY} AND {T0 + 3 * DAY}").select("ordinal", "value"), f"SELECT ordinal, value FROM metrics WHERE kind = 'latency' AND time_ns BETWEEN {T0 + DAY} AND {T0 + 3 * DAY}")
_STEPS = "(SELECT {k}, value - lag(value) OVER (PARTITION BY {k} ORDER BY time_ns, ordinal) AS d FROM metrics)"
_TREND = "CASE WHEN steps = 0 THEN 'missing' WHEN ups = 0 AND downs = 0 THEN 'flat' WHEN ups > 0 AND downs > 0 THEN 'volatile' WHEN ups > 0 THEN 'rising' ELSE 'falling' END"
metrics(
    "win8_metric_trend",
    lambda m: S.metric_trends(D.with_series(m), ["series"], 150.0),
    f"SELECT *, {_TREND} AS trend FROM (SELECT series, count(d) AS steps, count(*) FILTER (d > 150.0) AS ups, count(*) FILTER (d < -150.0) AS downs FROM {_STEPS.format(k='series')} GROUP BY series)",
)
_SPLIT = T0 + 15 * DAY
_CMP = f"""SELECT series, p AS previous, c AS current, round(c - p, 6) AS change, round(CASE WHEN abs(p) < 1e-6 THEN CASE WHEN c = 0 THEN 0.0 ELSE 1.0 END ELSE (c - p) / abs(p) END, 6) AS relative,
    CASE WHEN p IS NULL OR c IS NULL THEN 'missing' WHEN abs(c - p) < 1e-6 THEN 'flat' WHEN c > p THEN 'rising' ELSE 'falling' END AS trend
    FROM (SELECT series, last(value ORDER BY time_ns, ordinal) AS p FROM metrics WHERE time_ns < {_SPLIT} GROUP BY series) FULL JOIN (SELECT series, last(value ORDER BY time_ns, ordinal) AS c FROM metrics WHERE time_ns >= {_SPLIT} GROUP BY series) USING (series)"""
_compared = lambda m: J.compare_snapshots(D.with_series(m).where(f"time_ns < {_SPLIT}"), D.with_series(m).where(f"time_ns >= {_SPLIT}"))
metrics("jn3_snapshot_compare", _compared, _CMP)
_MERGED = lambda m: m.select("ordinal", F.map_from_entries(F.array_union(F.filter(F.map_entries("tags"), lambda e: e["key"] != "zone"), F.array(F.struct(F.lit("zone").alias("key"), F.lit("x").alias("value")), F.struct(F.lit("rack").alias("key"), F.col("kind").alias("value"))))).alias("tags")).select("ordinal", D.canonical(F.lit("t"), F.col("tags")).alias("merged"))
metrics("set6_tag_merge", _MERGED, "SELECT ordinal, concat('t|rack=', kind, '|shard=', shard, '|zone=x') AS merged FROM metrics")

# alerts
_RULES_A = [
    D.Alert("r1", "threshold", "evt.error", "critical", ">", 200.0, window_ns=2 * DAY),
    D.Alert("r2", "threshold", "evt.view", "warning", "<", 0.0),
    D.Alert("r3", "missing", "evt.nothing", "info"),
    D.Alert("r4", "stale", "evt.signup", "warning", max_age_ns=HOUR),
    D.Alert("r5", "rate_of_change", "evt.click", "warning", "!=", 0.0, window_ns=3 * DAY),
    D.Alert("r6", "trend", "evt.purchase", "info", expected="volatile", floor=1.0),
    D.Alert("r7", "threshold", "evt.error", "critical", ">", 1.0, enabled=False),
    D.Alert("r8", "missing", "evt.view", "warning", suppressed=((T0, T0 + 40 * DAY),)),
    D.Alert("r9", "threshold", "evt.error", "warning", ">=", 1.0, window_ns=DAY, min_duration_ns=5 * DAY),
    D.Alert("r10", "threshold", "evt.other", "warning", ">", 1.0),
]
_AT = T0 + 28 * DAY
_W = lambda name, w: f"metrics WHERE name = '{name}' AND time_ns <= {_AT}" + (f" AND time_ns >= {_AT - w}" if w else "")
# each rule's state first, then its reason from what the state says
_RULED = f"""ruled AS (
    SELECT 'r1' AS id, 'threshold' AS kind, 'critical' AS severity, CASE WHEN count(*) = 0 THEN 'no_data' WHEN bool_or(value > 200) THEN 'active' ELSE 'inactive' END AS state, count(*) AS n, 'threshold' AS told FROM {_W('evt.error', 2 * DAY)}
    UNION ALL SELECT 'r2', 'threshold', 'warning', CASE WHEN count(*) = 0 THEN 'no_data' WHEN bool_or(value < 0) THEN 'active' ELSE 'inactive' END, count(*), 'threshold' FROM {_W('evt.view', 0)}
    UNION ALL SELECT 'r3', 'missing', 'info', CASE WHEN count(*) = 0 THEN 'active' ELSE 'inactive' END, count(*), 'missing' FROM {_W('evt.nothing', 0)}
    UNION ALL SELECT 'r4', 'stale', 'warning', CASE WHEN count(*) = 0 THEN 'no_data' WHEN {_AT} - max(time_ns) > {HOUR} THEN 'active' ELSE 'inactive' END, count(*), 'stale' FROM {_W('evt.signup', 0)}
    UNION ALL SELECT 'r5', 'rate_of_change', 'warning', CASE WHEN count(*) < 2 OR max(time_ns) = min(time_ns) THEN 'no_data' WHEN last(value ORDER BY time_ns, ordinal) <> first(value ORDER BY time_ns, ordinal) THEN 'active' ELSE 'inactive' END, count(*), CASE WHEN count(*) < 2 THEN 'rate' ELSE 'elapsed' END FROM {_W('evt.click', 3 * DAY)}
    UNION ALL SELECT 'r6', 'trend', 'info', CASE WHEN count(*) < 2 THEN 'no_data' WHEN count(*) FILTER (d > 1) > 0 AND count(*) FILTER (d < -1) > 0 THEN 'active' ELSE 'inactive' END, count(*), 'trend' FROM (SELECT value - lag(value) OVER (ORDER BY time_ns, ordinal) AS d FROM {_W('evt.purchase', 0)})
    UNION ALL SELECT 'r7', 'threshold', 'critical', 'inactive', count(*), 'disabled' FROM {_W('evt.error', 0)}
    UNION ALL SELECT 'r8', 'missing', 'warning', 'suppressed', count(*), 'suppressed' FROM {_W('evt.view', 0)}
    UNION ALL SELECT 'r9', 'threshold', 'warning', CASE WHEN count(*) = 0 THEN 'no_data' WHEN bool_or(value >= 1) AND max(time_ns) - min(time_ns) >= {5 * DAY} THEN 'active' ELSE 'inactive' END, count(*), CASE WHEN bool_or(value >= 1) THEN 'duration' ELSE 'threshold' END FROM {_W('evt.error', DAY)}
    UNION ALL SELECT 'r10', 'threshold', 'warning', 'no_data', 0, 'threshold')"""
_ALERTS = f"""{_RULED}, texts(told, state, reason) AS (VALUES ('threshold', 'no_data', 'metric not present in current snapshot'), ('threshold', 'active', 'threshold condition matched'), ('threshold', 'inactive', 'threshold condition did not match'),
    ('duration', 'no_data', 'metric not present in current snapshot'), ('duration', 'active', 'threshold condition matched'), ('duration', 'inactive', 'condition active but below minimum duration'), ('missing', 'active', 'metric is absent'), ('missing', 'inactive', 'metric is present'),
    ('stale', 'no_data', 'metric has no samples'), ('stale', 'active', 'metric is stale'), ('stale', 'inactive', 'metric is fresh'), ('rate', 'no_data', 'rate condition needs at least two samples'), ('elapsed', 'no_data', 'rate condition has zero elapsed time'),
    ('elapsed', 'active', 'rate condition matched'), ('elapsed', 'inactive', 'rate condition did not match'), ('trend', 'no_data', 'trend condition needs at least two samples'), ('trend', 'active', 'trend condition matched'), ('trend', 'inactive', 'trend condition did not match'),
    ('disabled', 'inactive', 'rule disabled'), ('suppressed', 'suppressed', 'rule suppressed')),
    alerts AS (SELECT id, kind, severity, state, reason, n FROM ruled LEFT JOIN texts USING (told, state))"""
_alerts = lambda m: D.evaluate(m, _RULES_A, _AT)
metrics("dia2_alert_rules", _alerts, "SELECT * FROM alerts", _ALERTS)
metrics(
    "agg24_alert_summary",
    lambda m: D.alert_summary(_alerts(m)),
    """SELECT count(*) AS total_rules, count(*) FILTER (state = 'active') AS active_rules, count(*) FILTER (state = 'inactive') AS inactive_rules, count(*) FILTER (state = 'suppressed') AS suppressed_rules, count(*) FILTER (state = 'no_data') AS no_data_rules,
    count(*) FILTER (reason = 'rule disabled') AS disabled_rules, count(*) FILTER (state = 'active' AND severity = 'critical') AS critical_active, count(*) FILTER (state = 'active' AND severity = 'warning') AS warning_active,
    count(*) FILTER (state = 'active' AND severity = 'info') AS info_active FROM alerts""",
    _ALERTS,
)
metrics("flt14_firing_alerts", lambda m: _alerts(m).where("state = 'active'"), "SELECT * FROM alerts WHERE state = 'active'", _ALERTS)

# service levels
_SLICE = "count(*) FILTER (kind = 'good') AS good, count(*) FILTER (kind = 'bad') AS bad, count(*) FILTER (kind = 'ignored') AS ignored, round(coalesce(sum(CAST(weight AS DOUBLE)) FILTER (kind <> 'ignored'), 0), 6) AS total_weight, round(coalesce(sum(CAST(weight AS DOUBLE)) FILTER (kind = 'bad'), 0), 6) AS bad_weight"
slo("agg23_slo_slice", lambda e: D.slo_slice(e.where(f"time_ns BETWEEN {T0 + DAY} AND {T0 + 6 * DAY}"), []), f"SELECT {_SLICE} FROM slo WHERE time_ns BETWEEN {T0 + DAY} AND {T0 + 6 * DAY}")
slo(
    "win10_slo_partition",
    lambda e: D.slo_partition(e, T0, T0 + 32 * DAY, 2 * DAY - 1),
    f"""SELECT s AS slice_start, least(s + {2 * DAY - 1}, {T0 + 32 * DAY}) AS slice_end, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(ignored, 0) AS ignored, coalesce(total_weight, 0.0) AS total_weight, coalesce(bad_weight, 0.0) AS bad_weight
    FROM (SELECT unnest(range({T0}, {T0 + 32 * DAY + 1}, {2 * DAY})) AS s) LEFT JOIN (SELECT {T0} + (time_ns - {T0}) // {2 * DAY} * {2 * DAY} AS s, {_SLICE} FROM slo WHERE time_ns BETWEEN {T0} AND {T0 + 32 * DAY} GROUP BY 1) USING (s)""",
)


def _budget(target: float) -> str:
    return f"""round(CASE WHEN total_weight > 0 THEN bad_weight / total_weight ELSE 0.0 END, 9) AS error_ratio, round(CASE WHEN total_weight > 0 THEN bad_weight / total_weight ELSE 0.0 END / {min(max(1 - target, 0.0), 1.0)!r}, 9) AS used"""


_STATUS = "round(greatest(1 - used, 0.0), 9) AS remaining, CASE WHEN total_weight = 0 THEN 'unknown' WHEN used >= 1 THEN 'exhausted' WHEN used >= 0.75 THEN 'warning' ELSE 'healthy' END AS status"
_BURN = f"""burn AS (SELECT *, {_STATUS} FROM (SELECT *, {_budget(0.8)} FROM (SELECT label, {_SLICE} FROM slo JOIN (VALUES ('1h', {_AT - HOUR}), ('6h', {_AT - 6 * HOUR}), ('3d', {_AT - 3 * DAY}), ('all', 0)) w(label, since) ON time_ns >= since AND time_ns <= {_AT} GROUP BY label)))"""
_burn = lambda e: D.burn(e, _AT, [HOUR, 6 * HOUR, 3 * DAY, 0], 0.8)
slo("dia10_budget", lambda e: D.budget(D.slo_slice(e, [(F.col("ordinal") % 7).alias("part")]), 0.85), f"SELECT *, {_STATUS} FROM (SELECT *, {_budget(0.85)} FROM (SELECT ordinal % 7 AS part, {_SLICE} FROM slo GROUP BY 1))")
slo("dia11_multi_window_burn", _burn, "SELECT * FROM burn", _BURN)
metrics("dia12_slo_from_metrics", lambda m: D.slo_from_values(m, 100.0), "SELECT ordinal, time_ns, CASE WHEN value <= 100 THEN 'good' ELSE 'bad' END AS kind, CAST(1.0 AS DOUBLE) AS weight FROM metrics")
slo(
    "set5_slo_merge",
    lambda e: D.merge_events(e.where("kind = 'bad'"), e.where("kind <> 'bad'")),
    "SELECT time_ns, kind, weight, row_number() OVER (ORDER BY time_ns, kind, ordinal) - 1 AS place FROM (SELECT ordinal, time_ns, kind, CAST(weight AS DOUBLE) AS weight FROM slo)",
)
slo("sup6_events_between", lambda e: e.where(f"time_ns BETWEEN {T0 + DAY} AND {T0 + 2 * DAY}").select("ordinal", "time_ns", "kind"), f"SELECT ordinal, time_ns, kind FROM slo WHERE time_ns BETWEEN {T0 + DAY} AND {T0 + 2 * DAY}")

# incidents
_DELTAS = f"deltas AS ({_CMP})"
_FINDINGS = """found AS (SELECT 'alert' AS source, id AS subject, CASE severity WHEN 'critical' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS severity FROM alerts WHERE state = 'active'
    UNION ALL SELECT 'slo', label, CASE status WHEN 'exhausted' THEN 'critical' ELSE 'medium' END FROM burn WHERE status IN ('warning', 'exhausted')
    UNION ALL SELECT 'metric', series, CASE WHEN abs(relative) >= 1.0 THEN 'high' ELSE 'medium' END FROM deltas WHERE abs(relative) >= 0.5)"""


def _findings(s, d):
    m = A.metrics(s, d)
    return D.findings(_alerts(m), _burn(A.slo_events(s, d)), _compared(m), 0.5)


_CTES = f"WITH {A.METRICS_SQL}, {A.SLO_SQL}, {_ALERTS}, {_BURN}, {_DELTAS}, {_FINDINGS}"
TABLE["dia13_findings"] = (_findings, f"{_CTES} SELECT * FROM found")
TABLE["srt7_top_findings"] = (lambda s, d: D.top_findings(_findings(s, d), 5), f"{_CTES} SELECT * FROM found ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, source, subject LIMIT 5")
TABLE["dia13_findings_by_severity"] = (lambda s, d: D.findings_by_severity(_findings(s, d)), f"{_CTES} SELECT source, severity, count(*) AS findings FROM found GROUP BY ALL")


def _incidents(s, d):
    """One incident per zone, out of the zone's own metrics and all service
    levels; zone 0 is resolved. Its impacts are its devices' error packets."""
    m = A.metrics(s, d)
    zones, alerts, deltas = [], [], []
    for zone in ("0", "1"):
        own = m.where(F.col("tags")["zone"] == zone)
        with_id = lambda rows, z=zone: rows.withColumn("incident", F.lit(f"zone-{z}"))
        alerts.append(with_id(_alerts(own)))
        deltas.append(with_id(_compared(own)))
        zones.append((f"zone-{zone}", f"zone {zone}", "high", "resolved" if zone == "0" else "mitigating", _AT - DAY, _AT, _AT - HOUR if zone == "0" else None))
    ids = s.createDataFrame(zones, "incident string, title string, severity string, status string, opened_ns long, updated_ns long, resolved_ns long")
    slos = _burn(A.slo_events(s, d)).crossJoin(ids.select("incident"))  # two rows
    p = A.packets(s, d).where("kind = 'control'")
    impacts = p.groupBy(F.concat(F.lit("zone-"), (F.col("device") % 2).cast("string")).alias("incident"), F.col("archive_path").alias("component")).agg(F.lit("r").alias("region"), F.lit("errors").alias("description"), F.countDistinct("device").alias("affected_devices"), F.count_if(F.col("payload_size") == 0).alias("dropped_packets"), F.count_if(F.col("timestamp_ns") < F.col("capture_time_ns")).alias("delayed_packets"))
    alerts, deltas = alerts[0].unionByName(alerts[1]), deltas[0].unionByName(deltas[1])
    return scratch.kept(N.report(ids, N.findings(alerts, slos, deltas, 0.5, _AT), alerts, slos, impacts), "incidents")


def _zoned(sql: str, zone: str) -> str:
    """The rules' and changes' SQL over one zone's metrics."""
    return f"SELECT 'zone-{zone}' AS incident, x.* FROM ({sql.replace('FROM metrics', f'FROM metrics_{zone}')}) x"


_RULE_ROWS = _ALERTS.split("), texts(", 1)[0].removeprefix("ruled AS (")
_INCIDENTSQL = f"""WITH {A.METRICS_SQL}, {A.SLO_SQL}, {A.PACKETS_SQL}, {_BURN}, metrics_0 AS (SELECT * FROM metrics WHERE zone = '0'), metrics_1 AS (SELECT * FROM metrics WHERE zone = '1'),
    ruled AS ({_zoned(_RULE_ROWS, '0')} UNION ALL {_zoned(_RULE_ROWS, '1')}), {_ALERTS[_ALERTS.index('texts('):].replace('SELECT id,', 'SELECT incident, id,')},
    deltas AS ({_zoned(_CMP, '0')} UNION ALL {_zoned(_CMP, '1')}),
    incidents AS (SELECT * FROM (VALUES ('zone-0', 'resolved', {_AT - HOUR}), ('zone-1', 'mitigating', NULL)) v(incident, status, resolved_ns)),
    found AS (SELECT incident, 'alert' AS kind, CASE severity WHEN 'critical' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS severity, {_AT} AS time_ns, concat('alert:', id) AS source, id AS summary, reason AS detail FROM alerts WHERE state = 'active'
        UNION ALL SELECT incident, 'slo_burn', CASE b.status WHEN 'exhausted' THEN 'critical' ELSE 'medium' END, {_AT}, concat('slo:', label), concat(label, ' is ', b.status), NULL FROM burn b, incidents WHERE b.status IN ('warning', 'exhausted')
        UNION ALL SELECT incident, 'metric_anomaly', CASE WHEN abs(relative) >= 1.0 THEN 'high' ELSE 'medium' END, 0, concat('metric:', series), concat(series, ' changed ', trend), NULL FROM deltas WHERE abs(relative) >= 0.5),
    leveled AS (SELECT incident, {_AT - DAY} AS time_ns, 'info' AS level, 'incident' AS source, concat('opened ', incident) AS message FROM incidents
        UNION ALL SELECT incident, resolved_ns, 'info', 'incident', concat('resolved ', incident) FROM incidents WHERE resolved_ns IS NOT NULL
        UNION ALL SELECT incident, time_ns, CASE severity WHEN 'low' THEN 'info' WHEN 'medium' THEN 'warning' ELSE 'error' END, source, summary FROM found
        UNION ALL SELECT incident, {_AT}, CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'info' END, concat('alert:', id), reason FROM alerts WHERE state = 'active'),
    events_of AS (SELECT incident, CAST(row_number() OVER (PARTITION BY incident ORDER BY time_ns, CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, source, message) - 1 AS INTEGER) AS place, time_ns, level, source, message FROM leveled)"""
TABLE["dia15_incident_timeline"] = (lambda s, d: N.timeline(_incidents(s, d)), f"{_INCIDENTSQL} SELECT * FROM events_of")
TABLE["flt13_at_or_above"] = (lambda s, d: N.at_or_above(N.between(N.timeline(_incidents(s, d)), 0, _AT - 1), "warning"), f"{_INCIDENTSQL} SELECT * FROM events_of WHERE level IN ('warning', 'error') AND time_ns BETWEEN 0 AND {_AT - 1}")
TABLE["dia16_incident_findings"] = (lambda s, d: _incidents(s, d).select("incident", F.inline("findings")).drop("detail"), f"{_INCIDENTSQL} SELECT * EXCLUDE (detail) FROM found")
TABLE["dia16_incident_actions"] = (
    lambda s, d: _incidents(s, d).select("incident", F.inline("recommended")),
    f"""{_INCIDENTSQL}, called AS (SELECT incident, unnest([1, 2, 3]) AS step, unnest([EXISTS (SELECT 1 FROM burn WHERE burn.status = 'exhausted'), EXISTS (SELECT 1 FROM alerts a WHERE a.incident = i.incident AND state = 'active'), i.status <> 'resolved']) AS due FROM incidents i)
    SELECT incident, step, owner, action, reason FROM called JOIN (VALUES {', '.join(str((i + 1, *a)) for i, a in enumerate(D.ACTIONS))}) acts(step, owner, action, reason) USING (step) WHERE due""",
)
TABLE["agg29_incident_summary"] = (
    lambda s, d: N.summary(_incidents(s, d)),
    f"""{_INCIDENTSQL} SELECT incident, 'high' AS severity, status, {_AT - DAY} AS opened_ns, {_AT} AS updated_ns, coalesce(resolved_ns, {_AT}) - {_AT - DAY} AS duration_ns,
    (SELECT count(DISTINCT archive_path) FROM packets WHERE kind = 'control' AND concat('zone-', device % 2) = i.incident) AS impacts, (SELECT count(*) FROM found f WHERE f.incident = i.incident) AS findings, 0 AS actions, 0 AS open_actions,
    (SELECT count(*) FROM alerts a WHERE a.incident = i.incident AND state = 'active') AS firing_alerts, (SELECT count(*) FROM burn WHERE burn.status = 'exhausted') AS exhausted_slos FROM incidents i""",
)
TABLE["agg29_incident_statuses"] = (lambda s, d: N.status_counts(_incidents(s, d)), f"{_INCIDENTSQL} SELECT v.status, count(i.incident) AS incidents FROM (VALUES ('investigating'), ('identified'), ('mitigating'), ('resolved')) v(status) LEFT JOIN incidents i ON i.status = v.status GROUP BY v.status")
_LEVEL = "CASE WHEN kind = 'control' THEN 'warning' WHEN payload_size = 0 THEN 'debug' ELSE 'info' END"
packets("dia15_timeline", D.timeline, f"""SELECT capture_time_ns AS time_ns, {_LEVEL} AS level, concat(kind, ' from ', device) AS text, "offset" FROM packets""")
packets("flt13_timeline_level", lambda p: D.timeline(p).where(f"level IN ('warning', 'debug') AND time_ns BETWEEN {T0} AND {T0 + 3 * DAY}"), f"""SELECT capture_time_ns AS time_ns, {_LEVEL} AS level, concat(kind, ' from ', device) AS text, "offset" FROM packets WHERE {_LEVEL} <> 'info' AND capture_time_ns BETWEEN {T0} AND {T0 + 3 * DAY}""")

# control
_LOAD = lambda p: p.groupBy("device").agg(F.count("*").alias("packets"), F.lit(100).alias("packet_capacity"), F.sum("payload_size").cast("long").alias("bytes"), F.lit(120_000).alias("byte_capacity"), F.max(F.when(F.col("device") % 29 == 0, 1).otherwise(0)).alias("stalled"), F.count_if(F.col("payload_size") == 0).alias("inflight"))
packets(
    "ctl1_pressure",
    lambda p: C.pressure(_LOAD(p)).select("device", "ratio", "level"),
    """SELECT device, round(r, 6) AS ratio, ['nominal', 'watch', 'throttle', 'shed', 'stop'][1 + greatest(CASE WHEN r >= 0.97 THEN 4 WHEN r >= 0.85 THEN 3 WHEN r >= 0.7 THEN 2 WHEN r >= 0.5 THEN 1 ELSE 0 END, CASE WHEN device % 29 = 0 THEN 2 ELSE 0 END, CASE WHEN f > 25 THEN 1 ELSE 0 END)] AS level
    FROM (SELECT device, greatest(count(*) / 100, sum(payload_size) / 120000) AS r, count(*) FILTER (payload_size = 0) AS f FROM packets GROUP BY device)""",
)
_QUEUE = lambda p: p.select("offset", F.col("capture_time_ns").alias("arrival_ns"), F.when(F.col("sequence") % 4 > 0, F.col("capture_time_ns") + F.col("sequence") * 1_000_000_000).otherwise(0).alias("deadline_ns"), (F.col("device") % 4).alias("priority_rank"), (F.col("sequence") % 3).alias("attempts"))
_QSQL = """queue AS (SELECT "offset", capture_time_ns AS arrival_ns, CASE WHEN sequence % 4 > 0 THEN capture_time_ns + sequence * 1000000000 ELSE 0 END AS deadline_ns, device % 4 AS priority_rank, sequence % 3 AS attempts FROM packets)"""
packets("rt2_drain_priority", lambda p: C.drain(_QUEUE(p), "priority", 64), 'SELECT * FROM queue ORDER BY priority_rank DESC, arrival_ns, "offset" LIMIT 64', _QSQL)
packets("rt2_drain_deadline", lambda p: C.drain(_QUEUE(p), "deadline", 64), 'SELECT * FROM queue ORDER BY deadline_ns = 0, deadline_ns, arrival_ns, "offset" LIMIT 64', _QSQL)
packets("rt5_lease_order", lambda p: C.lease_order(_QUEUE(p), T0 + DAY, HOUR, 32), f'SELECT * FROM queue ORDER BY NOT (deadline_ns <> 0 AND deadline_ns <= {T0 + DAY + HOUR}), deadline_ns = 0, deadline_ns, priority_rank DESC, attempts, arrival_ns, "offset" LIMIT 32', _QSQL)
packets("ctl3_retry_schedule", lambda p: C.retry_schedule(p.select(F.col("offset").alias("command"), F.col("capture_time_ns").alias("sent_ns"), (F.col("sequence") % 9).alias("attempts")), 1_000_000, 60_000_000), """SELECT "offset" AS command, capture_time_ns AS sent_ns, sequence % 9 AS attempts, capture_time_ns + CAST(least(1000000 * pow(2.0, greatest(sequence % 9 - 1, 0)), 60000000) AS BIGINT) AS due_ns FROM packets""")
packets("ctl4_token_bucket", lambda p: C.token_bucket(p.withColumn("capture_time_ns", F.expr(f"{T0} + (capture_time_ns - {T0}) div 10000")), C.Bucket(1, 2)), None)
packets("rt3_batching", lambda p: C.batches(p, C.Batching(max_packets=16, max_payload=20_000, max_age_ns=6 * HOUR)), None)
_ACKS = lambda p: p.where("kind <> 'heartbeat'").select((F.col("sequence") % 50).alias("command_id"), (F.col("device") % 3).alias("device"), F.col("capture_time_ns").alias("time_ns"), F.when(F.col("payload_size") % 3 == 0, "busy").when(F.col("payload_size") % 3 == 1, "accepted").otherwise("malformed").alias("status"), F.col("offset").alias("ordinal"))
_CMDS = lambda p: p.select((F.col("sequence") % 40).alias("command_id")).distinct().select("command_id", (F.col("command_id") % 3).alias("device"), (F.lit(T0 + 2 * DAY) + F.col("command_id") * DAY).alias("deadline_ns"))
_ACKSQL = f"""acks AS (SELECT sequence % 50 AS command_id, device % 3 AS device, capture_time_ns AS time_ns, CASE payload_size % 3 WHEN 0 THEN 'busy' WHEN 1 THEN 'accepted' ELSE 'malformed' END AS status, "offset" AS ordinal FROM packets WHERE kind <> 'heartbeat'),
    cmds AS (SELECT command_id, command_id % 3 AS expected, {T0 + 2 * DAY} + command_id * {DAY} AS deadline_ns FROM (SELECT DISTINCT sequence % 40 AS command_id FROM packets)),
    outcomes AS (SELECT command_id, device, ordinal, CASE WHEN expected IS NULL THEN 'unexpected' WHEN coalesce(max(CASE WHEN device = expected AND time_ns <= deadline_ns AND status <> 'busy' THEN 1 ELSE 0 END) OVER (PARTITION BY command_id ORDER BY time_ns, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'duplicate'
        WHEN device <> expected THEN 'unexpected' WHEN time_ns > deadline_ns THEN 'stale' WHEN status IN ('accepted', 'busy') THEN 'matched' ELSE 'rejected' END AS outcome FROM acks LEFT JOIN cmds USING (command_id))"""
packets("ctl6_ack_outcomes", lambda p: C.acknowledgements(_ACKS(p), _CMDS(p)), "SELECT * FROM outcomes", _ACKSQL)
packets("agg25_ack_devices", lambda p: C.ack_devices(C.acknowledgements(_ACKS(p), _CMDS(p))), "SELECT device, count(*) AS acks, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'unexpected') AS unexpected, count(*) FILTER (outcome = 'stale') AS stale FROM outcomes GROUP BY device", _ACKSQL)
_ACKED_BY = T0 + 25 * DAY
_command = lambda p: (F.col("sequence") % 40 + F.col("device") % 5 * 40).alias("command_id")
_WANTED = lambda p: p.where("kind = 'spectrum'").groupBy(_command(p), F.col("capture_time_ns").alias("created_ns")).agg(F.min(F.col("device") % 3).alias("device"), F.min(F.when(F.col("sequence") % 7 == 0, 0).otherwise(F.col("capture_time_ns") + DAY)).alias("deadline_ns"), F.min((F.col("sequence") % 3).cast("int")).alias("required_accepts"))
_GIVEN = lambda p: p.where("kind IN ('heartbeat', 'observation')").select(_command(p), (F.col("device") % 3).alias("device"), F.col("capture_time_ns").alias("time_ns"), F.when(F.col("payload_size") % 5 == 0, "busy").when(F.col("payload_size") % 5 < 4, "accepted").otherwise("malformed").alias("status"), F.col("offset").alias("ordinal"))
_STOPPED = lambda p: p.where("kind = 'capabilities'").select(_command(p), F.col("capture_time_ns").alias("time_ns"))


def _observed(p):
    return E.observations(_WANTED(p), _GIVEN(p), _STOPPED(p), _ACKED_BY)


def _snapshots(p):
    return E.snapshots(_WANTED(p), _observed(p), _ACKED_BY)


_FITS = "ack AND e.created IS NOT NULL AND device = e.device AND (e.deadline = 0 OR time <= e.deadline)"
_WAITSQL = f"""named AS (SELECT *, sequence % 40 + device % 5 * 40 AS command_id FROM packets),
    wanted AS (SELECT command_id, capture_time_ns AS created_ns, min(device % 3) AS device, min(CASE WHEN sequence % 7 = 0 THEN 0 ELSE capture_time_ns + {DAY} END) AS deadline_ns, min(sequence % 3) AS required FROM named WHERE kind = 'spectrum' GROUP BY ALL),
    given AS (SELECT command_id, device % 3 AS device, capture_time_ns AS time, CASE WHEN payload_size % 5 = 0 THEN 'busy' WHEN payload_size % 5 < 4 THEN 'accepted' ELSE 'malformed' END AS status, "offset" AS ordinal, kind <> 'capabilities' AS ack
        FROM named WHERE kind IN ('heartbeat', 'observation', 'capabilities') AND capture_time_ns <= {_ACKED_BY} AND command_id IS NOT NULL),
    met AS (SELECT g.*, (SELECT {{'created': w.created_ns, 'device': w.device, 'deadline': w.deadline_ns, 'required': greatest(w.required, 1)}} FROM wanted w
        WHERE w.command_id = g.command_id AND w.command_id <> 0 AND w.created_ns <= g.time ORDER BY w.created_ns DESC LIMIT 1) AS e FROM given g),
    flagged AS (SELECT *, coalesce({_FITS} AND status <> 'malformed', false) AS accepts, coalesce(({_FITS} AND status = 'malformed') OR NOT ack, false) AS ends FROM met),
    judged AS (SELECT *, coalesce(count(*) FILTER (accepts) OVER w, 0) >= e.required OR coalesce(count(*) FILTER (ends) OVER w, 0) > 0 AS terminal
        FROM flagged WINDOW w AS (PARTITION BY command_id, e.created ORDER BY time, NOT ack, CASE WHEN ack THEN ordinal ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    observed AS (SELECT command_id, e.created AS created_ns, CASE WHEN ack THEN device END AS device, time AS at_ns, CASE WHEN ack THEN ordinal ELSE 0 END AS ordinal, CASE WHEN ack THEN 1 ELSE 2 END AS "rank",
        CASE WHEN NOT ack THEN 'cancelled' WHEN e IS NULL OR e.created IS NULL THEN 'unexpected' WHEN terminal THEN 'duplicate' WHEN device <> e.device THEN 'unexpected' WHEN e.deadline <> 0 AND time > e.deadline THEN 'stale' WHEN status = 'malformed' THEN 'rejected' ELSE 'matched' END AS kind
        FROM judged WHERE ack OR (e.created IS NOT NULL AND NOT terminal)),
    snap AS (SELECT w.command_id, w.device, w.created_ns, w.deadline_ns, CASE WHEN count(*) FILTER (o.kind = 'cancelled') > 0 THEN 'cancelled' WHEN count(*) FILTER (o.kind = 'matched') >= greatest(any_value(w.required), 1) OR count(*) FILTER (o.kind = 'rejected') > 0 THEN 'satisfied'
        WHEN w.deadline_ns <> 0 AND w.deadline_ns <= {_ACKED_BY} THEN 'timed_out' ELSE 'waiting' END AS state, count(*) FILTER (o.kind = 'matched') AS accepts, count(*) FILTER (o.kind = 'rejected') AS rejects,
        coalesce(max(o.at_ns) FILTER (o."rank" = 1), 0) AS last_ack, count(o.at_ns) AS n
        FROM wanted w LEFT JOIN observed o ON o.command_id = w.command_id AND o.created_ns = w.created_ns WHERE w.created_ns <= {_ACKED_BY} AND w.command_id <> 0 GROUP BY w.command_id, w.device, w.created_ns, w.deadline_ns),
    shots AS (SELECT command_id, device, created_ns, deadline_ns, state, accepts, rejects, CASE state WHEN 'timed_out' THEN {_ACKED_BY} ELSE last_ack END AS last_ns, n + CASE state WHEN 'timed_out' THEN 1 ELSE 0 END AS observations FROM snap)"""
packets("jn11_ack_observations", _observed, "SELECT * FROM observed", _WAITSQL)
packets("ctl6_expectations", _snapshots, "SELECT * FROM shots", _WAITSQL)
packets("ctl6_ack_devices", lambda p: E.device_summary(_snapshots(p)), "SELECT device, count(*) FILTER (state = 'waiting') AS waiting, count(*) FILTER (state = 'satisfied') AS satisfied, count(*) FILTER (state = 'timed_out') AS timed_out, count(*) FILTER (state = 'cancelled') AS cancelled, CAST(sum(observations) AS BIGINT) AS observations FROM shots GROUP BY device", _WAITSQL)
packets(
    "ctl6_ack_totals",
    lambda p: E.totals(_snapshots(p), _observed(p)),
    """SELECT (SELECT count(*) FROM shots) AS registered, (SELECT count(*) FROM shots WHERE state = 'timed_out') AS timed_out, (SELECT count(*) FROM shots WHERE state = 'cancelled') AS cancelled, count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'unexpected') AS unexpected, count(*) FILTER (kind = 'stale') AS stale, count(*) FILTER (kind = 'rejected') AS rejected FROM observed""",
    _WAITSQL,
)
packets("ctl2_admission", lambda p: C.admission(p.withColumn("level", F.when(F.col("payload_size") > 3000, "stop").when(F.col("payload_size") > 1500, "shed").when(F.col("payload_size") > 800, "throttle").otherwise("nominal")), C.Admission()), None)

_INCIDENTS = lambda p: p.groupBy(F.col("device").alias("incident")).agg(F.when(F.count("*") % 3 == 0, "resolved").otherwise("open").alias("status"), F.count_if(F.col("kind") == "control").alias("exhausted_slos"), F.count_if(F.col("payload_size") > 900).alias("firing_alerts"), F.count_if(F.col("kind") == "capabilities").alias("open_actions"), F.count_if(F.col("payload_size") == 0).alias("impacts"))
packets(
    "dia14_recommended_actions",
    lambda p: D.recommended(_INCIDENTS(p)),
    f"SELECT incident, step, owner, action, reason FROM called JOIN (VALUES {', '.join(str((i + 1, *a)) for i, a in enumerate(D.ACTIONS))}) acts(step, owner, action, reason) USING (step)",
    """called AS (SELECT incident, step FROM (SELECT incident, unnest([1, 2, 3, 4]) AS step, unnest(tests) AS due FROM (SELECT device AS incident, [count(*) FILTER (kind = 'control') > 0, count(*) FILTER (payload_size > 900) > 0, count(*) FILTER (kind = 'capabilities') = 0 AND count(*) % 3 > 0, count(*) FILTER (payload_size = 0) = 0] AS tests FROM packets GROUP BY device)) WHERE due)""",
)
packets(
    "rt7_collector_stats",
    lambda p: D.collector_stats(X.validate(X.with_sections(p), _NOW, 3000), S.sessions(p)),
    """SELECT count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, CAST(sum(w) AS BIGINT) AS warnings, (SELECT count(DISTINCT device) FROM packets) AS devices FROM (SELECT "offset", bool_or(severity = 'error') AS bad, count(*) FILTER (severity = 'warning') AS w FROM found GROUP BY "offset")""",
    f"{_PROBED}, {_FOUND}",
)
packets("srt8_timeline_order", lambda p: D.timeline(p).withColumn("level_rank", F.array_position(F.array(*[F.lit(x) for x in D.TIMELINE_LEVELS]), F.col("level")).cast("int")).orderBy("time_ns", F.desc("level_rank"), "offset").limit(40), f"""SELECT capture_time_ns AS time_ns, {_LEVEL} AS level, concat(kind, ' from ', device) AS text, "offset", CASE {_LEVEL} WHEN 'warning' THEN 3 WHEN 'info' THEN 2 ELSE 1 END AS level_rank FROM packets ORDER BY capture_time_ns, level_rank DESC, "offset" LIMIT 40""")
packets("set1_archive_union", lambda p: p.where("archive_ordinal = 0").unionByName(p.where("archive_ordinal = 2")).groupBy("archive_path").agg(F.count("*").alias("records")), "SELECT archive_path, count(*) AS records FROM packets WHERE archive_ordinal IN (0, 2) GROUP BY archive_path")


_BEFORE = "PARTITION BY device ORDER BY capture_time_ns, sequence, archive_ordinal, \"offset\""
_REPORT = f"""ordered AS (SELECT *, lag(capture_time_ns) OVER ({_BEFORE}) AS t0, lag(archive_path) OVER ({_BEFORE}) AS p0, lag(sequence) OVER ({_BEFORE}) AS s0 FROM packets),
    parts(part, device, kind, archive_path, other_path, start_ns, end_ns, records, payload_bytes, archives, average, share, least, p50, p90, p99, most, previous_sequence, sequence, detail) AS (
    SELECT 'summary', NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, min(capture_time_ns), max(capture_time_ns), count(*), CAST(sum(payload_size) AS BIGINT), count(DISTINCT archive_path), round(sum(payload_size) / count(*), 6),
        NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM packets
    UNION ALL SELECT 'archive', NULL, NULL, archive_path, NULL, min(capture_time_ns), max(capture_time_ns), count(*), CAST(sum(payload_size) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM packets GROUP BY archive_path
    UNION ALL SELECT 'bucket', NULL, NULL, NULL, NULL, b * {DAY}, b * {DAY} + {DAY} - 1, count(*), CAST(sum(payload_size) AS BIGINT), count(DISTINCT archive_path), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT *, capture_time_ns // {DAY} AS b FROM packets) GROUP BY b
    UNION ALL SELECT 'device', device, NULL, NULL, NULL, min(capture_time_ns), max(capture_time_ns), count(*), CAST(sum(payload_size) AS BIGINT), NULL, round(sum(payload_size) / count(*), 6),
        round(sum(payload_size) / (SELECT sum(payload_size) FROM packets), 6), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM packets GROUP BY device
    UNION ALL SELECT 'cell', device, kind, NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM packets GROUP BY device, kind
    UNION ALL SELECT 'percentiles', NULL, NULL, NULL, NULL, NULL, NULL, len(s), NULL, NULL, round(list_sum(s) / len(s), 6), NULL, s[1], s[CAST(floor(0.5 * (len(s) - 1) + 0.5) AS BIGINT) + 1], s[CAST(floor(0.9 * (len(s) - 1) + 0.5) AS BIGINT) + 1],
        s[CAST(floor(0.99 * (len(s) - 1) + 0.5) AS BIGINT) + 1], s[len(s)], NULL, NULL, NULL FROM (SELECT list(payload_size ORDER BY payload_size) AS s FROM packets)
    UNION ALL SELECT 'gap', device, NULL, archive_path, p0, t0, capture_time_ns, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ordered WHERE capture_time_ns - t0 > {12 * HOUR}
    UNION ALL SELECT 'anomaly', device, NULL, archive_path, NULL, capture_time_ns, NULL, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, s0, sequence,
        CASE WHEN sequence = s0 THEN 'duplicate sequence' WHEN sequence < s0 THEN 'sequence moved backwards' ELSE 'sequence gap' END FROM ordered WHERE sequence <> s0 + 1)"""
packets("agg16_statistics_report", lambda p: report.statistics(p, DAY, 12 * HOUR), "SELECT * FROM parts", _REPORT)
packets(
    "pln14_archive_report",
    lambda p: report.statistics(p, DAY, 12 * HOUR, overlaps=True).where("part IN ('archive', 'overlap')"),
    """SELECT * FROM parts WHERE part = 'archive'
    UNION ALL SELECT 'overlap', NULL, NULL, l, r, s, e, a + b, NULL, NULL, NULL, NULL, least(a, b), NULL, NULL, NULL, greatest(a, b), NULL, NULL, NULL FROM (
        SELECT l, r, s, e, (SELECT count(*) FROM packets WHERE archive_path = l AND capture_time_ns BETWEEN s AND e) AS a, (SELECT count(*) FROM packets WHERE archive_path = r AND capture_time_ns BETWEEN s AND e) AS b FROM (
            SELECT x.archive_path AS l, y.archive_path AS r, greatest(x.start_ns, y.start_ns) AS s, least(x.end_ns, y.end_ns) AS e FROM parts x JOIN parts y
            ON x.part = 'archive' AND y.part = 'archive' AND x.archive_path < y.archive_path AND x.start_ns <= y.end_ns AND y.start_ns <= x.end_ns))""",
    _REPORT,
)
