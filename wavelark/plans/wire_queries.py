"""Round trips through the wire formats and the archive sources: what is read
back must be the packets that were written, which is what the SQL says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import udf
from ..sources import adapters as A
from ..sources import archives, ath, replay, scratch, upkeep
from .archive_queries import DAY, T0, Run

TABLE: dict[str, tuple[Run, str | None]] = {}

#: Packets of one file, by number: the run that one task packs.
FILE_PACKETS = 512

_FIELDS = ("kind", "device", "timestamp_ns", "sequence")


def _text() -> Column:
    return F.concat("kind", F.lit(":"), F.col("sequence").cast("string"))


def _frame(*more: Column) -> Column:
    return udf("encode_packet")(F.struct(*_FIELDS, *more, _text().cast("binary").alias("payload"))).alias("frame")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor((F.col("offset") - 36) / 64)
    path = F.concat(F.lit("c"), F.floor(number / FILE_PACKETS).cast("string"), F.lit(".ath"))
    return A.packets(spark, sf_dir).select(path.alias("path"), F.col("offset").alias("place"), "capture_time_ns", _frame())


# A packet without sections is 45 bytes and its payload; a record has 16 more.
_SENT = f"""WITH {A.PACKETS_SQL}, sent AS (
    SELECT *, concat(kind, ':', sequence) AS body, length(concat(kind, ':', sequence)) AS size,
        concat('c', ("offset" - 36) // 64 // {FILE_PACKETS}, '.ath') AS path
    FROM packets), placed AS (
    SELECT *,
        CAST(row_number() OVER (PARTITION BY path ORDER BY "offset") - 1 AS INTEGER) AS place,
        36 + CAST(coalesce(sum(61 + size) OVER (
            PARTITION BY path ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts
    FROM sent)"""
_P = [f"packet.{c}" for c in _FIELDS]


def _body() -> Column:
    return F.decode(F.col("packet.payload"), "utf-8").alias("body")


def _cod1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _framed(spark, sf_dir).select("frame", udf("decode_packet")("frame").alias("packet"))
    return rows.select(*_P, F.col("packet.version").alias("version"), F.octet_length("frame").cast("long").alias("frame_bytes"), _body())


TABLE["cod1_packet_round_trip"] = (
    _cod1,
    f"{_SENT} SELECT kind, device, timestamp_ns, sequence, 3 AS version, 45 + size AS frame_bytes, body FROM sent",
)


def _cod2(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = lambda c, n: (F.col(c) % n).cast("int")
    fragment = F.struct(F.col("device").alias("stream_id"), small("sequence", 4).alias("sequence"), F.lit(4).alias("count"))
    route = F.struct(
        small("device", 8).alias("region"),
        small("device", 100).alias("collector"),
        small("archive_ordinal", 4).alias("priority"),
        F.array(small("device", 9), small("sequence", 10)).alias("relay_path"),
    )
    capabilities = F.struct(
        (F.col("device") % 2 == 0).alias("compression"),
        (F.col("device") % 3 == 0).alias("encryption"),
        F.lit(True).alias("gps_time"),
        small("device", 1000).alias("max_payload"),
        F.array(F.concat(F.lit("band"), small("device", 5).cast("string"))).alias("sensor_bands"),
    )
    extension = F.array(F.struct(small("device", 7).alias("type"), F.col("kind").cast("binary").alias("value")))
    sent = A.packets(spark, sf_dir).select(_frame(fragment.alias("fragment"), route.alias("route"), capabilities.alias("capabilities"), extension.alias("extensions")))
    p = sent.select(udf("decode_packet")("frame").alias("packet")).select("packet.*")
    return p.select(
        *_FIELDS,
        F.col("fragment.stream_id").alias("stream_id"),
        F.col("fragment.sequence").alias("part"),
        F.col("fragment.count").alias("parts"),
        F.col("route.region").alias("region"),
        F.col("route.collector").alias("collector"),
        F.col("route.priority").alias("priority"),
        F.array_join(F.col("route.relay_path").cast("array<string>"), ",").alias("relays"),
        F.col("capabilities.compression").alias("compression"),
        F.col("capabilities.encryption").alias("encryption"),
        F.col("capabilities.gps_time").alias("gps_time"),
        F.col("capabilities.max_payload").alias("max_payload"),
        F.array_join("capabilities.sensor_bands", ",").alias("bands"),
        F.col("extensions")[0]["type"].alias("extension_type"),
        F.decode(F.col("extensions")[0]["value"], "utf-8").alias("extension_value"),
    )


TABLE["cod2_sections"] = (
    _cod2,
    f"""{_SENT}
    SELECT kind, device, timestamp_ns, sequence,
        device AS stream_id,
        CAST(sequence % 4 AS INTEGER) AS part,
        4 AS parts,
        CAST(device % 8 AS INTEGER) AS region,
        CAST(device % 100 AS INTEGER) AS collector,
        CAST(archive_ordinal AS INTEGER) AS priority,
        concat(device % 9, ',', sequence % 10) AS relays,
        device % 2 = 0 AS compression,
        device % 3 = 0 AS encryption,
        true AS gps_time,
        CAST(device % 1000 AS INTEGER) AS max_payload,
        concat('band', device % 5) AS bands,
        CAST(device % 7 AS INTEGER) AS extension_type,
        kind AS extension_value
    FROM sent""",
)


def _cod3(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    number = F.unhex(F.concat(byte(F.col("device") % 256), byte(F.floor(F.col("device") / 256) % 256)))
    sent = A.packets(spark, sf_dir).select(*_FIELDS, udf("tlv_pack")(F.array(F.lit(1), F.lit(2)), F.array(number, _text().cast("binary"))).alias("data"))
    got = sent.withColumn("fields", udf("tlv_fields")("data"))
    value = lambda t: F.filter("fields", lambda f: f["type"] == t)[0]["value"]
    return got.select(
        "device",
        "sequence",
        F.octet_length("data").cast("long").alias("data_bytes"),
        F.size("fields").cast("long").alias("fields"),
        udf("tlv_unsigned")(value(1)).alias("number"),
        F.decode(value(2), "utf-8").alias("body"),
    )


TABLE["cod3_tlv"] = (
    _cod3,
    f"{_SENT} SELECT device, sequence, 10 + size AS data_bytes, 2 AS fields, device % 65536 AS number, body FROM sent",
)

# The checksums in SQL: a register that takes one bit of the text at a time. That
# of crc32c starts at zero, that of crc16 at all ones.
TABLE["cod4_checksums"] = (
    lambda s, d: A.packets(s, d).select(_text().alias("body")).distinct().select("body", udf("crc32c")(F.col("body").cast("binary")).alias("crc32c"), udf("crc16")(F.col("body").cast("binary")).alias("crc16")),
    f"""{_SENT}, bits AS (
    SELECT body,
        flatten(list_transform(string_split(body, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> CAST(i AS INTEGER)) & 1))) AS low_first,
        flatten(list_transform(string_split(body, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> CAST(7 - i AS INTEGER)) & 1))) AS high_first
    FROM (SELECT DISTINCT body FROM sent))
    SELECT body,
        xor(4294967295, list_reduce(list_prepend(CAST(0 AS BIGINT), low_first),
            lambda r, b: xor(r >> 1, CASE WHEN (r & 1) <> b THEN 2197175160 ELSE 0 END))) AS crc32c,
        list_reduce(list_prepend(CAST(65535 AS BIGINT), high_first),
            lambda r, b: xor((r << 1) & 65535, CASE WHEN ((r >> 15) & 1) <> b THEN 4129 ELSE 0 END)) AS crc16
    FROM bits""",
)


def _cod6(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.concat(F.repeat(F.lit("x"), F.col("payload_size").cast("int")), F.repeat(F.lit("y"), (F.col("sequence") % 300).cast("int")))
    rows = A.packets(spark, sf_dir).select("device", "sequence", "payload_size", runs.cast("binary").alias("data"))
    rows = rows.withColumn("packed", udf("rle_pack")("data"))
    return rows.select("device", "sequence", "payload_size", F.octet_length("packed").cast("long").alias("packed_bytes"), (udf("rle_unpack")("packed") == F.col("data")).alias("same"))


TABLE["cod6_run_lengths"] = (
    _cod6,
    f"""{_SENT}
    SELECT device, sequence, payload_size,
        2 * ((payload_size + 254) // 255 + (sequence % 300 + 254) // 255) AS packed_bytes,
        true AS same
    FROM sent""",
)


def _cod7(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.lit(b"first key"), (F.col("sequence") % 16).cast("int")
    rows = A.packets(spark, sf_dir).select("device", "sequence", number.alias("key_id"), _text().cast("binary").alias("plain"))
    rows = rows.withColumn("sealed", udf("seal")("plain", key, "key_id"))
    return rows.select(
        "device",
        "sequence",
        F.octet_length("sealed").cast("long").alias("sealed_bytes"),
        F.decode(udf("unseal")("sealed", key, "key_id"), "utf-8").alias("opened"),
        udf("unseal")("sealed", key, F.col("key_id") + 1).isNull().alias("refused"),
    )


TABLE["cod7_envelope"] = (
    _cod7,
    f"{_SENT} SELECT device, sequence, size + 4 AS sealed_bytes, body AS opened, true AS refused FROM sent",
)


def _scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    reading = F.struct(F.col("channel").cast("int").alias("channel"), "value", "scale", "quality")
    sent = F.struct(F.lit("scalar").alias("format"), F.col("time_ns").alias("sample_time_ns"), F.lit(10).alias("sample_rate_hz"), F.array(reading).alias("readings"))
    rows = A.readings(spark, sf_dir).select("reading_id", udf("decode_payload")(udf("encode_payload")(sent)).alias("p"))
    first = F.col("p.readings")[0]
    return rows.select("reading_id", "p.format", F.col("p.sample_time_ns").alias("time_ns"), *[first[c].alias(c) for c in ("channel", "value", "scale", "quality")])


TABLE["cod9_scalar_payload"] = (
    _scalar,
    f"""WITH {A.READINGS_SQL}
    SELECT reading_id, 'scalar' AS format, time_ns, CAST(channel AS INTEGER) AS channel, value, scale, quality FROM readings""",
)


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform("power_x10", lambda x: F.struct(x.alias("power_x10"), F.lit(-1040).alias("noise_x10")))
    sent = F.struct(F.lit("spectrum").alias("format"), "center_hz", F.lit(640_000).alias("span_hz"), F.col("bin_width_hz").cast("int").alias("bin_width_hz"), cells.alias("bins"))
    rows = A.frames(spark, sf_dir).select("frame_id", udf("decode_payload")(udf("encode_payload")(sent)).alias("p"))
    rows = rows.select("frame_id", F.col("p.center_hz").alias("center_hz"), F.posexplode("p.bins").alias("bin", "b"))
    return rows.select("frame_id", "center_hz", F.col("bin").cast("long").alias("bin"), F.col("b.power_x10").alias("power_x10"), F.col("b.noise_x10").alias("noise_x10"))


TABLE["cod9_spectrum_payload"] = (
    _spectrum,
    """SELECT vec_id AS frame_id, 433920000 + label * 200000 AS center_hz, n - 1 AS bin,
        CAST(round(-900.0 + CAST(embedding[n] AS DOUBLE) * 1000) AS INTEGER) AS power_x10, -1040 AS noise_x10
    FROM (SELECT *, unnest(range(1, 65)) AS n FROM embeddings)""",
)

def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives with the packets of FILE_PACKETS each."""
    folder = scratch.folder(spark, "archives")
    ath.write(_framed(spark, sf_dir).withColumnRenamed("path", "archive_path"), folder, blockBytes="8192")
    return folder


def _archive_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ath.load(spark, _stored(spark, sf_dir), "FAILFAST")
    return rows.select("archive_path", F.col("offset").alias("at"), "capture_time_ns", *_FIELDS, "payload_size")


_PLACED_COLUMNS = "path AS archive_path, starts AS at, capture_time_ns, kind, device, timestamp_ns, sequence, size AS payload_size"
TABLE["src1_archive_read"] = (_archive_read, f"{_SENT} SELECT {_PLACED_COLUMNS} FROM placed")
TABLE["src1_archive_range"] = (
    lambda s, d: _archive_read(s, d).where(F.col("capture_time_ns").between(T0 + 3 * DAY, T0 + 5 * DAY) & (F.col("device") < 500)),
    f"{_SENT} SELECT {_PLACED_COLUMNS} FROM placed WHERE capture_time_ns BETWEEN {T0 + 3 * DAY} AND {T0 + 5 * DAY} AND device < 500",
)
TABLE["src1_archive_headers"] = (
    lambda s, d: ath.headers(s, _stored(s, d)).select("archive_path", "format_version", "records", "first_time_ns", "last_time_ns"),
    f"""{_SENT}
    SELECT path AS archive_path, 1 AS format_version, count(*) AS records,
        min(capture_time_ns) AS first_time_ns, max(capture_time_ns) AS last_time_ns
    FROM sent GROUP BY path""",
)

#: Packets of a file in the queries on damaged ones.
SMALL_FILE = 64


def _unsound(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives of SMALL_FILE packets: by its number a file has no
    magic (1 of 6), a record count of 0 (2), a first time of 0 (3), records at
    their packets' own, unordered times (4), a changed byte in its last record
    (5), or nothing wrong."""
    number = F.floor((F.col("offset") - 36) / 64 / SMALL_FILE)
    kind = number % 6
    time = F.when(kind == 4, F.col("timestamp_ns")).otherwise(F.col("capture_time_ns"))
    path = F.concat(F.lit("c"), F.lpad(number.cast("string"), 9, "0"), F.lit(".ath"))
    files = archives.packed(A.packets(spark, sf_dir).select(path.alias("path"), F.col("offset").alias("place"), time.alias("capture_time_ns"), _frame()))
    kind = F.substring("path", 2, 9).cast("long") % 6
    zeros = F.lit(b"\0" * 8)
    content = F.when(kind == 1, F.overlay("content", zeros, 1)).when(kind == 2, F.overlay("content", zeros, 13)).when(kind == 3, F.overlay("content", zeros, 21))
    content = content.when(kind == 5, F.overlay("content", F.lit(b"\xff"), F.octet_length("content") - 8)).otherwise(F.col("content"))
    folder = scratch.folder(spark, "unsound")
    upkeep.store(files.select("path", content.alias("content")), folder)
    return folder


_UNSOUND = f"""WITH {A.PACKETS_SQL}, numbered AS (
    SELECT * EXCLUDE (archive_path), length(concat(kind, ':', sequence)) AS size, ("offset" - 36) // 64 // {SMALL_FILE} AS number,
        concat('c', lpad(CAST(("offset" - 36) // 64 // {SMALL_FILE} AS VARCHAR), 9, '0'), '.ath') AS archive_path
    FROM packets), placed AS (
    SELECT archive_path, number % 6 AS damage, device, sequence, size, kind, CASE number % 6 WHEN 4 THEN timestamp_ns ELSE capture_time_ns END AS time,
        36 + CAST(coalesce(sum(61 + size) OVER (PARTITION BY archive_path ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts,
        row_number() OVER (PARTITION BY archive_path ORDER BY "offset" DESC) = 1 AS final
    FROM numbered), readable AS (
    SELECT *, lag(time) OVER (PARTITION BY archive_path ORDER BY starts) AS before,
        max(sequence) OVER (PARTITION BY archive_path, device ORDER BY starts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
    FROM placed WHERE damage <> 1 AND NOT (damage = 5 AND final)), archive AS (
    SELECT archive_path, damage, count(*) AS records FROM placed GROUP BY ALL), findings AS (
    SELECT archive_path, 'error' AS severity, 'readable' AS "check", CASE damage WHEN 1 THEN 'archive magic mismatch' ELSE 'archive record crc mismatch' END AS message, NULL::BIGINT AS "offset", NULL::BIGINT AS capture_time_ns, NULL::BIGINT AS device, NULL::BIGINT AS sequence FROM archive WHERE damage IN (1, 5)
    UNION ALL SELECT archive_path, unnest(['error', 'warning']), unnest(['header_matches_records', 'manifest_consistency']), 'archive header record count differs from readable records', NULL, NULL, NULL, NULL FROM archive WHERE damage = 2
    UNION ALL SELECT archive_path, 'warning', unnest(['header_matches_records', 'manifest_consistency']), unnest(['archive header first timestamp differs from observed first timestamp', 'archive header first timestamp differs from readable records']), NULL, NULL, NULL, NULL FROM archive WHERE damage = 3
    UNION ALL SELECT archive_path, 'warning', 'manifest_consistency', 'archive records are not ordered by capture time', NULL, NULL, NULL, NULL FROM readable WHERE time < before AND damage <> 5
    UNION ALL SELECT archive_path, 'error', 'ordered_timestamps', 'record capture timestamp moved backwards', starts, time, device, sequence FROM readable WHERE time < before
    UNION ALL SELECT archive_path, 'warning', 'monotonic_device_sequences', 'device sequence moved backwards', starts, time, device, sequence FROM readable WHERE sequence < high
    UNION ALL SELECT archive_path, 'warning', 'payload_bounds', 'record payload is below configured minimum', starts, time, device, sequence FROM readable WHERE size < 8
    UNION ALL SELECT archive_path, 'error', 'payload_bounds', 'record payload exceeds configured maximum', starts, time, device, sequence FROM readable WHERE size > 15
    UNION ALL SELECT archive_path, 'info', 'sparse_devices', 'device has sparse archive coverage', NULL, max(time), device, NULL FROM readable WHERE damage <> 5 GROUP BY archive_path, device HAVING count(*) < 2)"""
_RULES = upkeep.Rules(sequence_order=True, least_payload=8, most_payload=15, sparse_records=2)
TABLE["pln9_file_audit"] = (lambda s, d: upkeep.audit(s, _unsound(s, d), _RULES), f"{_UNSOUND} SELECT * FROM findings")
TABLE["pln10_file_fleet"] = (
    lambda s, d: upkeep.fleet(s, _unsound(s, d), _RULES),
    f"""{_UNSOUND}, devices AS (SELECT archive_path, count(*) FILTER (nth > 1) AS shared FROM (
        SELECT archive_path, row_number() OVER (PARTITION BY device ORDER BY archive_path) AS nth FROM readable WHERE damage <> 5 GROUP BY archive_path, device) GROUP BY archive_path)
    SELECT a.archive_path, count(r.starts) AS records, min(starts) AS first_offset, max(starts) AS last_offset, min(size) AS least_payload, max(size) AS most_payload,
        CAST(coalesce(sum(size + 16), 0) AS BIGINT) AS bytes_estimated, coalesce(any_value(shared), 0) AS shared_devices,
        (SELECT count(*) FROM findings f WHERE f.archive_path = a.archive_path AND severity = 'error') AS errors,
        (SELECT count(*) FROM findings f WHERE f.archive_path = a.archive_path AND severity = 'warning') AS warnings,
        (SELECT count(*) FROM findings f WHERE f.archive_path = a.archive_path AND severity = 'info') AS infos,
        a.damage NOT IN (1, 5) AS readable, NOT EXISTS (SELECT 1 FROM findings f WHERE f.archive_path = a.archive_path AND severity = 'error') AS ok
    FROM archive a LEFT JOIN readable r ON r.archive_path = a.archive_path LEFT JOIN devices d ON d.archive_path = a.archive_path GROUP BY a.archive_path, a.damage""",
)


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = _unsound(spark, sf_dir), scratch.folder(spark, "repaired")
    return upkeep.repair(spark, folder, out, scratch.kept(upkeep.plan(spark, folder), "plans"))


TABLE["pln11_file_repair"] = (
    _repaired,
    f"""{_UNSOUND}, late AS (SELECT DISTINCT archive_path FROM readable WHERE time < before AND damage = 4), planned AS (
    SELECT a.archive_path, records, a.damage, CASE WHEN a.damage IN (1, 5) AND (a.damage = 1 OR records > 1) THEN CASE a.damage WHEN 1 THEN 'rebuild_from_salvage' ELSE 'quarantine_file' END
        WHEN a.damage = 5 THEN 'quarantine_file' WHEN a.damage = 2 THEN 'rewrite_from_readable_records' WHEN l.archive_path IS NOT NULL THEN 'quarantine_file' ELSE 'no_op' END AS action
    FROM archive a LEFT JOIN late l ON l.archive_path = a.archive_path)
    SELECT archive_path, action, CASE action WHEN 'no_op' THEN 'archive passed integrity audit' WHEN 'rebuild_from_salvage' THEN 'salvage scan found more packets than readable archive scan'
        WHEN 'quarantine_file' THEN 'archive could not be safely repaired' ELSE 'rewrite archive to refresh inconsistent header' END AS reason,
        CASE WHEN action IN ('rebuild_from_salvage', 'rewrite_from_readable_records') THEN archive_path || '.repaired.ath' WHEN action = 'quarantine_file' THEN archive_path || '.quarantine' END AS output,
        CASE damage WHEN 1 THEN 0 WHEN 5 THEN records - 1 ELSE records END AS readable_records,
        CASE WHEN action = 'no_op' THEN 0 WHEN damage = 5 THEN records - 1 ELSE records END AS salvaged_records,
        CASE action WHEN 'quarantine_file' THEN 0 ELSE records END AS expected_records,
        action IN ('rebuild_from_salvage', 'rewrite_from_readable_records') AS verify,
        CASE WHEN verify THEN records ELSE 0 END AS written_records, CASE WHEN verify THEN true END AS verified
    FROM planned""",
)


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of archives, replayed as a stream of eight batches into tables
    named by their batch, so that one that is given again replaces itself."""
    out = scratch.folder(spark, "replayed")

    def put(batch: DataFrame, number: int) -> None:
        batch.select("capture_time_ns", "archive_path", "offset", "device", "sequence", "payload_size").write.mode("overwrite").parquet(f"{out}/batch={number}")

    replay.emit(spark, _stored(spark, sf_dir), put, scratch.folder(spark, "replay-checkpoint"), startNs=T0 + DAY, endNs=T0 + 9 * DAY, stepNs=DAY)
    return spark.read.parquet(out).drop("batch")


TABLE["snk8_replay_stream"] = (
    _replayed,
    f"""{_SENT} SELECT capture_time_ns, path AS archive_path, starts AS "offset", device, sequence, size AS payload_size FROM placed WHERE capture_time_ns BETWEEN {T0 + DAY} AND {T0 + 9 * DAY}""",
)


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.cursor(A.packets(spark, sf_dir))


TABLE["src3_cursor"] = (
    _cursor,
    f"""WITH {A.PACKETS_SQL}
    SELECT archive_path, count(*) AS records_seen,
        arg_max(capture_time_ns, "offset") AS last_time_ns, arg_max(sequence, "offset") AS last_sequence
    FROM packets GROUP BY archive_path""",
)


def _salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose first eight bytes are gone can't be read, but salvaged."""
    damaged = archives.packed(_framed(spark, sf_dir)).withColumn("content", F.overlay("content", F.lit(b"\0" * 8), 1))
    found = archives.salvage(spark, damaged).where("packet.ok")
    return found.select("archive_path", F.col("offset").alias("at"), "capture_time_ns", *_P, _body())


TABLE["src7_salvage"] = (
    _salvage,
    f"{_SENT} SELECT path AS archive_path, starts + 12 AS at, capture_time_ns, kind, device, timestamp_ns, sequence, body FROM placed",
)
TABLE["src8_frames"] = (
    lambda s, d: archives.read_frames(s, _framed(s, d).select(F.concat_ws("/", "path", "place").alias("path"), F.col("frame").alias("content"))).select("path", *_P, _body()),
    f"""{_SENT} SELECT concat(path, '/', "offset") AS path, kind, device, timestamp_ns, sequence, body FROM sent""",
)
TABLE["src9_batches"] = (
    lambda s, d: archives.read_batches(s, archives.packed(_framed(s, d), batch=True)).select("path", "position", *_P, _body()),
    f"{_SENT} SELECT path, place AS position, kind, device, timestamp_ns, sequence, body FROM placed",
)
