"""Test tables as packets, readings, metrics, service-level events, spectrum
bins and I/Q samples, so that every operator runs on Parquet input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Kinds in rank order (fixed names; the rank is the position from 1).
KINDS = ("heartbeat", "observation", "spectrum", "control", "capabilities")
_EVENT_KIND = {"view": "heartbeat", "click": "observation", "purchase": "spectrum", "error": "control", "signup": "capabilities"}


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # zone-less timestamps are read as UTC
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets in four overlapping archives."""
    e = table(spark, sf_dir, "events")
    ordinal = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    fault = F.when(F.col("event_id") % 37 == 0, 2).when(F.col("event_id") % 41 == 0, 1).otherwise(0)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _EVENT_KIND.items()])
    capture = _nanos(F.col("ts"))
    return e.select(
        F.col("user_id").alias("device"),
        capture.alias("capture_time_ns"),
        (capture - (F.col("event_id") % 5) * 1_000_000_000).alias("timestamp_ns"),
        kind.alias("kind"),
        F.greatest(ordinal - fault, F.lit(0)).cast("long").alias("sequence"),
        F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.floor(F.col("value") * 10)).cast("long").alias("payload_size"),
        (F.col("event_id") * 64 + 36).alias("offset"),
        (F.col("event_id") % 4).cast("long").alias("archive_ordinal"),
        F.concat(F.lit("a"), (F.col("event_id") % 4).cast("string"), F.lit(".ath")).alias("archive_path"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scaled reading per event."""
    q = F.col("event_id") % 20
    quality = F.when(q < 16, "good").when(q == 16, "saturated").when(q == 17, "missing_calibration").when(q == 18, "noisy").otherwise("invalid")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("device"),
        _nanos(F.col("ts")).alias("time_ns"),
        (F.col("user_id") % 16).alias("channel"),
        F.floor(F.col("value") * 100).cast("int").alias("value"),
        F.lit(-2).alias("scale"),
        quality.alias("quality"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric sample per event."""
    kind = F.when(F.col("event_type").isin("view", "click"), "counter").when(F.col("event_type") == "purchase", "bytes").when(F.col("event_type") == "error", "latency").otherwise("gauge")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("evt."), "event_type").alias("name"),
        F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string"), F.lit("zone"), (F.col("user_id") % 2).cast("string")).alias("tags"),
        kind.alias("kind"),
        F.col("value"),
        _nanos(F.col("ts")).alias("time_ns"),
    )


def slo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "signup", "ignored").otherwise("good")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), _nanos(F.col("ts")).alias("time_ns"), kind.alias("kind"), F.lit(1.0).alias("weight"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectrum frames of 64 bins of 10 kHz."""
    e = table(spark, sf_dir, "embeddings")
    power = F.transform("embedding", lambda x: F.round(F.lit(-900.0) + x.cast("double") * 1000).cast("int"))
    return e.select(
        F.col("vec_id").alias("frame_id"),
        F.col("label").alias("receiver"),
        (F.col("vec_id") * 3600 * 1_000_000_000).alias("time_ns"),
        (F.lit(433_920_000) + F.col("label").cast("long") * 200_000).alias("center_hz"),
        F.lit(10_000).cast("long").alias("bin_width_hz"),
        power.alias("power_x10"),
        F.lit(-1040).alias("noise_x10"),
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames, a row per bin, with its frequency and dBm values."""
    f = frames(spark, sf_dir)
    low = F.greatest(F.col("center_hz") - F.expr("bin_width_hz * size(power_x10) div 2"), F.lit(0))
    f = f.withColumn("low_hz", low).select("frame_id", "receiver", "time_ns", "low_hz", "bin_width_hz", "noise_x10", F.posexplode("power_x10").alias("bin", "power_x10"))
    return f.select(
        "frame_id",
        "receiver",
        "time_ns",
        "bin",
        (F.col("low_hz") + F.col("bin") * F.col("bin_width_hz") + F.expr("bin_width_hz div 2")).alias("frequency_hz"),
        (F.col("power_x10") / 10.0).alias("power_dbm"),
        (F.col("noise_x10") / 10.0).alias("noise_dbm"),
    )


def iq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of 32 I/Q samples at 48 kHz, a row per sample."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.expr("transform(sequence(0, 31), n -> struct(embedding[2 * n] AS i, embedding[2 * n + 1] AS q))")).alias("n", "s"))
    return e.select(F.col("vec_id").alias("window_id"), "n", F.col("s.i").cast("double").alias("i"), F.col("s.q").cast("double").alias("q"))


# The same views for DuckDB.
PACKETS_SQL = """packets AS (
    SELECT user_id AS device, epoch_us(ts) * 1000 AS capture_time_ns, epoch_us(ts) * 1000 - (event_id % 5) * 1000000000 AS timestamp_ns,
        CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'observation' WHEN 'purchase' THEN 'spectrum' WHEN 'error' THEN 'control' WHEN 'signup' THEN 'capabilities' END AS kind,
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'signup' THEN 5 END AS kind_rank,
        greatest(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - CASE WHEN event_id % 37 = 0 THEN 2 WHEN event_id % 41 = 0 THEN 1 ELSE 0 END, 0) AS sequence,
        CASE WHEN event_id % 50 = 0 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS payload_size,
        event_id * 64 + 36 AS "offset", event_id % 4 AS archive_ordinal, concat('a', event_id % 4, '.ath') AS archive_path
    FROM events)"""
READINGS_SQL = """readings AS (
    SELECT event_id AS reading_id, user_id AS device, epoch_us(ts) * 1000 AS time_ns, user_id % 16 AS channel, CAST(floor(value * 100) AS INTEGER) AS value, -2 AS scale,
        CASE WHEN event_id % 20 < 16 THEN 'good' WHEN event_id % 20 = 16 THEN 'saturated' WHEN event_id % 20 = 17 THEN 'missing_calibration' WHEN event_id % 20 = 18 THEN 'noisy' ELSE 'invalid' END AS quality
    FROM events)"""
METRICS_SQL = """metrics AS (
    SELECT event_id AS ordinal, concat('evt.', event_type) AS name, CAST(user_id % 4 AS VARCHAR) AS shard, CAST(user_id % 2 AS VARCHAR) AS zone,
        CASE WHEN event_type IN ('view', 'click') THEN 'counter' WHEN event_type = 'purchase' THEN 'bytes' WHEN event_type = 'error' THEN 'latency' ELSE 'gauge' END AS kind,
        value, epoch_us(ts) * 1000 AS time_ns, concat('evt.', event_type, '|shard=', user_id % 4, '|zone=', user_id % 2) AS series
    FROM events)"""
SLO_SQL = """slo AS (
    SELECT event_id AS ordinal, epoch_us(ts) * 1000 AS time_ns, CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'ignored' ELSE 'good' END AS kind, 1.0 AS weight FROM events)"""
BINS_SQL = """bins AS (
    SELECT vec_id AS frame_id, label AS receiver, vec_id * 3600 * 1000000000 AS time_ns, n - 1 AS bin,
        greatest(433920000 + label * 200000 - 320000, 0) + (n - 1) * 10000 + 5000 AS frequency_hz,
        round(-900.0 + CAST(embedding[n] AS DOUBLE) * 1000) / 10.0 AS power_dbm, -104.0 AS noise_dbm
    FROM (SELECT *, unnest(range(1, 65)) AS n FROM embeddings))"""
IQ_SQL = """iq AS (
    SELECT vec_id AS window_id, n, CAST(embedding[2 * n + 1] AS DOUBLE) AS i, CAST(embedding[2 * n + 2] AS DOUBLE) AS q FROM (SELECT *, unnest(range(0, 32)) AS n FROM embeddings))"""
