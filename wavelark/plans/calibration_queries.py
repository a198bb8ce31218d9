"""Calibration profiles: their summary, issues and merges. Suppliers stand for
profiles, as no table holds any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..sources import adapters as A
from .archive_queries import Run

TABLE: dict[str, tuple[Run, str | None]] = {}


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile per supplier; some are empty, repeat an id, or hold points
    outside their range or of negative uncertainty."""
    n = F.col("s_suppkey")
    lower = (n % 50) * 1_000_000
    at = lambda i: F.struct(
        (lower + F.when(n % 5 == 0, 1 - i).otherwise(i) * 1_500_000).cast("long").alias("frequency_hz"),
        (i * 0.5 - 1).cast("double").alias("gain_db"),
        (n % 3 * 0.5).cast("double").alias("noise_db"),
        ((n % 11 - 1) * 0.5).cast("double").alias("uncertainty_db"),
    )
    return A.table(spark, sf_dir, "supplier").select(
        n.cast("long").alias("number"),
        F.concat(F.lit("p"), (n - F.when(n % 13 == 0, 1).otherwise(0)).cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("receiver"),
        F.concat(F.lit("ant"), (n % 3).cast("string")).alias("antenna"),
        lower.cast("long").alias("lower_hz"),
        (lower + n % 7 * 1_000_000).cast("long").alias("upper_hz"),
        (n % 17 * 10).cast("long").alias("valid_from_ns"),
        (n % 4 * 100).cast("long").alias("valid_until_ns"),
        F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (n % 4).cast("int")), at).alias("points"),
        F.array(F.concat(F.lit("t"), (n % 6).cast("string"))).alias("tags"),
    )


_PROFILES = """profiles AS (
    SELECT CAST(s_suppkey AS BIGINT) AS number,
        concat('p', s_suppkey - CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END) AS id,
        concat('r', s_nationkey) AS receiver,
        concat('ant', s_suppkey % 3) AS antenna,
        CAST(s_suppkey % 50 * 1000000 AS BIGINT) AS lower_hz,
        CAST(s_suppkey % 50 * 1000000 + s_suppkey % 7 * 1000000 AS BIGINT) AS upper_hz,
        CAST(s_suppkey % 17 * 10 AS BIGINT) AS valid_from_ns,
        CAST(s_suppkey % 4 * 100 AS BIGINT) AS valid_until_ns,
        concat('t', s_suppkey % 6) AS tag
    FROM supplier), points AS (
    SELECT p.*, i,
        CAST(lower_hz + CASE WHEN number % 5 = 0 THEN 1 - i ELSE i END * 1500000 AS BIGINT) AS frequency_hz,
        CAST(i * 0.5 - 1 AS DOUBLE) AS gain_db,
        CAST(number % 3 * 0.5 AS DOUBLE) AS noise_db,
        CAST((number % 11 - 1) * 0.5 AS DOUBLE) AS uncertainty_db
    FROM profiles p, (SELECT unnest(range(3)) AS i) WHERE i < least(number % 4, 3))"""

TABLE["agg30_calibration_summary"] = (
    lambda s, d: C.summary(profiles(s, d)),
    f"""WITH {_PROFILES}
    SELECT count(*) AS profiles,
        (SELECT count(*) FROM points) AS points,
        min(lower_hz) FILTER (WHERE upper_hz > lower_hz) AS lower_hz,
        max(upper_hz) FILTER (WHERE upper_hz > lower_hz) AS upper_hz,
        string_agg(DISTINCT receiver, ',' ORDER BY receiver) AS receivers,
        string_agg(DISTINCT antenna, ',' ORDER BY antenna) AS antennas
    FROM profiles""",
)

TABLE["sup20_calibration_issues"] = (
    lambda s, d: C.issues(profiles(s, d)),
    f"""WITH {_PROFILES}, seen AS (
    SELECT *, lag(frequency_hz) OVER (PARTITION BY number ORDER BY frequency_hz, gain_db) AS before FROM points)
    SELECT id, 'duplicate calibration profile id: ' || id AS issue
    FROM (SELECT id, unnest(range(count(*) - 1)) FROM profiles GROUP BY id)
    UNION ALL SELECT id, 'calibration profile ' || id || ' has empty frequency range' FROM profiles WHERE upper_hz <= lower_hz
    UNION ALL SELECT id, 'calibration profile ' || id || ' has no correction points' FROM profiles WHERE number % 4 = 0
    UNION ALL SELECT id, 'calibration point outside profile range: ' || id FROM seen
        WHERE NOT (frequency_hz >= lower_hz AND frequency_hz < upper_hz)
    UNION ALL SELECT id, 'calibration points are not strictly increasing: ' || id FROM seen WHERE frequency_hz <= before
    UNION ALL SELECT id, 'negative calibration uncertainty: ' || id FROM seen WHERE uncertainty_db < 0""",
)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile under the one of the next number."""
    p = profiles(spark, sf_dir)
    got = C.merged(p, p.withColumn("number", F.col("number") - 1), "number", F.concat(F.lit("m"), F.col("number").cast("string")))
    rows = got.select("id", "receiver", "lower_hz", "upper_hz", "valid_from_ns", "valid_until_ns", F.array_join("tags", ",").alias("tags"), F.explode_outer("points").alias("p"))
    return rows.select("id", "receiver", "lower_hz", "upper_hz", "valid_from_ns", "valid_until_ns", "tags", "p.frequency_hz", "p.gain_db", "p.noise_db")


TABLE["set8_calibration_merge"] = (
    _merged,
    f"""WITH {_PROFILES}, pairs AS (
    SELECT b.number, concat('m', b.number) AS id, b.receiver,
        CASE WHEN b.upper_hz <= b.lower_hz THEN o.lower_hz WHEN o.upper_hz <= o.lower_hz THEN b.lower_hz
            ELSE least(b.lower_hz, o.lower_hz) END AS lower_hz,
        CASE WHEN b.upper_hz <= b.lower_hz THEN o.upper_hz WHEN o.upper_hz <= o.lower_hz THEN b.upper_hz
            ELSE greatest(b.upper_hz, o.upper_hz) END AS upper_hz,
        greatest(b.valid_from_ns, o.valid_from_ns) AS valid_from_ns,
        CASE WHEN b.valid_until_ns = 0 THEN o.valid_until_ns WHEN o.valid_until_ns = 0 THEN b.valid_until_ns
            ELSE least(b.valid_until_ns, o.valid_until_ns) END AS valid_until_ns,
        CASE WHEN b.tag = o.tag THEN b.tag ELSE concat(least(b.tag, o.tag), ',', greatest(b.tag, o.tag)) END AS tags
    FROM profiles b JOIN profiles o ON o.number = b.number + 1), kept AS (
    SELECT number - 1 AS number, frequency_hz, gain_db, noise_db FROM points
    UNION ALL
    SELECT number, frequency_hz, gain_db, noise_db FROM points b
    WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.number = b.number + 1 AND o.frequency_hz = b.frequency_hz))
    SELECT p.* EXCLUDE (number), k.frequency_hz, k.gain_db, k.noise_db FROM pairs p LEFT JOIN kept k USING (number)""",
)
