"""All registered queries of the telemetry engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, query, sequences
from ..sources import adapters
from . import archive_queries, calibration_queries, diagnostic_queries, planning_queries, rf_queries, wire_queries

TABLES = (archive_queries.TABLE, planning_queries.TABLE, diagnostic_queries.TABLE, rf_queries.TABLE, wire_queries.TABLE, calibration_queries.TABLE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for table in TABLES for name, (run, _) in table.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for table in TABLES for name, (_, sql) in table.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-device health: records, gaps and sequence anomalies of the packets
    that a filter string selects."""
    packets = adapters.packets(spark, sf_dir)
    chosen = packets.where(query.parse("kind=control min_payload=1").query.matches())
    gaps = sequences.gaps(packets, archive_queries.HOUR).groupBy("device").agg(F.count("*").alias("gaps"))
    odd = sequences.anomalies(packets).groupBy("device").agg(F.count("*").alias("anomalies"))
    summary = aggregates.device_summary(chosen).join(gaps, "device", "left").join(odd, "device", "left")
    return summary.na.fill(0, ["gaps", "anomalies"]).orderBy(F.desc("anomalies"), "device")
