"""Samples of an archive collection; records stand in (time, archive, offset)
order and the sample is numbered by time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ORDER = ("capture_time_ns", "archive_ordinal", "offset")
_KEPT = ("archive_path", "capture_time_ns", "device", "sequence", "payload_size", "offset")


def _position(df: DataFrame) -> DataFrame:
    """df with its position from 0 in collection order: a rank within ranges
    of time plus the counts of the ranges before, so no task holds all rows."""
    span = 3_600_000_000_000
    rows = df.withColumn("hour", F.expr(f"capture_time_ns div {span}"))
    sizes = rows.groupBy("hour").agg(F.count("*").alias("n"))
    before = sizes.select("hour", F.coalesce(F.sum("n").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("hour").orderBy(*_ORDER)) - 1
    return rows.join(before, "hour").withColumn("position", (F.col("before") + within).cast("long")).drop("hour", "before")


def _numbered(chosen: DataFrame, limit: int) -> DataFrame:
    """The first `limit` (0: all) by the column `pick`, numbered by time."""
    if limit:
        chosen = chosen.orderBy("pick").limit(limit)
    ranked = _position(chosen.drop("position"))
    return ranked.select(F.col("position").alias("sample_rank"), *_KEPT)


def first(df: DataFrame, limit: int) -> DataFrame:
    """SMP1: the first records."""
    return _numbered(df.withColumn("pick", F.struct(*_ORDER)), limit)


def every(df: DataFrame, stride: int, limit: int) -> DataFrame:
    """SMP2: every stride-th record."""
    rows = _position(df)
    return _numbered(rows.where(F.col("position") % max(stride, 1) == 0).withColumn("pick", F.col("position")), limit)


def per_bucket(df: DataFrame, width: int, limit: int) -> DataFrame:
    """SMP3: the first record of every time bucket."""
    bucket = F.expr(f"capture_time_ns div {max(width, 1)}")
    least = df.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(*_ORDER, *[c for c in _KEPT if c not in _ORDER])).alias("r"))
    return _numbered(least.select("r.*").withColumn("pick", F.struct(*_ORDER)), limit)


def extremes(df: DataFrame, limit: int) -> DataFrame:
    """SMP5: smallest and largest payloads by turns until `limit` are taken."""
    order = ("payload_size", "capture_time_ns", "archive_ordinal", "offset")
    half = limit - limit // 2
    low = df.orderBy(*order).limit(half)
    total = df.count()
    high = df.orderBy(*[F.desc(c) for c in order]).limit(min(limit // 2, max(0, total - half)))
    chosen = low.unionByName(high)
    return _numbered(chosen, 0)


#: FNV-1a over 64-bit words: fixed values of the record hash (its start isn't
#: the usual one).
_FNV_START, _FNV_PRIME = 1469598103934665603, 1099511628211


def record_hash(df: DataFrame) -> DataFrame:
    """df with `hash` (signed 64 bits): FNV-1a over the record's numbers, then
    over the bytes of its archive path."""
    @F.pandas_udf("long")
    def fnv(ordinal: pd.Series, offset: pd.Series, time: pd.Series, size: pd.Series, device: pd.Series, sequence: pd.Series, path: pd.Series) -> pd.Series:
        h = np.full(len(path), _FNV_START, np.uint64)
        prime = np.uint64(_FNV_PRIME)
        with np.errstate(over="ignore"):
            for column in (ordinal, offset, time, size, device, sequence):
                h = (h ^ column.to_numpy(np.int64).view(np.uint64)) * prime
            paths = [p.encode() for p in path]
            for i in range(max(map(len, paths), default=0)):
                there = np.array([len(p) > i for p in paths])
                byte = np.array([p[i] if len(p) > i else 0 for p in paths], np.uint64)
                h = np.where(there, (h ^ byte) * prime, h)
        return pd.Series(h.view(np.int64))

    return df.withColumn("hash", fnv("archive_ordinal", "offset", "capture_time_ns", "payload_size", "device", "sequence", "archive_path"))


def hashed(df: DataFrame, modulus: int, remainder: int, limit: int = 0) -> DataFrame:
    """SMP4: records whose unsigned hash leaves the remainder."""
    low, high = F.col("hash").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("hash", 32)
    rest = (high % modulus * ((1 << 32) % modulus) + low % modulus) % modulus
    rows = record_hash(df).where(rest == remainder % modulus)
    return _numbered(rows.withColumn("pick", F.struct(*_ORDER)), limit)
