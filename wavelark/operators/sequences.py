"""Operators over consecutive records of a device, link or archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _in_time():
    """A device's records in time order."""
    return W.partitionBy("device").orderBy("capture_time_ns", "sequence", "archive_ordinal", "offset")


def _arrived():
    """A device's records as they arrived."""
    return W.partitionBy("device").orderBy("capture_time_ns", "offset")


def _in_file(*more: str):
    """Records in file order, per archive (and more)."""
    return W.partitionBy("archive_path", *more).orderBy("offset")


def timelines(df: DataFrame) -> DataFrame:
    """WIN1: per device its points, time range and payload."""
    return df.groupBy("device").agg(F.count("*").alias("points"), F.min("capture_time_ns").alias("first_time_ns"), F.max("capture_time_ns").alias("last_time_ns"), F.sum("payload_size").cast("long").alias("payload_bytes")).orderBy(F.desc("points"), "device")


def gaps(df: DataFrame, threshold: int) -> DataFrame:
    """WIN2: consecutive records of a device further apart than threshold."""
    rows = df.select("device", "archive_path", F.col("capture_time_ns").alias("end_ns"), F.lag("capture_time_ns").over(_in_time()).alias("start_ns"), F.lag("archive_path").over(_in_time()).alias("before_path"))
    rows = rows.withColumn("gap_ns", F.col("end_ns") - F.col("start_ns")).where(F.col("gap_ns") > threshold)
    return rows.select("device", "start_ns", "end_ns", "gap_ns", "before_path", F.col("archive_path").alias("after_path")).orderBy(F.desc("gap_ns"), "device", "start_ns")


def anomalies(df: DataFrame) -> DataFrame:
    """WIN3: duplicates, steps back and gaps of the sequence, in time order."""
    before = F.lag("sequence").over(_in_time())
    s = F.col("sequence")
    reason = F.when(s == F.col("before"), "duplicate sequence").when(s < F.col("before"), "sequence moved backwards").when(s > F.col("before") + 1, "sequence gap")
    rows = df.select("device", "capture_time_ns", "offset", "sequence", before.alias("before")).withColumn("reason", reason)
    return rows.where("reason IS NOT NULL").select("device", "capture_time_ns", "offset", F.col("before").alias("previous"), "sequence", "reason").orderBy("device", "capture_time_ns", "offset")


def order_audit(df: DataFrame) -> DataFrame:
    """WIN4: records older than the one before them in the file."""
    before = F.lag("capture_time_ns").over(_in_file())
    return df.select("archive_path", "offset", "capture_time_ns", before.alias("previous_ns")).where("capture_time_ns < previous_ns")


def regression_audit(df: DataFrame) -> DataFrame:
    """WIN5: sequences below the device's highest so far in the file."""
    highest = F.max("sequence").over(_in_file("device").rowsBetween(W.unboundedPreceding, -1))
    return df.select("archive_path", "device", "offset", "sequence", highest.alias("highest")).where("sequence < highest")


def link_findings(df: DataFrame, idle: int, jitter: int) -> DataFrame:
    """WIN6/STR7: idle gaps, jitter and sequence regressions by arrival."""
    w = _arrived()
    step = F.col("capture_time_ns") - F.lag("capture_time_ns").over(w)
    rows = df.select("device", "capture_time_ns", "offset", step.alias("step_ns"), (F.col("sequence") <= F.lag("sequence").over(w)).alias("back"))
    found = F.array_compact(F.array(F.when(F.col("step_ns") > idle, "link.idle_gap").when(F.col("step_ns") > jitter, "link.jitter"), F.when(F.col("back"), "link.sequence_regression")))
    return rows.select("device", "capture_time_ns", "offset", F.explode(found).alias("code"))


def link_summary(df: DataFrame, idle: int, jitter: int) -> DataFrame:
    """WIN6: findings per device and code."""
    return link_findings(df, idle, jitter).groupBy("device", "code").agg(F.count("*").alias("findings"))


def sliding(readings: DataFrame, width: int) -> DataFrame:
    """WIN7/STR3: statistics of the window of width that ends at each reading."""
    # Time is cut into blocks of width: a window is the part of its reading's
    # block up to it and the part of the block before from its start on. So two
    # running aggregates, one forwards and one backwards, give every window,
    # however many readings it holds.
    block = F.col("time_ns") - F.pmod("time_ns", F.lit(width))
    rows = readings.select("channel", "reading_id", "time_ns", "value", block.alias("block"))
    told = {"start_ns": F.min("time_ns"), "n": F.count("*"), "values": F.count("value"), "total": F.sum("value"), "least": F.min("value"), "most": F.max("value")}
    own = W.partitionBy("channel", "block").orderBy("time_ns").rangeBetween(W.unboundedPreceding, W.currentRow)
    heads = rows.select("*", *[x.over(own).alias(k) for k, x in told.items()])
    # the readings of one time in a block, and the windows that begin in it
    times = rows.groupBy("channel", "block", "time_ns").agg(*[x.alias(k) for k, x in told.items() if k != "start_ns"])
    asked = rows.where("time_ns IS NOT NULL").select("channel", (F.col("block") - width).alias("block"), (F.col("time_ns") - width).alias("time_ns")).distinct()
    both = times.select("*", F.lit(False).alias("asked")).unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    rest = W.partitionBy("channel", "block").orderBy(F.desc("time_ns"), "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    tail = {"start_ns": F.min(F.when(~F.col("asked"), F.col("time_ns"))), "n": F.sum("n"), "values": F.sum("values"), "total": F.sum("total"), "least": F.min("least"), "most": F.max("most")}
    tails = both.select("channel", "time_ns", "asked", *[x.over(rest).alias(f"old {k}") for k, x in tail.items()]).where("asked AND `old n` > 0")
    tails = tails.select("channel", (F.col("time_ns") + width).alias("time_ns"), *[f"`old {k}`" for k in tail])
    on = heads["channel"].eqNullSafe(tails["channel"]) & (heads["time_ns"] == tails["time_ns"])
    met = heads.join(tails, on, "left").select(heads["*"], *[tails[f"`old {k}`"] for k in tail])
    added = lambda c: F.coalesce(f"`old {c}`", F.lit(0)) + F.coalesce(c, F.lit(0))
    values = added("values")
    mean = F.when(values > 0, F.round(added("total").cast("double") / values, 6))
    return met.select("channel", "reading_id", "time_ns", F.least("start_ns", "`old start_ns`").alias("start_ns"), added("n").alias("n"), mean.alias("mean"), F.least("least", "`old least`").alias("least"), F.greatest("most", "`old most`").alias("most"))


def sessions(df: DataFrame, gap_report: int = 4) -> DataFrame:
    """STR1: session counters per device, by arrival, without expiry."""
    w = _arrived()
    so_far = w.rowsBetween(W.unboundedPreceding, -1)
    rows = df.select("device", "sequence", "timestamp_ns", F.max("sequence").over(so_far).alias("last"), F.max("timestamp_ns").over(so_far).alias("latest"))
    s, last = F.col("sequence"), F.col("last")
    return rows.groupBy("device").agg(
        F.count("*").alias("packets"),
        F.count_if(s <= last).alias("duplicates"),
        F.coalesce(F.sum(F.when(s > last, s - last - 1)), F.lit(0)).cast("long").alias("missing"),
        F.count_if((s > last) & (s - last - 1 > gap_report)).alias("gap_events"),
        F.count_if(F.col("timestamp_ns") < F.col("latest")).alias("regressions"),
        F.max("sequence").alias("last_sequence"),
    )


def session_totals(per_device: DataFrame) -> DataFrame:
    """AGG27: totals over all sessions."""
    return per_device.agg(F.count("*").alias("devices"), *[F.sum(c).cast("long").alias(c) for c in ("packets", "duplicates", "missing", "regressions")])


def idle_sessions(df: DataFrame, idle: int) -> DataFrame:
    """STR2: sessions that end after idle nanoseconds without a packet."""
    w = _arrived()
    opens = F.coalesce(F.col("capture_time_ns") - F.lag("capture_time_ns").over(w) >= idle, F.lit(True))
    rows = df.select("device", "capture_time_ns", "offset", opens.alias("opens"))
    rows = rows.withColumn("session", F.sum(F.col("opens").cast("long")).over(w))
    return rows.groupBy("device", "session").agg(F.min("capture_time_ns").alias("opened_ns"), F.max("capture_time_ns").alias("last_seen_ns"), F.count("*").alias("packets"))


def trend(steps: Column, ups: Column, downs: Column) -> Column:
    """WIN8: how consecutive differences beyond the noise floor lie."""
    return F.when(steps == 0, "missing").when((ups == 0) & (downs == 0), "flat").when((ups > 0) & (downs > 0), "volatile").when(ups > 0, "rising").otherwise("falling")


def metric_trends(metrics: DataFrame, key: list[str], floor: float) -> DataFrame:
    """WIN8/DIA7: the trend of every metric series."""
    w = W.partitionBy(*key).orderBy("time_ns", "ordinal")
    rows = metrics.select(*key, (F.col("value") - F.lag("value").over(w)).alias("step"))
    per = rows.groupBy(*key).agg(F.count("step").alias("steps"), F.count_if(F.col("step") > floor).alias("ups"), F.count_if(F.col("step") < -floor).alias("downs"))
    return per.withColumn("trend", trend(F.col("steps"), F.col("ups"), F.col("downs")))


def capacity_samples(catalog: DataFrame) -> DataFrame:
    """WIN9: cumulative records and bytes in catalog order (one row per
    archive, so a single task holds it)."""
    w = W.orderBy("first_time_ns", "archive_path").rowsBetween(W.unboundedPreceding, 0)
    return catalog.select(F.col("last_time_ns").alias("time_ns"), "archive_path", F.sum("records").over(w).cast("long").alias("records"), F.sum("payload_bytes").over(w).cast("long").alias("payload_bytes")).orderBy("time_ns", "archive_path")


def merged_ranges(ranges: DataFrame, group: list[str]) -> DataFrame:
    """SET2: closed ranges (start_ns, end_ns) merged where they overlap or
    touch; inverted ones are swapped."""
    rows = ranges.select(*group, F.least("start_ns", "end_ns").alias("s"), F.greatest("start_ns", "end_ns").alias("e"))
    w = W.partitionBy(*group).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.coalesce(F.col("s") > reach + 1, F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("opens").cast("long")).over(w))
    return rows.groupBy(*group, "island").agg(F.min("s").alias("start_ns"), F.max("e").alias("end_ns")).drop("island")
