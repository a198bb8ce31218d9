"""Backpressure, queues, limits and acknowledgements."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pressure levels and the load from which they hold (fixed values).
LEVELS = (("nominal", 0.0), ("watch", 0.50), ("throttle", 0.70), ("shed", 0.85), ("stop", 0.97))


def pressure(load: DataFrame) -> DataFrame:
    """CTL1: the level of (packets, packet_capacity, bytes, byte_capacity,
    stalled, inflight)."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.when(F.col(a) > 0, 1.0).otherwise(0.0))
    most = F.greatest(ratio("packets", "packet_capacity"), ratio("bytes", "byte_capacity"))
    rank = F.lit(0)
    for i, (_, least) in enumerate(LEVELS):
        rank = F.when(most >= least, i).otherwise(rank)
    rank = F.greatest(rank, F.when(F.col("stalled") > 0, 2).otherwise(0), F.when((F.col("packet_capacity") >= 4) & (F.col("inflight") > F.expr("packet_capacity div 4")), 1).otherwise(0))
    return load.withColumn("ratio", F.round(most, 6)).withColumn("level", F.get(F.array(*[F.lit(n) for n, _ in LEVELS]), rank))


def drain(queue: DataFrame, order: str, limit: int) -> DataFrame:
    """RT2/SRT10: what a queue snapshot (offset, arrival_ns, deadline_ns,
    priority_rank) gives next: fifo, priority (older first) or deadline
    (0 last)."""
    by = {
        "fifo": ["arrival_ns", "offset"],
        "priority": [F.desc("priority_rank"), "arrival_ns", "offset"],
        "deadline": [F.col("deadline_ns") == 0, "deadline_ns", "arrival_ns", "offset"],
    }[order]
    return queue.orderBy(*by).limit(limit)


def lease_order(tasks: DataFrame, now_ns: int, fairness_ns: int, limit: int) -> DataFrame:
    """RT5: tasks in the order in which they would be leased."""
    due = (F.col("deadline_ns") != 0) & (F.col("deadline_ns") <= now_ns + fairness_ns)
    return tasks.orderBy(~due, F.col("deadline_ns") == 0, "deadline_ns", F.desc("priority_rank"), "attempts", "arrival_ns", "offset").limit(limit)


def retry_schedule(commands: DataFrame, initial_ns: int, cap_ns: int) -> DataFrame:
    """CTL3: when (command, sent_ns, attempts) is due again: the delay doubles
    with every attempt, up to the cap."""
    delay = F.least(F.lit(initial_ns) * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(float(cap_ns)))
    return commands.withColumn("due_ns", F.col("sent_ns") + delay.cast("long"))


@dataclass(frozen=True)
class Bucket:
    """Tokens per second and the most that may gather."""

    rate: int
    burst: int


def token_bucket(df: DataFrame, limit: Bucket) -> DataFrame:
    """CTL4: whether each packet finds a token. Gained tokens are whole and a
    refill forgets the fraction of a second that it leaves. A device is one
    ordered pass over (device, capture_time_ns, offset)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["capture_time_ns", "offset"], kind="stable")
        tokens, last, allowed = limit.burst, None, []
        for now in rows["capture_time_ns"]:
            if last is not None:
                gained = (now - last) * limit.rate // 1_000_000_000
                if gained > 0:
                    tokens, last = min(limit.burst, tokens + gained), now
            else:
                last = now
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        return pd.DataFrame({"device": rows["device"], "offset": rows["offset"], "allowed": allowed})

    return df.select("device", "capture_time_ns", "offset").groupBy("device").applyInPandas(run, "device long, offset long, allowed boolean")


@dataclass(frozen=True)
class Batching:
    """When a batch closes."""

    max_packets: int = 64
    max_payload: int = 1 << 20
    max_age_ns: int = 5_000_000


def batches(df: DataFrame, policy: Batching, key: str = "archive_path") -> DataFrame:
    """RT3: batch numbers and why a batch was closed, in arrival order within
    a key. Control packets are alone in theirs; a sequence step back of a
    device that the batch holds closes it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["capture_time_ns", "offset"], kind="stable")
        number, n, size, start, alone = 0, 0, 0, 0, False
        high: dict[int, int] = {}
        numbers, reasons = [], []
        for time, device, sequence, payload, kind in zip(*(rows[c] for c in ("capture_time_ns", "device", "sequence", "payload_size", "kind")), strict=True):
            why = None
            if n:
                if alone or kind == "control":
                    why = "control_isolation"
                elif high.get(device, -1) > sequence:
                    why = "manual_flush"
                elif n >= policy.max_packets:
                    why = "max_packets"
                elif size + payload > policy.max_payload:
                    why = "max_payload"
                elif time - start >= policy.max_age_ns:
                    why = "max_age"
            if why:
                number, n, size = number + 1, 0, 0
                high.clear()
            if not n:
                start = time
            n, size, alone = n + 1, size + payload, kind == "control"
            high[device] = max(high.get(device, -1), sequence)
            numbers.append(number)
            reasons.append(why)
        return pd.DataFrame({key: rows[key], "offset": rows["offset"], "batch": numbers, "closed_before_by": reasons})

    rows = df.select(key, "offset", "capture_time_ns", "device", "sequence", "payload_size", "kind")
    return rows.groupBy(key).applyInPandas(run, f"{key} string, offset long, batch long, closed_before_by string")


def acknowledgements(acks: DataFrame, commands: DataFrame) -> DataFrame:
    """JN11/CTL6: how each ack (command_id, device, time_ns, status, ordinal)
    counts against commands (command_id, device, deadline_ns). The first
    terminal ack settles a command; what follows is a duplicate."""
    c = commands.select("command_id", F.col("device").alias("expected"), "deadline_ns")
    w = W.partitionBy("command_id").orderBy("time_ns", "ordinal")
    a = acks.join(c, "command_id", "left")
    fit = (F.col("device") == F.col("expected")) & (F.col("time_ns") <= F.col("deadline_ns"))
    terminal = F.coalesce(fit & (F.col("status") != "busy"), F.lit(False))
    settled = F.coalesce(F.max(terminal.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    how = (
        F.when(F.col("expected").isNull(), "unexpected")
        .when(settled, "duplicate")
        .when(F.col("device") != F.col("expected"), "unexpected")
        .when(F.col("time_ns") > F.col("deadline_ns"), "stale")
        .when(F.col("status").isin("accepted", "busy"), "matched")
        .otherwise("rejected")
    )
    return a.select("command_id", "device", "ordinal", how.alias("outcome"))


def ack_devices(outcomes: DataFrame) -> DataFrame:
    """AGG25: outcomes per device."""
    return outcomes.groupBy("device").agg(F.count("*").alias("acks"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("matched", "rejected", "duplicate", "unexpected", "stale")])


#: Kinds that are admitted under any pressure but the highest (fixed values).
PROTECTED = ("control", "heartbeat", "capabilities")


@dataclass(frozen=True)
class Admission:
    min_delay_ns: int = 1_000_000
    max_delay_ns: int = 1_000_000_000
    max_factor: int = 16


def admission(df: DataFrame, policy: Admission) -> DataFrame:
    """CTL2: the decision for packets (device, capture_time_ns, offset, kind,
    level), per device in arrival order: a delay opens a window in which what
    follows waits too, shedding doubles the factor of downsampling until a
    packet is accepted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["capture_time_ns", "offset"], kind="stable")
        delayed, factor, free_at, said = 0, 1, 0, []
        for now, kind, level in zip(rows["capture_time_ns"], rows["kind"], rows["level"], strict=True):
            action, delay, told = "accept", 0, 1
            if level == "stop" or kind not in PROTECTED:
                if now < free_at:
                    action, delay, told = "delay", free_at - now, factor
                elif level == "throttle":
                    wait = policy.min_delay_ns * 2 * min(delayed + 1, 32)
                    action, delay, told = "delay", max(policy.min_delay_ns, min(wait, policy.max_delay_ns)), factor
                elif level == "shed":
                    action, told = "downsample", min(max(2, factor * 2), policy.max_factor)
                elif level == "stop":
                    action, told = "reject", policy.max_factor
            delayed += action == "delay"
            factor = factor if action == "delay" else told
            free_at = now + (policy.max_delay_ns if action == "reject" else delay)
            said.append((action, delay, told))
        actions, delays, factors = zip(*said, strict=True)
        return pd.DataFrame({"device": rows["device"], "offset": rows["offset"], "action": actions, "delay_ns": delays, "factor": factors})

    rows = df.select("device", "capture_time_ns", "offset", "kind", "level")
    return rows.groupBy("device").applyInPandas(run, "device long, offset long, action string, delay_ns long, factor long")
