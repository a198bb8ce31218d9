"""CTL6, JN11: acknowledgements against what commands expect of them.

An as-of join: every ack meets the nearest earlier expectation of its command,
and what has come for that expectation before decides how the ack counts. Both
are windows over one command's events. A command may be expected again; its
acks then belong to the later expectation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses that end an expectation without success.
REJECTED = ("rejected", "malformed", "unknown_command")
STATES = ("waiting", "satisfied", "timed_out", "cancelled")
KINDS = ("matched", "duplicate", "unexpected", "stale", "rejected")


def _events(expected: DataFrame, acks: DataFrame, cancels: DataFrame | None, now_ns: int) -> DataFrame:
    """All events up to now with the expectation (`of`) that they belong to; at
    one time an expectation comes first and a cancellation last."""
    none = lambda kind, *names: {n: F.lit(None).cast(kind) for n in names}
    own = F.struct(F.col("device").alias("device"), F.col("created_ns").alias("created_ns"), F.coalesce("deadline_ns", F.lit(0)).alias("deadline_ns"), F.greatest(F.coalesce("required_accepts", F.lit(1)), F.lit(1)).alias("required"))
    kind = "struct<device:long,created_ns:long,deadline_ns:long,required:int>"
    columns = ["command_id", "at_ns", "rank", "ordinal", "device", "status", "given"]
    parts = [
        expected.where("command_id <> 0").select("command_id", F.col("created_ns").alias("at_ns"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ordinal"), F.col("device").cast("long").alias("device"), own.cast(kind).alias("given")).withColumns(none("string", "status")),
        acks.select("command_id", F.col("time_ns").alias("at_ns"), F.lit(1).alias("rank"), F.col("ordinal").cast("long").alias("ordinal"), F.col("device").cast("long").alias("device"), "status").withColumns(none(kind, "given")),
    ]
    if cancels is not None:
        parts.append(cancels.select("command_id", F.col("time_ns").alias("at_ns"), F.lit(2).alias("rank"), F.lit(0).cast("long").alias("ordinal")).withColumns(none("string", "status") | none("long", "device") | none(kind, "given")))
    rows = parts[0].select(*columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*columns))
    before = W.partitionBy("command_id").orderBy("at_ns", "rank", "ordinal").rowsBetween(W.unboundedPreceding, 0)
    return rows.where(F.col("at_ns") <= now_ns).withColumn("of", F.last("given", ignorenulls=True).over(before))


def observations(expected: DataFrame, acks: DataFrame, cancels: DataFrame | None = None, now_ns: int = (1 << 63) - 1) -> DataFrame:
    """(command_id, created_ns, device, at_ns, ordinal, rank, kind): every ack up
    to now (rank 1) with how it counts, and every cancellation (rank 2) that had
    an effect, of expectations (command_id, device, created_ns, deadline_ns,
    required_accepts), acks (command_id, device, time_ns, status, ordinal) and
    cancellations (command_id, time_ns). A deadline of 0 or null is none; an ack
    at the deadline is in time. created_ns is null where nothing was expected."""
    rows = _events(expected, acks, cancels, now_ns)
    of = lambda c: F.col(f"of.{c}")
    fits = (F.col("rank") == 1) & (F.col("device") == of("device")) & ((of("deadline_ns") == 0) | (F.col("at_ns") <= of("deadline_ns")))
    refused = F.col("status").isin(*REJECTED)
    rows = rows.withColumn("accepts", F.coalesce((fits & ~refused).cast("int"), F.lit(0))).withColumn("ends", F.coalesce(((fits & refused) | (F.col("rank") == 2)).cast("int"), F.lit(0)))
    earlier = W.partitionBy("command_id", F.col("of.created_ns")).orderBy("at_ns", "rank", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    terminal = (count("accepts") >= of("required")) | (count("ends") > 0)
    how = (
        F.when(F.col("of").isNull(), "unexpected")
        .when(terminal, "duplicate")
        .when(F.col("device") != of("device"), "unexpected")
        .when((of("deadline_ns") != 0) & (F.col("at_ns") > of("deadline_ns")), "stale")
        .when(refused, "rejected")
        .otherwise("matched")
    )
    rows = rows.withColumn("terminal", terminal).where("rank = 1 OR (rank = 2 AND of IS NOT NULL AND NOT terminal)")
    return rows.select("command_id", of("created_ns").alias("created_ns"), "device", "at_ns", "ordinal", "rank", F.when(F.col("rank") == 2, "cancelled").otherwise(how).alias("kind"))


def snapshots(expected: DataFrame, observed: DataFrame, now_ns: int) -> DataFrame:
    """Per expectation its state now, accepts, rejects, last observation and how
    many observations it has: acks of any kind, its cancellation, its timeout."""
    of = lambda k: F.count_if(F.col("kind") == k)
    per = observed.where("created_ns IS NOT NULL").groupBy("command_id", "created_ns").agg(of("matched").alias("accepts"), of("rejected").alias("rejects"), of("cancelled").alias("cancels"), F.max(F.when(F.col("rank") == 1, F.col("at_ns"))).alias("last_ack_ns"), F.count("*").alias("n"))
    rows = expected.where((F.col("command_id") != 0) & (F.col("created_ns") <= now_ns)).join(per, ["command_id", "created_ns"], "left").na.fill(0, ["accepts", "rejects", "cancels", "n"])
    required, deadline = F.greatest(F.coalesce("required_accepts", F.lit(1)), F.lit(1)), F.coalesce("deadline_ns", F.lit(0))
    state = F.when(F.col("cancels") > 0, "cancelled").when((F.col("accepts") >= required) | (F.col("rejects") > 0), "satisfied").when((deadline != 0) & (deadline <= now_ns), "timed_out").otherwise("waiting")
    late = F.col("state") == "timed_out"
    rows = rows.withColumn("state", state)
    last = F.when(late, F.lit(now_ns)).otherwise(F.coalesce("last_ack_ns", F.lit(0)))
    return rows.select("command_id", "device", "created_ns", "deadline_ns", "state", "accepts", "rejects", last.cast("long").alias("last_ns"), (F.col("n") + F.when(late, 1).otherwise(0)).alias("observations"))


def totals(snapshot: DataFrame, observed: DataFrame) -> DataFrame:
    """How many were registered, and ended or counted in which way."""
    own = snapshot.agg(F.count("*").alias("registered"), *[F.count_if(F.col("state") == s).alias(s) for s in ("timed_out", "cancelled")])
    return own.crossJoin(observed.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]))  # one row each


def device_summary(snapshot: DataFrame) -> DataFrame:
    """Per device its expectations by state, and their observations."""
    return snapshot.groupBy("device").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.sum("observations").alias("observations"))
