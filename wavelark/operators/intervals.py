"""Ranges: joins of those that overlap, and unions, intersections and
differences of sets of them.

A range is half-open: it holds its lower bound and not its upper one. A range
without a point, or with a null bound, is empty and meets nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of one level are so many times (as a power of two) as wide as those
#: of the level below.
STEP = 4
LEVELS = 64 // STEP


def _level(low: Column, high: Column) -> Column:
    """The least level whose buckets are as long as the range: it lies in two of
    them at most."""
    length = high - low
    return reduce(lambda a, b: a + b, [(length > (1 << STEP * k)).cast("int") for k in range(LEVELS - 1)])


def _bucket(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level * STEP)


def _spread(df: DataFrame, low: str, high: str, levels: list[int], own: tuple[int, ...], above: tuple[int, ...]) -> DataFrame:
    """df's ranges in all buckets of their level and of the given ones above it,
    once for each role that they play there."""
    levels_ = F.filter(F.array(*map(F.lit, levels)), lambda m: m >= F.col("level of it"))
    roles = F.when(F.col("bucket level") == F.col("level of it"), F.array(*map(F.lit, own))).otherwise(F.array(*map(F.lit, above)))
    rows = df.where(F.col(low) < F.col(high)).withColumn("level of it", _level(F.col(low), F.col(high))).withColumn("bucket level", F.explode(levels_))
    rows = rows.withColumn("role", F.explode(roles))
    first, last = _bucket(F.col(low), F.col("bucket level")), _bucket(F.col(high) - 1, F.col("bucket level"))
    return rows.withColumn("bucket", F.explode(F.sequence(first, last))).drop("level of it")


def levels_of(*sides: tuple[DataFrame, str, str]) -> list[int]:
    """The levels of ranges (table, lower, upper): an aggregation of each table."""
    held = [df.where(F.col(lo) < F.col(hi)).select(_level(F.col(lo), F.col(hi)).alias("level")) for df, lo, hi in sides]
    return sorted(r.level for r in reduce(DataFrame.union, held).distinct().collect()) or [0]


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: list[str] | None = None, levels: list[int] | None = None) -> DataFrame:
    """Pairs of rows whose ranges overlap and whose columns `on` are equal, each
    pair once: all columns of left and, but for `on`, of right, whose names must
    differ. Bounds are integers.

    Both sides are cut into buckets and joined on equal ones, so no row meets
    another that isn't near. A range is dealt to buckets as wide as itself: two
    at most, however long. Two ranges of unlike length meet at the longer one's
    level, to which the shorter one is dealt as well; where they share two
    buckets, the one that holds the later lower bound counts. One aggregation of
    either side finds the levels in use, sixteen at most, unless they are given.
    """
    on = on or []
    levels = levels if levels is not None else levels_of((left, *left_range), (right, *right_range))
    # roles: 0 both at their own level, 1 left at its own, 2 right at its own
    a = _spread(left, *left_range, levels, (0, 1), (2,))
    b = _spread(right, *right_range, levels, (0, 2), (1,))
    met = a.join(b, [*on, "bucket level", "bucket", "role"])
    (la, ha), (lb, hb) = left_range, right_range
    once = F.col("bucket") == _bucket(F.greatest(la, lb), F.col("bucket level"))
    met = met.where((F.col(la) < F.col(hb)) & (F.col(lb) < F.col(ha)) & once)
    return met.select(*left.columns, *[c for c in right.columns if c not in on])


def covered(ranges: list[tuple[DataFrame, str, str]], key: list[str], least: int, names: tuple[str, str] = ("lower", "upper")) -> DataFrame:
    """(*key, lower, upper): the maximal ranges that at least `least` of the given
    sets of ranges cover, per key: 1 is their union, their number their
    intersection. Ranges of one set may overlap; touching ones become one.

    A sweep: every range opens at its lower bound and closes at its upper one.
    Depths are kept per set, so that overlaps within a set count once.
    """
    low, high = names
    events = None
    for n, (df, lo, hi) in enumerate(ranges):
        rows = df.where(F.col(lo) < F.col(hi))
        ends = F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("change")), F.struct(F.col(hi).alias("at"), F.lit(-1).alias("change"))))
        part = rows.select(*key, ends.alias("end")).groupBy(*key, "end.at").agg(*[(F.sum("end.change") if k == n else F.lit(0)).cast("long").alias(f"set {k}") for k in range(len(ranges))])
        events = part if events is None else events.unionByName(part)
    sets = [f"set {k}" for k in range(len(ranges))]
    events = events.groupBy(*key, "at").agg(*[F.sum(s).alias(s) for s in sets])
    by = W.partitionBy(*key).orderBy("at")
    depth = reduce(lambda a, b: a + b, [(F.sum(s).over(by) > 0).cast("int") for s in sets])
    steps = events.withColumn("in", depth >= least).withColumn("was", F.coalesce(F.lag("in").over(by), F.lit(False)))
    turns = steps.where(F.col("in") != F.col("was"))
    return turns.withColumn("until", F.lead("at").over(by)).where("in").select(*key, F.col("at").alias(low), F.col("until").alias(high))
