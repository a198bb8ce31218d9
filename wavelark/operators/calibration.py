"""Tables of calibration profiles: (id, receiver, antenna, lower_hz, upper_hz,
valid_from_ns, valid_until_ns, points, tags), points an array of
(frequency_hz, gain_db, noise_db, uncertainty_db). A range is empty if its
upper end isn't above the lower one; valid_until_ns 0 is without end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sorted(points: Column) -> Column:
    return F.array_sort(points)  # by frequency, the first field


def summary(profiles: DataFrame) -> DataFrame:
    """AGG30: one row over all profiles: their number, that of their points,
    the hull of the ranges that aren't empty, receivers and antennas."""
    held = F.col("upper_hz") > F.col("lower_hz")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return profiles.agg(
        F.count("*").alias("profiles"),
        F.coalesce(F.sum(F.size("points")), F.lit(0)).cast("long").alias("points"),
        F.min(F.when(held, F.col("lower_hz"))).alias("lower_hz"),
        F.max(F.when(held, F.col("upper_hz"))).alias("upper_hz"),
        names("receiver").alias("receivers"),
        names("antenna").alias("antennas"),
    )


def issues(profiles: DataFrame) -> DataFrame:
    """SUP20: (id, issue), a row for each thing that is wrong with a profile or
    one of its points, which are taken in order of frequency."""
    own = profiles.withColumn("points", _sorted(F.col("points")))
    name, points = F.col("id"), F.col("points")
    say = lambda when, *text: F.when(when, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))

    def of_point(p: Column, i: Column) -> Column:
        f = p["frequency_hz"]
        return F.array(
            say(~((f >= F.col("lower_hz")) & (f < F.col("upper_hz"))), "calibration point outside profile range: ", name),
            say((i > 0) & (f <= F.get(points, i - 1)["frequency_hz"]), "calibration points are not strictly increasing: ", name),
            say(p["uncertainty_db"] < 0, "negative calibration uncertainty: ", name),
        )

    of_profile = F.array(
        say(name == "", "calibration profile has empty id"),
        say(F.col("receiver") == "", "calibration profile ", name, " has empty receiver id"),
        say(F.col("upper_hz") <= F.col("lower_hz"), "calibration profile ", name, " has empty frequency range"),
        say(F.size(points) == 0, "calibration profile ", name, " has no correction points"),
    )
    found = own.select("id", F.explode(F.array_compact(F.concat(of_profile, F.flatten(F.transform(points, of_point))))).alias("issue"))
    again = profiles.where(name != "").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select("id", F.explode(F.array_repeat(F.concat(F.lit("duplicate calibration profile id: "), name), (F.col("n") - 1).cast("int"))).alias("issue"))
    return found.union(again)


def merged(base: DataFrame, overlay: DataFrame, key: str, name: Column) -> DataFrame:
    """SET8: base under the overlay of the same key, named by an expression on
    base. Ranges join to their hull, validity to what both share; a point of
    the overlay takes the place of base's at its frequency, tags are united."""
    both = base.join(overlay.select(key, *[F.col(c).alias(f"o_{c}") for c in ("lower_hz", "upper_hz", "valid_from_ns", "valid_until_ns", "points", "tags")]), key)
    lower, upper, o_lower, o_upper = (F.col(c) for c in ("lower_hz", "upper_hz", "o_lower_hz", "o_upper_hz"))
    hull = lambda mine, other, joined: F.when(upper <= lower, other).when(o_upper <= o_lower, mine).otherwise(joined(mine, other))
    until, o_until = F.col("valid_until_ns"), F.col("o_valid_until_ns")
    stay = F.filter("points", lambda p: ~F.exists("o_points", lambda o: o["frequency_hz"] == p["frequency_hz"]))
    return both.select(
        name.alias("id"),
        "receiver",
        "antenna",
        hull(lower, o_lower, F.least).alias("lower_hz"),
        hull(upper, o_upper, F.greatest).alias("upper_hz"),
        F.greatest("valid_from_ns", "o_valid_from_ns").alias("valid_from_ns"),
        F.when(until == 0, o_until).when(o_until == 0, until).otherwise(F.least(until, o_until)).alias("valid_until_ns"),
        _sorted(F.concat(stay, F.col("o_points"))).alias("points"),
        F.array_sort(F.array_union("tags", "o_tags")).alias("tags"),
    )
