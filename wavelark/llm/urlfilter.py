"""URL filters as a temporal list join.

A list is a table of dated entries: from a day on a domain is blocked, allowed
or taken off the list. Entries become validity intervals, each ending where
the domain's next entry begins. Every capture is evaluated as of its fetch
day against the entries then active for its host and the host's parent
domains; the longest such domain decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which of several entries of one domain and day holds.
RANK = {"remove": 0, "allow": 1, "block": 2}


def host(url: Column) -> Column:
    """The lower-case host, or null where the url has none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until): until is exclusive, null while open.

    entries holds domain, day and action. Of one domain's entries of one day
    block goes before allow before remove. Entries with a null or an unknown
    action are skipped; domains are compared in lower case.
    """
    rank = F.coalesce(*[F.when(F.col("action") == name, F.lit(n)) for name, n in RANK.items()])
    rows = entries.select(F.lower("domain").alias("domain"), F.col("day").cast("date").alias("since"), rank.alias("rank")).dropna()
    rows = rows.groupBy("domain", "since").agg(F.max("rank").alias("rank"))
    until = F.lead("since").over(Window.partitionBy("domain").orderBy("since"))
    names = F.array(*[F.lit(x) for x in sorted(RANK, key=RANK.get)])
    return rows.select("domain", F.get(names, F.col("rank")).alias("action"), "since", until.alias("until")).where("action != 'remove'")


def verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """Per capture: id, host, verdict (block, allow or unlisted), domain (of the
    entry that decided) and since (the day from which it holds).

    A capture whose url is null or has no host, or without a day, is unlisted.
    Repeated rows stay rows. Hosts and days are evaluated once each, however
    many captures share them.
    """
    rows = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("day"))
    asked = rows.where("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = asked.select("host", "day", F.explode(above).alias("domain"))
    active = (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    met = parents.join(intervals(entries), "domain").where(active)
    best = F.max(F.struct(F.length("domain").alias("n"), "domain", "action", "since")).alias("best")
    told = met.groupBy("host", "day").agg(best)
    out = rows.join(told, ["host", "day"], "left")
    return out.select(F.col("id").alias(id_col), "host", F.coalesce("best.action", F.lit("unlisted")).alias("verdict"), F.col("best.domain").alias("domain"), F.col("best.since").alias("since"))
