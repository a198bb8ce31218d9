"""Archive queries: filters that say why a record was rejected."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import KINDS

REASONS = ("time", "device", "kind", "payload")


@dataclass(frozen=True)
class Query:
    """A conjunctive filter; None leaves a bound open, limit 0 means none."""

    start: int | None = None
    end: int | None = None
    device: int | None = None
    kind: str | None = None
    min_payload: int | None = None
    max_payload: int | None = None
    limit: int = 0

    def within(self, name: str) -> Column:
        """Whether a row passes one of REASONS."""
        test = F.lit(True)
        if name == "time":
            test = test if self.start is None else test & (F.col("capture_time_ns") >= self.start)
            return test if self.end is None else test & (F.col("capture_time_ns") <= self.end)
        if name == "payload":
            test = test if self.min_payload is None else test & (F.col("payload_size") >= self.min_payload)
            return test if self.max_payload is None else test & (F.col("payload_size") <= self.max_payload)
        wanted = getattr(self, name)
        return test if wanted is None else F.col(name) == wanted

    def matches(self, reasons: tuple[str, ...] = REASONS) -> Column:
        test = F.lit(True)
        for name in reasons:
            test = test & self.within(name)
        return test

    def reject(self, reasons: tuple[str, ...] = REASONS) -> Column:
        """The first failing reason, or null for a match."""
        return F.coalesce(*[F.when(~self.within(name), F.lit(name)) for name in reasons])


@dataclass
class Parsed:
    query: Query
    problems: list[str] = field(default_factory=list)


_KEYS = {"start": "start", "from": "start", "start_time": "start", "end": "end", "to": "end", "end_time": "end", "device": "device", "kind": "kind", "type": "kind", "min_payload": "min_payload", "max_payload": "max_payload", "limit": "limit"}


def parse(text: str) -> Parsed:
    """Reads `key=value` tokens; what can't be read becomes a problem."""
    values: dict[str, int | str] = {}
    problems = []
    lexer = shlex.shlex(text.replace(" =", "=").replace("= ", "="), posix=True)
    lexer.whitespace_split, lexer.commenters = True, ""
    try:
        tokens = list(lexer)
    except ValueError:
        return Parsed(Query(), ["unterminated quote"])
    for token in tokens:
        key, _, value = token.partition("=")
        name = _KEYS.get(key.strip().lower())
        if not key:
            problems.append("empty key")
        elif name is None:
            problems.append(f"unknown key {key}")
        elif not value:
            problems.append(f"empty value for {key}")
        elif name == "kind":
            low = value.lower()
            if low.isdigit() and 1 <= int(low) <= len(KINDS):
                values[name] = KINDS[int(low) - 1]
            elif low in KINDS:
                values[name] = low
            else:
                problems.append(f"unknown kind {value}")
        elif value.isdigit():
            values[name] = int(value)
        else:
            problems.append(f"bad integer for {key}")
    q = Query(**values)
    if q.start is not None and q.end is not None and q.start > q.end:
        problems.append("start after end")
    if q.min_payload is not None and q.max_payload is not None and q.min_payload > q.max_payload:
        problems.append("min_payload above max_payload")
    return Parsed(q, problems)


def describe(q: Query) -> str:
    """The filter as text, kinds by number."""
    parts = [f"{k}={KINDS.index(v) + 1 if k == 'kind' else v}" for k, v in vars(q).items() if v not in (None, 0)]
    return " ".join(parts) or "all"


ORDER = ("archive_ordinal", "offset")


def archive(df: DataFrame, q: Query) -> DataFrame:
    """FLT1: the matching records; a limit takes the first in file order."""
    found = df.where(q.matches())
    return found.orderBy(*ORDER).limit(q.limit) if q.limit else found


def scanned(df: DataFrame, q: Query, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """The records that a scan reads: with a limit it ends at the last match."""
    if not q.limit:
        return df
    last = df.where(q.matches(reasons)).select(F.struct(*ORDER).alias("at")).orderBy("at").limit(q.limit)
    last = last.agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return df.crossJoin(F.broadcast(last)).where((F.col("n") < q.limit) | (F.struct(*ORDER) <= F.col("last"))).drop("n", "last")  # one row


def stats(df: DataFrame, q: Query, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """FLT2: scanned, matched, and skipped by the first failing reason."""
    rows = scanned(df, q, reasons).select(q.reject(reasons).alias("why"))
    skipped = [F.count_if(F.col("why").eqNullSafe(r)).alias(f"skipped_by_{r}") for r in REASONS]
    return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("why").isNull()).alias("matched"), *skipped)


def selectivity(counted: DataFrame) -> DataFrame:
    """FLT3: every counter as a share of the scanned."""
    share = lambda c: F.when(F.col("scanned") > 0, F.round(F.col(c) / F.col("scanned"), 6)).otherwise(0.0).alias(f"{c}_ratio")
    return counted.select("scanned", share("matched"), *[share(f"skipped_by_{r}") for r in REASONS])


INDEX = ("capture_time_ns", "offset", "payload_size", "device", "sequence")


def index(df: DataFrame) -> DataFrame:
    """SRC2: what an index holds of every record."""
    return df.select("archive_ordinal", "archive_path", *INDEX)


def filter_index(df: DataFrame, q: Query) -> DataFrame:
    """FLT4/FLT5: an index knows no kinds; ordered by time, archive, offset."""
    found = index(df).where(q.matches(("time", "device", "payload")))
    return found.orderBy("capture_time_ns", *ORDER).limit(q.limit) if q.limit else found


def search(df: DataFrame, q: Query) -> DataFrame:
    """FLT6: counters of a collection search; the device picks what is scanned
    and the kind is tested last, on the loaded record."""
    rows = df if q.device is None else df.where(F.col("device") == q.device)
    return stats(rows, q, ("time", "payload", "kind"))


def at_or_after(df: DataFrame, time_ns: int) -> DataFrame:
    """FLT8: the first record at or after a time."""
    return index(df).where(F.col("capture_time_ns") >= time_ns).orderBy("capture_time_ns", *ORDER).limit(1)


def lookup(df: DataFrame, refs: DataFrame) -> DataFrame:
    """SRC5: records of refs (archive_path, offset); whether time, device and
    sequence are those of the ref."""
    r = refs.select("archive_path", "offset", *[F.col(c).alias(f"ref_{c}") for c in ("capture_time_ns", "device", "sequence")])
    ok = (F.col("ref_capture_time_ns") == F.col("capture_time_ns")) & (F.col("ref_device") == F.col("device")) & (F.col("ref_sequence") == F.col("sequence"))
    return df.join(r, ["archive_path", "offset"]).select("archive_path", "offset", "device", "kind", F.coalesce(ok, F.lit(False)).alias("same"))


def steps(df: DataFrame, allowed: DataFrame, most_payload: int) -> DataFrame:
    """FLT11: payload limit, then device allowlist; why a packet was dropped."""
    known = allowed.select("device").distinct().withColumn("known", F.lit(True))
    why = F.when(F.col("payload_size") > most_payload, "payload_limit").when(F.col("known").isNull(), "device_allowlist")
    return df.join(known, "device", "left").select("device", "offset", why.alias("dropped_by"))


def replay(df: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """SNK8: counters of a replay over an inclusive window, 0 for open."""
    inside = (F.lit(start == 0) | (F.col("capture_time_ns") >= start)) & (F.lit(end == 0) | (F.col("capture_time_ns") <= end))
    return df.agg(F.count("*").alias("seen"), F.count_if(inside).alias("emitted"), F.coalesce(F.sum(F.when(inside, F.col("payload_size"))), F.lit(0)).alias("bytes"))
