"""Stateful stream operators in event time: sessions that end by timers, link
findings, sliding statistics, rotation shards and spectrum history.

Rows of a key wait until the watermark has passed them and are then taken in
order of time, so that a stream gives what its batch query gives, in whatever
order rows arrive within the delay. Rows later than the delay are not taken:
choose it generously. State is what waits and a few numbers a key, or its window
or ring.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import history, planning
from .stateful import use_rocksdb

MS = 1_000_000


def _names(schema: str) -> list[str]:
    """The columns of a schema, whose nested types have no blanks."""
    return [c.split()[0] for c in schema.split(", ")]


def _plain(column: pd.Series) -> list:
    """Values as state takes them: arrays as lists, structs as tuples."""
    if column.dtype != object:
        return column.tolist()
    return [[tuple(x.values()) if isinstance(x, dict) else x for x in v] if isinstance(v, np.ndarray) else v for v in column]


def _bare(value: Any) -> Any:
    """Rows out of state, nested ones too, as tuples."""
    if isinstance(value, tuple):
        return tuple(map(_bare, value))
    return [_bare(v) for v in value] if isinstance(value, (list, np.ndarray)) else value


class InOrder(StatefulProcessor):
    """Takes a key's rows in order of time once the watermark has passed them.

    Subclasses name the columns of a row (the first three: time in nanoseconds
    and two that order equal times) and of the state, and implement `take`, and
    `settle` and `deadline` where time alone has an effect.
    """

    ROW: str
    STATE: str
    OUT: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.state = handle.getValueState("state", self.STATE)

    def take(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        """The state and output after rows, in order."""
        raise NotImplementedError

    def settle(self, key: tuple, state: tuple | None, now_ns: int) -> tuple[tuple | None, list[tuple]]:
        """The state and output after time has come to now_ns."""
        return state, []

    def deadline(self, state: tuple | None) -> int | None:
        """When settle has something to do next."""
        return None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = _names(self.ROW)
        for part in rows:
            columns = [_plain(part[n]) for n in names]
            self.waiting.appendList(list(zip(*columns, strict=True)))
        yield self._advance(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues)

    def _advance(self, key: tuple, timerValues: Any) -> pd.DataFrame:
        now = max(0, timerValues.getCurrentWatermarkInMs())
        waiting = sorted(map(_bare, self.waiting.get())) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] < now * MS]
        rest = waiting[len(due) :]
        state = _bare(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        if due:
            state, out = self.take(key, state, due)
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        state, more = self.settle(key, state, now * MS)
        if state is not None:
            self.state.update(state)
        at = [x for x in (rest[0][0] if rest else None, self.deadline(state)) if x is not None]
        if at:
            # a timer of the past would fire at once, in vain
            self.handle.registerTimer(max(min(at) // MS + 1, now + 1))
        return pd.DataFrame(out + more, columns=_names(self.OUT)) if out or more else self._none()

    def _none(self) -> pd.DataFrame:
        kinds = {"long": "int64", "int": "int32", "double": "float64", "string": "object"}
        return pd.DataFrame({c.split()[0]: pd.Series(dtype=kinds[c.split()[1]]) for c in self.OUT.split(", ")})

    def close(self) -> None:
        pass


_PACKET = "capture_time_ns long, archive_path string, offset long"


class IdleSessions(InOrder):
    """STR2: a session ends when its device has been silent for idle_ns of event
    time, without waiting for another packet."""

    ROW = _PACKET
    STATE = "session long, opened_ns long, last_ns long, packets long"
    OUT = "device long, session long, opened_ns long, last_seen_ns long, packets long"

    def __init__(self, idle_ns: int):
        self.idle_ns = idle_ns

    def _ended(self, key: tuple, state: tuple) -> tuple:
        session, opened, last, packets = state
        return (int(key[0]), session, opened, last, packets)

    def take(self, key, state, rows):
        out = []
        for time, *_ in rows:
            if state is not None and state[3] and time - state[2] >= self.idle_ns:
                out.append(self._ended(key, state))
                state = (state[0], 0, 0, 0)
            if state is None or not state[3]:
                state = ((state[0] if state else 0) + 1, time, time, 1)
            else:
                state = (state[0], state[1], time, state[3] + 1)
        return state, out

    def settle(self, key, state, now_ns):
        if state is None or not state[3] or now_ns - state[2] < self.idle_ns:
            return state, []
        return (state[0], 0, 0, 0), [self._ended(key, state)]

    def deadline(self, state):
        return state[2] + self.idle_ns if state is not None and state[3] else None


class LinkFindings(InOrder):
    """STR7: idle gaps, jitter and sequence regressions, each against the packet
    before."""

    ROW = f"{_PACKET}, sequence long"
    STATE = "last_ns long, sequence long"
    OUT = "device long, capture_time_ns long, offset long, code string"

    def __init__(self, idle_ns: int, jitter_ns: int):
        self.idle_ns, self.jitter_ns = idle_ns, jitter_ns

    def take(self, key, state, rows):
        out = []
        for time, _, offset, sequence in rows:
            if state is not None:
                step = time - state[0]
                code = "link.idle_gap" if step > self.idle_ns else "link.jitter" if step > self.jitter_ns else None
                out += [(int(key[0]), time, offset, c) for c in (code, "link.sequence_regression" if sequence <= state[1] else None) if c]
            state = (time, sequence)
        return state, out


class Shards(InOrder):
    """STR8, PLN3: the shard of every record under any mix of limits."""

    ROW = f"{_PACKET}, payload_size long"
    STATE = "shard long, records long, payload long, start_ns long, last_ns long"
    OUT = "device long, archive_path string, offset long, shard long, opened_by string"

    def __init__(self, policy: planning.Rotation):
        self.policy = policy

    def take(self, key, state, rows):
        out = []
        shard = state or (0, 0, 0, 0, 0)
        for time, path, offset, size in rows:
            shard, why = planning.place(self.policy, shard, time, size)
            out.append((int(key[0]), path, offset, shard[0], why))
        return shard, out


class Sliding(InOrder):
    """STR3: statistics of the window that ends at each reading; the state holds
    the readings of one window."""

    ROW = "time_ns long, reading_id long, value long"
    STATE = "times array<long>, values array<long>"
    OUT = "channel long, reading_id long, time_ns long, start_ns long, n long, mean double, least long, most long"

    def __init__(self, width_ns: int):
        self.width_ns = width_ns

    def take(self, key, state, rows):
        times, values = (list(state[0]), list(state[1])) if state else ([], [])
        out, at = [], 0
        while at < len(rows):
            # readings of one time are in each other's windows
            time, same = rows[at][0], at
            while same < len(rows) and rows[same][0] == time:
                times.append(time)
                values.append(rows[same][2])
                same += 1
            first = next(i for i, t in enumerate(times) if t >= time - self.width_ns)
            times, values = times[first:], values[first:]
            told = (times[0], len(values), round(sum(values) / len(values), 6), min(values), max(values))
            out += [(int(key[0]), r[1], time, *told) for r in rows[at:same]]
            at = same
        return (times, values), out


class Ring(InOrder):
    """RF17: after every step of the watermark the tracks of the receiver's last
    observations. The state is the ring."""

    ROW = f"time_ns long, frame_id long, ratio double, peaks array<{history.PEAK}>"
    STATE = f"ring array<struct<time_ns:long,frame_id:long,peaks:array<{history.PEAK}>>>"
    OUT = history.TRACK

    def __init__(self, most: int, tolerance: int):
        self.most, self.tolerance = most, tolerance

    def take(self, key, state, rows):
        ring = [(r[0], r[1], [tuple(p) for p in r[2]]) for r in (state[0] if state else [])]
        ring = sorted(ring + [(t, f, [tuple(p) for p in peaks]) for t, f, _, peaks in rows])[-self.most :]
        return (ring,), history.summaries(int(key[0]), [(f, t, p) for t, f, p in ring], self.tolerance)[0]


def _run(rows: DataFrame, key: str, time: str, delay: str, processor: InOrder) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    timed = rows.select(key, *_names(processor.ROW), F.timestamp_micros(F.expr(f"{time} div 1000")).alias("event_time")).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(processor, processor.OUT, "Append", "EventTime")


def idle_sessions(packets: DataFrame, idle_ns: int, delay: str = "1 hour") -> DataFrame:
    return _run(packets, "device", "capture_time_ns", delay, IdleSessions(idle_ns))


def link_findings(packets: DataFrame, idle_ns: int, jitter_ns: int, delay: str = "1 hour") -> DataFrame:
    return _run(packets, "device", "capture_time_ns", delay, LinkFindings(idle_ns, jitter_ns))


def shards(packets: DataFrame, policy: planning.Rotation, delay: str = "1 hour") -> DataFrame:
    return _run(packets, "device", "capture_time_ns", delay, Shards(policy))


def sliding(readings: DataFrame, width_ns: int, delay: str = "1 hour") -> DataFrame:
    return _run(readings, "channel", "time_ns", delay, Sliding(width_ns))


def tracks(observed: DataFrame, most: int = history.MOST, tolerance: int = history.TOLERANCE_HZ, delay: str = "1 hour") -> DataFrame:
    """The tracks of every receiver's ring whenever it has changed."""
    return _run(observed, "receiver", "time_ns", delay, Ring(most, tolerance))
