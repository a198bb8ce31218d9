"""Stateful stream operators, one per device or link.

Within a micro-batch a key's rows are put in order of arrival first. State is
kept until its time to live ends; the library never drops a late row but
labels it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import codec as C
from ..functions.udfs import packet_row

SESSION = "device long, offset long, event string, missing long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Stateful processors need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Sessions(StatefulProcessor):
    """STR1/STR2: opened, duplicate, gap, regression and seen events."""

    def __init__(self, gap_report: int = 4, idle_ns: int = 30_000_000_000):
        self.gap_report, self.idle_ns = gap_report, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "sequence long, timestamp_ns long, seen_ns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["capture_time_ns", "offset"], kind="stable")
        last = self.state.get() if self.state.exists() else None
        sequence, latest, seen = (None, None, None) if last is None else tuple(last)
        out = []
        for r in got.itertuples():
            if seen is not None and r.capture_time_ns - seen >= self.idle_ns:
                out += [(r.offset, "idle_timeout", 0), (r.offset, "closed", 0), (r.offset, "opened", 0)]
            if sequence is None:
                out.append((r.offset, "opened", 0))
                sequence, latest = r.sequence, r.timestamp_ns
            else:
                if r.sequence == sequence:
                    out.append((r.offset, "duplicate_sequence", 0))
                elif r.sequence < sequence:
                    out.append((r.offset, "duplicate_sequence", 0))
                elif r.sequence - sequence - 1 > self.gap_report:
                    out.append((r.offset, "sequence_gap", r.sequence - sequence - 1))
                if r.timestamp_ns < latest:
                    out.append((r.offset, "timestamp_regression", 0))
                sequence, latest = max(sequence, r.sequence), max(latest, r.timestamp_ns)
            seen = r.capture_time_ns
            out.append((r.offset, "packet_seen", 0))
        self.state.update((int(sequence), int(latest), int(seen)))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["device", "offset", "event", "missing"])

    def close(self) -> None:
        pass


def sessions(packets: DataFrame, gap_report: int = 4, idle_ns: int = 30_000_000_000) -> DataFrame:
    """Session events of a stream of packets."""
    use_rocksdb(packets.sparkSession)
    rows = packets.select("device", "sequence", "timestamp_ns", "capture_time_ns", "offset")
    return rows.groupBy("device").transformWithStateInPandas(Sessions(gap_report, idle_ns), SESSION, "Append", "None")


def take_frames(buffer: bytes, most: int = C.MAX_PACKET) -> tuple[list[dict], bytes]:
    """SRC6/STR5: the frames at the front of a byte stream, and what remains.
    Bytes before a magic are dropped; a frame that fails is dropped whole, an
    impossible length costs one byte."""
    magic = C.PACKET_MAGIC.to_bytes(4, "little")
    out = []
    while True:
        at = buffer.find(magic)
        if at < 0:
            return out, buffer[-3:] if len(buffer) >= 4 else buffer
        buffer = buffer[at:]
        if len(buffer) < 8:
            return out, buffer
        size = int.from_bytes(buffer[4:8], "little") + 12
        if size > most:
            out.append(packet_row(None) | {"error": "malformed_packet"})
            buffer = buffer[1:]
        elif len(buffer) < size:
            return out, buffer
        else:
            out.append(packet_row(buffer[:size]))
            buffer = buffer[size:]


PARSED = "link_id string, ok boolean, error string, device long, kind string, sequence long, payload binary"


class Resync(StatefulProcessor):
    """Frames out of chunks (link_id, chunk, data), kept whole over batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("chunk", kind="stable")
        buffer = bytes(self.state.get()[0]) if self.state.exists() else b""
        packets, rest = take_frames(buffer + b"".join(bytes(x) for x in got["data"]))
        self.state.update((rest,))
        yield pd.DataFrame([(key[0], p["ok"], p["error"], p["device"], p["kind"], p["sequence"], p["payload"]) for p in packets], columns=["link_id", "ok", "error", "device", "kind", "sequence", "payload"]).astype({"device": "Int64", "sequence": "Int64"})

    def close(self) -> None:
        pass


def parse(chunks: DataFrame) -> DataFrame:
    """Packets and decode errors of byte streams, one per link."""
    use_rocksdb(chunks.sparkSession)
    return chunks.groupBy("link_id").transformWithStateInPandas(Resync(), PARSED, "Append", "None")


WHOLE = "device long, stream_id long, fragments long, payload string"


class Reassembly(StatefulProcessor):
    """PRO6/STR6: whole payloads of fragments; a stream whose count changes is
    dropped, and unfinished ones go when their time to live ends (None: never)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "sequence int", "payload string, count int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        out = []
        for r in got.itertuples():
            held = {k[0]: v for k, v in self.parts.iterator()}
            if any(v[1] != r.count for v in held.values()):
                self.parts.clear()
                continue
            if r.sequence not in held:
                self.parts.updateValue((int(r.sequence),), (r.payload, int(r.count)))
                held[r.sequence] = (r.payload, r.count)
            if len(held) == r.count:
                out.append((key[0], key[1], len(held), "".join(held[i][0] for i in sorted(held))))
                self.parts.clear()
        yield pd.DataFrame(out, columns=["device", "stream_id", "fragments", "payload"])

    def close(self) -> None:
        pass


def reassemble(fragments: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Whole payloads of a stream of fragments (device, stream_id, sequence,
    count, arrival, payload); a time to live is in processing time."""
    use_rocksdb(fragments.sparkSession)
    rows = fragments.select("device", "stream_id", "sequence", "count", "arrival", "payload")
    return rows.groupBy("device", "stream_id").transformWithStateInPandas(Reassembly(ttl_ms), WHOLE, "Append", "None" if ttl_ms is None else "ProcessingTime")


def tumbling(packets: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    """STR4: counts per event-time window; rows later than delay are counted
    in no window, so choose it generously."""
    from pyspark.sql import functions as F

    rows = packets.withColumn("ts", F.timestamp_micros(F.expr("capture_time_ns div 1000")))
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("packets"), F.sum("payload_size").alias("payload_bytes"))
