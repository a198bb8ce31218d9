"""Capture archives, frames and salvaged bytes as DataFrames, and back.

Reading goes through Spark's binaryFile source, so any store that Spark knows
will do; one file is one task, as its record lengths chain.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import codec as C
from ..functions.frames import Decoded, sealed
from ..functions.udfs import PACKET, packet_rows, signed, udf

HEADER = 36
#: Rows of a batch that a task hands over.
BATCH = 8192
FILE = pa.schema([("path", pa.string()), ("content", pa.binary())])
RECORD = f"archive_path string, archive_ordinal int, offset long, capture_time_ns long, corrupt string, packet {PACKET}"


def _files(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(path, content) of files; a DataFrame of them stays as it is."""
    if isinstance(paths, DataFrame):
        return paths.select("path", "content")
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def scan(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, capture time, frame, what is wrong) of an archive's records;
    ends at the first damaged one."""
    if data[:8] != C.ARCHIVE_MAGIC:
        yield 0, 0, b"", "archive magic mismatch"
        return
    at = HEADER
    while at < len(data):
        if at + 12 > len(data):
            yield at, 0, b"", "record ends early"
            return
        time, size = struct.unpack_from("<QI", data, at)
        end = at + 12 + size
        if end + 4 > len(data):
            yield at, signed(time), b"", "record extent beyond the file"
            return
        if C.crc32c(data[at:end]) != struct.unpack_from("<I", data, end)[0]:
            yield at, signed(time), b"", "record crc mismatch"
            return
        yield at, signed(time), data[at + 12 : end], None
        at = end + 4


def read(spark: SparkSession, paths: list[str] | DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """SRC1: the records of archives in list order of their paths. FAILFAST
    fails at the first damaged record; PERMISSIVE keeps it as a row with
    `corrupt` and ends that file there."""
    order = {} if isinstance(paths, DataFrame) else {os.path.basename(p.rstrip("/")): i for i, p in enumerate(paths)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                name = os.path.basename(path)
                rows = list(scan(bytes(data)))
                bad = next((w for *_, w in rows if w), None)
                if bad and mode == "FAILFAST":
                    raise ValueError(f"{name}: {bad}")
                packets = packet_rows([f if not w else None for _, _, f, w in rows])
                yield pd.DataFrame([{"archive_path": name, "archive_ordinal": order.get(name, 0), "offset": o, "capture_time_ns": t, "corrupt": w, "packet": p} for (o, t, _, w), p in zip(rows, packets, strict=True)], columns=["archive_path", "archive_ordinal", "offset", "capture_time_ns", "corrupt", "packet"])

    return _files(spark, paths).mapInPandas(work, RECORD)


def as_packets(records: DataFrame) -> DataFrame:
    """Records as the packet rows that the operators take."""
    p = "packet."
    return records.where("corrupt IS NULL AND packet.ok").select("archive_path", "archive_ordinal", "offset", "capture_time_ns", *[p + c for c in ("device", "timestamp_ns", "kind", "sequence", "fragment", "route", "capabilities", "payload")], F.octet_length("packet.payload").cast("long").alias("payload_size"))


def cursor(packets: DataFrame) -> DataFrame:
    """SRC3: what a reader knows at the end of each archive: the records seen,
    the last one's capture time and sequence."""
    last = lambda c: F.max_by(c, "offset")
    return packets.groupBy("archive_path").agg(F.count("*").alias("records_seen"), last("capture_time_ns").alias("last_time_ns"), last("sequence").alias("last_sequence"))


def headers(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """What the headers of archives state."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                version, n, first, last = struct.unpack_from("<IQQQ", bytes(data[:HEADER]).ljust(HEADER, b"\0"), 8)
                rows.append((os.path.basename(path), version, n, signed(first), signed(last)))
            yield pd.DataFrame(rows, columns=["archive_path", "format_version", "records", "first_time_ns", "last_time_ns"])

    return _files(spark, paths).mapInPandas(work, "archive_path string, format_version int, records long, first_time_ns long, last_time_ns long")


def salvage(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """SRC7: every whole frame found by its magic, at any offset; a frame that
    fails is passed over by one byte. The capture time is that of the record
    in front, if its length agrees, else 0."""
    kinds = StructType.fromDDL(f"archive_path string, offset long, capture_time_ns long, frame binary, packet {PACKET}")
    arrow = to_arrow_schema(kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held.append((os.path.basename(path.as_py()), content.as_py()))
                size += len(held[-1][1])
                if size >= HELD:
                    yield from _salvaged(held, arrow)
                    held, size = [], 0
        yield from _salvaged(held, arrow)

    return _files(spark, paths).mapInArrow(work, kinds)


#: Bytes of files that are salvaged together, candidates taken of one at a time,
#: and of one behind a frame that failed.
HELD, CHAIN, SHORT = 4 << 20, 4096, 16


def _candidates(data: bytes, at: int, most: int) -> list[tuple[int, int, bytes | None]]:
    """(offset, capture time, frame or None) of up to so many frames from at on,
    if each is whole."""
    magic, out = struct.pack("<I", C.PACKET_MAGIC), []
    while len(out) < most and (at := data.find(magic, at)) >= 0 and at + 12 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0] + 12
        time = 0
        if at >= 12 and struct.unpack_from("<I", data, at - 4)[0] == size:
            time = signed(struct.unpack_from("<Q", data, at - 12)[0])
        whole = size <= C.MAX_PACKET and at + size <= len(data)
        out.append((at, time, data[at : at + size] if whole else None))
        at += size if whole else 1
    return out


def _salvaged(files: list[tuple[str, bytes]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Frames are taken one behind the other as if all were whole and decoded
    together; of a file's those up to the first that failed count, and the next
    turn goes on one byte behind it."""
    packet, turn = arrow.field("packet").type, [(name, data, 0, CHAIN) for name, data in files]
    while turn:
        taken = [(name, data, most, _candidates(data, at, most)) for name, data, at, most in turn]
        got = Decoded([f for *_, found in taken for *_, f in found])
        keep, turn, start = [], [], 0
        for name, data, most, found in taken:
            ok = got.ok[start : start + len(found)]
            good = len(found) if ok.all() else int(np.argmin(ok))
            keep += [(name, o, t, start + i) for i, (o, t, _) in enumerate(found[: good + 1])]
            start += len(found)
            if good < len(found):
                turn.append((name, data, found[good][0] + 1, SHORT))
            elif len(found) == most:
                turn.append((name, data, found[-1][0] + len(found[-1][2]), min(2 * most, CHAIN)))
        if not keep:
            continue
        chosen = pa.array([i for *_, i in keep], pa.int64())
        fields = [got.column(f.name, f.type).take(chosen) for f in packet]
        frames = pa.array([f if ok else None for f, ok in zip(got.frames, got.ok, strict=True)], pa.binary()).take(chosen)
        columns = [pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.int64()), pa.array([k[2] for k in keep], pa.int64()), frames, pa.StructArray.from_arrays(fields, fields=list(packet))]
        rows = pa.RecordBatch.from_arrays(columns, schema=arrow)
        yield from (rows.slice(i, BATCH) for i in range(0, rows.num_rows, BATCH))


def read_frames(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """SRC8: files that hold one frame each."""
    return _files(spark, paths).select("path", udf("decode_packet")("content").alias("packet"))


def read_batches(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """SRC9: the packets of batch files; a damaged batch is one row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                r, frames = C.Reader(bytes(data)), []
                try:
                    frames = [r.bytes(r.take("I")) for _ in range(r.take("H"))]
                    if not r.empty:
                        raise C.WireError("malformed_packet", "trailing batch bytes")
                except C.WireError:
                    frames = [None]
                yield pd.DataFrame([{"path": path, "position": i, "packet": p} for i, p in enumerate(packet_rows(frames))], columns=["path", "position", "packet"])

    return _files(spark, paths).mapInPandas(work, f"path string, position int, packet {PACKET}")


def archive_bytes(records: list[tuple[int, bytes]]) -> bytes:
    """An archive of (capture time, frame); the header has the least and the
    largest time."""
    times = [t for t, _ in records]
    out = [C.ARCHIVE_MAGIC, struct.pack("<IQQQ", 1, len(records), min(times, default=0), max(times, default=0))]
    for time, frame in records:
        record = struct.pack("<QI", time, len(frame)) + frame
        out += [record, struct.pack("<I", C.crc32c(record))]
    return b"".join(out)


def packed(frames: DataFrame, batch: bool = False) -> DataFrame:
    """(path, content): an archive, or a batch file, of the frames of each
    path of (path, place, capture_time_ns, frame), in order of place.

    A file is built in one task's memory, so its frames must be few: callers
    name files after runs of a stated length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, times, parts = None, [], []

        def done() -> bytes:
            if batch:
                return C.encode_batch(parts)
            header = struct.pack("<IQQQ", 1, len(parts), min(times) % (1 << 64), max(times) % (1 << 64))
            return b"".join([C.ARCHIVE_MAGIC, header, *parts])

        for rows in batches:
            names, at, made = (rows.column(c).to_pylist() for c in ("path", "capture_time_ns", "frame"))
            parts_ = made if batch else sealed(at, made)
            files: dict[str, list] = {"path": [], "content": []}
            start = 0
            while start < len(names):
                stop = start + 1
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                if names[start] != path:
                    if parts:
                        files["path"].append(path)
                        files["content"].append(done())
                    path, times, parts = names[start], [], []
                times += at[start:stop]
                parts += parts_[start:stop]
                start = stop
            yield pa.RecordBatch.from_pydict(files, FILE)
        if parts:
            yield pa.RecordBatch.from_pydict({"path": [path], "content": [done()]}, FILE)

    rows = frames.select("path", "place", "capture_time_ns", "frame").repartition("path").sortWithinPartitions("path", "place")
    return rows.select("path", "capture_time_ns", "frame").mapInArrow(work, "path string, content binary")
