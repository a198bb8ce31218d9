"""format("ath"): capture archives as a data source, read by ranges of an index
and written in two phases.

Files are reached through pyarrow's filesystems, so a folder may be local
(shared by all nodes) or in an object store. Every commit leaves one Parquet
file below `_index` with a row per block of records: where it begins and ends in
its file and the least and largest time, device and payload size in it. Filters
on these columns choose blocks before anything is read, and records outside the
time range aren't decoded. Spark applies all filters again, so that an index
only ever spares work. Files without an index, or whose size isn't the one that
the index knows, are read as one range, in pieces of a bounded size.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import codec as C
from ..functions.frames import Decoded, sealed
from ..functions.udfs import signed

HEADER = 36
#: Bytes that a reader asks for at a time, a writer keeps before it begins a
#: file's body, an index block covers, and a partition reads; rows of a batch.
PIECE, KEPT, BLOCK, PARTITION, ROWS = 4 << 20, 64 << 20, 1 << 20, 32 << 20, 8192
RECORD = (
    "archive_path string, archive_ordinal long, offset long, capture_time_ns long, corrupt string, device long, timestamp_ns long, kind string, sequence long, "
    "fragment struct<stream_id:long,sequence:int,count:int>, route struct<region:int,collector:int,priority:int,relay_path:array<int>>, "
    "capabilities struct<compression:boolean,encryption:boolean,gps_time:boolean,max_payload:int,sensor_bands:array<string>>, payload binary, payload_size long"
)
#: What may be read besides, with a schema of the caller's: the record's bytes.
FRAME = "frame binary"
HEADERS = "archive_path string, archive_ordinal long, bytes long, format_version int, records long, first_time_ns long, last_time_ns long"
#: Index columns that filters are held against.
_BOUNDED = {"capture_time_ns": "time", "device": "device", "payload_size": "payload"}
INDEX = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("records", pa.int64()), *[(f"{end}_{name}", pa.int64()) for name in _BOUNDED.values() for end in ("least", "most")]])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def archive_files(where: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The archives at a path: the file, or those of the folder, by name."""
    at = where.get_file_info(path)
    if at.type == fs.FileType.File:
        return [at]
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and f.extension == "ath"), key=lambda f: f.base_name)


@dataclass
class Piece:
    """Records of a stretch of a file: rows of (offset, capture time, frame, what
    is wrong), of the whole ones their bytes and stated checksums; whether
    another piece follows."""

    rows: list[tuple[int, int, bytes, str | None]]
    records: list[bytes]
    stated: list[int]
    more: bool


def pieces(f: pa.NativeFile, start: int, stop: int, size: int) -> Iterator[Piece]:
    """The records from start to stop in a file of so many bytes, up to the first
    whose length or extent is wrong; checksums aren't looked at. Holds one piece,
    or one record, at a time."""
    if start == 0:
        f.seek(0)
        if f.read(8) != C.ARCHIVE_MAGIC:
            yield Piece([(0, 0, b"", "archive magic mismatch")], [], [], False)
            return
        start = HEADER
    at, head = start, struct.Struct("<qI").unpack_from
    while at < stop:
        f.seek(at)
        data, rows, records, stated, wrong, pos = f.read(min(PIECE, size - at)), [], [], [], None, 0
        while at + pos < stop:
            if pos + 12 > len(data):
                wrong = "truncated archive record" if at + pos + 12 > size else None
                break
            time, length = head(data, pos)
            end = pos + 12 + length
            if length > C.MAX_PACKET or at + end + 4 > size:
                wrong = "archive record frame exceeds packet size limit" if length > C.MAX_PACKET else "archive record is truncated"
                rows.append((at + pos, time, b"", wrong))
                break
            if end + 4 > len(data):
                break
            records.append(data[pos:end])
            stated.append(int.from_bytes(data[end : end + 4], "little"))
            rows.append((at + pos, time, data[pos + 12 : end], None))
            pos = end + 4
        if wrong == "truncated archive record":
            rows.append((at + pos, 0, b"", wrong))
        yield Piece(rows, records, stated, wrong is None and at + pos < stop)
        if wrong:
            return
        at += pos


def checked(held: list[Piece]) -> list[tuple[list[tuple[int, int, bytes, str | None]], bool]]:
    """The rows of pieces up to the first damaged record of each, and whether a
    piece has one; all checksums are computed together."""
    sums = C.crc32c_many([r for p in held for r in p.records])
    bad = sums != np.fromiter((s for p in held for s in p.stated), np.uint32, len(sums))
    out, start = [], 0
    for p in held:
        own = bad[start : start + len(p.records)]
        start += len(p.records)
        n = int(np.argmax(own)) if own.any() else None
        rows = p.rows if n is None else [*p.rows[:n], (p.rows[n][0], p.rows[n][1], b"", "archive record crc mismatch")]
        out.append((rows, bool(rows) and rows[-1][3] is not None))
    return out


def walk(f: pa.NativeFile, start: int, stop: int, size: int) -> Iterator[list[tuple[int, int, bytes, str | None]]]:
    """Lists of (offset, capture time, frame, what is wrong) of the records from
    start to stop in a file of so many bytes; ends at the first damaged one."""
    for piece in pieces(f, start, stop, size):
        rows, damaged = checked([piece])[0]
        yield rows
        if damaged:
            return


@dataclass
class Range(InputPartition):
    """Ranges of files that one task reads: (path, ordinal, start, stop, size)."""

    parts: list[tuple[str, int, int, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.most = int(options.get("partitionbytes", PARTITION))
        self.bounds: dict[str, tuple[int | None, int | None]] = {}

    def _narrow(self, column: str, low: int | None, high: int | None) -> None:
        a, b = self.bounds.get(column, (None, None))
        self.bounds[column] = (a if low is None else low if a is None else max(a, low), b if high is None else high if b is None else min(b, high))

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name in _BOUNDED and isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
                self._narrow(name, min(f.value), max(f.value))
            elif name in _BOUNDED and isinstance(value, int):
                if isinstance(f, EqualTo):
                    self._narrow(name, value, value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._narrow(name, value, None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._narrow(name, None, value)
            yield f  # Spark applies it again

    def partitions(self) -> list[Range]:
        where, path = opened(self.path)
        files = archive_files(where, path)
        known = self._blocks(where, path)
        parts: list[tuple[str, int, int, int, int]] = []
        for ordinal, f in enumerate(files):
            sizes, blocks = known.get(f.base_name, (None, []))
            if sizes != f.size:
                blocks = [(0, f.size)]
            for start, stop in sorted(blocks):
                last = parts[-1] if parts else None
                if last and last[0] == f.path and last[3] == start and stop - last[2] <= self.most:
                    parts[-1] = (f.path, ordinal, last[2], stop, f.size)
                else:
                    parts.append((f.path, ordinal, start, stop, f.size))
        out, held = [], 0
        for part in parts:
            size = part[3] - part[2]
            if not out or held + size > self.most:
                out.append(Range([]))
                held = 0
            out[-1].parts.append(part)
            held += size
        return out or [Range([])]

    def _blocks(self, where: fs.FileSystem, path: str) -> dict[str, tuple[int, list[tuple[int, int]]]]:
        """Per indexed file its size and the blocks that filters leave."""
        if not where.get_file_info(f"{path}/_index").type == fs.FileType.Directory:
            return {}
        index = ds.dataset(f"{path}/_index", INDEX, "parquet", filesystem=where)
        chosen = None
        for column, (low, high) in self.bounds.items():
            name = _BOUNDED[column]
            for test in ([] if low is None else [ds.field(f"most_{name}") >= low]) + ([] if high is None else [ds.field(f"least_{name}") <= high]):
                chosen = test if chosen is None else chosen & test
        sizes = index.to_table(columns=["path", "bytes"]).group_by("path").aggregate([("bytes", "max")]).to_pylist()
        out: dict[str, tuple[int, list]] = {r["path"]: (r["bytes_max"], []) for r in sizes}
        for r in index.to_table(columns=["path", "start", "stop"], filter=chosen).to_pylist():
            out[r["path"]][1].append((r["start"], r["stop"]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        where, _ = opened(self.path)
        held: list[tuple[str, int, Piece]] = []
        size = 0
        for path, ordinal, start, stop, whole in partition.parts:
            name = path.rpartition("/")[2]
            with where.open_input_file(path) as f:
                for piece in pieces(f, start, stop, whole):
                    held.append((name, ordinal, piece))
                    size += sum(map(len, piece.records))
                    # small files wait for others, a large one's next piece depends on this one
                    if piece.more or size >= PIECE:
                        rows, damaged = self._taken(held)
                        yield from self._batches(rows, arrow)
                        held, size = [], 0
                        if damaged:
                            break
        yield from self._batches(self._taken(held)[0], arrow)

    def _taken(self, held: list[tuple[str, int, Piece]]) -> tuple[list[tuple], bool]:
        """Rows (name, ordinal, offset, time, frame, what is wrong) within the
        bounds of time, and whether the last piece has a damaged one."""
        low, high = self.bounds.get("capture_time_ns", (None, None))
        out, damaged = [], False
        for (name, ordinal, _), (rows, damaged) in zip(held, checked([p for *_, p in held]), strict=True):
            if damaged and self.strict:
                raise ValueError(f"{name}: {rows[-1][3]}")
            out += [(name, ordinal, *r) for r in rows if r[3] or ((low is None or r[1] >= low) and (high is None or r[1] <= high))]
        return out, damaged

    def _batches(self, rows: list[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            got = Decoded([None if r[5] else r[4] for r in part])
            wrong = [r[5] or e for r, e in zip(part, got.errors(), strict=True)]
            if self.strict and not got.ok.all():
                n = int(np.argmin(got.ok))
                raise ValueError(f"{part[n][0]}: {wrong[n]}")
            own = {"archive_path": 0, "archive_ordinal": 1, "offset": 2, "capture_time_ns": 3}
            columns = []
            for f in arrow:
                if f.name in own:
                    columns.append(pa.array([r[own[f.name]] for r in part], f.type))
                elif f.name == "corrupt":
                    columns.append(pa.array(wrong, f.type))
                elif f.name == "frame":
                    columns.append(pa.array([None if w else r[4] for r, w in zip(part, wrong, strict=True)], f.type))
                else:
                    columns.append(got.column(f.name, f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)


class HeaderReader(DataSourceReader):
    """What the headers of archives state: 36 bytes of each file are read."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema

    def partitions(self) -> list[Range]:
        parts = [(f.path, n, 0, HEADER, f.size) for n, f in enumerate(archive_files(*opened(self.path)))]
        return [Range(parts[i : i + 1024]) for i in range(0, max(len(parts), 1), 1024)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, _ = opened(self.path)
        for path, ordinal, _, _, size in partition.parts:
            with where.open_input_file(path) as f:
                head = f.read(HEADER)
            version, count, first, last = struct.unpack_from("<IQQQ", head.ljust(HEADER, b"\0"), 8)
            yield path.rpartition("/")[2], ordinal, size, version, signed(count), signed(first), signed(last)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, (temporary path, name), and their index rows."""

    files: list[tuple[str, str]] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=list)


def _records(times: list[int], frames: list[bytes]) -> Iterator[tuple[int, bytes, tuple[int, int], tuple[int, int]]]:
    """Per frame what _File.put takes."""
    got = Decoded(frames)
    # what can't be decoded may be anything, so no filter may pass it over
    devices = [(d, d) if ok else (-(1 << 63), (1 << 63) - 1) for d, ok in zip(got.numbers("device").tolist(), got.ok, strict=True)]
    sizes = [(n, n) if ok else (0, 1 << 62) for n, ok in zip(got.sizes().tolist(), got.ok, strict=True)]
    return zip(times, sealed(times, frames), devices, sizes, strict=True)


class _File:
    """One archive as it is written: kept in memory at first, its body beside it
    once that is too large, for the header comes first and is known last."""

    def __init__(self, where: fs.FileSystem, path: str, block: int):
        self.where, self.path, self.block = where, path, block
        self.kept, self.size, self.body, self.at = [], 0, None, HEADER
        self.count, self.least, self.most = 0, 0, 0
        self.blocks: list[dict] = []

    def add(self, time: int, frame: bytes) -> None:
        self.put(*next(_records([time], [frame])))

    def put(self, time: int, record: bytes, device: tuple[int, int], payload: tuple[int, int]) -> None:
        """One record, and the least and largest device and payload size that
        it may have."""
        self.least, self.most = (min(self.least, time), max(self.most, time)) if self.count else (time, time)
        self.count += 1
        if not self.blocks or self.blocks[-1]["stop"] - self.blocks[-1]["start"] >= self.block:
            self.blocks.append({"start": self.at, "stop": self.at, "records": 0, "least_time": time, "most_time": time, "least_device": device[0], "most_device": device[1], "least_payload": payload[0], "most_payload": payload[1]})
        b = self.blocks[-1]
        self.at += len(record)
        b["stop"], b["records"] = self.at, b["records"] + 1
        for name, low, high in (("time", time, time), ("device", *device), ("payload", *payload)):
            if low < b[f"least_{name}"]:
                b[f"least_{name}"] = low
            if high > b[f"most_{name}"]:
                b[f"most_{name}"] = high
        self.kept.append(record)
        self.size += len(record)
        if self.size > KEPT:
            self.body = self.body or self.where.open_output_stream(f"{self.path}.body")
            self.body.write(b"".join(self.kept))
            self.kept, self.size = [], 0

    def close(self) -> None:
        header = C.ARCHIVE_MAGIC + struct.pack("<IQQQ", 1, self.count, self.least % (1 << 64), self.most % (1 << 64))
        if self.body:
            self.body.write(b"".join(self.kept))
            self.body.close()
        with self.where.open_output_stream(self.path) as out:
            out.write(header)
            if self.body:
                with self.where.open_input_stream(f"{self.path}.body") as back:
                    while piece := back.read(PIECE):
                        out.write(piece)
                self.where.delete_file(f"{self.path}.body")
            else:
                out.write(b"".join(self.kept))

    def verify(self) -> None:
        """The file holds what was written, read again from its store."""
        count = 0
        with self.where.open_input_file(self.path) as f:
            for rows in walk(f, 0, self.at, f.size()):
                wrong = next((w for *_, w in rows if w), None)
                if wrong:
                    raise OSError(f"{self.path}: {wrong} after writing")
                count += len(rows)
            if count != self.count or f.size() != self.at:
                raise OSError(f"{self.path}: {count} records and {f.size()} bytes after writing {self.count} and {self.at}")


class Writer(DataSourceArrowWriter):
    """Tasks write below `_temporary/<job>` and read their files back; the commit
    moves them, and the index of the job becomes visible last."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.named = "archive_path" in schema.names
        self.block = int(options.get("blockbytes", BLOCK))
        self.most = int(options.get("filebytes", 1 << 30))
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, path = opened(self.path)
        where.create_dir(f"{path}/_temporary/{self.job}", recursive=True)
        out, now, name = Written(), None, None

        def end() -> None:
            now.close()
            now.verify()
            out.files.append((now.path, name))
            out.blocks += [{"path": name, "bytes": now.at} | b for b in now.blocks]

        for batch in batches:
            times, frames = batch.column("capture_time_ns").to_pylist(), batch.column("frame").to_pylist()
            wishes = batch.column("archive_path").to_pylist() if self.named else None
            for n, record in enumerate(_records(times, frames)):
                wish = wishes[n] if wishes else name if now and now.at < self.most else f"part-{self.job[:8]}-{task.partitionId():05d}-{len(out.files) + (now is not None):03d}.ath"
                if now is None or wish != name:
                    if now:
                        end()
                    now, name = _File(where, f"{path}/_temporary/{self.job}/{task.taskAttemptId()}-{len(out.files)}", self.block), wish
                now.put(*record)
        if now:
            end()
        return out

    def commit(self, messages: list) -> None:
        where, path = opened(self.path)
        done = [m for m in messages if m]
        twice = [n for n, k in Counter(name for m in done for _, name in m.files).items() if k > 1]
        if twice:
            raise ValueError(f"an archive's rows are in several places: {sorted(twice)[:3]}")
        if self.overwrite and where.get_file_info(path).type == fs.FileType.Directory:
            for f in archive_files(where, path):
                where.delete_file(f.path)
            if where.get_file_info(f"{path}/_index").type == fs.FileType.Directory:
                where.delete_dir(f"{path}/_index")
        for m in done:
            for temporary, name in m.files:
                where.move(temporary, f"{path}/{name}")
        blocks = [b for m in done for b in m.blocks]
        if blocks:
            where.create_dir(f"{path}/_index", recursive=True)
            made = f"{path}/_temporary/{self.job}/index"
            pq.write_table(pa.Table.from_pylist(blocks, INDEX), made, filesystem=where)
            where.move(made, f"{path}/_index/{self.job}.parquet")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, path = opened(self.path)
        if where.get_file_info(f"{path}/_temporary/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{path}/_temporary/{self.job}")


class ArchiveSource(DataSource):
    """Reads a folder of archives, or one; options mode (PERMISSIVE keeps a
    damaged record as a row with `corrupt` and goes on with the next range,
    FAILFAST fails) and partitionBytes. Writes (capture_time_ns, frame), with
    archive_path into files of that name, whose rows then must come in one
    partition, sorted by it; options blockBytes and fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "ath"

    def schema(self) -> str:
        return HEADERS if self.options.get("part") == "headers" else RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options, schema) if self.options.get("part") == "headers" else Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("ath") known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def load(spark: SparkSession, path: str, mode: str = "PERMISSIVE", columns: str | None = None, **options: str) -> DataFrame:
    """SRC1: the records of archives; columns (a schema) chooses among RECORD and
    FRAME what tasks hand over."""
    register(spark)
    reader = spark.read.format("ath").options(mode=mode, **options)
    return (reader.schema(columns) if columns else reader).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("ath").option("part", "headers").load(path)


def write(frames: DataFrame, folder: str, mode: str = "append", **options: str) -> None:
    """SNK1: archives of (capture_time_ns, frame) below folder, or of
    (archive_path, capture_time_ns, frame) into files of these names, in order
    of the column place if there is one."""
    register(frames.sparkSession)
    if "archive_path" in frames.columns:
        order = [c for c in ("archive_path", "place") if c in frames.columns]
        frames = frames.repartition("archive_path").sortWithinPartitions(*order).select("archive_path", "capture_time_ns", "frame")
    else:
        frames = frames.select("capture_time_ns", "frame")
    frames.write.format("ath").mode(mode).options(**options).save(folder)
