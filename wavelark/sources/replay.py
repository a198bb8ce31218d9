"""SNK8: captured records as a stream, replayed in order of capture time.

The offset of the stream is a capture time: a batch holds the records of the
next stretch of it, so a restart goes on behind the last committed time and
gives every record once, and a batch that failed is read again as it was. With
preserved timing a stretch becomes readable when as much wall-clock time, times
the speed, has passed since the replay began, as its records took; without, at
once, `step_ns` of capture time a batch.

The folder is one that format("ath") writes: with its index a stretch reads the
blocks that may hold it and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.types import StructType

from . import ath


class Stretch(InputPartition):
    """A partition of the records from start to before end."""

    def __init__(self, start: int, end: int, ranges: ath.Range):
        self.start, self.end, self.ranges = start, end, ranges


class ReplayReader(DataSourceStreamReader):
    """Offsets: `next`, the capture time that a batch begins with, and `began`,
    the wall-clock time at which the replay began."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.speed = float(options.get("speed", 1.0))
        if self.speed <= 0:
            raise ValueError("replay speed must be positive")
        self.timed = options.get("preservetiming", "false").lower() == "true"
        self.step = int(options.get("stepns", 1 << 62))
        self._span: tuple[int, int] | None = None
        self._last: dict | None = None

    def _bounds(self) -> tuple[int, int]:
        """The window's first time and the one behind its last: inclusive options
        startNs and endNs, 0 for the archives' own."""
        if self._span is None:
            heads = ath.HeaderReader(self.options, ath.StructType())
            rows = [r for part in heads.partitions() for r in heads.read(part) if r[4]]
            first, last = min((r[5] for r in rows), default=0), max((r[6] for r in rows), default=-1)
            start, end = int(self.options.get("startns", 0)), int(self.options.get("endns", 0))
            self._span = max(first, start) if start else first, (min(last, end) if end else last) + 1
        return self._span

    def initialOffset(self) -> dict:
        self._last = {"next": self._bounds()[0], "began": time.time_ns()}
        return self._last

    def latestOffset(self) -> dict:
        first, end = self._bounds()
        last = self._last or self.initialOffset()
        reach = first + int((time.time_ns() - last["began"]) * self.speed) if self.timed else last["next"] + self.step
        self._last = {"next": max(last["next"], min(end, reach)), "began": last["began"]}
        return self._last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a restarted query plans its last batch before it asks for more
        self._last = self._last or end
        low, high = start["next"], end["next"]
        if low >= high:
            return []
        reader = ath.Reader(self.options, self.schema)
        list(reader.pushFilters([GreaterThanOrEqual(("capture_time_ns",), low), LessThan(("capture_time_ns",), high)]))
        return [Stretch(low, high, r) for r in reader.partitions()]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        reader = ath.Reader(self.options, self.schema)
        reader.bounds["capture_time_ns"] = (partition.start, partition.end - 1)
        for batch in reader.read(partition.ranges):
            at = batch.column("capture_time_ns")
            # damaged records have no place in time
            inside = pa.compute.and_(pa.compute.and_(pa.compute.greater_equal(at, partition.start), pa.compute.less(at, partition.end)), pa.compute.is_null(batch.column("corrupt")))
            yield batch.filter(inside)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ReplaySource(DataSource):
    """format("ath-replay"): options path, startNs, endNs (inclusive, 0: open),
    stepNs (capture time of a batch), preserveTiming and speed."""

    @classmethod
    def name(cls) -> str:
        return "ath-replay"

    def schema(self) -> str:
        return ath.RECORD

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(self.options, schema)


def stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The records of a folder's archives as a stream."""
    spark.dataSource.register(ReplaySource)
    return spark.readStream.format("ath-replay").options(**{k: str(v) for k, v in options.items()}).load(path)


def emit(spark: SparkSession, path: str, handler, checkpoint: str, **options: object) -> dict[str, int]:
    """SNK9: replays a window into handler(batch of records, number of the batch)
    and returns how many records and payload bytes it was given. A run that
    broke off goes on where its checkpoint stands."""
    told = {"emitted": 0, "bytes": 0}

    def each(batch: DataFrame, number: int) -> None:
        # decoded once, for the handler and for the counts
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            handler(batch, number)
            n, size = batch.agg(F.count("*"), F.coalesce(F.sum("payload_size"), F.lit(0))).first()
        finally:
            batch.unpersist()
        told["emitted"] += n
        told["bytes"] += size

    query = stream(spark, path, **options).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return told
