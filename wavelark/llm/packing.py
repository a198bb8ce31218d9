"""Best-fit packing by exact-complement hashing.

Lengths are numbers up to the capacity, so how often each occurs is all that
planning needs: at most `capacity` counts, summed by Spark, reach the driver.
The plan is a list of patterns (lengths that share a sequence) with how many
sequences use each. A pattern starts with the longest length left; its gap is
filled exactly by one, two or three lengths that are still available, looked
up in indexes of single lengths, pair sums and triple sums; where none fills
it, the longest length that fits goes in (best fit) and the rest of the gap is
looked up again. Each pattern is used as often as the counts allow, which
exhausts a length, so the plan is bounded by the capacity as well. Pieces then
find their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, staged
from .tokens import word_coder

PIECES = "row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): documents as token ids,
    closed by id 0, those beyond capacity cut. row numbers the documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, width = word_coder(tokenizer), 4 * capacity
        for b in rows_of(batches, 512):
            out: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column(2).to_pylist()):
                ids = coder.encode(text or "") + b"\0\0\0\0"
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, value in zip(out, (i, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            picked = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(picked), b.column(1).take(picked), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
                names=["id", "row", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, {PIECES}")


class Planner:
    """Consumes counts of lengths; left[n] pieces of length n remain."""

    #: Lengths that may run out before the pair sums are indexed anew. An old
    #: index lists too many sums, never too few.
    STALE = 24

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.indexed, self.pair_sums = -1, np.zeros(0, bool)

    def _index(self) -> None:
        there = self.left > 0
        present = int(there.sum())
        if self.indexed < 0 or self.indexed - present > self.STALE:
            sums = np.rint(np.fft.irfft(np.fft.rfft(there.astype(float), 2 * len(there)) ** 2))
            self.indexed, self.pair_sums = present, sums[: self.capacity + 1] > 0

    def pair(self, gap: int, free: np.ndarray) -> list[int] | None:
        """Two available lengths of that sum, as unequal as possible."""
        low = np.nonzero(free[: gap // 2 + 1] > 0)[0]
        ok = (free[gap - low] > 0) & ((low * 2 < gap) | (free[low] > 1))
        return [gap - int(low[i]), int(low[i])] if len(low) and ok[i := int(np.argmax(ok))] else None

    def complement(self, gap: int, held: dict[int, int]) -> list[int] | None:
        """One to three available lengths that add up to gap exactly."""
        free = self.left.copy()
        for length, n in held.items():
            free[length] -= n
        if free[gap] > 0:
            return [gap]
        if not self.pair_sums[gap]:
            two = None
        elif two := self.pair(gap, free):
            return two
        first = np.nonzero(free[:gap] > 0)[0]
        for a in first[self.pair_sums[gap - first]][::-1].tolist():
            free[a] -= 1
            two = self.pair(gap - a, free)
            free[a] += 1
            if two:
                return [a, *two]
        return None

    def patterns(self) -> Iterator[tuple[list[int], int]]:
        """(lengths in falling order, number of sequences)."""
        while (there := np.nonzero(self.left > 0)[0]).size:
            self._index()
            chosen = [int(there[-1])]
            held = {chosen[0]: 1}
            gap = self.capacity - chosen[0]
            while gap > 0:
                more = self.complement(gap, held)
                if more is None:
                    fit = [n for n in there[: np.searchsorted(there, gap, side="right")].tolist() if self.left[n] > held.get(n, 0)]
                    if not fit:
                        break
                    more = [fit[-1]]
                for n in more:
                    held[n] = held.get(n, 0) + 1
                chosen += more
                gap -= sum(more)
            times = min(int(self.left[n]) // k for n, k in held.items())
            for n, k in held.items():
                self.left[n] -= k * times
            yield sorted(chosen, reverse=True), times


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks: the pieces of `length` with ranks from `rank` on, `each`
    to a sequence, are at `offset` of the sequences from `sequence` on."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, times in Planner(counts, capacity).patterns():
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, from 0, among the rows of their length: numbers within
    a hashed part of the length, plus what the parts before it hold."""
    total = rows.count()
    parts = max(1, ceil(sqrt(total)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "piece")) - 1
    return rows.join(sizes, ["length", "part"]).withColumn("rank", (F.col("before") + number).cast("long")).drop("part", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is a document, repeated rows and rows without an id included; a
    null text is as an empty one, a single id 0. An empty table gives none.
    """
    rows = staged(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    held = docs.sparkSession.sparkContext.broadcast(runs)
    rows = ranked(rows).select("id", "piece", "start", "length", "ids_crc32", "rank")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = held.value
        keys = (runs["length"] << 44) + runs["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
            after = rank - runs["rank"][at]
            sequence = runs["sequence"][at] + after // runs["each"][at]
            offset = runs["offset"][at] + after % runs["each"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
