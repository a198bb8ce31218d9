"""Benchmark decontamination with an Aho-Corasick automaton.

Items and documents are normalised alike: A-Z to lower case, every other
ASCII character but 0-9 and a-z to a space. Normalising keeps byte positions,
so an offset in the scanned text is one in the original. The automaton holds
the windows of all items, each between spaces; a document is scanned once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, keyed, rows_of, staged, utf8, without

#: UTF-8 bytes of benchmark text in one automaton (some 40 bytes of memory for
#: each byte of each window, windows overlapping tenfold). More text goes into
#: more automata, a pass over the documents for each.
SHARD_BYTES = 500_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SPANS = "spans array<struct<start: long, end: long>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows(item: bytes | None, size: int) -> set[bytes]:
    """The item's windows of size consecutive words; fewer words are one."""
    w = words(item)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


class Scanner:
    """An automaton over the windows of (item name, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(name)
        self.automaton = ahocorasick.Automaton()
        for w, names in owners.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, names))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words [first, end), disjoint and in order; item names."""
        if self.empty or not w:
            return [], set()
        joined = b" " + b" ".join(w) + b" "
        found = list(self.automaton.iter(joined.decode("latin-1")))
        if not found:
            return [], set()
        before = np.cumsum(np.frombuffer(joined, np.uint8) == 32)
        mark = np.zeros(len(w) + 1, np.int64)
        names: set[str] = set()
        for at, (n, owners) in found:
            end = before[at] - 1
            mark[end - n] += 1
            mark[end] -= 1
            names |= owners
        hit = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
        edges = np.nonzero(hit[1:] != hit[:-1])[0].tolist()
        return list(zip(edges[::2], edges[1::2], strict=True)), names


def character_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Code-point offsets in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_TABLE))]
    out, done, chars = [], 0, 0
    for first, end in runs:
        pair = []
        for byte in (at[first][0], at[end - 1][1]):
            chars += len(text[done:byte].decode("utf-8", "replace"))
            done = byte
            pair.append(chars)
        out.append({"start": pair[0], "end": pair[1]})
    return out


def sha_of(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is size consecutive words of an item (all words of a shorter
    one). Texts that are null or have no words hit nothing, and such items
    have no windows. Repeated rows stay rows; items that share an id count
    once; an item without an id is named by the empty string. An empty
    benchmark contaminates nothing. spans are code-point offsets [start, end)
    in the original text of the runs of hit words.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, ceil(total / shard_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spark = docs.sparkSession

    def scanner(shard: int):
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(shards)) == shard)
        return spark.sparkContext.broadcast([(r.name, bytes(r.text) if r.text is not None else None) for r in mine.collect()])

    if shards == 1:
        held = scanner(0)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scanner(held.value, size)
            for b in rows_of(batches):
                out: list[list] = [[], [], [], [], [], []]
                for text in utf8(b.column(1)):
                    w = words(text)
                    runs, names = scan.scan(w)
                    n_hit = sum(y - x for x, y in runs)
                    for column, value in zip(out, (len(w), n_hit, len(names), sha_of(names), n_hit > 0, character_spans(text or b"", runs)), strict=True):
                        column.append(value)
                spans = pa.array(out[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_()), spans],
                    names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

        found = rows.mapInArrow(work, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, {SPANS}")
        return found.withColumnRenamed("id", id_col)

    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    def passes(held) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scanner(held.value, size)
            for b in rows_of(batches):
                out: list[list] = [[], [], [], []]
                for row, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    w = words(text)
                    runs, names = scan.scan(w)
                    for column, value in zip(out, (row, len(w), [{"start": x, "end": y} for x, y in runs], sorted(names)), strict=True):
                        column.append(value)
                pairs = pa.array(out[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pairs, pa.array(out[3], pa.list_(pa.string()))], names=["row", "n_words", "runs", "names"])

        return rows.select("row", "text").mapInArrow(work, "row long, n_words long, runs array<struct<start: long, end: long>>, names array<string>")

    hits = passes(scanner(0))
    for shard in range(1, shards):
        hits = hits.unionByName(passes(scanner(shard)))
    merged = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    merged = merged.join(rows, "row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            n_hit, spans = [], []
            for text, runs in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                joined: list[list[int]] = []
                for x, y in sorted((r["start"], r["end"]) for r in runs):
                    if joined and x <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], y)
                    else:
                        joined.append([x, y])
                n_hit.append(sum(y - x for x, y in joined))
                spans.append(character_spans(text or b"", [(x, y) for x, y in joined]))
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(n_hit, pa.int64()), b.column(4), b.column(5), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, kinds)], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    parts = merged.select("id", "text", "runs", "n_words", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"))
    return parts.mapInArrow(finish, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, {SPANS}").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES, scan: bool = False) -> DataFrame:
    """The rows of docs that contamination wouldn't mark, unchanged."""
    key = free_name(docs, "row")
    rows = keyed(docs, key, scan)
    found = contamination(rows.select(F.col(key).alias("id"), F.col(text_col).alias("text")), benchmark, size, "id", "text", item_col, item_text_col, shard_bytes)
    return without(rows, key, found.where("contaminated").select(F.col("id").alias(key))).select(*docs.columns)
