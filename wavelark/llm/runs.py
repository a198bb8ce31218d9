"""Periodic runs of words by the runs theorem.

A run is a maximal stretch with period q that is at least twice q long. With
suffixes ranked under an order of the words and under its reverse (the end of
a text is least in the one and greatest in the other), every run holds a root:
the longest Lyndon word that begins at some position, which ends where the next
position of smaller rank lies. So at most two roots a position need a look:
each is extended to both sides by the longest common extension of its ends,
the least value of the LCP array between two ranks, which a sparse table gives.

Documents are independent, so tasks take them in Arrow batches without an
exchange; within a batch the words are numbers and all documents share one
suffix array, parted by separators that no suffix comparison passes. A run of
`least` words or more repeats some stretch of half as many: documents without
such a repeat, by hashes that may only err towards a look, have no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of

#: Words that share a suffix array, beyond a single document.
TOGETHER = 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's first one's place."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if full.all():
        return flat, offsets - offsets[0]
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]


class Suffixes:
    """Ranks of the suffixes of numbers that end with a separator, an element
    that occurs once, and common extensions of any two of them."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        order = np.argsort(x, kind="stable")
        head, size = _groups(x[order])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(head, size)
        # a rank is the place of its first suffix; only those that tie are sorted again
        tied, step, levels = order[np.repeat(size > 1, size)], 1, [rank]
        while tied.size:
            key = rank[tied] * n + rank[tied + step]
            by = np.argsort(key)
            tied, key = tied[by], key[by]
            old = rank[tied]
            outer, outer_size = _groups(old)
            head, size = _groups(key)
            rank = rank.copy()
            rank[tied] = old + np.repeat(head, size) - np.repeat(outer, outer_size)
            tied, step = tied[np.repeat(size > 1, size)], step * 2
            levels.append(rank)
        self.rank = rank
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        a, b = place[:-1].copy(), place[1:].copy()
        lcp = np.zeros(max(n - 1, 1), np.int32)
        for k in range(len(levels) - 2, -1, -1):
            more = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            lcp[: n - 1] += more.astype(np.int32)
            a += more
            b += more
        self.least = [lcp]
        while 2 * (half := 1 << (len(self.least) - 1)) <= len(lcp):
            below = self.least[-1]
            self.least.append(np.minimum(below[:-half], below[half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at i and j, different places, agree."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal elements begin, and their sizes."""
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(ordered)))


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one with a smaller rank; the last place for
    those that have none."""
    last = len(ranks) - 1
    found = [last] * len(ranks)
    for i in range(last - 1, -1, -1):
        r, j = ranks[i], i + 1
        while j < last and ranks[j] > r:
            j = found[j]
        found[i] = j
    return found


def find(codes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, in that order. codes has
    the documents' words as numbers from 0, one document after the other."""
    lengths = np.diff(offsets)
    count, n = len(lengths), int(offsets[-1] - offsets[0]) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    x = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    x[inside], x[ends] = codes[offsets[0] : offsets[-1]] + count, np.arange(count)
    forward, backward = Suffixes(x), Suffixes(np.append(x[:-1][::-1], x[-1]))
    # the end of a text is least in the first order and greatest in the second,
    # where a root that would reach it is none
    up = np.array(next_smaller(forward.rank.tolist()))
    turned = np.where(inside, n - forward.rank, -1)
    down = np.array(next_smaller(turned.tolist()))
    first, second = np.flatnonzero(inside), np.flatnonzero(inside & inside[down])
    root, stop = np.append(first, second), np.append(up[first], down[second])
    period = stop - root
    right = forward.extension(root, stop)
    long = np.maximum(least, 2 * period)
    # a word to the left must agree where the right side isn't enough
    some = (period + right >= long) | ((root > 0) & (x[root - 1] == x[stop - 1]))
    root, stop, period, right, long = root[some], stop[some], period[some], right[some], long[some]
    left = backward.extension(n - 1 - root, n - 1 - stop)
    length = left + period + right
    some = length >= long
    start, length, period = root[some] - left[some], length[some], period[some]
    found = np.unique(np.stack([start, length, period], 1), axis=0) if len(start) else np.zeros((0, 3), np.int64)
    order = np.lexsort((found[:, 2], found[:, 0]))
    start, length, period = found[order].T
    document = np.searchsorted(ends, start)
    begins = ends - lengths
    return document, start - begins[document], length, period


def repeating(codes: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether each document may hold the same `width` words twice: true for
    all that do, and by chance for others."""
    n, lengths = len(codes), np.diff(offsets)
    if n < width:
        return np.zeros(len(lengths), bool)
    document = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    with np.errstate(over="ignore"):
        value = _mixed(codes.astype(np.uint64) + np.uint64(1))
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + value[k : n - width + 1 + k]
        total = _mixed(total + document[: n - width + 1])
    whole = document[: n - width + 1] == document[width - 1 :]
    total, of = total[whole], document[: n - width + 1][whole]
    ordered = np.sort(total)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(lengths), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, total), len(twice) - 1)
        out[of[twice[at] == total].astype(np.int64)] = True
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _of_texts(texts: pa.Array, least: int) -> list[pa.Array]:
    flat, offsets = words(texts)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    looked = np.flatnonzero(repeating(codes, offsets, max(1, (least + 1) // 2)))
    lengths = np.diff(offsets)
    parts, held = [[]], 0
    for d in looked.tolist():
        if parts[-1] and held + lengths[d] > TOGETHER:
            parts.append([])
            held = 0
        parts[-1].append(d)
        held += lengths[d]
    runs, kept = [], np.ones(len(flat), bool)
    for part in filter(None, parts):
        own = np.concatenate([[0], np.cumsum(lengths[part])])
        numbers = np.concatenate([codes[offsets[d] : offsets[d + 1]] for d in part])
        numbers = np.unique(numbers, return_inverse=True)[1]
        document, start, length, period = find(numbers, own, least)
        document = np.array(part)[document]
        runs.append(np.stack([document, start, length, period]))
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, offsets[document] + start + period, 1)
        np.add.at(change, offsets[document] + start + length, -1)
        kept &= np.cumsum(change)[:-1] == 0
    document, start, length, period = np.concatenate(runs, 1) if runs else np.zeros((4, 0), np.int64)
    values = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(document, np.arange(len(lengths) + 1)), pa.int32()), values)
    places = np.concatenate([[0], np.cumsum(kept)])[offsets]
    left = pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat if kept.all() else flat.filter(pa.array(kept)))
    return [pa.array(lengths), lists, pc.binary_join(left, " ")]


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """docs with n_words, runs (array of start, length, period: word numbers
    from 0, by start, then period) and collapsed: the words that no run holds
    beyond its first period, joined by single spaces.

    Words are what lies between the six ASCII blanks. A run has at least `least`
    words and two periods. A null text has no words; so has an empty or blank
    one. Repeated rows get equal results. Columns of docs named n_words, runs or
    collapsed give way to these. One document's words and its suffix arrays
    (some 500 bytes a word) must fit a task.
    """
    if least < 1:
        raise ValueError("least must be positive")
    own = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            got = _of_texts(batch.column(batch.num_columns - 1).cast(pa.string()), least)
            arrays = [*batch.columns[:-1], *got]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    given = docs.select(*own, F.col(text_col).cast("string").alias("text to split"))
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL(SCHEMA).fields]))


def listed(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def longest(runs: Column) -> Column:
    """The longest run; of equal ones the first, then that of least period.
    Null where there is none."""
    order = lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))
    return F.array_min(F.transform(runs, order))
