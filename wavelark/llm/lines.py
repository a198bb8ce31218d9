"""Line dedup by a segment-partition edit-distance join.

Of two lines that differ by at most MAX_EDITS = 2 edits, the shorter one is
split into three segments, of which an edit-free one occurs in the other line:
the first at its start, the last at its end, the middle one (if the outer two
hold an edit each) at most one place aside. Indexes of segments are kept apart
by length class; a line is listed in its own class and probes the classes of
lines one and two characters shorter. A cell is one segment of one class.

Cells are found in two passes over hashes, without texts: the first leaves the
cells that hold different lines, the second lists who is in them. In a cell of
many comparisons the shared segment is cut out and what remains of its lines
is partitioned again, below that cell. Classes too short for segments have cells
by characters, which hold links only; lines of two characters at most are all
linked and are counted, not paired. Lines of one cell meet if their lengths
and the parities of their character pairs allow it (an edit changes four
parities at most), and are verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, free_name, keyed, parted, rows_of, scope, split, staged, union

MAX_EDITS = 2
#: Comparisons in a cell beyond which it is partitioned again.
CELL_PAIRS = 1 << 16

WORD = 64
BITS = tuple(f"bits{i}" for i in range(4))
BLANKS = " \t\r\v\f"


def _rows(a: str, b: str) -> int:
    """Edit distance by rows; for strings of a few characters."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def distance(a: str, b: str, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is larger.

    After the common ends are cut, a word of WORD bits moves down the band's
    diagonal: its top bit is the row `most` below the column's own, so the bits
    hold the vertical differences of all rows that a distance of `most` can
    reach.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    while end < len(b) and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) <= most:
        return _rows(a, b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << WORD) - 1, 1 << (WORD - 1)
    plus, minus, score, level = full ^ ((1 << (WORD - most - 1)) - 1), 0, most, top >> 1
    for i, c in enumerate(b):
        shift = i + most + 1 - WORD
        match = where.get(c, 0)
        match = (match >> shift if shift > 0 else match << -shift) & full
        zero = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(zero | plus) & full, zero & plus
        if i < len(a) - most:
            score += not zero & top
        else:  # the last row lies inside the word from here on
            score += bool(up & level) - bool(down & level)
            level >>= 1
        if score > most + len(b) - len(a) + most:
            return most + 1
        zero = (zero & full) >> 1
        plus, minus = down | ~(zero | up) & full, zero & up
    return min(score, most + 1)


# How a line is listed: by its first segment, the middle one, the last one, or
# the middle one a place further on; below three characters by characters.
_FIRST, _MIDDLE, _LAST, _ASIDE, _SHORT, _ALL = range(6)


def _short(n: Column, rest: Column) -> Column:
    """Names of the cells in which a rest of n <= 4 characters meets those of one
    or two characters within two edits of it, from which it differs in length.

    Three characters meet one that they hold, and two of which the first is
    their first or second or the second their second or third. Four meet the
    two that are left when two of them go.
    """
    at = lambda i: F.substring(rest, i, 1)
    name = lambda kind, *chars: F.concat(F.lit(kind), *chars)
    two = [name("=", at(1), at(2)), name("<", at(1)), name(">", at(2))]
    three = [name("1", at(i)) for i in (1, 2, 3)] + [name("<", at(i)) for i in (1, 2)] + [name(">", at(i)) for i in (2, 3)]
    four = [name("=", at(i), at(j)) for i in (1, 2, 3) for j in range(i + 1, 5)]
    of = lambda names: F.array_distinct(F.array(*names))
    return F.when(n == 1, of([name("1", at(1))])).when(n == 2, of(two)).when(n == 3, of(three)).when(n == 4, of(four))


def listed(rows: DataFrame, brief: bool = True) -> DataFrame:
    """(key, cell, line, spot, own, at, size) of rows (key, line, rest): the
    cells of a rest below key, and where the segment lies in it. own tells that
    the class is that of the rest's length; if not, the rest probes it.

    A class is named by its shortest length and spans an eighth to a sixteenth
    of it; lengths up to 15 have their own. Rests of MAX_EDITS characters at
    most share a cell; brief=False leaves that one out.
    """
    lowest = lambda n: n - F.pmod(n, F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(n)) - 4, F.lit(0))))
    rows = rows.withColumn("n", F.length("rest"))
    named = rows.where("n BETWEEN 1 AND 4").select("key", "line", "n", F.explode(_short(F.col("n"), F.col("rest"))).alias("name"))
    short = named.select("key", F.xxhash64("key", F.lit(_SHORT), "name").alias("cell"), "line", F.lit(_SHORT).alias("spot"), (F.col("n") <= MAX_EDITS).alias("own"), F.lit(0).alias("at"), F.lit(0).alias("size"))
    if brief:
        alike = rows.where(F.col("n") <= MAX_EDITS)
        short = short.union(alike.select("key", F.xxhash64("key", F.lit(_ALL)).alias("cell"), "line", F.lit(_ALL).alias("spot"), F.lit(True).alias("own"), F.lit(0).alias("at"), F.lit(0).alias("size")))
    rows = rows.select("*", F.posexplode(F.array(*[F.col("n") - less for less in range(MAX_EDITS + 1)])).alias("less", "m"))
    rows = rows.withColumn("low", lowest(F.col("m"))).where("low >= 3").where((F.col("less") == 0) | (F.col("low") != lowest(F.col("m") + 1)))
    rows = rows.withColumn("third", F.floor(F.col("low") / 3).cast("int")).withColumn("middle", F.col("low") - 2 * F.col("third") - 1)
    rows = rows.select("*", F.explode(F.array(*[F.lit(spot) for spot in range(4)])).alias("spot"))
    spot = F.col("spot")
    rows = rows.where((spot != _ASIDE) | (F.col("middle") > 0))
    at = F.when(spot == _FIRST, 0).when(spot == _LAST, F.col("n") - F.col("third")).otherwise(F.col("third") + (spot == _ASIDE).cast("int"))
    rows = rows.withColumn("at", at).withColumn("size", F.when(spot.isin(_FIRST, _LAST), F.col("third")).otherwise(F.col("middle")))
    kind = F.when(spot == _ASIDE, _MIDDLE).otherwise(spot)
    cell = F.xxhash64("key", "low", kind, F.substring(F.col("rest"), F.col("at") + 1, F.col("size")))
    return rows.select("key", cell.alias("cell"), "line", "spot", (F.col("less") == 0).alias("own"), "at", "size").union(short)


def live(cells: DataFrame) -> DataFrame:
    """The cells that hold different lines, some as their own class; cells by
    characters must hold lines of other classes too."""
    other = ~F.col("own") | (F.col("spot") != _SHORT)
    held = cells.groupBy("cell").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.max("own").alias("own"), F.max(other).alias("other"))
    return held.where("lo < hi AND own AND other").select("cell")


def parities(texts: DataFrame) -> DataFrame:
    """texts (line, digest, text) with their length n and bits0 to bits3: bit h
    is the parity of the number of neighbouring characters with hash h."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            sizes, bits = np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, 4), np.int64)
            for i, text in enumerate(b.column(2).to_pylist()):
                c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                pairs = (c[:-1] << np.uint64(32) | c[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
                odd = np.bincount(pairs.astype(np.int64), minlength=256) & 1
                sizes[i], bits[i] = len(c), np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), *map(pa.array, bits.T.copy())], names=["line", "digest", "text", "n", *BITS])

    return texts.select("line", "digest", "text").mapInArrow(work, "line long, digest binary, text string, n int, " + ", ".join(f"{c} long" for c in BITS))


def candidates(cells: DataFrame, texts: DataFrame, most: int = CELL_PAIRS) -> DataFrame:
    """(a, b), a < b: lines of texts (line, text, n, bits0, ...) that share one of
    the cells (key, cell, line, spot, own, at, size), or one below it."""
    marks, rests = texts.select("line", "n", *BITS), texts.select(F.lit(0).cast("long").alias("key"), "line", F.col("text").alias("rest"))
    found = []
    while True:
        count = cells.groupBy("cell").agg(F.count_if(F.col("spot") != _ASIDE).alias("x"), F.count("*").alias("y"))
        cells = staged(cells.join(count, "cell").withColumn("large", (F.col("x") * F.col("y") > most) & (F.col("size") > 0)), "cells")
        few = cells.where(~F.col("large")).select("cell", "line", "spot", "own").join(marks, "line")
        x, y = few.where(F.col("spot") != _ASIDE).alias("x"), few.alias("y")
        # either of two lines may be the one that stands aside
        near = (F.col("x.own") | F.col("y.own")) & ((F.col("x.spot") != _SHORT) | (F.col("x.own") != F.col("y.own"))) & (F.abs(F.col("x.n") - F.col("y.n")) <= MAX_EDITS)
        near &= sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in BITS) <= 4 * MAX_EDITS
        pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.line") != F.col("y.line")) & near)
        found.append(staged(pairs.select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b")).distinct(), "pairs"))
        many = cells.where("large").select("key", "cell", "line", "at", "size")
        if many.isEmpty():
            break
        # the shared segment goes; what remains is partitioned below the cell
        rest = F.concat(F.substring(F.col("rest"), F.lit(1), F.col("at")), F.substring(F.col("rest"), F.col("at") + F.col("size") + 1, F.length("rest")))
        rests = staged(many.join(rests, ["key", "line"]).select(F.col("cell").alias("key"), "line", rest.alias("rest")).distinct(), "rests")
        below = listed(rests)
        cells = below.join(live(below), "cell")
    return union(found).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the digests of the pairs' texts that differ by MAX_EDITS edits at
    most. Lines are hashes: all texts of a hash are compared."""
    side = lambda end, text: texts.select(F.col("line").alias(end), F.col("digest").alias(f"{end}_digest"), F.col("text").alias(text))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            keep = [distance(x, y, MAX_EDITS) <= MAX_EDITS for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a_digest", "b_digest", "x", "y").mapInArrow(work, "a binary, b binary")


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, id, at, text) of docs (row, id, text): every line that isn't
    blank, at its number."""
    rows = docs.select("row", "id", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("at", "text"))
    return rows.where(F.length(F.btrim("text", F.lit(BLANKS))) > 0)


def links(lines: DataFrame, least_chars: int = 0, most: int = CELL_PAIRS) -> DataFrame:
    """(a, b): digests of the different texts of lines (text), repeats
    included, that are within MAX_EDITS edits of each other and have
    least_chars characters or more. Pairs of texts of MAX_EDITS characters at
    most, all of which are linked, aren't listed (see brief)."""
    named = lines.where(F.length("text") >= least_chars).select(F.xxhash64("text").alias("line"), "text")
    spots = listed(named.select(F.lit(0).cast("long").alias("key"), "line", F.col("text").alias("rest")), brief=False)
    some = staged(live(spots.select("cell", "line", "spot", "own")), "live")
    # repeats go before the join, so that a common line's don't meet in one task
    cells = union([staged(rows.distinct().join(keys, "cell"), "members") for rows, keys in parted(spots, "cell", some)])
    asked = staged(cells.select("line").distinct(), "asked")
    of = lambda rows: rows.groupBy("text").agg(F.lit(1)).select(F.xxhash64("text").alias("line"), digest().alias("digest"), "text")
    texts = union([staged(parities(of(rows).join(keys, "line", "left_semi")), "texts") for rows, keys in parted(named, "line", asked)])
    return verified(candidates(cells, texts, most), texts)


def brief(lines: DataFrame, least_chars: int = 0) -> DataFrame:
    """(digest) of the different texts of lines (text) that have MAX_EDITS
    characters at most: no two are more than MAX_EDITS edits apart."""
    length = F.length("text")
    return lines.where((length >= least_chars) & (length <= MAX_EDITS)).select(digest().alias("digest")).distinct()


def digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def classes(docs: DataFrame, least_chars: int = 0, most: int = CELL_PAIRS) -> DataFrame:
    """Per line of docs (row, id, text) that isn't blank: row, id, at (its
    number from 0), class_id (32 hex digits), n_links (other texts within
    MAX_EDITS edits), first (whether it is the class's first line: the smallest
    id, then row, then number).

    Equal lines are one class; lines of least_chars characters or more are
    linked within MAX_EDITS edits, and linked lines are one class. Null and
    blank texts have no lines. Rows without an id come after all others.
    Repeated rows repeat their lines.
    """
    seen = occurrences(docs)
    where = staged(seen.select("row", "id", "at", digest().alias("digest")), "lines")
    with scope() as own:
        linked = own.keep(staged(links(seen.select("text"), least_chars, most), "links"))
        alike = own.keep(staged(brief(seen.select("text"), least_chars), "brief"))
    total, one = alike.agg(F.count("*"), F.min("digest")).first()
    ends = linked.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links"))
    degree = ends.union(alike.select("digest", F.lit(total - 1))).groupBy("node").agg(F.sum("links").alias("n_links"))
    stars = alike.select(F.col("digest").alias("a"), F.lit(one).cast("binary").alias("b"))
    told = degree.where("n_links > 0").join(components(linked.select("a", "b").union(stars)), "node").withColumnRenamed("node", "digest")
    named = where.join(told, "digest", "left").select("row", "id", "at", F.coalesce("root", "digest").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    order = F.struct(F.col("id").isNull().alias("x"), "id", "row", "at")
    # by its place a first line is found again without bringing a class together
    first = named.groupBy("class").agg(F.min(order).alias("least")).select("least.row", "least.at", F.lit(True).alias("first"))
    got = named.join(first, ["row", "at"], "left")
    return got.select("row", "id", "at", F.lower(F.hex("class")).alias("class_id"), "n_links", F.coalesce("first", F.lit(False)).alias("first"))


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 0, most: int = CELL_PAIRS, scan: bool = False) -> DataFrame:
    """(id, line, class_id, n_links, kept) of every line that isn't blank; scan
    as for common.keyed."""
    key = free_name(docs, "row")
    rows = keyed(docs, key, scan).select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = classes(rows, least_chars, most)
    return got.select(F.col("id").alias(id_col), F.col("at").alias("line"), "class_id", "n_links", F.col("first").alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 0, most: int = CELL_PAIRS, scan: bool = False) -> DataFrame:
    """docs with all but the first line of every class taken out of the texts.

    Blank lines stay. A document of which nothing but blanks would be left
    goes; one that was null or blank before stays as it is.
    """
    key = free_name(docs, "row")
    gone = free_name(docs, "gone")
    rows = keyed(docs, key, scan)
    with scope() as own:
        got = classes(rows.select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), least_chars, most)
        drop = got.where(~F.col("first")).groupBy(F.col("row").alias(key)).agg(F.collect_list("at").alias(gone))
        drop = own.keep(staged(drop, "drop"))
    names, at = docs.columns, docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            texts, stay = [], []
            for text, out in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if out is not None:
                    out = set(out)
                    text = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in out)
                texts.append(text)
                stay.append(out is None or text.strip(BLANKS + "\n") != "")
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    touched, others = split(rows, key, bitmap(drop, key))
    changed = touched.join(drop, key, "left").select(*docs.columns, gone).mapInArrow(work, docs.schema)
    return others.select(*docs.columns).union(changed)
