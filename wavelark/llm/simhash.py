"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint is described by its Hamming distances to reference
fingerprints (pivots), computed once. The pivots of one block differ from a
base pivot inside that block only, so the distances minus the base distance
tell what a fingerprint holds in the block. Of `blocks` blocks at least
`blocks - max_bits` are the same in fingerprints that differ in max_bits bits
or fewer, so equal distance differences over some set of that many blocks find
every pair: one distance table, and one equi-join, per set. Pairs whose
coordinates to the remaining, global pivots differ by more than max_bits are
discarded (the triangle inequality), and survivors are verified bit by bit.

A cell with more than CELL fingerprints isn't paired. Its fingerprints are
listed under each of their 65 variants with at most one changed bit instead:
fingerprints two bits apart or nearer share a variant, and one variant has 65
fingerprints at most. So no group, however large, is paired or held by a task.

`one_of_each` removes near copies by the similarity of their shingles. The
tables bring together texts within two bits. Texts of a similarity of 0.8 may
be any number of bits apart, so all others meet through one of their rarest
shingles, which misses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, components, free_name, keyed, maybe_in, parted, rows_of, scope, staged, union, utf8, without

CELL = 24
GLOBAL_PIVOTS = 8
#: Counters that tell rare from common shingles, by hash.
BUCKETS = 1 << 16
BITS = tuple(f"bits{i}" for i in range(4))


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Space-joined word shingles of the text with A-Z lower-cased, repeats
    included; of fewer words the whole sequence, of none nothing."""
    words = (text or b"").lower().split()  # of bytes: A-Z only; at space and \t\n\v\f\r
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(parts: list[bytes], seed: int = 42) -> int:
    """64 bits; each is set if it is set in over half of the parts' XXH64."""
    if not parts:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
    ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) for i in range(0, len(h), 65536))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row. Null and empty texts have fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            got = np.array([fingerprint(shingles(t, width), seed) for t in utf8(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class Pivots:
    """Reference fingerprints, from a fixed seed: the same in every run."""

    def __init__(self, blocks: int, per_block: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.base = np.uint64(rng.integers(0, 2**64, dtype=np.uint64))
        self.inside = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            block = np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1))
            masks = rng.integers(0, 2**64, per_block, dtype=np.uint64) & block
            self.inside.append(self.base ^ masks)
        self.all = rng.integers(0, 2**64, GLOBAL_PIVOTS, dtype=np.uint64)
        self.weights = rng.integers(1, 2**64, (blocks, per_block), dtype=np.uint64) | np.uint64(1)

    def coordinates(self, fp: np.ndarray) -> np.ndarray:
        """Distances to the global pivots, a byte each in a 64-bit number."""
        d = np.bitwise_count(fp[:, None] ^ self.all[None, :]).astype(np.uint64)
        return (d << (np.arange(GLOBAL_PIVOTS, dtype=np.uint64) * np.uint64(8))[None, :]).sum(1, dtype=np.uint64)

    def block_keys(self, fp: np.ndarray) -> np.ndarray:
        """Per block a 64-bit mix of the distance differences there."""
        base = np.bitwise_count(fp ^ self.base).astype(np.int64)
        keys = []
        for pivots, w in zip(self.inside, self.weights, strict=True):
            d = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int64) - base[:, None]
            keys.append((d.view(np.uint64) * w[None, :]).sum(1, dtype=np.uint64))
        return np.stack(keys, 1)


def cells(nodes: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(cell, node, fp, at): a row per node and distance table."""
    sets = list(combinations(range(blocks), blocks - max_bits))
    pivots = Pivots(blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 4096):
            fp = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, at = pivots.block_keys(fp), pivots.coordinates(fp).view(np.int64)
            for n, chosen in enumerate(sets):
                key = np.full(len(fp), n, np.uint64)
                for c in chosen:
                    key = (key ^ keys[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), b.column(1), pa.array(at)], names=["cell", "node", "fp", "at"])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "fp").mapInArrow(work, f"cell long, node {kind}, fp long, at long")


def variants(rows: DataFrame) -> DataFrame:
    """(a, b) between fingerprints that share one of their 65 variants."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    listed = rows.select("node", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("variant"))
    first = listed.groupBy("variant").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z")
    return listed.join(first.select("variant", "a"), "variant").where("node != a").select("a", F.col("node").alias("b")).distinct()


def links(nodes: DataFrame, max_bits: int = 2, blocks: int = 4) -> DataFrame:
    """(a, b), a < b: links that connect all nodes (node, fp) which differ in
    max_bits bits or fewer, exactly for max_bits up to 2.

    Nodes in cells beyond CELL are linked within two bits, through variants.
    """
    rows = cells(nodes, max_bits, blocks)
    count = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(count, "cell"), "cells")
    few = rows.where(F.col("n") <= CELL)
    x, y = few.alias("x"), few.alias("y")
    apart = [F.abs(F.shiftright("x.at", 8 * i).bitwiseAND(F.lit(255)) - F.shiftright("y.at", 8 * i).bitwiseAND(F.lit(255))) for i in range(GLOBAL_PIVOTS)]
    near = (F.greatest(*apart) <= max_bits) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
    pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") < F.col("y.node")) & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = variants(rows.where(F.col("n") > CELL).select("node", "fp").distinct())
    return pairs.union(many).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """Per row: the id, its fingerprint (16 hex digits) and component_id, the
    smallest id that links of max_bits or fewer differing bits reach.

    Null and empty texts have fingerprint zero and are linked as any other.
    Repeated rows stay rows. Rows without an id are linked too but name no
    component: component_id is null only where no row of a component has an
    id. Other columns are ignored; an empty table gives an empty result.
    """
    got = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    found = staged(got.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    linked = links(found.select(F.col("fp").alias("node"), "fp"), max_bits, max_bits + 2)
    member = components(linked).join(found, F.col("node") == F.col("fp"), "inner")
    member = staged(member.select("fp", "root", "first"), "members")
    least = member.groupBy("root").agg(F.min("first").alias("component"))
    member = member.join(least, "root").select("fp", "component")
    named = found.join(member, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return got.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _profiles(rows: DataFrame, width: int) -> DataFrame:
    """(row, id, key binary, fp long, n) of rows (row, id, text): key and, by
    its first half, the node stand for the word sequence, fp is the fingerprint.
    Wordless texts are left out. Rows without a key: in how many texts of a
    task a shingle of bucket `fp` occurs (n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = np.zeros(BUCKETS, np.int64), None
        names = ["row", "id", "key", "fp", "n"]
        for b in rows_of(batches):
            kinds, keys, prints = [b.column(0).type, b.column(1).type], [], np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(utf8(b.column(2))):
                keys.append(_key(text))
                if keys[-1]:
                    parts = shingles(text, width)
                    prints[i] = np.uint64(fingerprint(parts)).astype(np.int64)
                    np.add.at(seen, _bucket(_hashes(parts)), 1)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(prints), pa.nulls(b.num_rows, pa.int64())], names=names)
            yield out.filter(out.column(2).is_valid())
        some = np.nonzero(seen)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), k) for k in kinds), pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(seen[some])], names=names)

    row, kind = (rows.schema[c].dataType.simpleString() for c in ("row", "id"))
    return rows.mapInArrow(work, f"row {row}, id {kind}, key binary, fp long, n long")


def _key(text: bytes | None) -> bytes | None:
    words = (text or b"").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _hashes(parts: list[bytes]) -> np.ndarray:
    """The hashes of the distinct shingles."""
    parts = set(parts)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def prefixes(texts: DataFrame, often: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(cell, node, size) of texts (text): their first shingles, those of rare
    buckets (often: texts per bucket) before others.

    Of two texts with the given similarity each has size * similarity shingles
    at least in common with the other, so that they share one of the first
    size - ceil(size * similarity) + 1 in any order that is the same for all.
    """
    held = texts.sparkSession.sparkContext.broadcast(often)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for b in rows_of(batches, 256):
            cells, nodes, sizes = [], [], []
            for text in utf8(b.column(0)):
                if key := _key(text):
                    h = _hashes(shingles(text, width))
                    first = h[np.lexsort((h, often[_bucket(h)]))[: len(h) - ceil(len(h) * similarity - 1e-9) + 1]]
                    cells.append(first)
                    nodes.append(np.full(len(first), _node(key), np.int64))
                    sizes.append(np.full(len(first), len(h), np.int32))
            if cells:
                cells, nodes, sizes = map(np.concatenate, (cells, nodes, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(nodes), pa.array(sizes)], names=["cell", "node", "size"])

    return texts.select("text").mapInArrow(work, "cell long, node long, size int")


def similar(pairs: DataFrame, texts: DataFrame, marks: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text; copies may occur) have
    a Jaccard similarity of their distinct shingles of at least `similarity`.
    Sketches (marks) tell most others first; only texts of pairs that are left
    reach an exchange."""
    pairs = staged(alike(pairs, _met(marks.select("node", "size", "sketch"), pairs), similarity), "alike")
    met = _met(texts.select("node", "text"), pairs).groupBy("node").agg(F.first("text").alias("text"))
    of = lambda node, text: met.select(F.col("node").alias(node), F.col("text").alias(text))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 256):
            keep = []
            for x, y in zip(utf8(b.column(2)), utf8(b.column(3)), strict=True):
                x, y = set(shingles(x, width)), set(shingles(y, width))
                keep.append(len(x & y) >= similarity * len(x | y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (node) that occur in pairs (a, b), and few others."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    return maybe_in(rows, "node", bitmap(nodes, "node"))


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches (node, size, sketch) allow the
    similarity: similar sets differ in a known share of their sizes at most."""
    of = lambda node, n: texts.select(F.col("node").alias(node), F.col("size").alias(f"size{n}"), F.col("sketch").alias(f"sketch{n}"))
    both = pairs.join(of("a", 0), "a").join(of("b", 1), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            apart = np.array([_apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)])
            keep = apart <= sizes * ((1 - similarity) / (1 + similarity)) + 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "size0", "size1", "sketch0", "sketch1").mapInArrow(work, "a long, b long")


def _sketch(hashes: np.ndarray) -> bytes:
    """Parities of the number of hashes by their last bits: two bits a hash."""
    bits = min(1 << 16, max(256, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer one is folded."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """texts (text) that have words, with their node, their number of distinct
    shingles (size), a sketch of them and bits0 to bits3: bit h is the parity of
    the number of shingles with hash h. A shingle that only one of two texts has
    changes one bit, so texts differ in as many shingles as in bits, or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            nodes, bits, sizes, sketches = [], np.zeros((b.num_rows, 4), np.int64), [], []
            for i, text in enumerate(utf8(b.column(0))):
                key, hashes = _key(text), _hashes(shingles(text, width))
                odd = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                bits[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                nodes.append(_node(key) if key else None)
                sizes.append(len(hashes))
                sketches.append(_sketch(hashes))
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), b.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), *map(pa.array, bits.T.copy())], names=["node", "text", "size", "sketch", *BITS])
            yield out.filter(out.column(0).is_valid())

    return texts.select("text").mapInArrow(work, "node long, text string, size int, sketch binary, " + ", ".join(f"{c} long" for c in BITS))


def marked(texts: DataFrame) -> DataFrame:
    """(node, size, sketch, bits0 to bits3) of what sketched gives, once a node:
    copies have the same."""
    return texts.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "sketch", *BITS)])


def grouped(rows: DataFrame, first: DataFrame, texts: DataFrame, marks: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root): the components of all similar pairs that share a cell of
    rows (cell, node, size), or are candidates of first (a, b).

    In a round every cell gives some pivots, which are verified with all of the
    cell that aren't of their component yet, and then leave the cell. A cell is
    done when the rest of it is one component. So every pair is verified, or
    its texts are linked already, and a group of copies costs as many
    verifications as it has texts, not pairs.
    """
    found = staged(similar(first, texts, marks, width, similarity), "similar")
    member = staged(components(found), "members")
    tried, pivots, live = staged(first.distinct(), "tried"), 1, rows
    while True:
        live = live.join(member, "node", "left").select("cell", "node", "size", F.coalesce("root", "node").alias("root"))
        # what is left of a cell matters while it holds two components
        open_ = live.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
        live = staged(live.join(open_, "cell"), "cells")
        if live.isEmpty():
            return member
        part = F.pmod(F.xxhash64("node"), F.lit(pivots))
        chosen = live.groupBy("cell", part.alias("part")).agg(F.min("node").alias("node"))
        chosen = staged(live.join(chosen.select("cell", "node"), ["cell", "node"]), "pivots")
        bits = marks.select("node", *BITS)
        p, q = chosen.join(bits, "node").alias("p"), live.join(bits, "node").alias("q")
        sizes = F.least("p.size", "q.size") >= F.greatest("p.size", "q.size") * similarity - 1e-9
        # similar sets differ in a known share of their sizes at most
        apart = sum(F.bit_count(F.col(f"p.{c}").bitwiseXOR(F.col(f"q.{c}"))) for c in BITS)
        sizes &= apart <= (F.col("p.size") + F.col("q.size")) * ((1 - similarity) / (1 + similarity)) + 1e-9
        pairs = p.join(q, (F.col("p.cell") == F.col("q.cell")) & (F.col("p.root") != F.col("q.root")) & sizes)
        pairs = pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        found = staged(similar(pairs, texts, marks, width, similarity), "similar")
        tried = tried.union(pairs)
        if not found.isEmpty():
            member = staged(components(found.union(member.select(F.col("root").alias("a"), F.col("node").alias("b")))), "members")
        live = live.join(chosen.select("cell", "node"), ["cell", "node"], "left_anti").select("cell", "node", "size")
        pivots *= 16


def _copies(texts: DataFrame, key: str, width: int, similarity: float, max_bits: int, own: scope) -> DataFrame:
    """(key) of the rows of texts (row, id, text) that aren't their group's first."""
    got = staged(_profiles(texts, width), "profiles")
    often = np.zeros(BUCKETS, np.int64)
    for r in got.where("key IS NULL").groupBy("fp").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        often[r.fp] = r.n
    got = got.where("key IS NOT NULL").select("row", "id", "key", "fp")
    order = F.struct(F.col("id").isNull().alias("x"), "id", "row")
    node = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("node")
    nodes = staged(got.groupBy("key", "fp").agg(F.min(order).alias("least")).select("key", "fp", node, "least"), "texts")
    # within max_bits: fingerprints by the tables, texts of one fingerprint
    prints = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    pairs = links(prints.select(F.col("fp").alias("node"), "fp"), max_bits, max_bits + 2)
    pairs = pairs.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    same = nodes.select("fp", F.col("node").alias("y")).join(prints, "fp").where("node != y").select(F.col("node").alias("x"), "y")
    first = staged(pairs.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "first")
    # the others
    listed = prefixes(texts, often, width, similarity)
    many = listed.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("cell")
    many = staged(many, "many")
    cells = union([staged(some.distinct().join(keys, "cell"), "cells") for some, keys in parted(listed, "cell", many)])
    met = cells.select("node").union(first.select("a")).union(first.select("b")).distinct()
    asked = staged(nodes.join(met, "node", "left_semi").select(F.col("least.row").alias("row")), "asked")
    # rows that a bitmap lets through by chance are copies or meet nothing
    some = union([staged(sketched(some, width), "texts") for some, _ in parted(texts.select("row", "text"), "row", asked)])
    marks = staged(marked(some), "marks")
    groups = nodes.join(grouped(cells, first, some, marks, width, similarity), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = groups.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    gone = got.select("row").join(stay, "row", "left_anti").select(F.col("row").alias(key))
    return own.keep(staged(gone, "gone"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 2, scan: bool = False) -> DataFrame:
    """docs with one row of each group of near copies, the smallest id's; scan
    as for common.keyed.

    Texts of one word sequence are copies. Others are linked if their sets of
    shingles (width words, A-Z lower-cased) have a Jaccard similarity of at
    least `similarity`; linked texts are one group. Texts whose fingerprints
    are within max_bits meet through the pivots' tables, all others through
    their rarest shingles; every pair that meets is verified. Texts without
    words are no copies of each other and stay. Rows without an id come last.
    """
    key = free_name(docs, "row")
    rows = keyed(docs, key, scan)
    with scope() as own:
        texts = rows.select(F.col(key).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        gone = _copies(texts, key, width, similarity, max_bits, own)
    return without(rows, key, gone).select(*docs.columns)
