"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only in local mode, where that setting may be missing (tests), a temporary
    folder takes its place, which goes when the process ends. On a cluster a
    missing setting is an error: no other folder is known to be shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="wavelark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/wavelark/{label}-{uuid.uuid4().hex}"


class scope:  # noqa: N801
    """with scope() as own: what is staged inside is removed at its end, but for
    the tables given to own.keep, which the scope around it takes over, if there
    is one. A thread sees its own scopes only."""

    def __enter__(self) -> scope:
        self.paths: dict[str, SparkSession] = {}
        self.kept: set[str] = set()
        self.outer = _open.get()
        _open.set(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table.staged_at)
        return table

    def __exit__(self, error: type[BaseException] | None, *_) -> None:
        _open.set(self.outer)
        for path, spark in self.paths.items():
            if error is not None or path not in self.kept:
                _delete(spark, path)
            elif self.outer is not None:
                self.outer.paths[path] = spark


#: The innermost scope of the thread.
_open: ContextVar[scope | None] = ContextVar("scope", default=None)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage, so
    a lost executor costs no more than the tasks that it ran."""
    path, own = new_path(df.sparkSession, label), _open.get()
    if own is not None:
        own.paths[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Removes what staged wrote for tables that nothing will read again."""
    for df in tables:
        own = _open.get()
        if own is not None:
            own.paths.pop(df.staged_at, None)
        _delete(df.sparkSession, df.staged_at)


def keyed(docs: DataFrame, name: str, scan: bool = False) -> DataFrame:
    """docs with a column `name` that tells its rows apart and is the same
    whenever they are computed again: the file and the place in it.

    scan says that docs is read from files, row by row; if it isn't, or the
    source knows no places, docs is written first.
    """
    if scan:
        try:
            at = docs.metadataColumn("_metadata")
            return docs.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")))
        except AnalysisException:
            pass
    return keyed(staged(docs, "documents"), name, True)


#: Rows of a bitmap at most, 64 bits each: what a broadcast of one may hold.
BITMAP_ROWS = 1 << 19


def _place(column: str, where: str):
    hashed = F.xxhash64(column)
    return F.pmod(hashed, F.lit(BITMAP_ROWS)).alias(where), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(hashed, 40).bitwiseAND(F.lit(63)).cast("int"))


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """A set that holds all the keys and, by chance, some others: BITMAP_ROWS
    rows however many keys there are. It is written, not kept in a lineage."""
    bucket, bit = _place(column, "bucket")
    return staged(keys.select(bucket, bit.alias("bit")).groupBy("bucket").agg(F.bit_or("bit").alias("mask")), "bitmap")


def maybe_in(rows: DataFrame, column: str, held: DataFrame) -> DataFrame:
    """The rows whose column may be in a bitmap: all that are, and few others
    while the bitmap is sparse. It spares the others an exchange."""
    bucket, bit = _place(column, "bucket_")
    met = rows.withColumn("bucket_", bucket).join(F.broadcast(held), F.col("bucket_") == F.col("bucket"))  # BITMAP_ROWS at most
    return met.where(F.col("mask").bitwiseAND(bit) != 0).drop("bucket", "bucket_", "mask")


#: Keys that a bitmap takes while it is to spare exchanges: with these an eighth
#: of its bits are set at most, and it lets no more of the other rows through.
BITMAP_KEYS = BITMAP_ROWS * 8


def parted(rows: DataFrame, column: str, keys: DataFrame, most: int | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(rows, keys): the keys (staged, distinct) in as many hash ranges as keep a
    bitmap sparse, each with the rows whose column may be in it. Every range
    reads rows once, so that what reaches an exchange doesn't grow with the
    number of keys. No rows are lost, none is in two ranges."""
    parts = max(1, math.ceil(keys.count() / (most or BITMAP_KEYS)))
    for n in range(parts):
        inside = F.pmod(F.xxhash64(F.lit(parts), column), F.lit(parts)) == n if parts > 1 else F.lit(True)
        some = keys.where(inside)
        yield maybe_in(rows.where(inside), column, bitmap(some, column)), some


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def split(rows: DataFrame, column: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose column may be in a bitmap, and those that aren't in it."""
    bucket, bit = _place(column, "bucket_")
    met = rows.withColumn("bucket_", bucket).join(F.broadcast(held), F.col("bucket_") == F.col("bucket"), "left")  # BITMAP_ROWS at most
    inside = F.coalesce(F.col("mask").bitwiseAND(bit) != 0, F.lit(False))
    return met.where(inside).select(*rows.columns), met.where(~inside).select(*rows.columns)


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows whose column isn't among gone's: most pass by a bitmap, the
    others meet gone in a join."""
    gone = staged(gone.select(column).distinct(), "gone")
    some, others = split(rows, column, bitmap(gone, column))
    return others.union(some.join(gone, column, "left_anti").select(*rows.columns))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish in taken:
        wish += "_"
    return wish


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of `most` rows and, beyond a single row,
    `size` bytes, which bounds what a task holds."""
    for batch in batches:
        parts = [batch.slice(at, most) for at in range(0, batch.num_rows, most)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def is_training(doc_id, modulus: int, excluded: int):
    """Column: crc32 of doc_id as text, modulo modulus, differs from excluded.

    A row without doc_id never trains.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != excluded, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, root), root the smallest node reachable.

    edges holds a and b of one orderable type. Alternates the large and the
    small star, both plain joins and minima, until the edges no longer change.
    Only nodes that occur in edges are returned; nulls are no nodes.
    """
    now = staged(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, staged(small.where("u != v").distinct(), "edges")
        release(before)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen:
            break
        seen = told
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
