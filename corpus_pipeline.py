"""A corpus pipeline: five stages over `documents`, each on all that the stage
before kept, written as Parquet and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm import decontamination, lines, packing, quality, simhash
from wavelark.llm.common import release, scope, staged
from wavelark.llm.queries import word_tokenizer


#: Two edits change a tenth of such a line at most; shorter ones ("Yes.", "No.")
#: go only if they are equal.
LEAST_CHARS = 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal lines the first stays, and of lines of LEAST_CHARS characters or
    more that are within two edits of each other."""
    return lines.deduplicate(docs, least_chars=LEAST_CHARS, scan=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.one_of_each(docs, width=5, similarity=0.8, scan=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, scan=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row for each piece."""
    return packing.pack(docs, word_tokenizer(), 2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express a trained classifier or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with scope() as own:
            docs = own.keep(staged(stage(spark, docs, sf_dir), "stage"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
