"""The pipeline's stages and registration."""

import check_oracles
import corpus_pipeline

from wavelark.llm import queries


def test_stages_and_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and kept
        ids = kept
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_line_stage_removes_what_line_dedup_finds(spark, data):
    unspaced, wide, short = "同じ段落がどの文書にもそのまま現れるので取り除かれる", "one\u00a0two\u3000three\u00a0four\u3000five\u00a0six", "All rights reserved here"
    rows = [(i, "\n".join([f"line {i} holds words that are its own {i * 7919}", unspaced, wide, short])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, data).collect()}
    assert left == {0: rows[0][1], 1: rows[1][1].split("\n")[0], 2: rows[2][1].split("\n")[0]}


def test_empty_table_through_all_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


def test_queries_with_sql(spark, data):
    con = check_oracles.connect(data)
    for name, sql in queries.oracle_sql().items():
        assert check_oracles.compare(spark, con, queries.queries()[name], sql, data) is None, name
