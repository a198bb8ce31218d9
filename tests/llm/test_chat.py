"""Layouts, template and loss mask of chat formatting."""

import json

import check_oracles
import pytest
from pyspark.sql import functions as F

from wavelark.llm import chat, queries

#: record, layout, turns
CASES = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "x: <y>%", "content": "### </turn> \\ #### \n"}], "id": 5}, "messages", [("user", "a"), ("x: <y>%", "### </turn> \\ #### \n")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, {"from": "system", "value": "s"}]}, "shared", [("user", "q"), ("assistant", ""), ("system", "s")]),
    ({"prompt": "p", "completion": "c", "turns": [1]}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"output": "o", "system": "s", "instruction": "i"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"data": {"question": "q", "answer": 5}}, "nested", [("user", "q"), ("assistant", "5")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "User", "content": "x" * 300_000}]}, "messages", [("User", "x" * 300_000)]),
    ({"messages": [{"role": "user"}, {"content": "c"}]}, "messages", [("user", ""), ("", "c")]),
    ({"messages": [1]}, None, None),
    ({"messages": [[{"role": "u", "content": "c"}]]}, None, None),
    ({"messages": [{"role": "u", "content": {"text": "c"}}]}, None, None),
    ({"prompt": "p"}, None, None),
    ({"prompt": "p", "completion": "c", "messages": []}, None, None),
    ({"data.question": "q", "data.answer": "a"}, None, None),
    ([1], None, None),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(n, json.dumps(r)) for n, (r, _, _) in enumerate(CASES)] + [(-1, None), (-2, ""), (-3, "{bad")]
    return spark.createDataFrame([(*r, "mine") for r in rows], "n int, record string, layout string")


def test_layouts(records):
    done = {r.n: r for r in chat.canonical(records).collect()}
    assert len(done) == len(CASES) + 3 and chat.canonical(records.where("false")).count() == 0
    for n, (_, layout, turns) in enumerate(CASES):
        assert done[n].layout == layout
        assert (done[n].turns is None) if turns is None else [tuple(t) for t in done[n].turns] == turns
        assert done[n].fingerprint is not None
    assert all(done[n].layout is None and done[n].turns is None and done[n].fingerprint is None for n in (-1, -2, -3))
    assert done[3].fingerprint != done[4].fingerprint


def test_paths(spark):
    text = json.dumps({"a.b": {"c": [[{"d": 1}], []], "e f": 1}, "x`y": None, "z[": []})
    got = spark.createDataFrame([(text,)], "r string").select(chat.paths(F.col("r")).alias("p")).first().p
    assert got == sorted(["a%2Eb.c[][].d", "a%2Eb.e f", "x`y", "z%5B[]"])


def test_template_reads_back(records):
    done = chat.formatted(chat.canonical(records))
    rows = done.select("n", "formatted", "loss", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in rows:
        turns = CASES[r.n][2] if r.n >= 0 else None
        if turns is None:
            assert r.formatted is None
            continue
        assert [tuple(t) for t in r.back] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count("</turn>") == len(turns) == r.formatted.count("### ")
        for s in r.loss:
            assert r.formatted[: s.start].endswith("### Assistant: ") and r.formatted[s.stop :].startswith("</turn>\n")


def test_two_mappings_must_differ(records):
    with pytest.raises(ValueError):
        chat.canonical(records, mappings=[*chat.MAPPINGS, chat.Mapping("again", fields=(("prompt", "user"), ("completion", "tool")))])


def test_query(spark, data, tmp_path):
    con = check_oracles.connect(data)
    assert check_oracles.compare(spark, con, queries.op12_chat, queries.oracle_sql()["op12_chat"], data) is None
    spark.read.parquet(f"{data}/conversations.parquet").limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [(r.conv_id, r.n_turns) for r in queries.op12_chat(spark, str(tmp_path)).collect()] == [(-7, 2)]


def test_query_with_odd_rows(spark, data, tmp_path):
    rows = [(1, 0, "user", None), (1, None, None, "### ## </turn>\\"), (None, 0, "assistant", "a" * 50_000), (2, 0, "user", "q"), (2, 1, "assistant", "\\/turn> 💡"), (3, 0, "human", "q"), (3, 1, "a:b", ""), (4, 1, "user", "x"), (4, 1, "user", "x"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a###")]
    spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, record string, layout string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = check_oracles.connect(data)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert check_oracles.compare(spark, con, queries.op12_chat, queries.oracle_sql()["op12_chat"], str(tmp_path)) is None
