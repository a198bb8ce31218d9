"""Repairs of conversations against a search over all edits."""

import functools
import itertools
import re

import check_oracles
import numpy as np
import pyarrow as pa

from wavelark.llm import dialogue, queries


def cheapest(codes):
    """(cost, audit) over all edits with up to three inserts in a row."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def go(i, last, inserts):
        ways = [(0, "")] if i == len(codes) and last in ("", "a") else []
        if inserts < 3:
            ways += [(5 + c, "I" + w) for c, w in go(i, after[last], inserts + 1)]
        if i < len(codes):
            x, more = codes[i].lower(), 5 * codes[i].isupper()
            ways += [(2 + c, "D" + w) for c, w in go(i + 1, last, 0)]
            if x != "d":
                if x == after[last] or (x == "s" and last == ""):
                    ways += [(more + c, "K" + w) for c, w in go(i + 1, x, 0)]
                ways += [(more + 1 + c, "R" + w) for c, w in go(i + 1, after[last], 0)]
        return [min(ways)] if ways else []

    return go(0, "", 0)[0]


def test_edits():
    rng = np.random.default_rng(5)
    odds = [0.1, 0.25, 0.25, 0.05, 0.05, 0.1, 0.1, 0.02, 0.08]
    codes = ["".join(rng.choice(list(dialogue.CODES), rng.integers(0, 12), p=odds)) for _ in range(1500)]
    codes += map("".join, itertools.product("suaSUAd", repeat=4))
    for x, got in zip(codes, dialogue.plans(pa.array(codes)).to_pylist(), strict=True):
        assert (got["cost"], got["audit"]) == cheapest(x)
        roles = "".join(e["role"][0] if e["role"] else x[e["source"]].lower() for e in got["edits"])
        assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(got["audit"].replace("D", ""))


def test_small_tensors_give_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    codes = pa.array(["".join(rng.choice(list(dialogue.CODES), n)) for n in rng.integers(0, 300, 80)])
    whole = dialogue.plans(codes).to_pylist()
    monkeypatch.setattr(dialogue, "CELLS", 64)
    assert dialogue.plans(codes).to_pylist() == whole and dialogue.plans(pa.array([], pa.string())).to_pylist() == []


def test_repair(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yo."), (1, 1, "assistant", "Yo."), (1, 4, "assistant", "Well!"),
        (2, None, "assistant", "First."), (2, 0, "user", " \t"), (2, 1, None, "x."),
        (None, 3, "system", None), (3, 0, "user", "no end" * 20_000), (3, 1, "assistant", "End. \n"),
    ]
    table = spark.createDataFrame([(*r, "x", False) for r in rows] + [(4, 0, "user", "gone", "x", True)], "conv_id long, turn long, role string, text string, audit string, lost boolean").repartition(3)
    got = {r.conv_id: r for r in dialogue.repair(table, lost_col="lost").collect()}
    assert set(got) == {1, 2, 3, 4, None} and dialogue.repair(table.where("false"), lost_col="lost").count() == 0
    said = lambda r: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [(x.role, x.text[:9]) for x in r.repaired])
    assert said(got[1]) == (2, 0, 1, 0, 2, 4, "KDDK", [("user", "Hi."), ("assistant", "Well!")])
    assert said(got[2]) == (0, 1, 0, 0, 1, 4, "RDR", [("user", "First."), ("assistant", "x.")])
    assert said(got[3]) == (0, 0, 0, 1, 0, 4, "DD", [])
    assert said(got[4]) == (0, 0, 0, 0, 0, 0, "", [])
    assert said(got[None]) == (0, 1, 0, 0, 0, 2, "D", [])


def test_query(spark, data):
    assert check_oracles.compare(spark, check_oracles.connect(data), queries.op13_repair, queries.oracle_sql()["op13_repair"], data) is None


def test_query_with_odd_rows(spark, data, tmp_path):
    rng = np.random.default_rng(9)
    pick = lambda values: values[rng.integers(len(values))]
    rows = [(pick([1, 2, 3, -5, None, 60]), pick([None, 0, 1, 2, 3, 9]), pick(["user", "assistant", "system", "", None, "Tool"]), pick(["a.", "b", "", None, "c! \n", "long " * 3000])) for _ in range(150)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = check_oracles.connect(data)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert check_oracles.compare(spark, con, queries.op13_repair, queries.oracle_sql()["op13_repair"], str(tmp_path)) is None
