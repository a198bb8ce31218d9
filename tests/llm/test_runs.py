"""Runs of words against all periods tried at all places."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wavelark.llm import queries, runs


def all_runs(w, least):
    """By definition: every maximal stretch of every period, least period first."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, 2 * p) and not any(s <= i and s + m >= i + length and p % q == 0 for s, m, q in out):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left_over(w, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_random_words(least):
    rng = np.random.default_rng(least)
    for _ in range(40):
        texts = []
        for _ in range(rng.integers(1, 8)):
            w = [chr(97 + c) for c in rng.integers(0, rng.integers(1, 4), rng.integers(0, 60))]
            if rng.random() < 0.4 and w:
                w = (w[:3] + w[: rng.integers(1, 12)] * 8)[:60] + w
            texts.append(" ".join(w))
        n, found, collapsed = (x.to_pylist() for x in runs._of_texts(pa.array(texts), least))
        for t, count, got, rest in zip(texts, n, found, collapsed, strict=True):
            w = t.split()
            want = all_runs(w, least)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            assert count == len(w) and rest == left_over(w, want)


def test_many_documents_in_several_arrays(monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 50)
    texts = [" ".join(f"w{i % (3 + d)}" for i in range(20 + d)) for d in range(40)] + ["", None, "one"]
    _, found, _ = (x.to_pylist() for x in runs._of_texts(pa.array(texts), 12))
    for t, got in zip(texts, found, strict=True):
        assert [(r["start"], r["length"], r["period"]) for r in got] == all_runs((t or "").split(), 12)


def test_blanks_are_the_six_ascii_ones():
    flat, offsets = runs.words(pa.array([" a\tb\nc\x0bd\x0ce\rf ", "g\x1fh i j", None, ""]))
    assert flat.to_pylist() == ["a", "b", "c", "d", "e", "f", "g\x1fh i j"] and offsets.tolist() == [0, 6, 7, 7, 7]


def test_table(spark):
    long = " ".join(f"x{i % 9_000}" for i in range(40_000))
    rows = [(1, "a b c " * 5, "own"), (1, "a b c " * 5, "own"), (None, None, None), (2, "", "x"), (3, " \n ", "x"), (4, long, "x"), (5, "q" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = runs.find_runs(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and runs.find_runs(docs.where("false")).count() == 0
    said = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed[:20]) for r in got.collect())
    assert said == [("1", 15, [(0, 15, 3)], "a b c"), ("1", 15, [(0, 15, 3)], "a b c"), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 40_000, [(0, 40_000, 9_000)], long[:20]), ("5", 1, [], "q" * 20), ("None", 0, [], "")]


def test_query_on_whole_table(spark, data):
    got = {r.doc_id: r for r in queries.op11_runs(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        w = (r.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 1500:  # the definition takes the square of it
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w = [x.decode() for x in w]
        want = all_runs(w, 12)
        some += bool(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        q = got[r.doc_id]
        assert (q.n_runs, q.start, q.length, q.period) == (len(want), *best)
        assert q.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert q.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in want).encode()).hexdigest()
        assert q.collapsed_sha256 == hashlib.sha256(left_over(w, want).encode()).hexdigest()
    assert some
