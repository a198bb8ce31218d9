"""Corpus operators against brute force on small tables with nulls, empty and
long texts, ties, repeated rows and columns of clashing names."""

import collections
import hashlib
import itertools
import math
import re
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavelark.llm import attention, common, decontamination, lines, lm, neighbours, packing, quality, sanitise, simhash, urlfilter, warc
from wavelark.llm.common import is_training
from wavelark.llm.queries import subword_tokenizer, word_tokenizer

EXTRA = ["row", "id", "fp", "cell", "length", "rank", "score", "gone", "line", "kind", "digest"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
BASE = "The quick brown fox jumps over the lazy dog while seventeen cheerful engineers measure radio noise near the harbour and write everything down for later study by their patient colleagues"


def texts():
    w = BASE.split()
    near = " ".join(w[:10] + ["wobbly"] + w[11:])
    return [
        (1, BASE),
        (2, BASE),
        (3, near),
        (3, near),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (None, "a document without an id, mail me at who@example.com or +1 (555) 010-9999 today"),
        (7, "mail who@example.com zebra99 quick\nsecond line that is long enough to link"),
        (8, "write who@example.com zebra99 slow\nsecond line that is long enough to linkx"),
        (9, "card 4111 1111 1111 1111 and 10.0.0.1 and 999.1.1.1 zebra99 who@example.com\nsecond line that is 1ong enough to link"),
        (10, "é ñ 💡 ümlaut word " * 3 + "\n\n\nsecond line that is long enough to link"),
        (11, " ".join(f"w{i % 997}" for i in range(20_000))),
        (12, "a" * 30_000),
        (13, "1 " * 5_000 + "a.b." * 2_000 + "@x.y" + "\nOne. One."),
        (14, "One. One."),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts()) and simhash.near_duplicates(none).count() == 0
    of = lambda t: simhash.fingerprint(simhash.shingles(t.encode() if t is not None else None, 3))
    prints = collections.defaultdict(set)
    for i, t in texts():
        prints[of(t)].add(i)
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for f, ids in prints.items():
        least[root(f)] += [i for i in ids if i is not None]
    want = sorted(((i, f"{of(t):016x}", min(least[root(of(t))], default=None)) for i, t in texts()), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_simhash_large_groups_through_variants(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 1)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6)
    prints = {int(b) ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 60, 7) for j in range(0, 60, 11)}
    got = simhash.links(spark.createDataFrame([(f, f) for f in prints], "node long, fp long")).collect()
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in got:
        assert (r.a ^ r.b).bit_count() <= 2
        parent[root(r.a)] = root(r.b)
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            assert root(a) == root(b)


def test_one_of_each(docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and simhash.one_of_each(none).count() == 0
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "4", "5", "6", "None", "7", "8", "9", "10", "11", "12", "13", "14"] + (["3"] if jaccard(texts()[0][1], texts()[2][1]) < 0.8 else []))


def jaccard(a, b):
    x, y = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_texts_are_found(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, at = [], 0
    for _ in range(30):
        w = [word() for _ in range(300)]
        rows.append((at, " ".join(w)))
        x = list(w)
        for k in rng.choice(300, 3, replace=False):
            x[k] = word()
        rows.append((at + 1, " ".join(x)))
        at += 2
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 60, 2))


def test_near_texts_are_found_whatever_their_group(spark):
    # a base with many copies that are similar to it and not to each other, in
    # the order that puts the base last, and pairs far apart in single words
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join(base[: 10 * (i % 19)] + [word() for _ in range(35)] + base[10 * (i % 19) :])) for i in range(60)]
    rows.append((60, " ".join(base)))
    for i in range(100, 160, 2):
        w = [word() for _ in range(60)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w + [word() for _ in range(12)]))]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {root(i) for i, _ in rows}
    assert want == {0, *range(100, 160, 2)} and jaccard(rows[0][1], rows[1][1]) < 0.8
    kept = [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(kept) == sorted(want)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://b/", big), (1, "http://a/\r\nX: 1", big), (None, None, big), (2, "http://c", None), (4, "http://d", "short"), (5, "http://d", "short"), (6, "u", big), (6, "u", big + "é")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "a")
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [("1", "response", None, 203), ("3", "revisit", 1, 203), ("None", "revisit", 1, 203), ("6", "revisit", 1, 203), ("6", "response", None, 205), ("2", "response", None, 0), ("4", "response", None, 5), ("5", "response", None, 5)]
    )
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in got)
    warc.export(spark, path, str(tmp_path / "files"))
    loaded = warc.load(spark, str(tmp_path / "files" / "part-*")).collect()
    want = {bytes(r.record) for r in warc.records(spark, path).collect()}
    assert {bytes(r.header) + bytes(r.content) for r in loaded} == want
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    assert warc.archive(pages.where("false")).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    got = packing.pack(docs, word_tokenizer(), 512).collect()
    want = collections.Counter()
    for i, text in texts():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for n, s in enumerate(range(0, len(ids), 512)):
            want[(i, n, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert len(by) == math.ceil(sum(r.length for r in got) / 512)
    assert packing.pack(none, word_tokenizer()).count() == 0


def test_plan_fills_gaps():
    rng = np.random.default_rng(0)
    counts = collections.Counter(rng.integers(1, 400, 5000).tolist())
    runs = packing.plan(dict(counts), 400)
    least = max(math.ceil(sum(k * v for k, v in counts.items()) / 400), sum(v for k, v in counts.items() if k > 200))
    assert runs["sequence"].max() + 1 <= 1.02 * least
    held = collections.Counter()
    for length, rank, each in zip(runs["length"], runs["rank"], runs["each"], strict=True):
        held[int(length)] = max(held[int(length)], int(rank + each))
    assert all(held[k] <= v for k, v in counts.items())


BASE_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    luhn = sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE_KINDS.items() for m in re.finditer(p, text or "") if holds(k, m.group()))


def test_sanitise(docs, none):
    got = sanitise.sanitise(docs).collect()
    assert len(got) == len(texts()) and sanitise.sanitise(none).count() == 0
    want = sorted(hashlib.sha256(base_spans(t).encode()).hexdigest() for _, t in texts())
    assert sorted(r.base_sha256 for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[9].n_card == 1 and by[9].n_ip == 1 and by[9].n_email == 1
    assert all(by[i].spans.startswith(base_spans(dict(texts())[i])) for i in by if i is not None)
    # zebra99 occurs with the address and nowhere else
    assert "term:" in by[7].spans and "zebra99" not in by[7].sanitised and "[email]" in by[7].sanitised
    assert by[1].spans == "" and by[1].sanitised is None


def test_sanitise_terms_of_two_rows_and_short_terms(spark):
    rows = [f"some words that all rows hold {i}" for i in range(40)]
    rows[3] = "some words that Quixley 王伟 qz hold at q.q@example.org today"
    rows[9] = "other words by Quixley and 王伟 or qz for q.q@example.org"
    rows[20] = "some words of one row, alone@example.org and Zanzibar"
    got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i in (3, 9):
        assert got[i].n_email == 1 and all(x not in got[i].sanitised for x in ("Quixley", "王伟", "qz")) and "words" in got[i].sanitised
    assert got[20].sanitised == "some words of one row, [email] and Zanzibar"


def test_sanitise_touching_matches(spark):
    rows = ["a@b.c_d@e.f", "x" * 50 + "@", "1.2.3.4.5.6.7.8", "+1 2345678 9" * 3, "٣ +49 30 1234567é a@b.co", "4111-1111-1111-1111 4111111111111111"]
    got = sanitise.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    for r in got:
        assert r.base_sha256 == hashlib.sha256(base_spans(rows[r.doc_id]).encode()).hexdigest(), rows[r.doc_id]


def within(a, b, most=2):
    """Whether a and b differ by `most` edits at most, by trying all of them."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    a, b = a[at:], b[at:]
    if most == 0 or not b:
        return len(a) <= most
    return any(within(x, y, most - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def check_links(spark, rows, **kwargs):
    """Holds membership of documents of one line each against all pairs."""
    got = lines.membership(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), **kwargs).collect()
    different = sorted(set(rows))
    degree, parent = collections.Counter(), {x: x for x in different}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(different, 2):
        if abs(len(a) - len(b)) <= 2 and within(a, b):
            parent[root(a)] = root(b)
            degree.update((a, b))
    assert {r.doc_id: r.n_links for r in got} == {i: degree[x] for i, x in enumerate(rows)}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        groups[r.class_id].add(r.doc_id)
        want[root(rows[r.doc_id])].add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("most", [lines.CELL_PAIRS, 4])
def test_lines_of_few_characters(spark, most):
    rng = np.random.default_rng(11)
    rows = ["".join(rng.choice(list("abcdé文"), n)) for n in rng.integers(1, 7, 150)]
    check_links(spark, rows + [f"Page {i}" for i in range(95, 125)] + [f"{i}." for i in range(8, 14)], most=most)


def test_lines_with_full_bitmaps_and_in_several_parts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(1, 14, 120)]
    monkeypatch.setattr(common, "BITMAP_ROWS", 1)  # 64 bits, all of them set
    check_links(spark, rows)
    monkeypatch.setattr(common, "BITMAP_KEYS", 40)
    check_links(spark, rows)


def test_short_lines_are_counted_not_paired(spark):
    rows = [chr(0x4E00 + i % 40) + chr(0x4E00 + i // 40) for i in range(1600)]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    assert lines.links(df).count() == 0 and lines.brief(df).count() == 1600
    got = lines.membership(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert got.groupBy("class_id", "n_links").count().collect()[0][1:] == (1599, 1600)
    assert got.where("kept").collect()[0].doc_id == 0


def test_scopes_own_their_tables(spark):
    table = lambda n: common.staged(spark.range(n), "scope")
    alone = table(3)
    with common.scope() as outer:
        with common.scope() as own:
            lost, kept = table(1), own.keep(table(2))
            done = []
            other = threading.Thread(target=lambda: done.append(table(5)))
            other.start()
            other.join()
        assert kept.count() == 2 and done[0].count() == 5 and kept.staged_at in outer.paths
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
            spark.read.parquet(lost.staged_at).count()
        with pytest.raises(ZeroDivisionError), common.scope() as failed:
            gone = failed.keep(table(4))
            1 / 0  # noqa: B018
    for df in (kept, gone):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
            spark.read.parquet(df.staged_at).count()
    assert alone.count() == 3 and done[0].count() == 5


@pytest.mark.parametrize(("most", "least"), [(lines.CELL_PAIRS, 0), (8, 20)])
def test_lines(docs, none, most, least):
    got = lines.membership(docs, least_chars=least, most=most).collect()
    occ = [(i, n, x) for i, t in texts() for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\v\f")]
    assert len(got) == len(occ) and lines.membership(none).count() == 0
    distinct = sorted({x for *_, x in occ})
    parent, degree = {x: x for x in distinct}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([x for x in distinct if len(x) >= least], 2):
        if abs(len(a) - len(b)) <= 2 and within(a, b):
            parent[root(a)] = root(b)
            degree[a] += 1
            degree[b] += 1
    assert sum(degree.values()) >= 6
    links = {(r.doc_id, r.line): r.n_links for r in got}
    assert all(links[(i, n)] == degree[x] for i, n, x in occ)
    by = collections.defaultdict(set)
    for r in got:
        by[r.class_id].add((r.doc_id, r.line))
    want = collections.defaultdict(set)
    for i, n, x in occ:
        want[root(x)].add((i, n))
    assert sorted(map(sorted, (map(str, v) for v in by.values()))) == sorted(map(sorted, (map(str, v) for v in want.values())))
    kept = lines.deduplicate(docs, least_chars=20, most=most)
    assert kept.columns == docs.columns
    text = {r.doc_id: r.text for r in kept.collect()}
    assert 2 not in text and text[8] == "write who@example.com zebra99 slow" and 14 not in text and text[4] is None
    assert lines.deduplicate(none).count() == 0


def test_distance():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = "".join(rng.choice(list("ab"), rng.integers(0, 90)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(0, len(b) + 1)
            b[k : k + rng.integers(0, 2)] = [] if rng.random() < 0.4 else ["c"]
        b = "".join(b)
        for most in (1, 2, 3):
            assert lines.distance(a, b, most) == min(lines._rows(a, b), most + 1)


def test_quality(spark, docs, none, data):
    real, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.classify(real, labels)
    truth = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in truth) >= 0.9 * len(truth)
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    good = {r.doc_id for r in got.where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.accepted(real, labels).collect()} == good
    odd = labels.where("false").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 0, 0), (3, 7, 1)], labels.schema))
    assert quality.classify(docs, odd).count() == len(texts()) and quality.accepted(none, labels).count() == 0
    assert quality.classify(docs, odd).where("score = 1").count() == len(texts())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    v[7] = v[8]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (None, [1.0] * 16), (604, [1.0] * 3), (5, v[9].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = neighbours.neighbours(df, k=10, every=20, block_rows=256, query_rows=16).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 600, 20))
    hits = []
    ids, m = np.array([*range(600), 5]), np.vstack([v, v[9]])
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - m[ids == r.vec_id] @ v[q]).min() < 1e-9 for r in found)
        s = m @ v[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]]
        hits.append(len(set(best) & {r.vec_id for r in found}) / 10)
    assert np.mean(hits) >= 0.9
    few = neighbours.neighbours(df.where("vec_id < 5"), k=10, every=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4] and neighbours.neighbours(df.where("false")).count() == 0


ITEMS = [(1, BASE), (2, "One. One."), (3, None), (4, "..."), (None, "second line that is long enough to link"), (5, "quick brown fox jumps over the lazy dog while seventeen CHEERFUL engineers"), (5, "nothing here at all")]


@pytest.mark.parametrize("shard_bytes", [500_000, 120])
def test_decontamination(spark, docs, none, shard_bytes):
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, name string")
    got = decontamination.contamination(docs, bench, size=10, shard_bytes=shard_bytes).collect()
    assert len(got) == len(texts())
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = collections.defaultdict(set)
    for i, t in ITEMS:
        w = of(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            own[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = []
    for i, t in texts():
        w, hit, names = of(t), set(), set()
        for n in {len(x) for x in own}:
            for k in range(len(w) - n + 1):
                if o := own.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= o
        want.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted(want)
    ten = next(r for r in got if r.doc_id == 10)
    assert [dict(texts())[10][s.start : s.end] for s in ten.spans] == ["second line that is long enough to link"]
    clean = decontamination.clean(docs, bench, size=10, shard_bytes=shard_bytes)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(w[0] for w in want if not w[5]) and clean.columns == docs.columns
    assert decontamination.clean(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_language_model(docs, none, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 3)
    got = lm.scores(docs, subword_tokenizer()).collect()
    assert len(got) == len(texts()) and lm.scores(none, subword_tokenizer()).count() == 0
    train = [t for i, t in texts() if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in train for w in (t or "").encode().lower().split())
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    floor = math.log10(total + 0.5 * (distinct + 1))
    want = []
    for i, t in texts():
        w = (t or "").encode().lower().split()
        base = sum(math.log10(counts[x] + 0.5) - floor for x in w) + math.log10(len(train) + 0.5) - floor
        want.append((str(i), None if i is None else zlib.crc32(str(i).encode()) % 5 == 1, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(base, 6)))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_each_token_is_scored_once():
    from wavelark.llm import attention

    for n in (1, 5, 31, 32, 33, 56, 57, 300):
        seen = [s + i for s, first in attention.windows(n) for i in range(first, attention.WINDOW) if s + i < n]
        assert seen == list(range(n))


def test_probabilities_sum_to_one():
    from wavelark.llm import attention

    c = lm.Classes({5: 10, 7: 3, 9: 1}, 50)
    w = attention.initial(c.shares)
    first = [math.exp(lm.score(w, c, [np.array([], np.int64)])[0])]
    z, _ = attention.hidden(w, np.array([[attention.START] + [0] * (attention.WINDOW - 1)]))
    p = np.exp(attention.log_softmax(w, z[0, :1]))[0]
    mass = sum(p[c.classes[i]] * math.exp(c.tail[i]) for i in range(51))
    assert abs(mass + p[len(c.classes[c.classes > 0]) + 1 :].sum() - 1) < 1e-4 and 0 < first[0] < 1


def test_url_filters(spark):
    caps = spark.createDataFrame([(1, "http://A.b.com/x", "2024-01-10"), (2, "http://a.b.com", "2024-02-10"), (2, "http://a.b.com", "2024-02-10"), (3, "http://c.b.com", "2024-01-10"), (4, None, "2024-01-01"), (5, "nourl", "2024-01-01"), (6, "http://u@a.b.com:80/", None), (None, "http://a.b.com", "2024-03-10")], "page_id long, url string, day string")
    entries = spark.createDataFrame([("a.b.com", "2024-01-05", "block"), ("a.b.com", "2024-02-01", "allow"), ("a.b.com", "2024-03-01", "remove"), ("a.b.com", "2024-03-01", "remove"), ("b.com", "2024-01-08", "block"), ("b.com", "2024-01-08", "allow"), (None, "2024-01-01", "block"), ("c.b.com", "2024-01-01", "what")], "domain string, day string, action string")
    got = sorted((str(r.page_id), r.verdict, r.domain) for r in urlfilter.verdicts(caps, entries).collect())
    assert got == [("1", "block", "a.b.com"), ("2", "allow", "a.b.com"), ("2", "allow", "a.b.com"), ("3", "block", "b.com"), ("4", "unlisted", None), ("5", "unlisted", None), ("6", "unlisted", None), ("None", "block", "b.com")]
    assert urlfilter.verdicts(caps.where("false"), entries).count() == 0
    assert urlfilter.verdicts(caps, entries.where("false")).where("verdict != 'unlisted'").count() == 0


def test_tokenizer_files():
    assert public_tokenizers.path("word_bpe_49k.json")


def test_hot_group_of_equal_texts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(BASE)).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    got = simhash.near_duplicates(df)
    assert got.where("doc_id % 3 = 0").select("component_id").distinct().count() == 1 and got.count() == 3000
    assert packing.pack(df, word_tokenizer()).count() == 3000


def test_lm_beats_the_unigram_model_on_held_out_texts(spark):
    """Texts in which the next word follows from the last: attention must tell
    more than the class shares that its weights start from, which are the
    unigram model."""

    follow = ["the", "cat", "sat", "on", "a", "mat", "and", "it", "was", "red"]
    docs = [(i, " ".join(follow[(i + k * (1 + i % 2)) % 10] for k in range(40 + i % 60))) for i in range(600)]
    path = subword_tokenizer()
    got = lm.gather(spark.createDataFrame(docs, "doc_id long, text string"), path, "doc_id", "text").cache()
    counts = {int(bytes(r.word)): r.n for r in got.where("kind = 2").groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    c = lm.Classes(counts, lm.subwords(path).n_vocab)
    w = lm.fit(got.where("kind = 0").where(is_training(F.col("id"), 5, 1)), c, c.shares)
    held = [np.array(lm.subwords(path).encode_ordinary(t), np.int64) for i, t in docs if zlib.crc32(str(i).encode()) % 5 == 1]
    model, unigram = lm.score(w, c, held).sum(), lm.score(attention.initial(c.shares), c, held).sum()
    assert model > 0.7 * unigram  # both negative
    got.unpersist()


def test_lm_windows_hold_every_subword_once(spark):
    size = attention.WINDOW
    rows = [(i, np.arange(1, n + 1, dtype=np.uint32)) for i, n in enumerate([0, 1, size - 1, size, size + 1, 5 * size, 1000])] + [(None, np.arange(1, 100, dtype=np.uint32))]
    df = spark.createDataFrame([(i, bytearray(ids.tobytes())) for i, ids in rows], "id long, ids binary")
    c = lm.Classes({i: 2000 - i for i in range(1, 500)}, 1200)
    got, rounds = collections.Counter(), [lm.windows(df, r).collect() for r in range(lm.ROUNDS)]
    assert all(rounds)
    for r in itertools.chain(*rounds):
        x, y, scored = lm._examples(c, [bytes(r.ids)])
        got.update(y[scored].tolist())
    want = collections.Counter(int(c.classes[i]) for _, ids in rows for i in [*ids.tolist(), c.end])
    assert got == want
