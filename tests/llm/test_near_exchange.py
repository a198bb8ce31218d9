"""What near-dedup sends through exchanges, and the sketches that spare it."""

import numpy as np

from wavelark.llm import simhash
from wavelark.llm.common import staged


def _written(spark):
    """Bytes that all stages so far wrote for exchanges."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_sketches_tell_apart_reach_no_exchange(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    base = [word() for _ in range(600)]
    texts = [(0, " ".join(base)), (1, " ".join([*base[:500], *(word() for _ in range(20)), *base[520:]]))]
    texts += [(i, " ".join([*base[:8], *(word() for _ in range(592))])) for i in range(2, 200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = staged(simhash.sketched(spark.createDataFrame([*texts, texts[1], (200, " ")], "n long, text string"), 5), "texts")
        marks = staged(simhash.marked(held), "marks")
        assert held.count() == 201 and marks.count() == 200
        node = [simhash._node(simhash._key(t.encode())) for _, t in texts]
        pairs = staged(spark.createDataFrame([(node[0], node[i]) for i in range(1, 200)], "a long, b long"), "pairs")
        start = _written(spark)
        assert [tuple(r) for r in simhash.similar(pairs, held, marks, 5, 0.8).collect()] == [(node[0], node[1])]
        sent = _written(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < sent < sum(len(t) for _, t in texts) / 5


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(9)
    for n, m in ((0, 0), (1, 1), (100, 90), (500, 700), (100, 3_000), (40_000, 33_000)):
        common = rng.integers(0, 1 << 63, min(n, m) * 4 // 5, dtype=np.uint64)
        x, y = (np.concatenate([common, rng.integers(0, 1 << 63, k - len(common), dtype=np.uint64)]) for k in (n, m))
        apart = simhash._apart(simhash._sketch(x), simhash._sketch(y))
        assert apart == simhash._apart(simhash._sketch(y), simhash._sketch(x)) <= n + m - 2 * len(common)
        other = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert not 100 <= n < 10_000 or simhash._apart(simhash._sketch(x), simhash._sketch(other)) > 2 * n / 9
