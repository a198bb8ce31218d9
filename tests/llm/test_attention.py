"""The attention model against plain computations from its definition."""

import numpy as np
import pytest

from wavelark.llm import attention as A
from wavelark.llm import lm


def model(seed=0):
    r = np.random.default_rng(seed)
    return A.initial(r.random(A.HEAD) + 0.01), r


def plain(w, x):
    """log probabilities of all classes at every place of the inputs x, in double precision."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    e = w["embed"][x] + w["place"][: len(x)]
    q, k, v = (e @ w["qkv"][:, i * A.WIDTH : (i + 1) * A.WIDTH] for i in range(3))
    h = np.zeros_like(e)
    for i in range(len(x)):
        a = k[: i + 1] @ q[i] / A.WIDTH**0.5
        a = np.exp(a - a.max())
        h[i] = e[i] + (a / a.sum()) @ v[: i + 1] @ w["mix"]
    z = np.hstack([h + np.maximum(h @ w["wide"], 0) @ w["narrow"], np.ones((len(x), 1))])
    soft = lambda d: d - d.max(-1, keepdims=True) - np.log(np.exp(d - d.max(-1, keepdims=True)).sum(-1, keepdims=True))
    group = soft(z @ w["group"])
    return np.hstack([group[:, [g]] + soft(z @ w["out"][g]) for g in range(A.GROUPS)])


def test_a_position_takes_few_numbers_and_its_probability_is_exact():
    """An output of one level took HEAD exponentials a position, which was most
    of op9_lm's time; the classes' probabilities still sum to one."""
    assert A.GROUPS * A.MEMBERS == A.HEAD and A.GROUPS + A.MEMBERS <= A.HEAD // 8
    w, r = model()
    x = r.integers(0, A.START, A.WINDOW)
    z, _ = A.hidden(w, x[None])
    got = A.log_softmax(w, z[0])
    assert np.allclose(np.exp(got).sum(1), 1, atol=1e-4) and np.allclose(got, plain(w, x), atol=1e-4)
    target = r.integers(0, A.HEAD, A.WINDOW)
    order, starts = A.sorted_by_group(target, r.random(A.WINDOW) < 0.8)
    one = A.log_probability(w, z[0][order], target[order], starts)
    assert np.allclose(one, got[order, target[order]], atol=1e-4)


@pytest.mark.parametrize("scale", [1, 60])
def test_scores_are_those_of_the_definition(scale):
    """Texts of one and of several windows, also with logits beyond a float's exponentials."""
    w, r = model(1)
    for k in ("qkv", "out", "group"):
        w[k] = w[k] * np.float32(scale)
    c = lm.Classes({i: 3000 - i for i in range(1, A.HEAD)}, 3000)
    texts = [r.integers(0, 3000, n) for n in (0, 1, A.WINDOW - 1, A.WINDOW, A.STRIDE + A.WINDOW, 500)]
    want = []
    for ids in texts:
        x, y = lm.arrange(c, ids)
        total = 0.0
        for s, first in A.windows(len(y)):
            cut = slice(s, s + A.WINDOW)
            logp = plain(w, x[cut])
            total += sum(logp[i, c.classes[t]] + c.tail[t] for i, t in enumerate(y[cut]) if i >= first)
        want.append(total)
    assert np.allclose(lm.score(w, c, texts), want, rtol=2e-4)


def test_gradient_is_the_slope_of_the_loss():
    w, r = model(2)
    n = A.BLOCK + 3  # two blocks
    x, y, scored = r.integers(0, A.START, (n, A.WINDOW)), r.integers(0, A.HEAD, (n, A.WINDOW)), r.random((n, A.WINDOW)) < 0.9

    def loss(w):
        z, _ = A.hidden(w, x)
        return -A.log_softmax(w, z[scored])[np.arange(scored.sum()), y[scored]].astype(float).mean()

    got, g = A.gradient(w, x, y, scored)
    assert abs(got - loss(w)) < 1e-4
    for k, v in g.items():
        way = v / np.sqrt((v**2).sum())  # uphill, where the slope is the gradient's length
        step = np.float32(0.01)
        slope = (loss(w | {k: w[k] + step * way}) - loss(w | {k: w[k] - step * way})) / (2 * float(step))
        assert abs(slope / np.sqrt((v**2).sum()) - 1) < 0.03, k


def test_windows_become_inputs_and_targets(spark):
    """Whole, later, last and empty windows of texts; ids beyond 16 bits in some."""
    size = 70_000
    c = lm.Classes({i: 80_000 - i for i in [*range(1, 300), *range(65_530, 65_800)]}, size)
    texts = [np.arange(first, first + n, dtype=np.uint32) for first in (1, 65_500, 69_800) for n in (0, 5, A.WINDOW - 1, A.WINDOW, 2 * A.WINDOW + 7)]
    rows = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "id long, ids binary")
    raw = [bytes(r.ids) for n in range(lm.ROUNDS) for r in lm.windows(rows, n).collect()]
    got = [(x[s].tolist(), y[s].tolist()) for x, y, s in zip(*lm._examples(c, raw), strict=True)]
    want = []
    for t in texts:
        x, y = lm.arrange(c, t.astype(np.int64))
        want += [(x[at : at + A.WINDOW].tolist(), c.classes[y[at : at + A.WINDOW]].tolist()) for at in range(0, len(t) + 1, A.WINDOW)]
    assert sorted(got) == sorted(want)


def test_windows_take_two_bytes_an_id(spark):
    """They are shuffled, once for all subwords of the training texts."""
    rows = spark.createDataFrame([(0, bytearray(np.arange(1, 1001, dtype=np.uint32).tobytes()))], "id long, ids binary")
    assert sum(len(r.ids) for n in range(lm.ROUNDS) for r in lm.windows(rows, n).collect()) == 16 * 8 + 2 * (1000 + 15)
