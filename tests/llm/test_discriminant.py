"""The classifier's scores against normal densities worked out another way."""

import numpy as np

from wavelark.llm.quality import Discriminant


def test_scores_are_posteriors_of_two_normal_densities():
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(size=(400, 5)) * (1 + y[:, None] * np.arange(5)) + y[:, None]
    d = Discriminant.fit(x, y)

    # shrinkage and densities from their definitions: inverses and determinants
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    whole = own[0] * np.mean(y == 0) + own[1] * np.mean(y == 1)
    logs = []
    for k in (0, 1):
        c = 0.7 * own[k] + 0.3 * whole
        c = 0.95 * c + 0.05 * np.trace(c) / 5 * np.eye(5)
        off = z - z[y == k].mean(0)
        logs.append(np.log(np.mean(y == k)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(c), off))
    assert np.allclose(d.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)
    assert ((d.score(x) > 0.5) == (y == 1)).mean() > 0.8


def test_one_class_gives_no_classifier():
    assert Discriminant.fit(np.ones((3, 2)), np.ones(3, int)) is None
    assert Discriminant.fit(np.zeros((0, 2)), np.zeros(0, int)) is None
