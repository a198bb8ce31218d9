"""A small causal self-attention model in numpy: one block, one head.

Targets are HEAD classes: the most frequent subwords and one class for all
others. The output has two levels, a group of classes and a class of the group,
so that the exact probability of a class takes GROUPS + MEMBERS numbers and not
HEAD. The output biases start as the log shares of groups and classes, so an
untrained model already is the corpus's unigram model.
"""

from __future__ import annotations

from math import prod

import numpy as np

WIDTH = 16
HEAD = 1024
MEMBERS = 32  # classes of a group, by falling frequency
GROUPS = HEAD // MEMBERS
BUCKETS = 64  # inputs that stand for the subwords outside the head
WINDOW = 64
STRIDE = 48
START = HEAD + BUCKETS
BLOCK = 32  # windows that are computed together

Weights = dict[str, np.ndarray]

#: The last row of group and out is a bias.
_SHAPES = {
    "embed": (START + 1, WIDTH),
    "place": (WINDOW, WIDTH),
    "qkv": (WIDTH, 3 * WIDTH),
    "mix": (WIDTH, WIDTH),
    "wide": (WIDTH, 2 * WIDTH),
    "narrow": (2 * WIDTH, WIDTH),
    "group": (WIDTH + 1, GROUPS),
    "out": (GROUPS, WIDTH + 1, MEMBERS),
}
_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = np.float32(WIDTH**-0.5)


def initial(shares: np.ndarray, seed: int = 5) -> Weights:
    """Small random weights; shares of the classes give the output biases."""
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.3 if k in ("embed", "place") else 0.25, s).astype(np.float32) for k, s in _SHAPES.items()}
    own = np.maximum(shares, 1e-9).reshape(GROUPS, MEMBERS)
    w["group"] *= 0.1
    w["group"][WIDTH] = np.log(own.sum(1))
    w["out"] *= 0.1
    w["out"][:, WIDTH] = np.log(own / own.sum(1, keepdims=True))
    return w


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def _views(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = prod(s)
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def unflatten(flat: np.ndarray) -> Weights:
    return _views(flat.astype(np.float32))


class Room:
    """Arrays that a loop over blocks uses again: fresh ones of this size would
    get their pages from the system every time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def hidden(w: Weights, x: np.ndarray, low: int = 0, room: Room | None = None) -> tuple[np.ndarray, dict]:
    """The block's output at the places from low on of inputs x (windows,
    WINDOW), and what the gradient needs (of low 0). All of it lies in room."""
    room = room or Room()
    n, rows = len(x), len(x) * (WINDOW - low)
    e = w["embed"].take(x, axis=0, out=room("e", n, WINDOW, WIDTH), mode="clip")
    e += w["place"]
    m = w["qkv"].copy()
    m[:, :WIDTH] *= _SCALE
    qkv = np.matmul(e.reshape(-1, WIDTH), m, out=room("qkv", n * WINDOW, 3 * WIDTH)).reshape(n, WINDOW, 3 * WIDTH)
    q, k = qkv[:, low:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH]
    v = room("v", n, WINDOW, WIDTH + 1)
    v[:, :, :WIDTH] = qkv[:, :, 2 * WIDTH :]
    v[:, :, WIDTH] = 1  # sums a row of a
    a, both = room("a", n, WINDOW - low, WINDOW), room("both", n, WINDOW - low, WIDTH + 1)
    np.matmul(q, k.transpose(0, 2, 1), out=a)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        a *= _MASK[low:]
        np.matmul(a, v, out=both)
    mass = both[:, :, WIDTH:]
    if not (np.isfinite(both).all() and mass.min(initial=1) > 1e-25):  # near the ends of a float's range: less each row's greatest
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        a[:, _MASK[low:] == 0] = -np.inf
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        np.matmul(a, v, out=both)
    c = np.divide(both[:, :, :WIDTH], mass, out=room("c", n, WINDOW - low, WIDTH)).reshape(-1, WIDTH)
    h = np.matmul(c, w["mix"], out=room("h", rows, WIDTH))
    h.reshape(n, WINDOW - low, WIDTH)[...] += e[:, low:]
    u = np.matmul(h, w["wide"], out=room("u", rows, 2 * WIDTH))
    np.maximum(u, 0, out=u)
    z = np.matmul(u, w["narrow"], out=room("z", rows, WIDTH))
    z += h
    return z.reshape(n, WINDOW - low, WIDTH), {"e": e, "m": m, "q": q, "k": k, "v": v, "a": a, "mass": mass, "c": c, "h": h, "u": u}


def log_softmax(w: Weights, z: np.ndarray) -> np.ndarray:
    """The log probabilities of all classes for rows of hidden's output."""

    def part(d: np.ndarray) -> np.ndarray:
        d = d - d.max(-1, keepdims=True)
        return d - np.log(np.exp(d).sum(-1, keepdims=True))

    z = _with_one(z, Room())
    first, second = part(z @ w["group"]), part(np.einsum("nw,gwm->ngm", z, w["out"]))
    return (first[:, :, None] + second).reshape(-1, HEAD)


def _with_one(z: np.ndarray, room: Room) -> np.ndarray:
    out = room("with one", len(z), WIDTH + 1)
    out[:, :WIDTH] = z
    out[:, WIDTH] = 1
    return out


def sorted_by_group(target: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scored places of target (flat) ordered by group, and where groups start."""
    group = np.where(scored, target // MEMBERS, GROUPS).astype(np.uint8)
    starts = np.zeros(GROUPS + 1, np.int64)
    np.cumsum(np.bincount(group, minlength=GROUPS + 1)[:GROUPS], out=starts[1:])
    return np.argsort(group, kind="stable")[: starts[-1]], starts


def _logits(w: Weights, z: np.ndarray, starts: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Those of the groups, and those of the classes of a row's own group."""
    first, second = np.matmul(z, w["group"], out=room("first", len(z), GROUPS)), room("second", len(z), MEMBERS)
    for g in np.flatnonzero(np.diff(starts)):
        rows = slice(starts[g], starts[g + 1])
        np.matmul(z[rows], w["out"][g], out=second[rows])
    return first, second


def _exp(d: np.ndarray, own: np.ndarray) -> np.ndarray:
    """d becomes its exponentials, and their sums are returned. Logits near the
    ends of a float's range are moved first, and own with them."""
    if d.size and (d.max() > 80 or d.min() < -80):
        most = d.max(1)
        d -= most[:, None]
        own -= most
    np.exp(d, out=d)
    return d @ np.ones(d.shape[1], np.float32)


def log_probability(w: Weights, z: np.ndarray, target: np.ndarray, starts: np.ndarray, room: Room | None = None) -> np.ndarray:
    """The log probability of one class per row; rows are ordered by group."""
    room, each = room or Room(), np.arange(len(target))
    total = np.zeros(len(target), np.float32)
    for d, t in zip(_logits(w, _with_one(z, room), starts, room), (target // MEMBERS, target % MEMBERS), strict=True):
        own = d[each, t]
        mass = _exp(d, own)
        total += own - np.log(mass)
    return total


def gradient(w: Weights, x: np.ndarray, y: np.ndarray, scored: np.ndarray, room: Room | None = None) -> tuple[float, Weights]:
    """Mean loss over the scored positions and its gradient."""
    g = _views(np.zeros(sum(map(prod, _SHAPES.values())), np.float32))
    n, loss, room = max(1, int(scored.sum())), 0.0, room or Room()
    de = room("of embed", len(x) * WINDOW, WIDTH)
    for at in range(0, len(x), BLOCK):
        cut = slice(at, at + BLOCK)
        loss += _add_gradient(g, w, x[cut], y[cut].ravel(), scored[cut].ravel(), np.float32(1 / n), de[at * WINDOW : (at + BLOCK) * WINDOW], room)
    g["place"] += de.reshape(len(x), -1).sum(0).reshape(WINDOW, WIDTH)
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
    inputs = x.ravel()[order]
    heads = np.flatnonzero(np.diff(inputs, prepend=-1))
    g["embed"][inputs[heads]] = np.add.reduceat(de.take(order, axis=0, out=room("sorted", *de.shape), mode="clip"), heads, axis=0)
    return loss / n, g


def _add_gradient(g: Weights, w: Weights, x: np.ndarray, y: np.ndarray, scored: np.ndarray, share: np.float32, de: np.ndarray, room: Room) -> float:
    """Adds to g what a block gives but for its inputs' part, which becomes de."""
    z, s = hidden(w, x, 0, room)
    n, rows, loss = len(x), len(y), 0.0
    order, starts = sorted_by_group(y, scored)
    z, target, each = _with_one(z.reshape(-1, WIDTH).take(order, axis=0), room), y[order], np.arange(len(order))
    first, second = _logits(w, z, starts, room)
    for d, t in ((first, target // MEMBERS), (second, target % MEMBERS)):
        own = d[each, t]
        mass = _exp(d, own)
        loss += float((np.log(mass) - own).sum())
        d *= (share / mass)[:, None]
        d[each, t] -= share
    g["group"] += z.T @ first
    d = np.matmul(first, w["group"][:WIDTH].T, out=room("d", len(order), WIDTH))
    for i in np.flatnonzero(np.diff(starts)):
        part = slice(starts[i], starts[i + 1])
        g["out"][i] += z[part].T @ second[part]
        d[part] += second[part] @ w["out"][i, :WIDTH].T
    dz = room("dz", rows, WIDTH)
    dz[...] = 0
    dz[order] = d
    g["narrow"] += s["u"].T @ dz
    du = np.matmul(dz, w["narrow"].T, out=room("du", rows, 2 * WIDTH))
    du *= s["u"] > 0
    g["wide"] += s["h"].T @ du
    dh = np.matmul(du, w["wide"].T, out=room("dh", rows, WIDTH))
    dh += dz
    g["mix"] += s["c"].T @ dh
    # a holds exponentials, not shares: what its sums would divide is divided here
    dc = np.matmul(dh, w["mix"].T, out=room("dc", rows, WIDTH))
    d = room("dboth", n, WINDOW, WIDTH + 1)
    d[:, :, :WIDTH] = dc.reshape(n, WINDOW, WIDTH)
    dc *= s["c"]
    d[:, :, WIDTH] = (dc @ np.full(WIDTH, -1, np.float32)).reshape(n, WINDOW)
    d /= s["mass"]
    dqkv = room("dqkv", n, WINDOW, 3 * WIDTH)
    np.matmul(s["a"].transpose(0, 2, 1), d[:, :, :WIDTH], out=dqkv[:, :, 2 * WIDTH :])
    da = np.matmul(d, s["v"].transpose(0, 2, 1), out=room("da", n, WINDOW, WINDOW))
    da *= s["a"]
    np.matmul(da, s["k"], out=dqkv[:, :, :WIDTH])
    np.matmul(da.transpose(0, 2, 1), s["q"], out=dqkv[:, :, WIDTH : 2 * WIDTH])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    own = s["e"].reshape(-1, WIDTH).T @ dqkv
    own[:, :WIDTH] *= _SCALE
    g["qkv"] += own
    np.matmul(dqkv, s["m"].T, out=de)
    de += dh
    return loss


def train(w: Weights, x: np.ndarray, y: np.ndarray, scored: np.ndarray, steps: int, rate: float, batch: int = 128, seed: int = 3) -> Weights:
    """Adam over shuffled batches of windows, for that many steps."""
    rng = np.random.default_rng(seed)
    flat = flatten(w)
    w = _views(flat)
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    order, room = np.zeros(0, np.int64), Room()
    for t in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(x))])
        pick, order = order[:batch], order[batch:]
        g = flatten(gradient(w, x[pick], y[pick], scored[pick], room)[1])
        g /= np.float32(max(1.0, float(np.sqrt(g @ g))))
        m *= 0.9
        m += np.float32(0.1) * g
        s *= 0.99
        g *= g
        g *= np.float32(0.01)
        s += g
        flat -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
    return w


def windows(n: int) -> list[tuple[int, int]]:
    """(start, first scored position) of the windows over n positions: they
    overlap by WINDOW - STRIDE, and each position is scored once."""
    out = [(0, 0)]
    while out[-1][0] + WINDOW < n:
        out.append((out[-1][0] + STRIDE, WINDOW - STRIDE))
    return out
