"""A small gated recurrent language model in numpy, with a class-factored output.

Symbols 0 to ``SHORT - 1`` are the commonest words (0 is the end of a text), the rest stand for classes of all other
words. The output is a softmax over classes and, within the classes of common words, one over their words.

Arrays are laid out by feature, then by position, so that every operation runs along many positions at once.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
SHORT, WITHIN, TAIL = 1024, 32, 16
CLASSES = SHORT // WITHIN + TAIL
#: Steps of truncated back-propagation; the state is carried across windows.
WINDOW = 32
RATE = 1e-2
#: Parallel streams in training, and at most in scoring.
STREAMS, WIDEST = 256, 1024
#: Positions whose output is computed at a time.
AT_ONCE = 1 << 14
_SHAPES = {"x": (SHORT + TAIL, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN + 1, CLASSES), "w": (SHORT // WITHIN, HIDDEN + 1, WITHIN)}

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int = 42) -> Params:
    """Small random weights, and biases that start from the log-shares of the symbols (counts of SHORT + TAIL)."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(scale=0.1, size=s).astype(np.float32) for k, s in _SHAPES.items()}
    c = counts + 0.5
    inner = c[:SHORT].reshape(-1, WITHIN)
    p["c"][-1] = np.log(np.concatenate([inner.sum(axis=1), c[SHORT:]]))
    p["w"][:, -1, :] = np.log(inner)
    return p


def packed(p: Params) -> bytes:
    return np.concatenate([p[k].ravel() for k in _SHAPES]).astype("<f4").tobytes()


def unpacked(raw: bytes | np.ndarray) -> Params:
    flat = (np.frombuffer(raw, "<f4") if isinstance(raw, bytes) else raw).astype(np.float32)
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


class Streams:
    """Whole texts laid one after the other in parallel streams, the longest stream first.

    Step t has a position for each of the first ``starts[t + 1] - starts[t]`` streams, so that none is padding.
    ``x`` and ``y`` are the inputs and targets of the positions, ``first`` tells where a text starts, ``text`` whose
    position it is.
    """

    def __init__(self, texts: list[np.ndarray], widest: int = WIDEST):
        sizes = np.array([len(t) for t in texts], np.int64)
        heap = [(0, b) for b in range(min(widest, len(texts)))]
        stream, begin = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        for t in np.argsort(-sizes, kind="stable").tolist():
            begin[t], stream[t] = at, b = heap[0]
            heapq.heapreplace(heap, (at + int(sizes[t]), b))
        ends = np.zeros(len(heap), np.int64)
        for at, b in heap:
            ends[b] = at
        order = np.argsort(-ends, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        active = np.searchsorted(-ends[order], -np.arange(ends.max()), side="left")
        self.starts = np.concatenate(([0], np.cumsum(active)))
        y = np.concatenate(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.starts[begin[owner] + inside] + rank[stream[owner]]
        x = np.concatenate(([0], y[:-1]))
        x[inside == 0] = 0
        self.width = len(heap)
        self.x, self.y, self.text, self.first = np.empty(len(y), np.int32), np.empty(len(y), np.int32), np.empty(len(y), np.int32), np.empty(len(y), bool)
        self.x[place], self.y[place], self.text[place], self.first[place] = x, y, owner, inside == 0


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def step(ut: np.ndarray, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state from the input's share of the gates (3 HIDDEN, n) and the state before, and what led to it."""
    a = ut @ h
    zr = gates[: 2 * HIDDEN] + a[: 2 * HIDDEN]
    z, r = _sigmoid(zr)[:HIDDEN], zr[HIDDEN:]
    c = a[2 * HIDDEN :]
    n = r * c
    n += gates[2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, c


def _chosen(logits: np.ndarray, at: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The log-softmax of one row in each column, and with ``grad`` its gradient by the logits, which are overwritten."""
    every = np.arange(logits.shape[1])
    logits -= logits.max(axis=0)
    total = logits[at, every]
    np.exp(logits, out=logits)
    sums = logits.sum(axis=0)
    total -= np.log(sums)
    if not grad:
        return total, None
    logits *= -1 / sums
    logits[at, every] += 1
    return total, logits


def output(p: Params, hb: np.ndarray, y: np.ndarray, grad: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray] | None, np.ndarray | None]:
    """Log-probability (natural) of each target given its hidden state with a row of ones below it, (HIDDEN + 1, n).

    With ``grad`` also the gradients of their sum by the weights and by the states.
    """
    cls = np.where(y < SHORT, y // WITHIN, y - SHORT + SHORT // WITHIN)
    # Positions are put in the order of their class, so that each class's are a slice.
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    hb, cls, at = np.take(hb, order, axis=1), cls[order], y[order] % WITHIN
    total, d = _chosen(p["c"].T @ hb, cls, grad)
    g, dh = None, None
    if grad:
        g = {"c": hb @ d.T, "w": np.zeros(_SHAPES["w"], np.float32)}
        dh = p["c"][:-1] @ d
    bounds = np.searchsorted(cls, np.arange(SHORT // WITHIN + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[k], bounds[k + 1])
        within, d = _chosen(p["w"][k].T @ hb[:, own], at[own], grad)
        total[own] += within
        if grad:
            g["w"][k] = hb[:, own] @ d.T
            dh[:, own] += p["w"][k][:-1] @ d
    out = np.empty_like(total)
    out[order] = total
    if grad:
        back = np.empty_like(dh)
        back[:, order] = dh
        dh = back
    return out, g, dh


def log_likelihoods(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """The log-probability (natural, double) of each whole text of symbols, state carried from its first to its last."""
    if not texts:
        return np.zeros(0)
    s = Streams(texts)
    starts = s.starts.tolist()
    ut, table = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["x"].T)
    h = np.zeros((HIDDEN, s.width), np.float32)
    fresh = np.logical_or.reduceat(s.first, s.starts[:-1])
    lp = np.empty(len(s.y))
    t = 0
    while t < len(starts) - 1:
        upto = t + 1
        while upto < len(starts) - 1 and starts[upto + 1] - starts[t] <= AT_ONCE:
            upto += 1
        lo, hi = starts[t], starts[upto]
        hb = np.ones((HIDDEN + 1, hi - lo), np.float32)
        gates = np.take(table, s.x[lo:hi], axis=1)
        for k in range(t, upto):
            a, b = starts[k], starts[k + 1]
            h = h[:, : b - a]
            if fresh[k]:
                h = h * ~s.first[a:b]
            h = step(ut, gates[:, a - lo : b - lo], h)[0]
            hb[:HIDDEN, a - lo : b - lo] = h
        lp[lo:hi] = output(p, hb, s.y[lo:hi])[0]
        t = upto
    return np.bincount(s.text, lp, len(texts))


class Trainer:
    """Adam over windows of truncated back-propagation."""

    def __init__(self, p: Params):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.steps = self.tokens = 0

    def train(self, texts: list[np.ndarray]) -> None:
        """One pass: the texts in one row are cut into equal streams, so that a cut text's rest starts afresh."""
        y = np.concatenate(texts).astype(np.int32)
        first = np.zeros(len(y), bool)
        first[np.cumsum([0, *map(len, texts[:-1])])] = True
        x = np.concatenate(([0], y[:-1])).astype(np.int32)
        x[first] = 0
        width = max(1, min(STREAMS, len(y) // WINDOW))
        rest = -len(y) % width
        x, y, first = np.pad(x, (0, rest)), np.pad(y, (0, rest), constant_values=-1), np.pad(first, (0, rest))
        x, y, first = (np.ascontiguousarray(a.reshape(width, -1).T) for a in (x, y, first))
        h = np.zeros((HIDDEN, width), np.float32)
        for t in range(0, len(x), WINDOW):
            part = slice(t, t + WINDOW)
            h = self.update(*self.gradients(x[part], y[part], first[part], h))

    def gradients(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], int, np.ndarray]:
        """Gradients of a window's log-likelihood, the state before it being given; its targets; the state after it."""
        p, (steps, width) = self.p, x.shape
        ut, size = np.ascontiguousarray(p["u"].T), (HIDDEN, steps, width)
        gates = np.take(p["x"].T, x.ravel(), axis=1).reshape(3 * HIDDEN, steps, width)
        before, z, r, n, c = (np.empty(size, np.float32) for _ in range(5))
        hb = np.ones((HIDDEN + 1, steps, width), np.float32)
        stay, fresh = (~first).astype(np.float32), first.any(axis=1)
        for t in range(steps):
            if fresh[t]:
                h = h * stay[t]
            before[:, t] = h
            h, z[:, t], r[:, t], n[:, t], c[:, t] = step(ut, gates[:, t], h)
            hb[:HIDDEN, t] = h
        flat, real = y.ravel(), y.ravel() >= 0
        count, hb = int(real.sum()), hb.reshape(HIDDEN + 1, -1)
        if not count:
            return {}, 0, h
        above = np.zeros((HIDDEN, steps * width), np.float32)
        if count == len(flat):
            _, g, above = output(p, hb, flat, grad=True)
        else:
            _, g, above[:, real] = output(p, hb[:, real], flat[real], grad=True)
        above = above.reshape(size)
        # What reaches the gates before their squashing (outer), and the products with the state (inner).
        outer, inner = np.empty((3 * HIDDEN, steps, width), np.float32), np.empty((3 * HIDDEN, steps, width), np.float32)
        dz, dn = (before - n) * z * (1 - z), (1 - z) * (1 - n * n)
        dr, back = c * r * (1 - r), np.zeros((HIDDEN, width), np.float32)
        for t in range(steps - 1, -1, -1):
            d = above[:, t] + back
            da, dc = outer[:, t], inner[:, t]
            np.multiply(d, dz[:, t], out=da[:HIDDEN])
            np.multiply(d, dn[:, t], out=da[2 * HIDDEN :])
            np.multiply(da[2 * HIDDEN :], dr[:, t], out=da[HIDDEN : 2 * HIDDEN])
            dc[: 2 * HIDDEN] = da[: 2 * HIDDEN]
            np.multiply(da[2 * HIDDEN :], r[:, t], out=dc[2 * HIDDEN :])
            back = p["u"] @ dc
            back += d * z[:, t]
            if fresh[t]:
                back *= stay[t]
        g["u"] = before.reshape(HIDDEN, -1) @ inner.reshape(3 * HIDDEN, -1).T
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        ordered = x.ravel()[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        g["x"] = np.zeros(_SHAPES["x"], np.float32)
        rows = np.ascontiguousarray(outer.reshape(3 * HIDDEN, -1).T)
        g["x"][ordered[starts]] = np.add.reduceat(rows[order], starts, axis=0)
        return g, count, h

    def update(self, g: dict[str, np.ndarray], count: int, h: np.ndarray) -> np.ndarray:
        """One step of Adam up the mean of the gradients; hands the state on."""
        if not count:
            return h
        self.steps += 1
        self.tokens += count
        rate = np.float32(RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps) / np.sqrt(1 + self.steps / 300))
        for k, grad in g.items():
            grad *= np.float32(1 / count)
            self.m[k] += 0.1 * (grad - self.m[k])
            grad *= grad
            self.v[k] += 0.001 * (grad - self.v[k])
            self.p[k] += rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
        return h
