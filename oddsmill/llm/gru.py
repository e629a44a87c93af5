"""A gated recurrent network with a class-factored output softmax, in numpy: truncated backpropagation, and log-likelihood
with the state carried across windows. Works on streams of symbols; it knows nothing of texts or Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Units, steps of a window of truncated backpropagation, and streams that go in step.
HIDDEN, STEPS, STREAMS = 16, 16, 256
RATE = 0.08
#: Predicted one by one: the most frequent words, in classes of PER_CLASS; all others by class, TAIL classes of word endings.
HEAD, PER_CLASS, TAIL = 512, 32, 48


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


def _log_softmax(weight: np.ndarray, bias: np.ndarray, states: np.ndarray, target: np.ndarray, slopes: bool):
    """Log-probability of each target class at the positions of ``states`` (units by positions); with ``slopes`` also the
    gradient of its negated sum in each class."""
    e = weight.T @ states
    e += bias[:, None]
    e -= e.max(axis=0)
    at = np.arange(states.shape[1])
    ll = e[target, at]
    np.exp(e, out=e)
    total = e.sum(axis=0)
    ll -= np.log(total)
    if slopes:
        e /= total
        e[target, at] -= 1
    return ll, e


@dataclass
class Shape:
    """Symbols 0.. are ``head`` words in classes of ``per_class`` (the last may be smaller), then one symbol for each of
    ``tail`` classes, of which the network predicts only the class. Symbol 0 ends a document."""

    head: int
    per_class: int
    tail: int

    @property
    def head_classes(self) -> int:
        return -(-self.head // self.per_class)

    @property
    def symbols(self) -> int:
        return self.head + self.tail

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail


def initial(shape: Shape, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose outputs are the unigram shares of ``counts`` (by symbol); only the recurrent part is random."""
    rng, h = np.random.default_rng(seed), HIDDEN
    counts = counts.astype(float) + 0.5
    full = np.full(shape.head_classes * shape.per_class, 1e-9)
    full[: shape.head] = counts[: shape.head]
    inside = full.reshape(-1, shape.per_class)
    by_class = np.concatenate([inside.sum(axis=1), counts[shape.head :]])
    bias = np.log(inside / inside.sum(axis=1, keepdims=True))
    bias[inside <= 1e-9] = -1e4
    p = {
        "x": rng.normal(0, 0.3, (shape.symbols, 3 * h)), "b": np.concatenate([np.full(h, 1.0), np.zeros(2 * h)]), "u": rng.normal(0, 0.25, (h, 3 * h)),
        "c": np.zeros((h, shape.classes)), "cb": np.log(by_class / by_class.sum()), "w": np.zeros((shape.head_classes, h, shape.per_class)), "wb": bias,
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


class Streams:
    """Documents laid end to end in ``STREAMS`` streams, the longest first into the shortest stream. ``x`` is the symbol
    before, ``y`` the symbol to predict, ``doc`` the document (-1: the stream is over)."""

    def __init__(self, docs: list[np.ndarray], streams: int = STREAMS):
        import heapq

        streams = max(1, min(streams, len(docs)))
        heap, lanes = [(0, i) for i in range(streams)], [[] for _ in range(streams)]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            size, lane = heapq.heappop(heap)
            lanes[lane].append(d)
            heapq.heappush(heap, (size + len(docs[d]), lane))
        lanes.sort(key=lambda lane: -sum(len(docs[d]) for d in lane))
        long = max((sum(len(docs[d]) for d in lane) for lane in lanes), default=0)
        self.y, self.doc = np.zeros((long, streams), np.uint16), np.full((long, streams), -1, np.int32)
        for i, lane in enumerate(lanes):
            if lane:
                y = np.concatenate([docs[d] for d in lane])
                self.y[: len(y), i] = y
                self.doc[: len(y), i] = np.repeat(lane, [len(docs[d]) for d in lane])
        self.x = np.zeros_like(self.y)
        self.x[1:] = self.y[:-1]  # a document's first symbol follows the end of the one before, or the start, which is the same symbol
        self.fresh = np.ones((long, streams), bool)
        self.fresh[1:] = self.doc[1:] != self.doc[:-1]

    def windows(self, steps: int):
        """Windows of the streams that are still running; streams are ordered by length, so these are the first ones."""
        for at in range(0, len(self.y), steps):
            live = int((self.doc[at] >= 0).sum())
            yield tuple(a[at : at + steps, :live] for a in (self.x, self.y, self.doc, self.fresh))


class Network:
    def __init__(self, shape: Shape, params: dict[str, np.ndarray]):
        self.shape, self.p = shape, params

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """States of a window, and what going back through it needs."""
        n, p = HIDDEN, self.p
        a = (p["x"] + p["b"])[x]
        keep = (~fresh).astype(np.float32)[:, :, None]
        states, kept = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            h = h * keep[t]
            g = h @ p["u"]
            zr = _sigmoid(a[t, :, : 2 * n] + g[:, : 2 * n])
            z, r, c = zr[:, :n], zr[:, n:], g[:, 2 * n :]
            new = np.tanh(a[t, :, 2 * n :] + r * c)
            kept.append((h, z, r, c, new))
            h = new + z * (h - new)
            states[t] = h
        return states, h, kept

    def outputs(self, states: np.ndarray, y: np.ndarray, slopes: bool):
        """Natural log-likelihood of each target; with ``slopes`` also the gradients of its negated sum.

        Arrays of classes have the positions last, so that a step over them runs through memory in order however few classes there are."""
        p, shape = self.p, self.shape
        s = np.ascontiguousarray(states.T)
        word = y < shape.head
        cls = np.where(word, y // shape.per_class, y - shape.head + shape.head_classes)
        ll, e = _log_softmax(p["c"], p["cb"], s, cls, slopes)
        grads, back = {}, None
        if slopes:
            grads = {"c": s @ e.T, "cb": e.sum(axis=1), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
            back = e.T @ p["c"].T
        order = np.argsort(np.where(word, cls, shape.head_classes).astype(np.uint16), kind="stable")[: int(word.sum())]  # two bytes: sorted by digits
        edges = np.searchsorted(cls[order], np.arange(shape.head_classes + 1))
        s, target = np.ascontiguousarray(states[order].T), y[order] - cls[order] * shape.per_class
        inner, part = np.empty(len(order), ll.dtype), np.empty((len(order), HIDDEN), np.float32)
        for k in range(shape.head_classes):
            at = slice(edges[k], edges[k + 1])
            if at.start == at.stop:
                continue
            inner[at], e = _log_softmax(p["w"][k], p["wb"][k], s[:, at], target[at], slopes)
            if slopes:
                grads["w"][k], grads["wb"][k] = s[:, at] @ e.T, e.sum(axis=1)
                part[at] = e.T @ p["w"][k].T
        ll[order] += inner
        if slopes:
            back[order] += part
        return ll, grads, back

    def back(self, x: np.ndarray, fresh: np.ndarray, kept: list, back: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the recurrent part, cut at the start of the window."""
        n, p = HIDDEN, self.p
        h, z, r, c, new = (np.stack([k[i] for k in kept]) for i in range(5))
        da = np.empty((*x.shape, 3 * n), np.float32)
        dg = np.empty_like(da)
        to_z, to_new, to_r = (h - new) * z * (1 - z), (1 - z) * (1 - new * new), c * r * (1 - r)  # what does not depend on the steps behind
        z, up, dh = z * (~fresh)[:, :, None], p["u"].T, np.zeros(back.shape[1:], np.float32)
        for t in range(len(x) - 1, -1, -1):
            dh += back[t]
            d, g = da[t], dg[t]
            dnew = dh * to_new[t]
            np.multiply(dh, to_z[t], out=d[:, :n])
            np.multiply(dnew, to_r[t], out=d[:, n : 2 * n])
            d[:, 2 * n :] = dnew
            g[:, : 2 * n] = d[:, : 2 * n]
            np.multiply(dnew, r[t], out=g[:, 2 * n :])
            dh *= z[t]
            through = g @ up
            through[fresh[t]] = 0
            dh += through
        du = h.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
        flat, at = da.reshape(-1, 3 * n), x.ravel()
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0)))
        return {"u": du, "b": flat.sum(axis=0), "x": (at[order][first], np.add.reduceat(flat[order], first, axis=0))}

    def train(self, docs: list[np.ndarray], rate: float = RATE, streams: int = STREAMS, steps: int = STEPS, seen: dict | None = None) -> float:
        """One pass over the documents by Adagrad; returns the mean natural log-likelihood before each update."""
        seen = seen if seen is not None else {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        total = count = 0.0
        lanes = Streams(docs, streams)
        h = np.zeros((lanes.y.shape[1], HIDDEN), np.float32)
        for x, y, doc, fresh in lanes.windows(steps):
            states, h, kept = self.run(x, fresh, h[: x.shape[1]])
            live = (doc >= 0).ravel()
            every = bool(live.all())
            s, target = states.reshape(-1, HIDDEN), y.ravel().astype(np.int64)
            ll, grads, part = self.outputs(s if every else s[live], target if every else target[live], True)
            back = part if every else np.zeros_like(s)
            if not every:
                back[live] = part
            grads |= self.back(x, fresh, kept, back.reshape(states.shape))
            n = len(ll)
            total, count = total + float(ll.sum()), count + n
            for k, g in grads.items():
                rows, g = g if k == "x" else (slice(None), g)
                g = g / np.float32(max(n, 1) ** 0.5 * 8)
                seen[k][rows] += g * g
                self.p[k][rows] -= np.float32(rate) * g / np.sqrt(seen[k][rows])
        return total / max(count, 1)

    def score(self, docs: list[np.ndarray], streams: int = STREAMS, steps: int = 64) -> np.ndarray:
        """Log10-likelihood of each whole document."""
        out = np.zeros(len(docs))
        lanes = Streams(docs, streams)
        h = np.zeros((lanes.y.shape[1], HIDDEN), np.float32)
        for x, y, doc, fresh in lanes.windows(steps):
            states, h, _ = self.run(x, fresh, h[: x.shape[1]])
            live = (doc >= 0).ravel()
            ll, _, _ = self.outputs(states.reshape(-1, HIDDEN)[live], y.ravel()[live].astype(np.int64), False)
            out += np.bincount(doc.ravel()[live], ll, minlength=len(docs))
        return out / np.log(10)
