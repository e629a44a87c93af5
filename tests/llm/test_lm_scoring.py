import math
import zlib
from collections import Counter

import numpy as np
import pytest

from oddsmill.llm import gru, lm_scoring
from oddsmill.llm.tables import keyed_text




def make(seed=0):
    shape = gru.Shape(8, 3, 4)
    rng = np.random.default_rng(seed)
    params = gru.initial(shape, rng.integers(1, 50, shape.symbols), seed)
    for k in ("c", "w"):
        params[k] = rng.normal(0, 0.5, params[k].shape).astype(np.float32)
    return shape, gru.Network(shape, params)


def plain_score(net, doc):
    """The definition, one symbol at a time in double precision."""
    p, n, shape = {k: v.astype(float) for k, v in net.p.items()}, gru.HIDDEN, net.shape
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    h, before, total = np.zeros(n), 0, 0.0
    for y in doc:
        a, g = p["x"][before] + p["b"], h @ p["u"]
        z, r = sig(a[:n] + g[:n]), sig(a[n : 2 * n] + g[n : 2 * n])
        new = np.tanh(a[2 * n :] + r * g[2 * n :])
        h = new + z * (h - new)
        cls = y // shape.per_class if y < shape.head else y - shape.head + shape.head_classes
        total += soft(h @ p["c"] + p["cb"])[cls]
        if y < shape.head:
            total += soft(h @ p["w"][cls] + p["wb"][cls])[y % shape.per_class]
        before = y
    return total / math.log(10)


def test_scores_carry_the_state_across_windows_and_not_across_documents():
    shape, net = make()
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, shape.symbols, n), 0).astype(np.uint16) for n in (0, 1, 70, 200, 3, 5)]
    want = [plain_score(net, d) for d in docs]
    for streams, steps in ((1, 7), (3, 64), (256, 16)):
        assert np.allclose(net.score(docs, streams, steps), want, rtol=1e-4)
    assert len(net.score([])) == 0


def test_probabilities_of_all_symbols_add_up():
    shape, net = make(3)
    docs = [np.array([5, 2, s], np.uint16) for s in range(shape.symbols)]
    rest = plain_score(net, [5, 2])
    assert abs(sum(10 ** (x - rest) for x in net.score(docs)) - 1) < 1e-3


def test_gradients_match_differences():
    shape, net = make(2)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, shape.symbols, (6, 4)), rng.integers(0, shape.symbols, (6, 4))
    fresh = np.zeros((6, 4), bool)
    fresh[0], fresh[3, 1] = True, True

    def loss():
        states, _, kept = net.run(x, fresh, np.zeros((4, gru.HIDDEN), np.float32))
        ll, grads, part = net.outputs(states.reshape(-1, gru.HIDDEN), y.ravel(), True)
        return -float(ll.sum()), grads | net.back(x, fresh, kept, part.reshape(states.shape))

    _, grads = loss()
    rows, g = grads.pop("x")
    grads["x"] = np.zeros_like(net.p["x"])
    grads["x"][rows] = g
    for k in ("u", "b", "x", "c", "cb", "w", "wb"):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            if k == "wb" and net.p[k][at] < -1e3:
                continue
            old = net.p[k][at]
            net.p[k][at] = old + 1e-2
            up = loss()[0]
            net.p[k][at] = old - 1e-2
            down = loss()[0]
            net.p[k][at] = old
            assert abs((up - down) / 2e-2 - grads[k][at]) < 0.02 + 0.05 * abs(grads[k][at]), k


def base_scores(docs):
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t in docs]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((d is not None, d or 0, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in tokens)


@pytest.mark.parametrize("lexicon", [300_000, 2])
def test_base_scores_match_plain_counts(spark, odd, lexicon, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEXICON", lexicon)
    monkeypatch.setattr(lm_scoring, "HEAD", 2)
    rows = lm_scoring.score_documents(keyed_text(odd)).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == base_scores([(r.doc_id, r.text) for r in odd.collect()])
    assert all(r.score < 0 for r in rows)


def test_empty_table(spark, no_documents):
    assert lm_scoring.score_documents(keyed_text(no_documents)).count() == 0


def test_model_beats_the_counts_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm_scoring.score_documents(keyed_text(docs)).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)


def test_log_softmax_has_positions_last_and_matches_float64():
    rng = np.random.default_rng(5)
    weight, bias, states = rng.normal(size=(4, 7)).astype("f4"), rng.normal(size=7).astype("f4"), rng.normal(size=(4, 50)).astype("f4")
    target = rng.integers(0, 7, 50)
    logit = weight.T.astype(float) @ states + bias[:, None]
    share = np.exp(logit) / np.exp(logit).sum(axis=0)
    ll, slopes = gru._log_softmax(weight, bias, states, target, True)
    assert np.allclose(ll, np.log(share[target, np.arange(50)]), atol=1e-5)
    assert slopes.shape == (7, 50) and np.allclose(slopes, share - (np.arange(7)[:, None] == target), atol=1e-5)
