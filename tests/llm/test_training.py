"""The training loops of both classifiers against plain loops over single coordinates."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shopgauge.llm import quality, toxicity


def plain_ftrl(texts, labels, s):
    """FTRL-proximal with a rate of its own for each coordinate; the last number is the constant, which has no L1."""
    size = 1 << s.bits
    z, n = {}, {}

    def weight(i):
        l1 = s.l1 if i < size else 0.0
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for text, label in zip(texts, labels):
            w = {i: weight(i) for i in text}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in text:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i)) != 0}


@pytest.mark.parametrize("l1", [0.0, 0.3, 2.0])
def test_ftrl(l1):
    rng = np.random.default_rng(4)
    s = toxicity.Settings(bits=6, l1=l1, epochs=3)
    labels = rng.integers(0, 2, 50).astype(float)
    texts = [np.append(np.unique(np.append(rng.integers(0, 64, rng.integers(1, 12)), 7 if y else 9)), 64).astype(np.int32) for y in labels]
    at, w = toxicity.train(texts, labels, s)
    expected = plain_ftrl([t.tolist() for t in texts], labels.tolist(), s)
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(expected, rel=1e-9)
    assert expected[7] > 0 > expected[9]


def plain_sgd(texts, labels, s):
    """Averaged vectors, two outputs, softmax, one step per text; what is learned folds into a number per bucket."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, (1 << s.bits, s.dims)).tolist()
    out, bias = [[0.0, 0.0] for _ in range(s.dims)], [0.0, 0.0]
    steps, done = s.epochs * len(texts), 0
    for _ in range(s.epochs):
        for t in rng.permutation(len(texts)).tolist():
            at, share = texts[t]
            hidden = [sum(share[k] * vectors[at[k]][d] for k in range(len(at))) for d in range(s.dims)]
            logit = [sum(hidden[d] * out[d][c] for d in range(s.dims)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(logit)) for x in logit]
            p = [x / sum(e) for x in e]
            p[int(labels[t])] -= 1
            rate = s.rate * (1 - done / steps)
            back = [out[d][0] * p[0] + out[d][1] * p[1] for d in range(s.dims)]
            for k in range(len(at)):
                for d in range(s.dims):
                    vectors[at[k]][d] -= rate * math.sqrt(len(at)) * share[k] * back[d]
            for d in range(s.dims):
                for c in (0, 1):
                    out[d][c] -= rate * hidden[d] * p[c]
            for c in (0, 1):
                bias[c] -= rate * 0.1 * p[c]
            done += 1
    return [sum(v[d] * (out[d][1] - out[d][0]) for d in range(s.dims)) for v in vectors], bias[1] - bias[0]


def test_sgd():
    rng = np.random.default_rng(6)
    s = quality.Settings(bits=5, dims=3, epochs=4)
    labels = rng.integers(0, 2, 50)
    texts = []
    for y in labels.tolist():
        at = np.unique(np.append(rng.integers(0, 32, rng.integers(1, 9)), 3 if y else 5))
        share = rng.random(len(at))
        texts.append((at, share / share.sum()))
    weights, constant = quality.train(texts, labels, s)
    expected, bias = plain_sgd([(a.tolist(), x.tolist()) for a, x in texts], labels.tolist(), s)
    assert weights.tolist() == pytest.approx(expected, rel=1e-9, abs=1e-12) and constant == pytest.approx(bias)
    assert weights[3] > 0 > weights[5]
