"""The soft probe: gradient by finite differences, both ways of stepping, a fit that tells classes."""

import numpy as np
import pytest

from quillon.operators import probe


def data(n=120, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    true = rng.standard_normal((k, d))
    x = rng.standard_normal((n, d)) / 10
    y = 1 / (1 + np.exp(-20 * x @ true.T))
    return x, y, rng.choice([0.0, 0.5, 1.0], n)


def frame(spark, x, y, w):
    return spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, y array<double>, w double")


def test_gradient():
    x, y, w = data(20)
    rng = np.random.default_rng(1)
    weights, bias = rng.standard_normal((3, 5)), rng.standard_normal(3)
    got = probe.loss_and_gradient(x, y, w, weights, bias)
    loss = lambda a, b: probe.loss_and_gradient(x, y, w, a, b)[:, 0].sum()
    for i in range(3):
        for j in range(6):
            up, low = np.column_stack([weights, bias]), np.column_stack([weights, bias])
            up[i, j] += 1e-5
            low[i, j] -= 1e-5
            slope = (loss(up[:, :-1], up[:, -1]) - loss(low[:, :-1], low[:, -1])) / 2e-5
            assert abs(slope - got[i, 1 + j]) < 1e-6 * max(1, abs(slope))
    # the loss of plain logits
    p = 1 / (1 + np.exp(-(x * probe.SCALE @ weights.T + bias)))
    assert abs(got[:, 0].sum() - (-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(axis=1) * w).sum()) < 1e-9


@pytest.mark.parametrize("bound", [probe.DRIVER_NUMBERS, 0])
def test_steps_equal_numpy(spark, bound):
    x, y, w = data()
    got = probe.fit_soft_probe(frame(spark, x, y, w).repartition(3), epochs=6, driver_numbers=bound)
    at, m, v = np.zeros((3, 6)), 0, 0
    for t in range(1, 7):
        g = probe.loss_and_gradient(x, y, w, at[:, :-1], at[:, -1])[:, 1:] / len(x)
        g[:, :-1] += 2e-4 * at[:, :-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - 0.01 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(got.weights, at[:, :-1], atol=1e-10) and np.allclose(got.bias, at[:, -1], atol=1e-10)
    assert len(got.losses) == 6 and got.losses[-1] < got.losses[0]


def test_fit_and_scores(spark):
    x, y, w = data(400)
    rows = frame(spark, x, y, w)
    got = probe.fit_soft_probe(rows)
    assert got.losses[-1] < 0.8 * got.losses[0] and np.abs(got.probabilities(x) - y).mean() < 0.15
    scored = probe.probe_scores(rows.withColumnRenamed("x", "embedding"), got, ["a", "b", "c"], ["y"]).collect()
    want = {tuple(b): p for b, p in zip(y.tolist(), got.probabilities(x))}
    assert all(np.allclose([r.probs[c] for c in "abc"], want[tuple(r.y)]) for r in scored) and len(scored) == 400
    assert probe.fit_soft_probe(rows.limit(0)) is None
