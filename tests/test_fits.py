"""Models fitted together: at their optimum, the same as alone, and all in each pass."""

import math

import numpy as np
import pytest

from lumenframe.operators import fits, heads


def table(spark, x, y, fold=None):
    rows = [(v.tolist(), [int(t) for t in np.atleast_1d(c)], int(f)) for v, c, f in zip(x, y, fold if fold is not None else [0] * len(x), strict=True)]
    return spark.createDataFrame(rows, "embedding array<double>, y array<int>, fold int").repartition(3)


def gradient(m, x, y, fold):
    f = fits.losses([m], [m.x.ravel()], x, y, fold)[0][1:].reshape(m.outputs, -1) * m.c
    f[:, :-1] += m.x[:, :-1]
    return np.abs(f).max()


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(2)
    x, y, fold = rng.normal(size=(40, 3)), rng.integers(0, 3, (40, 1)), rng.integers(0, 4, 40)
    models = [fits.Model(3, 1.0, np.array([1.0, 2.0, 0.5]), without=2), fits.Model(1, 1.0, np.array([0.5, 2.0]))]
    for m, y_ in zip(models, (y, (y > 0).astype(int)), strict=True):
        p = rng.normal(size=m.outputs * 4)
        got = fits.losses([m], [p], x, y_, fold)[0]
        for i in range(len(p)):
            d = np.zeros(len(p))
            d[i] = 1e-6
            numeric = (fits.losses([m], [p + d], x, y_, fold)[0][0] - fits.losses([m], [p - d], x, y_, fold)[0][0]) / 2e-6
            assert abs(numeric - got[1 + i]) < 1e-5


def test_all_models_reach_their_optimum_in_common_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 300)
    x, fold = rng.normal(size=(300, 6)) + np.eye(6)[y] * 1.5, np.arange(300) % 3
    rows = table(spark, x, y, fold)
    models = [fits.Model(4, c, np.array([1.0, 0.5, 2.0, 1.0]), without=f) for c in (0.01, 1.0, 100.0) for f in (None, 0, 1, 2)]
    jobs, run = [], fits._partial
    monkeypatch.setattr(fits, "_partial", lambda shared: jobs.append(len(shared.value[0])) or run(shared))
    passes = fits.fit(rows, models, 6)
    assert passes == len(jobs) < 150 and jobs[0] == 12
    for m in models:
        used = np.ones(300, bool) if m.without is None else fold != m.without
        assert gradient(m, x, y[:, None], fold) < 1e-4 * max(1.0, m.c * used.sum() / 100)
    alone = fits.Model(4, 1.0, np.array([1.0, 0.5, 2.0, 1.0]), without=1)
    fits.fit(rows, [alone], 6)
    assert np.abs(alone.x - models[6].x).max() < 1e-4


def test_separable_and_constant_features(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [-1.0, 5.0], [-2.0, 5.0]])
    y = np.array([[1, 0], [1, 0], [0, 0], [0, 1]])
    models = [fits.Model(1, 1.0, np.array([1.0, 1.0]), target=t) for t in (0, 1)]
    fits.fit(table(spark, x, y), models, 2)
    for m in models:
        assert gradient(m, x, y, np.zeros(4)) < 1e-5
    assert (x @ models[0].x[0, :-1] + models[0].x[0, -1] > 0).tolist() == [True, True, False, False]


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_heads_are_at_their_minimum_and_pick_c(spark, c):
    rng = np.random.default_rng(5)
    y = rng.random(200) < 0.3
    x = rng.normal(size=(200, 4)) + y[:, None] * [1.5, 0, 0, -1]
    df = spark.createDataFrame([(i, v.tolist(), ["p"] if t else []) for i, (v, t) in enumerate(zip(x, y, strict=True))], "item long, embedding array<float>, labels array<string>").repartition(3)
    h = heads.train_heads(df, df, ["p"], grid=(c,)).first()
    w, b, n = np.array(h["w"]), h["b"], y.sum()
    x = x.astype(np.float32).astype(float)
    error = (1 / (1 + np.exp(-(x @ w + b))) - y) * np.where(y, 200 / (2 * n), 200 / (2 * (200 - n)))
    assert np.abs(w + c * x.T @ error).max() < 1e-3 and abs(c * error.sum()) < 1e-3 and h["c_reg"] == c
    tied = heads.train_heads(df, df.where("size(labels) = 0"), ["p"], grid=(1.0, 0.01)).first()
    assert tied["c_reg"] == 0.01  # no positives to choose by


def test_macro_f1_counts_seen_classes_only():
    assert heads.macro_f1(np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0]])) == round((0.8 + 2 / 3) / 2, 6)
    assert heads.macro_f1(np.zeros((2, 2))) == 0.0 and math.isfinite(heads.macro_f1(np.eye(3)))
