"""Hard negatives against plain integer loops, with ties, windows, odd rows and large numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import negatives, queries
from tests.helpers import collected, oracle

SF = "/root/testdata/sf0.001"


def brute(rows, asks, k=5, scale=256):
    """rows: (id, label, vector)."""
    known = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, dot = [], lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, lab, v in known:
        if asks(i):
            others = sorted((-dot(v, w), j, m == lab) for j, m, w in known if j != i and len(w) == len(v))
            for p, j, _ in [x for x in others if x[2]][:k]:
                close = [(n, q) for n, q, same in others if not same and 80 * -p <= 100 * -n <= 100 * -p][:k]
                out += [(i, j, r + 1, q, -p, -n) for r, (n, q) in enumerate(close)]
    return sorted(out)


def run(spark, rows, every=5, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, id string").repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect()))


def test_negatives_equal_sql(spark):
    assert collected(queries.op12_hard_negatives(spark, SF)) == oracle(SF, queries.oracle_sql()["op12_hard_negatives"])


@pytest.mark.parametrize("n,dim,cells", [(250, 40, 1 << 20), (200, 7, 1 << 20), (260, 33, 2000)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, dim, cells):
    """Few labels and coarse components: many ties, many rows in every window; small blocks of rows and anchors."""
    for name in ("BLOCK_CELLS", "ANCHOR_CELLS", "SCORE_CELLS"):
        monkeypatch.setattr(negatives, name, cells)
    rng = random.Random(n)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    rows = [(i, rng.randrange(3), [round((c + rng.gauss(0, 0.7)) * 2) / 8 for c in rng.choice(centre)]) for i in range(n)]
    rows += [(n + i, i % 2, rows[0][2]) for i in range(40)]  # one vector with many rows of both labels
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 500


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.9, 0.25]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, None, [1.0, 0.2]), (None, 2, [1.0, 0.2]), (6, 2, None), (7, 2, [1.0, None]),
        (8, 1, [-1.0, 0.0]), (9, 2, [-1.0, 0.0]), (10, 3, [1.0]), (11, 3, [0.5]), (12, 2, [0.9]), (13, 4, [0.0, 0.0]), (14, 1, [0.0, 0.0]),
    ]
    assert run(spark, rows, every=10) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, every=1) == brute(rows, lambda i: True)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0, F.col("label")).collect() == []


def test_an_id_of_several_rows_is_one_anchor(spark):
    rows = [(0, 2, [1.0, 1.0]), (0, 1, [1.0, 0.0]), (0, 1, [2.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (2, 3, [0.9, 0.0])]
    got = run(spark, rows, every=10)
    p = 256 * 256
    want = [(0, 1, 1, 2, p, p), (0, 1, 2, 2, p, 230 * 256)]
    assert got == sorted(want * 2)


@pytest.mark.parametrize("top", [10, 1 << 24, 1 << 40, 1 << 61])
def test_survivors_are_all_in_the_window(top):
    rng = np.random.default_rng(top % 97)
    a, v = rng.integers(-top, top, (7, 48)), rng.integers(-top, top, (90, 48))
    v[:20] = a[0] + rng.integers(-2, 3, (20, 48))
    edge = (1 << 63) - 1
    exact = np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), -edge - 1), edge) for q in v.tolist()] for p in a.tolist()], dtype=np.int64)
    axes = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    high = np.partition(exact, 70, axis=1)[:, 70]
    low = np.partition(exact, 60, axis=1)[:, 60]
    for turn in (axes, None):
        x, y, s = negatives.survivors(negatives.Rotated(a, turn), negatives.Rotated(v, turn), negatives.rounding(48, turn), low, high, lambda b, e: np.ones((e - b, 90), bool))
        assert (exact[x, y] == s).all()
        found = set(zip(x.tolist(), y.tolist(), strict=True))
        assert {(i, j) for i in range(7) for j in range(90) if low[i] <= exact[i, j] <= high[i]} <= found
        if top < 1 << 40:
            assert len(found) < 7 * 60  # most others are gone before the integer products


def test_axes_are_those_of_all_rows(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 6)) * [9, 1, 5, 1, 1, 1] * 10).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1, 2])], "id long, vec array<long>").repartition(4)
    found = negatives.rotations(df)
    assert sorted(found) == [2, 6]
    want = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    assert np.abs(np.abs(np.diag(found[6].T @ want)) - 1).max() < 1e-6
    assert negatives.rotations(df.limit(0)) == {}
