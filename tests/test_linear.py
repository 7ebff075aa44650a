"""Many linear machines at once against each by itself, and calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import linear
from lexigrid.session import staged


def made(seed=2, n=90, d=12, classes=("a", "b", "c"), noise=0.6):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, d)) < 0.4, rng.normal(0, 1, (n, d)), 0.0)
    w = rng.normal(0, 1, (d, len(classes)))
    y = np.argmax(x @ w + noise * rng.normal(0, 1, (n, len(classes))), axis=1)
    return x, y, np.arange(n) % 3


@pytest.fixture(scope="module")
def rows_of(spark):
    def make(x, y, fold, classes):
        table = []
        for i, row in enumerate(x):
            at = np.flatnonzero(row)
            table.append((i, classes[y[i]], int(fold[i]), [int(k) for k in at], [float(v) for v in row[at]]))
        df = spark.createDataFrame(table, "doc_id long, label string, fold int, idx array<int>, val array<double>")
        return staged(df.repartition(3), "rows")

    return make


def plain_svm(x, sign, c, steps=20000):
    """Gradient descent on the same function, by itself."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    rate = 0.5 / (1 / (c * n) + (x**2).sum() / n / linear.SMOOTH + 1 / linear.SMOOTH)
    for _ in range(steps):
        _, slope = linear._hinge(sign * (x @ w + b))
        pull = -sign * slope / n
        w -= rate * (w / (c * n) + x.T @ pull)
        b -= rate * pull.sum()
    return w, b


def value(x, sign, c, w, b):
    return w @ w / (2 * c * len(x)) + linear._hinge(sign * (x @ w + b))[0].mean()


@pytest.mark.parametrize("block", [1 << 21, 200])
def test_all_machines_equal_each_by_itself(rows_of, block, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK", block)
    monkeypatch.setattr(linear, "_GATHERED", 0 if block < 300 else 64 << 20)
    classes = ("a", "b", "c")
    x, y, fold = made()
    found = linear.fit_all(rows_of(x, y, fold, classes), x.shape[1], classes, 3, (0.1, 2.0), tol=1e-5)
    assert found.weights.shape == (13, 4 * 2 * 3)
    for j, i, c in ((0, 0, 0), (2, 1, 1), (3, 1, 2), (3, 0, 1)):
        mine = fold != j
        sign, penalty = np.where(y == c, 1.0, -1.0)[mine], found.penalties[i]
        w = found.of(j, i)[:, c]
        want = plain_svm(x[mine], sign, penalty)
        assert value(x[mine], sign, penalty, w[:-1], w[-1]) <= value(x[mine], sign, penalty, *want) * 1.0005 + 1e-7


def test_scale_by_fold_goes_into_the_weights(rows_of):
    classes = ("a", "b")
    x, y, fold = made(5, 60, 6, classes)
    x[:, 0] *= 100
    scale = np.array([np.abs(x[fold != j]).max(0) for j in range(4)])
    found = linear.fit_all(rows_of(x, y, fold, classes), 6, classes, 3, (1.0,), scale, tol=1e-5)
    for j in range(4):
        plain = linear.fit_all(rows_of(x / scale[j], y, fold, classes), 6, classes, 3, (1.0,), tol=1e-5)
        got, want = found.of(j, 0)[:, 0], plain.of(j, 0)[:, 0]
        assert got[:-1] * scale[j] == pytest.approx(want[:-1], abs=2e-2) and got[-1] == pytest.approx(want[-1], abs=2e-2)


def test_margins_are_out_of_fold(rows_of):
    classes = ("a", "b", "c")
    x, y, fold = made()
    rows = rows_of(x, y, fold, classes)
    found = linear.fit_all(rows, 12, classes, 3, (0.5, 1.0))
    for r in linear.margins(rows, found, ["label", "fold"]).collect():
        w = found.of(r["fold"], r["setting"])
        want = x[r["doc_id"]] @ w[:-1] + w[-1]
        assert r["margins"] == pytest.approx(list(want)) and r["predicted"] == classes[int(np.argmax(want))]
    new = rows.withColumn("fold", F.lit(None).cast("int"))
    for r in linear.margins(new, found).where("setting = 1").collect():
        w = found.of(3, 1)
        assert r["margins"] == pytest.approx(list(x[r["doc_id"]] @ w[:-1] + w[-1]))


def test_no_row_calibrates_the_machine_it_trained(spark, rows_of):
    """Labels by chance and as many features as rows: margins of training rows look certain, those out of fold do not."""
    rng = np.random.default_rng(4)
    classes = ("a", "b")
    x, y, fold = rng.normal(0, 1, (60, 80)), rng.integers(0, 2, 60), np.arange(60) % 3
    rows = rows_of(x, y, fold, classes)
    found = linear.fit_all(rows, 80, classes, 3, (10.0,))
    scored = staged(linear.margins(rows, found, ["label", "fold"]), "scored")
    seen = staged(linear.margins(rows.withColumn("fold", F.lit(3)), found, ["label"]), "seen")
    assert seen.where("label = predicted").count() == 60
    own, fair = linear.calibrated(seen, classes), linear.calibrated(scored, classes)
    chance = lambda curve, m: 1 / (1 + np.exp(curve[0] * m + curve[1]))
    assert chance(own[1], 1.0) > 0.9 and abs(chance(fair[1], 1.0) - 0.5) < 0.25


def test_calibration_against_gradient_descent(spark):
    rng = np.random.default_rng(6)
    m, y = rng.normal(0, 2, 300), np.zeros(300, int)
    y[rng.random(300) < 1 / (1 + np.exp(-1.5 * m + 0.5))] = 1
    table = [("ab"[k], [float(-v), float(v)]) for k, v in zip(y, m)]
    (_, _), (a, b) = linear.calibrated(spark.createDataFrame(table, "label string, margins array<double>"), ("a", "b"))
    n = y.sum()
    t = np.where(y == 1, (n + 1) / (n + 2), 1 / (300 - n + 2))
    p, q = 0.0, 0.0
    for _ in range(20000):
        e = t - 1 / (1 + np.exp(p * m + q))
        p, q = p - 0.05 * (e * m).mean(), q - 0.05 * e.mean()
    assert (a, b) == pytest.approx((p, q), abs=1e-3)
    apart = [("a", [1.0, -1.0])] * 20 + [("b", [-1.0, 1.0])] * 20
    curves = linear.calibrated(spark.createDataFrame(apart, "label string, margins array<double>"), ("a", "b"))
    assert all(np.isfinite(c).all() for c in curves)
    assert 1 / (1 + np.exp(curves[1][0] + curves[1][1])) == pytest.approx(21 / 22, abs=1e-3)
