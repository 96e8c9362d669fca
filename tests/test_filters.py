"""Walk-forward filters and the bootstrap against plain NumPy forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import filters as FL
from barloom.operators import trades as T
from barloom.operators import training as M

FEATURES, TARGETS = ["a", "b", "c"], ["y1", "y2", "y3"]


def plain_fit(x, y, c):
    """Newton's method on one model, from the definition of its loss."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.append((x - mean) / scale, np.ones((len(x), 1)), axis=1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, keep = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(c * (z.T * (w * p * (1 - p))) @ z + keep, c * z.T @ (w * (p - y)) + keep @ b)
    return b, mean, scale


def plain_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.0] + [0, 10, 3]
    chance = 1 / (1 + np.exp(-(x[:, 0] * 2 + x[:, 1] / 50)))
    y = np.stack([rng.random(n) < chance, rng.random(n) < 0.5, np.arange(n) > 400], axis=1).astype(int)
    fold = np.array([-1] * 40 + list(np.repeat([0, 1, 2], [160, 200, 200])))
    x[5, 0], x[450, 1] = np.nan, np.inf
    return x, y, fold


def test_filters_equal_plain_fits(spark, table):
    x, y, fold = table
    rows = spark.createDataFrame([(i, None if f < 0 else int(f), *map(float, u), *map(int, v)) for i, (u, v, f) in enumerate(zip(x, y, fold))],
                                 "id long, fold int, a double, b double, c double, y1 int, y2 int, y3 int").repartition(5)
    model = FL.fit_filters(rows, FEATURES, TARGETS, 3)
    got = {r["id"]: r["proba"] for r in FL.scored_by_filters(rows, model, FEATURES, TARGETS).collect()}
    assert sorted(got) == list(range(40, 600))
    fine = np.isfinite(x).all(axis=1)
    quality = {(r["target"], r["fold"]): r for r in FL.filter_quality(FL.scored_by_filters(rows, model, FEATURES, TARGETS), TARGETS).collect()}
    for k in range(3):
        past, here = (fold < k) & fine, np.flatnonzero(fold == k)
        for t in range(3):
            # fold 0 has 39 sound rows before it, target y3 no hit before fold 2
            if past.sum() < 50 or len(set(y[past, t])) < 2:
                assert all(got[i][t] is None for i in here)
                continue
            b, mean, scale = plain_fit(x[past], y[past, t], FL.C)
            want = 1 / (1 + np.exp(-np.append((x[here] - mean) / scale, np.ones((len(here), 1)), axis=1) @ b))
            sound = [n for n, i in enumerate(here) if fine[i]]
            assert np.allclose([got[here[n]][t] for n in sound], want[sound], atol=1e-6) and all(got[here[n]][t] is None for n in range(len(here)) if n not in sound)
            q, labels = quality[TARGETS[t], k], y[here, t][sound]
            assert (q["rows"], q["positives"]) == (len(sound), labels.sum())
            if 0 < labels.sum() < len(labels):
                assert q["auc"] == pytest.approx(plain_auc(labels, np.round(want[sound], 4)), abs=2e-4)
    assert not quality["y1", 1]["weak"] and quality["y2", 1]["weak"]


def test_equal_rows_are_read_once_and_count_as_often_as_they_come(spark, table, monkeypatch):
    x, y, fold = table
    rows = spark.createDataFrame([(None if f < 0 else int(f), *map(float, u), *map(int, v)) for u, v, f in zip(x, y, fold)],
                                 "fold int, a double, b double, c double, y1 int, y2 int, y3 int").repartition(5)
    tables, real = [], FL.settle
    monkeypatch.setattr(FL, "settle", lambda df, name="table": tables.append(real(df, name)) or tables[-1])
    once = FL.fit_filters(rows, FEATURES, TARGETS, 3, c=0.5, least=30)
    often = FL.fit_filters(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4)))), FEATURES, TARGETS, 3, c=0.125, least=30)
    # 600 rows without the last fold of 200 and one that is not sound
    assert [t.count() for t in tables] == [399, 399] and [t.agg(F.sum("n")).first()[0] for t in tables] == [399, 4 * 399]
    for name in ("coef", "mean", "scale", "usable"):
        assert np.allclose(once[name], often[name], atol=1e-8)
    assert once["usable"].any()


def test_newton_sums_equal_loops():
    rng = np.random.default_rng(7)
    z, y, n, coef, weights = np.append(rng.normal(size=(2, 50)), np.ones((1, 50)), axis=0), rng.integers(0, 2, (2, 50)), rng.integers(1, 5, 50), rng.normal(size=(2, 3)), rng.random((2, 2))
    got = FL.newton_sums(z, y, n, coef, weights)
    for t in range(2):
        gradient, bend = np.zeros(3), np.zeros((3, 3))
        for r in range(50):
            p, w = 1 / (1 + np.exp(-coef[t] @ z[:, r])), n[r] * weights[t, y[t, r]]
            gradient += w * (p - y[t, r]) * z[:, r]
            bend += w * p * (1 - p) * np.outer(z[:, r], z[:, r])
        assert np.allclose(got[t], np.append(gradient, bend.ravel()))


def test_bootstrap_equals_a_loop_and_is_poisson(spark):
    rng = np.random.default_rng(6)
    pnl, ids = rng.normal(0.1, 1, 300), rng.integers(0, 2**40, 300)
    got = T.bootstrap_profit_factor(spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, pnl)], "id long, pnl double").repartition(3), "pnl", "id", reps=200).first()
    weight = np.searchsorted(np.array(T.poisson_cuts()), T.bootstrap_chance(ids & (2**32 - 1), np.arange(200)), side="right")
    pf = sorted(sum(w * v for w, v in zip(col, pnl) if v > 0) / -sum(w * v for w, v in zip(col, pnl) if v < 0) for col in weight.T)
    assert got["rows"] == 300 and got["pf_low"] == pytest.approx(np.quantile(pf, 0.05))
    many = np.searchsorted(np.array(T.poisson_cuts()), T.bootstrap_chance(np.arange(4000), np.arange(300)), side="right")
    assert many.mean() == pytest.approx(1, abs=0.01) and many.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(many[0], many[1])[0, 1]) < 0.2


def test_top_coefficients_name_the_telling_feature(spark, table):
    x, y, _ = table
    rows = spark.createDataFrame([(*map(float, u), int(v[0]), 1.0) for u, v in zip(x, y) if np.isfinite(u).all()], "a double, b double, c double, label int, weight double")
    got = M.top_coefficients(rows, FEATURES, "label", "weight", 2).collect()
    assert [r["feature"] for r in got] == ["a", "b"] and got[0]["coefficient"] > got[1]["coefficient"] > 0
    assert rows.select(F.count("*")).first()[0] == 598
