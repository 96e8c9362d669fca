"""Chunked forms against plain loops; chunks are small so that every boundary rule runs."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators import series as S
from barloom.operators.aggregates import exact_quantiles
from barloom.operators.joins import asof_join, nearest_join
from barloom.operators.ranking import top_per_key


def frame(spark, values, symbol="x"):
    return spark.createDataFrame([(symbol, i, float(v)) for i, v in enumerate(values)], "symbol string, bar_idx long, v double")


def column(df, c, order="bar_idx"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


RNG = np.random.default_rng(7)


def test_index_series_numbers_across_buckets(spark):
    t = sorted(RNG.choice(10_000, 300, replace=False).tolist())
    df = spark.createDataFrame([("x", int(v)) for v in t], "symbol string, t long")
    got = S.index_series(df, ["symbol"], ["t"], [F.floor(F.col("t") / 97)]).orderBy("t").collect()
    assert [r.bar_idx for r in got] == list(range(300))


def test_over_chunks_equals_one_window(spark):
    df = frame(spark, RNG.normal(size=500))
    got = S.over_chunks(df, lambda x, f: x.withColumn("m", F.avg("v").over(f.last(20))).withColumn("n", f.lead("v", 3)), back=19, ahead=3, chunk=32)
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    want = df.withColumn("m", F.avg("v").over(w.rowsBetween(-19, 0))).withColumn("n", F.lead("v", 3).over(w))
    assert np.allclose(column(got, "m"), column(want, "m"))
    assert column(got, "n") == column(want, "n")


def test_over_chunks_rejects_frames_longer_than_a_chunk(spark):
    with pytest.raises(ValueError):
        S.over_chunks(frame(spark, [1.0]), lambda x, f: x, back=50, chunk=10)


def test_cusum_equals_recurrence(spark):
    r = RNG.normal(size=400)
    got = S.cusum(frame(spark, r), F.col("v"), size=17)
    up, down, a, b = [], [], 0.0, 0.0
    for x in r:
        a, b = max(0.0, a + x), min(0.0, b + x)
        up.append(a)
        down.append(b)
    assert np.allclose(column(got, "cusum_pos"), up)
    assert np.allclose(column(got, "cusum_neg"), down)


@pytest.mark.parametrize("period", [5, 14, 26])
def test_ema_forgets_across_chunks(spark, period):
    v = RNG.normal(size=3000).cumsum() + 500
    a = R.ema_alpha(period)
    halo = S.ema_halo(a)
    got = S.over_chunks(frame(spark, v), lambda x, f: x.withColumn("e", S.ema(F.col("v"), a, f)), back=halo, chunk=max(halo, 300))
    want, y = [], v[0]
    for i, x in enumerate(v):
        y = x if i == 0 else a * x + (1 - a) * y
        want.append(y)
    assert np.allclose(column(got, "e"), want, rtol=1e-12)


def test_ema_chunk_refuses_far_apart_factors():
    with pytest.raises(ValueError):
        S.ema_chunk(S.ema_halo(0.001), 0.9, 0.001)


def test_wilder_seed_and_recurrence(spark):
    v = np.abs(RNG.normal(size=1500)) + 1
    halo = S.ema_halo(1 / 14) + 15
    got = column(S.over_chunks(frame(spark, v), lambda x, f: x.withColumn("w", S.wilder(F.col("v"), 14, f)), back=halo, chunk=halo), "w")
    assert got[:14] == [None] * 14
    y = v[1:15].mean()
    assert got[14] == pytest.approx(y)
    for i in range(15, 1500):
        y = (y * 13 + v[i]) / 14
    assert got[-1] == pytest.approx(y)


@pytest.mark.parametrize("gap,share,size", [(3, 1.0, 8), (12, 0.5, 20), (12, 0.05, 16), (1, 0.7, 4)])
def test_thin_equals_greedy(spark, gap, share, size):
    idx = [i for i in range(400) if RNG.random() < share]
    df = spark.createDataFrame([(s, i) for s in ("x", "y") for i in idx], "symbol string, bar_idx long")
    got = S.thin(df, gap, size=max(size, gap)).filter("symbol = 'x'").orderBy("bar_idx").collect()
    want, free = [], 0
    for i in idx:
        if i >= free:
            want.append(i)
            free = i + gap
    assert [r.bar_idx for r in got] == want


def test_running_and_carry(spark):
    v = RNG.normal(size=200)
    df = frame(spark, v)
    b = [F.floor(F.col("bar_idx") / 13)]
    r = S.running(df, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "c": ("count", F.col("v"))}, bucket=b)
    assert np.allclose(column(r, "s"), v.cumsum())
    assert np.allclose(column(r, "m"), np.maximum.accumulate(v))
    assert column(r, "c") == list(range(1, 201))
    sparse = df.withColumn("k", F.when(F.col("bar_idx") % 41 == 5, F.col("v")))
    got = column(S.carry_last(sparse, "k", ["symbol"], ["bar_idx"], b[0], "filled"), "filled")
    last = None
    for i, x in enumerate(v):
        last = float(x) if i % 41 == 5 else last
        assert got[i] == last


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([("x", t) for t in range(0, 100, 3)], "symbol string, t long")
    right = spark.createDataFrame([("x", t) for t in (4, 10, 11, 50, 70)], "symbol string, at long")
    times = [4, 10, 11, 50, 70]
    for r in asof_join(left, right, ["symbol"], "t", "at", "m", 7).collect():
        past = [a for a in times if a <= r.t]
        assert (r.m.at if r.m else None) == (past[-1] if past else None)
    for r in nearest_join(left, right, ["symbol"], "t", "at", "m", 7).collect():
        assert r.m.at == min(times, key=lambda a: (abs(a - r.t), -a))


def test_exact_quantiles_with_ties_and_hot_group(spark):
    rows = [("hot", float(x)) for x in RNG.integers(0, 40, 3000)] + [("cold", float(x)) for x in RNG.normal(size=7)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.q): r.value_at_q for r in exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.9, 1.0], bins=16).collect()}
    for k in ("hot", "cold", "one"):
        v = [x for n, x in rows if n == k]
        for q in (0.25, 0.5, 0.9, 1.0):
            assert got[(k, q)] == pytest.approx(np.quantile(v, q))


def test_top_per_key(spark):
    df = spark.createDataFrame([("a", i, (i * 37) % 101) for i in range(500)], "k string, id long, w long")
    got = top_per_key(df, ["k"], [F.desc("w"), F.col("id")], 9, salts=8).collect()
    want = sorted(((i * 37) % 101, -i) for i in range(500))[::-1][:9]
    assert sorted((r.w, -r.id) for r in got)[::-1] == want
