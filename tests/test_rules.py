"""Hand-made cases and brute-force twins of rules that SQL does not check."""

import math

import numpy as np
import pytest

from barloom.functions import complexity as C
from barloom.functions import exits as X
from barloom.streaming import steps as S

RNG = np.random.default_rng(3)


def naive_entropy(x, m=2, r_mult=0.2):
    r = r_mult * x.std()

    def count(k):
        hit = tot = 0
        for i in range(len(x) - k):
            for j in range(i + 1, len(x) - k):
                tot += 1
                hit += all(abs(x[i + s] - x[j + s]) <= r for s in range(k))
        return hit, tot
    (a, ta), (b, tb) = count(m), count(m + 1)
    return 0.0 if not a or not b else -math.log((b / tb) / (a / ta))


def test_sample_entropy():
    x = RNG.normal(size=(4, 30))
    assert np.allclose(C.sample_entropy_matrix(x), [naive_entropy(v) for v in x])


def test_hurst_of_trend_exceeds_noise_and_is_bounded():
    noise, walk = RNG.normal(size=(20, 200)), RNG.normal(size=(20, 200)).cumsum(1)
    h0, h1 = C.hurst_matrix(noise, 10), C.hurst_matrix(walk, 10)
    assert h1.mean() > h0.mean() and ((h0 >= 0) & (h1 <= 1)).all()
    assert C.hurst_matrix(np.ones((2, 200)), 10).tolist() == [0.5, 0.5]
    assert C.hurst_matrix(np.ones((1, 30)), 20).tolist() == [0.5]


def test_fluctuation_width_short_and_flat():
    assert C.fluctuation_width_matrix(np.ones((1, 60))).tolist() == [0.0]
    assert C.fluctuation_width_matrix(RNG.normal(size=(1, 20))).tolist() == [0.0]


def one(bars, stop=(1.0,), **kw):
    names = ["open", "high", "low", "close", "volume_ratio", "quote_slope", "taker_slope", "trend", "win_prob", "participation", "exhaustion", "close_pos", "upper_wick"]
    neutral = [1.0, 0.0, 0.0, 0.0, 0.4, 50.0, 50.0, 0.5, 0.2]
    m = np.array([[*b, *neutral] for b in bars], dtype=float)
    path = {n: m[None, :, i] for i, n in enumerate(names)}
    first = {n: np.array([v]) for n, v in zip(names, [10, 10, 10, 10, *neutral])}
    args = dict(bank=2.0, fraction=0.5, activate=2.0, trail=1.0, pre=3, post=4, penetration=0.2, slip_cap=0.25, material=1.0) | kw
    out = X.adaptive_exit(path, first, np.array([10.0]), np.array([1.0]), np.array(stop), **args)
    return [np.asarray(o)[0] for o in out]


def test_adaptive_stop_fills_below_and_at_gap():
    lab, val, off, px, slip, banked, _ = one([(10, 10.2, 8.5, 9)])
    assert lab[0] == X.SL and off[0] == 1 and px[0] == pytest.approx(9 - 0.2 * 0.5) and slip[0] == pytest.approx(0.1) and not banked[0]
    lab, val, off, px, *_ = one([(8.0, 8.2, 7.5, 8)])
    assert px[0] == 8.0 and val[0] == pytest.approx(-2.0)


def test_adaptive_timeout_before_bank_and_bank_then_end():
    lab, val, off, *_ = one([(10, 10.5, 9.8, 10.1)] * 5)
    assert lab[0] == X.TIMEOUT and off[0] == 3 and val[0] == pytest.approx(0.1)
    lab, val, off, px, slip, banked, dd = one([(10, 12.5, 10, 12.2), (12, 12.4, 12.1, 12.3)])
    assert lab[0] == X.TP and banked[0] and val[0] == pytest.approx(0.5 * 2.0 + 0.5 * 2.3)


def test_adaptive_sweep_equals_single_stops():
    bars = [(10 + d, 10 + d + abs(RNG.normal()), 10 + d - abs(RNG.normal()), 10 + d + 0.1) for d in RNG.normal(size=12).cumsum() * 0.3]
    stops = (0.8, 1.5, 3.0)
    swept = one(bars, stop=stops)
    for i, s in enumerate(stops):
        alone = one(bars, stop=(s,))
        assert all(np.isclose(float(a[0]), float(b[i])) for a, b in zip(alone, swept))


def test_adaptive_no_atr_is_no_trade():
    names = ["open", "high", "low", "close", "volume_ratio", "quote_slope", "taker_slope", "trend", "win_prob", "participation", "exhaustion", "close_pos", "upper_wick"]
    path = {n: np.ones((1, 3)) for n in names}
    lab, val, off, *_ = X.adaptive_exit(path, {n: np.ones(1) for n in names}, np.array([1.0]), np.array([0.0]), np.array([1.0]), 2, 0.5, 2, 1, 3, 4, 0.2, 0.25, 1.0)
    assert lab[0, 0] == X.TIMEOUT and val[0, 0] == 0.0 and off[0, 0] == 0


def run(step, rows):
    state, out = {}, []
    for r in rows:
        state, emitted = step(state, r)
        out.extend(emitted)
    return out


def test_adwin_cuts_at_a_shift_only():
    calm = run(S.adwin(), [{"t": i, "id": i, "x": float(i % 2)} for i in range(300)])
    assert not any(h for _, _, h, _, _ in calm)
    shift = run(S.adwin(), [{"t": i, "id": i, "x": 1.0 if i < 200 else 0.0} for i in range(400)])
    hits = [i for i, (_, _, h, _, _) in enumerate(shift) if h]
    assert hits and 200 <= hits[0] < 260 and shift[-1][3] < 0.1


def test_picks_suppress_repeats_and_stop_before_target():
    base = {"direction": "BULLISH", "tp1": 11.0, "tp2": 12.0, "tp3": 13.0, "sl": 9.0, "price": 10.0}
    def row(t, kind, i=0, **k):
        return {"t": t, "kind": kind, "id": i, **base, **k}
    out = run(S.pick_lifecycle(), [row(0, "pick", 1), row(60, "pick", 2), row(120, "price", price=11.5), row(180, "price", price=8.0), row(240, "price", price=13.5)])
    assert [(i, s) for i, _, s, *_ in out] == [(1, "PENDING"), (1, "TP1"), (1, "TP3")]
    out = run(S.pick_lifecycle(), [row(0, "pick", 1), row(60, "price", price=8.5), row(90, "price", price=14.0)])
    assert [s for _, _, s, *_ in out] == ["PENDING", "SL"]
    out = run(S.pick_lifecycle(), [row(0, "pick", 1), row(90000, "price", price=10.0)])
    assert [s for _, _, s, *_ in out] == ["PENDING", "EXPIRED"]


def test_streak_size_and_day_turn():
    out = run(S.loss_streak(), [{"t": 86400 * d, "id": i, "pnl": p} for i, (d, p) in enumerate([(0, -1), (0, -1), (1, -1), (1, -1), (1, 2)])])
    assert [(d, n, f) for _, _, d, n, f in out] == [(-1, 1, 1.0), (-2, 2, 1.0), (-1, 3, 0.5), (-2, 4, 0.25), (0, 0, 1.0)]


def test_confirmed_drift_needs_two_streams():
    both = run(S.confirmed_drift(0), [{"t": i, "id": i, "acc": float(i < 200), "cal": float(i >= 200), "feat": 0.5} for i in range(400)])
    only = run(S.confirmed_drift(0), [{"t": i, "id": i, "acc": float(i < 200), "cal": 0.5, "feat": 0.5} for i in range(400)])
    assert any(c for _, _, c in both) and not any(c for _, _, c in only)


def test_regime_entropy_blends_its_parts(spark):
    from pyspark.sql import functions as F

    from barloom.functions.features import regime_entropy
    rows = [(0.0, 0.5, 1.5, 0.0), (3.0, 0.9, 0.25, 0.5), (1.0, 0.1, 1.0, 1.0), (-1.0, 0.5, 0.0, 0.2)]
    got = [r[0] for r in spark.createDataFrame(rows, "e double, h double, t double, w double").select(regime_entropy(*map(F.col, "ehtw"))).collect()]
    want = [0.3 * (min(1, e / 2) if e > 0 else 0) + 0.6 * abs(h - 0.5) + 0.2 * (1 - t if t < 1 else 0) + 0.2 * w for e, h, t, w in rows]
    assert np.allclose(got, want)
