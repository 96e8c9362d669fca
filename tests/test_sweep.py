"""Exit labels by a sweep over chunks against one walk of each event over the whole series."""

import numpy as np
import pandas as pd
import pytest

from barloom.functions import exits as X
from barloom.operators import labels as L
from barloom.operators import outcomes as O


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    rows, starts = [], []
    for symbol, n in (("a", 400), ("b", 30), ("c", 1)):
        close = 100 + rng.normal(size=n).cumsum()
        for i in range(n):
            high, low = close[i] + rng.random() * 2, close[i] - rng.random() * 2
            rows.append((symbol, i, float(rng.uniform(low, high)), float(high), float(low), float(close[i]), *[float(x) for x in rng.random(9) * 60]))
            if i % 3 == 0 or symbol == "c":
                starts.append((symbol, i, float(close[i]), float(rng.choice([0.0, 1.5, 2.5]) if i % 30 == 0 else 1.5)))
    bars = pd.DataFrame(rows, columns=["symbol", "bar_idx", *O.FLOW])
    return bars, pd.DataFrame(starts, columns=["symbol", "start_bar", "close", "atr"]), spark.createDataFrame(bars), spark.createDataFrame(
        starts, "symbol string, start_bar long, close double, atr double")


def paths(bars, starts, horizon, first, cols):
    """Whole paths of the events that have bars ahead, cut from the whole series."""
    kept, out = [], {c: [] for c in cols}
    for row in starts.itertuples():
        own = bars[bars.symbol == row.symbol]
        ahead = own[(own.bar_idx >= row.start_bar + first) & (own.bar_idx <= row.start_bar + horizon)]
        if len(ahead):
            kept.append(row.Index)
            for c in cols:
                out[c].append(np.append(ahead[c].to_numpy(), np.full(horizon - first + 1 - len(ahead), np.nan)))
    return starts.loc[kept], {c: np.array(v) for c, v in out.items()}


@pytest.mark.parametrize("chunk, cells", [(2048, 4_000_000), (7, 4_000_000), (50, 400)])
def test_adaptive_exits_by_chunks_equal_whole_series(series, monkeypatch, chunk, cells):
    bars, starts, sb, ss = series
    monkeypatch.setattr(L, "SWEEP_CELLS", cells)
    got = O.adaptive_outcomes(ss, sb, stops=(1.0, 2.0), bank=1.2, activate=1.0, trail=1.0, pre=12, post=15, chunk=chunk).toPandas()
    ev, path = paths(bars, starts, 39, 0, O.FLOW)
    lab, val, off, px, slip, banked, dd = X.adaptive_exit({c: v[:, 1:] for c, v in path.items()}, {c: v[:, 0] for c, v in path.items()}, ev.close.to_numpy(), ev.atr.to_numpy(),
                                                          np.array([1.0, 2.0]), 1.2, 0.5, 1.0, 1.0, 12, 15, 0.20, 0.25, 1.0)
    want = pd.DataFrame({"symbol": np.repeat(ev.symbol.to_numpy(), 2), "start_bar": np.repeat(ev.start_bar.to_numpy(), 2), "sl_atr": np.tile([1.0, 2.0], len(ev)), "outcome": X.LABELS[lab].ravel(),
                         "realized": val.ravel(), "exit_bar": (ev.start_bar.to_numpy()[:, None] + off).ravel(), "exit_price": px.ravel(), "stop_slip_atr": slip.ravel(),
                         "banked": banked.ravel(), "max_drawdown": dd.ravel()})
    key = ["symbol", "start_bar", "sl_atr"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("chunk", [2048, 11])
def test_decision_matrix_by_chunks_equals_whole_series(series, chunk):
    bars, starts, sb, ss = series
    live = ss.filter("atr > 0")
    got = O.decision_matrix(live, sb, 6, 9, stops=(1.0,), chunk=chunk).toPandas()
    ev, path = paths(bars, starts[starts.atr > 0], 15, 1, ["open", "high", "low", "close"])
    g = np.array(O.grid_rows(6, 9, (1.0,)))
    lab, val, dd = X.grid_exit(*[path[c] for c in ("open", "high", "low", "close")], ev.close.to_numpy(), ev.atr.to_numpy(), g[:, 0], g[:, 1], g[:, 3], g[:, 4], 6, 9, 0.2, 0.25)
    want = {tuple(k): (len(ev), t, v, d) for k, t, v, d in zip(g.tolist(), (lab == X.TP).sum(0), val.sum(0), dd.max(0))}
    assert len(got) == len(want)
    for r in got.itertuples():
        n, tp, total, worst = want[r.bank_atr, r.bank_fraction, r.trail_activate_atr, r.runner_trail_atr, r.sl_atr]
        assert (r[6], r.tp_count) == (n, tp)
        assert r.sum_realized_atr == pytest.approx(total) and r.max_trade_drawdown_atr == pytest.approx(worst)
