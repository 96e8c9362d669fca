"""Exit rules over many events at once, as array steps along the bar axis.

Each function takes a batch of padded paths (events x bars) and a small parameter grid and
walks the bars once, updating events x grid state arrays. They run inside Spark tasks on
Arrow batches; Spark partitions the events.
"""

from __future__ import annotations

import numpy as np

from barloom.functions.scores import top_score, wave_score

SL, TP, TIMEOUT = 0, 1, 2
LABELS = np.array(["SL", "TP", "TIMEOUT"])


def grid_exit(o, h, lo, c, entry, atr, bank, fraction, trail, stop, pre: int, post: int,
              penetration: float, slip_cap: float):
    """Bank-and-trail rule on a grid: (label, realized, drawdown), each events x grid.

    The bank target is looked at before the stop; stops fill below their level by the
    penetration share of one ATR plus capped slippage.
    """
    n, k = len(entry), len(bank)
    e, a = entry[:, None], np.where(atr > 0, atr, 1e-12)[:, None]
    banked = np.zeros((n, k), bool)
    done = np.zeros((n, k), bool)
    peak = np.repeat(e, k, 1)
    level = e - stop * a
    realized = np.zeros((n, k))
    label = np.full((n, k), TIMEOUT)
    worst = np.zeros((n, k))
    tail = np.repeat(e, k, 1)
    for j in range(min(h.shape[1], pre + post)):
        here = ~np.isnan(c[:, j])[:, None] & ~done
        if not here.any():
            break
        O, H, L, C = (x[:, j][:, None] for x in (o, h, lo, c))
        worst = np.where(here, np.fmax(worst, (e - L) / a), worst)
        tail = np.where(here, C, tail)
        was = banked.copy()
        hit = here & ~was & (H >= e + bank * a)
        top = np.where(here & (was | hit), np.fmax(peak, C), peak)
        runner = here & was
        trailed = np.where(hit | runner, top - trail * a, -np.inf)
        level = np.where(hit, trailed, np.where(runner, np.fmax(level, trailed), level))
        peak, banked = top, was | hit
        eff = level - penetration * a
        fill = np.fmax(eff - np.fmin(O - eff, slip_cap * a), L)
        stopped = here & ~hit & (L <= eff)
        late = here & ~hit & ~stopped & (j + 1 >= np.where(was, pre + post, pre))
        price = np.where(stopped, fill, C)
        value = np.where(was, bank * fraction + (1 - fraction) * (price - e) / a, (price - e) / a)
        end = stopped | late
        realized = np.where(end, value, realized)
        label = np.where(stopped, np.where(was, TP, SL), label)
        done |= end
    rest = np.where(banked, bank * fraction + (1 - fraction) * (tail - e) / a, (tail - e) / a)
    return label, np.where(done, realized, rest), worst


def _c(x):
    return np.clip(x, 0.0, 1.0)


def entry_strength(participation, win_prob, trend, quote_slope, close_pos):
    return (0.30 * _c((participation - 55) / 45) + 0.25 * _c((win_prob - 0.40) / 0.30) + 0.20 * _c((trend + 0.05) / 0.55)
            + 0.15 * _c((quote_slope + 0.01) / 0.08) + 0.10 * _c((close_pos - 0.45) / 0.45))


def adaptive_exit(path: dict, first: dict, entry, atr, stop, bank: float, fraction: float, activate: float, trail: float,
                  pre: int, post: int, penetration: float, slip_cap: float, material: float):
    """Staged exit whose trailing stop tightens with the flow; events x stops.

    ``path`` holds matrices per bar field, ``first`` the same fields at the entry bar.
    Returns label, realized ATR, exit offset, exit price, slippage, banked, drawdown.
    """
    n, k = len(entry), len(stop)
    live = atr > 0
    e, a = entry[:, None], np.where(live, atr, 1.0)[:, None]
    strength = entry_strength(first["participation"], first["win_prob"], first["trend"], first["quote_slope"], first["close_pos"])
    s = strength[:, None]
    post_limit = np.maximum(post, post + np.floor(12.0 * strength + 0.5).astype(int))[:, None]
    hard = e - stop[None, :] * a
    gain = fraction * bank
    cushion = gain / max(1.0 - fraction, 1e-12)
    buffer = np.maximum(np.minimum(cushion * (0.18 + 0.32 * s), 0.75 * trail + 0.25 * bank), 0.15)
    shape = (n, k)
    banked, done = np.zeros(shape, bool), np.repeat(~live[:, None], k, 1)
    bank_off, off = np.full(shape, -1), np.zeros(shape, int)
    top_close, runner_top, rstop = np.repeat(e, k, 1), np.repeat(e, k, 1), hard.copy()
    peak, peak_off = e.copy(), np.zeros((n, 1), int)
    peak_vr, peak_qs = first["volume_ratio"][:, None].copy(), first["quote_slope"][:, None].copy()
    worst, realized, price, slip = (np.zeros(shape) for _ in range(4))
    price += e
    label, tail, tail_off = np.full(shape, TIMEOUT), np.repeat(e, k, 1), np.zeros(shape, int)
    for j in range(path["close"].shape[1]):
        here = ~np.isnan(path["close"][:, j])[:, None] & ~done & (j + 1 <= pre + post_limit)
        if not here.any():
            break
        b = {f: v[:, j][:, None] for f, v in path.items()}
        new = b["high"] > peak
        peak, peak_off = np.where(new, b["high"], peak), np.where(new, j + 1, peak_off)
        peak_vr, peak_qs = np.where(new, b["volume_ratio"], peak_vr), np.where(new, b["quote_slope"], peak_qs)
        worst = np.where(here, np.fmax(worst, (peak - b["low"]) / a), worst)
        tail, tail_off = np.where(here, b["close"], tail), np.where(here, j + 1, tail_off)

        def stop_fill(level, b=b):
            step = np.fmin(penetration * (level - b["low"]), slip_cap * a)
            return np.where(b["open"] <= level, b["open"], level - step)

        was = banked.copy()
        hurt = here & ~was & (b["low"] <= hard)
        hit = here & ~was & ~hurt & (b["high"] >= e + bank * a)
        idle = here & ~was & ~hurt & ~hit & (j + 1 >= pre)
        top_close = np.where(hit | (here & was), np.fmax(top_close, b["close"]), top_close)
        runner_top = np.where(hit, np.fmax(np.fmax(runner_top, top_close), e + bank * a),
                              np.where(here & was, np.fmax(runner_top, top_close), runner_top))
        rstop = np.where(hit, np.fmax(e - buffer * a, hard), rstop)
        bank_off = np.where(hit, j + 1, bank_off)

        dd, up = np.fmax(peak - b["close"], 0) / a, np.fmax(peak - e, 0) / a
        since = np.maximum(j + 1 - peak_off, 0)
        scale = material if material > 0 else 1e-12
        wave = wave_score(b, dd / scale, _c)
        risk = top_score(up, dd / scale, peak_vr - b["volume_ratio"], peak_qs - b["quote_slope"], b["exhaustion"], since, _c)
        risky = _c((risk - 55) / 35)
        tight = (0.32 * risky + 0.20 * _c((65 - wave) / 35) + 0.18 * _c((b["exhaustion"] - 55) / 35) + 0.15 * _c((0.60 - b["close_pos"]) / 0.60)
                 + 0.15 * np.fmax(_c((b["upper_wick"] - 0.30) / 0.45), _c(since / 8)))
        strong = _c(0.55 * s + 0.25 * _c((wave - 65) / 35) + 0.20 * _c((b["participation"] - 55) / 45) - 0.20 * risky)
        mult = np.clip(1 + 0.40 * strong - 0.45 * tight, 0.70, 1.60)
        when = np.clip(activate + 0.75 * strong - 0.60 * tight, 0.75, activate + 1.25)
        runner = here & was
        raised = np.where((runner_top - e) / a >= when, runner_top - trail * mult * a, -np.inf)
        rstop = np.where(runner, np.fmax(rstop, raised), rstop)
        trailed = runner & (b["low"] <= rstop)
        aged = runner & ~trailed & (j + 1 - bank_off >= post_limit)

        px = np.where(hurt, stop_fill(hard), np.where(trailed, stop_fill(rstop), b["close"]))
        value = np.where(was, gain + (1 - fraction) * (px - e) / a, (px - e) / a)
        end = hurt | idle | trailed | aged
        realized, price, off = np.where(end, value, realized), np.where(end, px, price), np.where(end, j + 1, off)
        slip = np.where(hurt, np.fmax((hard - px) / a, 0), np.where(trailed, np.fmax((rstop - px) / a, 0), slip))
        label = np.where(hurt, SL, np.where(trailed | aged, TP, label))
        banked = was | hit
        done |= end
    open_left = ~done
    rest = np.where(banked, gain + (1 - fraction) * (tail - e) / a, (tail - e) / a)
    label = np.where(open_left, np.where(banked, TP, TIMEOUT), label)
    return (label, np.where(open_left, rest, realized), np.where(open_left, tail_off, off),
            np.where(open_left, tail, price), slip, banked, worst)
