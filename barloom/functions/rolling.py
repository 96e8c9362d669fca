"""Column expressions over bar series. Every function takes the chunk's ``Frames``.

Three true-range averages exist and are named apart: ``atr_sma``, ``atr_ema``, ``atr_wilder``.
Population and sample deviations are named apart too (``_pop`` / ``_samp``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.operators.series import Frames, wilder

EPS = 1e-8
# tanh form of the normal distribution function: sqrt(2/pi) as used for every probability here
NORMAL_TANH = 0.79788456


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clip01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


# -- means and deviations ---------------------------------------------------------------

def rolling_mean(c: Column | str, n: int, f: Frames) -> Column:
    """Mean of the last n rows; of what there is while the series is younger than n."""
    return F.avg(col(c)).over(f.last(n))


def rolling_std_pop(c: Column | str, n: int, f: Frames) -> Column:
    """Population deviation of the last n rows, 0 until n rows exist."""
    return F.when(f.full(n), F.stddev_pop(col(c)).over(f.last(n))).otherwise(0.0)


def prior_mean(c: Column | str, n: int, f: Frames) -> Column:
    """Mean of the n rows before the current one, 0 until n such rows exist."""
    return F.when(F.col(f.idx) >= n, F.avg(col(c)).over(f.prior(n))).otherwise(0.0)


def volume_ratio(f: Frames, n: int = 20) -> Column:
    """Volume against the mean of the n bars before; 1 while that mean is not positive."""
    base = prior_mean("volume", n, f)
    return F.when(base > 0, F.col("volume") / base).otherwise(1.0)


def volume_anomaly(f: Frames, n: int = 50) -> Column:
    """Volume against the mean of the last n bars, current one included; NULL before n bars."""
    return F.when(f.full(n), F.try_divide(F.col("volume"), F.avg("volume").over(f.last(n))))


# -- range and bands ----------------------------------------------------------------------

def true_range(f: Frames) -> Column:
    """Largest of high-low and the distances to the previous close; high-low on the first bar."""
    prev = f.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_sma(f: Frames, n: int = 14, tr: str | Column = "tr") -> Column:
    """Plain mean of n true ranges, NULL before n bars. ``tr`` must be a column already."""
    return F.when(f.full(n), F.avg(col(tr)).over(f.last(n)))


def bollinger_pop(c: Column | str, n: int, k: float, f: Frames) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) with population deviation; zeros before n rows."""
    mid = F.avg(col(c)).over(f.last(n))
    dev = F.stddev_pop(col(c)).over(f.last(n)) * k
    return tuple(F.when(f.full(n), x).otherwise(0.0) for x in (mid + dev, mid, mid - dev))


def bollinger_samp(c: Column | str, n: int, k: float, f: Frames) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) with sample deviation; NULL before n rows."""
    mid = F.avg(col(c)).over(f.last(n))
    dev = F.stddev_samp(col(c)).over(f.last(n)) * k
    return tuple(F.when(f.full(n), x) for x in (mid + dev, mid, mid - dev))


def range_position(f: Frames, n: int = 50) -> tuple[Column, Column, Column]:
    """High and low of the n bars before and where the close lies between them."""
    hi, lo = F.max("high").over(f.prior(n)), F.min("low").over(f.prior(n))
    return hi, lo, F.when(hi - lo >= EPS, F.try_divide(F.col("close") - lo, hi - lo))


def range_rank(f: Frames, n: int = 100) -> Column:
    """Share of the last n bars whose range is at most the current one."""
    span = F.col("high") - F.col("low")
    seen = F.collect_list(span).over(f.last(n))
    return F.size(F.filter(seen, lambda x: x <= span)) / F.size(seen)


def atr_percentile(atr: str, f: Frames, lookback: int = 240, first: int = 14, stride: int = 5) -> Column:
    """Causal rank of the current ATR among every ``stride``-th earlier one of the look-back.

    0.5 until 100 bars exist. Later bars never take part.
    """
    sampled = F.when((F.col(f.idx) >= first) & ((F.col(f.idx) - first) % stride == 0), F.col(atr))
    seen = F.collect_list(sampled).over(f.last(lookback))
    share = F.size(F.filter(seen, lambda x: x <= F.col(atr))) / F.greatest(F.size(seen), F.lit(1))
    return F.when(f.full(100), share).otherwise(0.5)


def support_resistance(f: Frames, n: int = 96, low_q: float = 0.10, high_q: float = 0.90) -> tuple[Column, Column]:
    """Interpolated percentile of the n lows and highs before the current bar."""
    ready = F.col(f.idx) >= n
    return (F.when(ready, F.percentile("low", low_q).over(f.prior(n))),
            F.when(ready, F.percentile("high", high_q).over(f.prior(n))))


def stochastic_k(f: Frames, n: int = 14) -> Column:
    """Where the close lies in the range of the last n bars (0..100); 50 when the range is nil."""
    hi, lo = F.max("high").over(f.last(n)), F.min("low").over(f.last(n))
    k = F.coalesce(F.try_divide(100.0 * (F.col("close") - lo), hi - lo), F.lit(50.0))
    return F.when(f.full(n), k).otherwise(50.0)


def stochastic_d(k: str, f: Frames, n: int = 14, smooth: int = 3) -> Column:
    """Mean of the last ``smooth`` K values; K itself until that many exist. ``k`` is a column."""
    return F.when(f.full(n + smooth - 1), F.avg(k).over(f.last(smooth))).otherwise(F.col(k))


# -- candle anatomy -----------------------------------------------------------------------

def candle(f: Frames | None = None) -> dict[str, Column]:
    """Body, range, body efficiency, close position, upper wick; safe on flat candles."""
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    return {
        "body": F.col("close") - F.col("open"),
        "candle_range": F.col("high") - F.col("low"),
        "body_eff": (F.col("close") - F.col("open")) / span,
        "close_pos": (F.col("close") - F.col("low")) / span,
        "upper_wick": (F.col("high") - F.greatest("open", "close")) / span,
    }


def prior_body(f: Frames, n: int = 20) -> Column:
    """Mean absolute body of the n bars before."""
    return F.when(F.col(f.idx) >= n, F.avg(F.abs(F.col("close") - F.col("open"))).over(f.prior(n)))


# -- returns ------------------------------------------------------------------------------

def simple_return(f: Frames, k: int = 1, c: str = "close") -> Column:
    return F.try_divide(F.col(c), f.lag(c, k)) - 1.0


def log_return(f: Frames, k: int = 1, c: str = "close") -> Column:
    floor = F.lit(1e-12)
    return F.ln(F.greatest(F.col(c), floor) / F.greatest(f.lag(c, k), floor))


def mean_shift(f: Frames, n: int = 50) -> Column:
    """Distance of the close from its n-bar mean in population deviations."""
    gap = F.col("close") - F.avg("close").over(f.last(n))
    dev = F.when(f.full(11), F.stddev_pop("close").over(f.last(n))).otherwise(EPS)
    return gap / (dev + EPS)


def rolling_slope(c: str, f: Frames, n: int = 5) -> Column:
    """Least-squares slope per bar over the last n rows, 0 before n rows."""
    return F.when(f.full(n), F.regr_slope(F.col(c), F.col(f.idx).cast("double")).over(f.last(n))).otherwise(0.0)


def signed_r2(c: str, f: Frames, n: int = 10) -> Column:
    """Fit quality of a straight line through the last n values, with the sign of its slope.

    Flat values give 0.
    """
    x = F.col(f.idx).cast("double")
    w = f.last(n)
    cov = F.covar_pop(x, F.col(c)).over(w)
    r2 = F.coalesce(F.try_divide(cov * cov, F.var_pop(x).over(w) * F.var_pop(c).over(w)), F.lit(0.0))
    return F.when(f.full(n), F.least(r2, F.lit(1.0)) * F.when(cov >= 0, 1.0).otherwise(-1.0))


def forward_fill(c: str, f: Frames, reach: int, default: float) -> Column:
    """Last known value within ``reach`` rows, else the default (``carry_last`` has no such bound)."""
    known = F.when(~F.isnan(F.col(c)), F.col(c))
    return F.coalesce(F.last(known, ignorenulls=True).over(f.last(reach)), F.lit(default))


# -- order flow ---------------------------------------------------------------------------

def vpin_bulk(f: Frames, n: int = 14, step: str = "dclose") -> Column:
    """Flow toxicity with bulk classification of volume; ``step`` holds close - previous close.

    The deviation belongs to the frame's end, so the frame is folded as an array. The frame
    has n slots of which the first counts as an unchanged price.
    """
    steps = F.collect_list(F.struct(F.col(step).alias("d"), F.col("volume").alias("v"))).over(f.last(n - 1))
    s1 = F.sum(step).over(f.last(n - 1))
    s2 = F.sum(F.col(step) * F.col(step)).over(f.last(n - 1))
    var = F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))
    sigma = F.sqrt(var)
    lean = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x["v"] * F.tanh(x["d"] / sigma * NORMAL_TANH))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x["v"])
    return F.when(f.full(n) & (var > 0) & (total > 0), F.abs(lean) / total).otherwise(0.5)


def vpin_taker(f: Frames, n: int = 14) -> Column:
    """Imbalance of taker buys against the rest over n bars; 0.5 before n bars or without volume."""
    buy = F.sum("taker_buy_base").over(f.last(n))
    sell = F.sum(F.greatest(F.col("volume") - F.col("taker_buy_base"), F.lit(0.0))).over(f.last(n))
    return F.when(f.full(n) & (buy + sell > 0), F.abs(buy - sell) / (buy + sell)).otherwise(0.5)


def taker_imbalance(f: Frames, n: int = 10) -> Column:
    """(buys - sells) / volume over the last n bars."""
    buy, vol = F.sum("taker_buy_base").over(f.last(n)), F.sum("volume").over(f.last(n))
    return (2 * buy - vol) / (vol + EPS)


def flow_proxy(f: Frames, n: int = 21) -> Column:
    """Net taker flow of n bars mapped from [-1, 1] to [0, 100]; 50 when unknown."""
    buy, vol = F.sum("taker_buy_base").over(f.last(n)), F.sum("volume").over(f.last(n))
    net = F.try_divide(2 * buy - vol, vol)
    return F.when(f.full(5) & (vol >= EPS), clip((net + 1) / 2 * 100, 0.0, 100.0)).otherwise(50.0)


def kyle_lambda(f: Frames, n: int = 20, ret: str = "ret") -> Column:
    """Price impact: slope of returns on signed volume over n bars, 0 when it cannot be fitted."""
    signed = F.when(F.col(ret) >= 0, F.col("volume")).otherwise(-F.col("volume"))
    fit = F.regr_slope(F.col(ret), signed).over(f.last(n))
    return F.when(F.col(f.idx) >= n, F.coalesce(fit, F.lit(0.0))).otherwise(0.0)


def amihud(f: Frames, n: int = 20, ret: str = "ret") -> Column:
    """Mean absolute return per unit of volume over bars with volume, 0 when there are none."""
    ratio = F.when(F.col("volume") > 0, F.abs(F.col(ret)) / F.col("volume"))
    return F.when(F.col(f.idx) >= n, F.coalesce(F.avg(ratio).over(f.last(n)), F.lit(0.0))).otherwise(0.0)


def frac_diff_weights(d: float = 0.4, cutoff: float = 1e-4, longest: int = 1000) -> list[float]:
    """Binomial weights of (1 - L)^d, newest first, down to the cutoff."""
    weights = [1.0]
    for k in range(1, longest + 1):
        nxt = -weights[-1] * (d - k + 1) / k
        if abs(nxt) < cutoff:
            break
        weights.append(nxt)
    return weights


def frac_diff(c: str, f: Frames, weights: list[float]) -> Column:
    """Fixed-width fractional difference, NULL until the whole weight window is filled."""
    taps = F.array(*[F.lit(w) for w in reversed(weights)])
    seen = F.collect_list(F.col(c)).over(f.last(len(weights)))
    total = F.aggregate(F.zip_with(seen, taps, lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(f.full(len(weights)), total)


def taker_persistence(f: Frames) -> Column:
    """Share of the three bars before whose taker imbalance points the way of the last move."""
    up = F.col("close") > f.lag("close")
    lean = F.col("taker_buy_base") * 2 - F.col("volume")
    votes = sum(
        (F.when(up, f.lag(lean, k) > 0).otherwise(f.lag(lean, k) < 0)).cast("int")
        for k in (1, 2, 3))
    return votes / 3.0


def depth_delta(f: Frames) -> Column:
    """Volume change over five bars relative to the 20-bar mean."""
    return (F.col("volume") - f.lag("volume", 5)) / (F.avg("volume").over(f.last(20)) + EPS)


# -- recurrences (stacked means add up their halos) -----------------------------------------

def rsi(gain: str, loss: str, period: int, f: Frames) -> Column:
    """Relative strength 0..100; 50 in the warm-up, 100 without any loss."""
    up, down = wilder(F.col(gain), period, f), wilder(F.col(loss), period, f)
    return F.when(F.col(f.idx) < period, 50.0).when(down == 0, 100.0).otherwise(
        100.0 - 100.0 / (1.0 + F.try_divide(up, down)))


def ema_alpha(period: int) -> float:
    return 2.0 / (period + 1.0)


def directional_moves(f: Frames) -> tuple[Column, Column]:
    """(+DM, -DM) of one bar, 0 on the first bar."""
    up = F.col("high") - f.lag("high")
    down = f.lag("low") - F.col("low")
    return (F.when((up > down) & (up > 0), up).otherwise(0.0),
            F.when((down > up) & (down > 0), down).otherwise(0.0))


# -- barrier probabilities ------------------------------------------------------------------

# Variance recursion and jump-size parameters.
GARCH = {"omega": 1e-6, "alpha": 0.10, "beta": 0.85}
JUMPS = {"rate": 0.5, "up": 15.0, "down": 10.0, "p_up": 0.4}


def barrier_prob(f: Frames, tp: Column, sl: Column, ret: str = "lr", fast: int = 20, slow: int = 100) -> Column:
    """Probability that the upper barrier is met first under drift, recursive variance and jumps.

    ``tp`` and ``sl`` are fractional distances; ``ret`` holds log returns (NULL on bar 0).
    """
    n = F.count(ret).over(f.last(slow))
    drift = 0.6 * F.avg(ret).over(f.last(fast)) + 0.4 * F.avg(ret).over(f.last(slow))
    centre = F.avg(ret).over(f.last(fast))
    sample = F.coalesce(F.var_samp(ret).over(f.last(fast)), F.lit(0.0))
    recent = F.collect_list(ret).over(f.last(fast))
    var = F.aggregate(recent, sample, lambda v, r: GARCH["omega"] + GARCH["alpha"] * (r - centre) * (r - centre)
                      + GARCH["beta"] * v)
    var = F.greatest(var, F.lit(1e-20))
    p, q = JUMPS["p_up"], 1.0 - JUMPS["p_up"]
    iu, idn = 1.0 / JUMPS["up"], 1.0 / JUMPS["down"]
    jump_var = p * iu**2 + q * idn**2 + p * q * (iu + idn) ** 2
    spread = var + JUMPS["rate"] * jump_var
    pull = drift - 0.5 * var
    a = 2.0 * pull / spread
    e_sl, e_tp = F.exp(clip(a * sl, -500.0, 500.0)), F.exp(clip(-a * tp, -500.0, 500.0))
    den = e_tp - e_sl
    met = (F.when(F.abs(pull) < 1e-10, F.try_divide(sl, tp + sl))
           .when(F.abs(den) < 1e-15, 0.5)
           .otherwise(clip01(F.try_divide(1.0 - e_sl, den))))
    return F.when((n < 3) | (tp <= 0) | (sl <= 0), 0.5).otherwise(met)


def crossing_in_time(sigma: Column, tp: Column, bars_left: int) -> Column:
    """Chance to cross the barrier within the bars left (normal approximation)."""
    z = tp / (sigma * math.sqrt(bars_left))
    return F.when((sigma < 1e-12) | (tp <= 0), 0.0).otherwise(clip01(1.0 - F.tanh(z * NORMAL_TANH)))


def implied_vol_ratio(avg_bars: Column, dist: Column, sigma: Column) -> Column:
    """Deviation implied by the mean bars to the barrier over the realised one, in [0.1, 10]."""
    ratio = F.try_divide(dist, F.sqrt(avg_bars) * sigma)
    bad = F.coalesce(avg_bars <= 0, F.lit(True)) | (dist <= 0) | (sigma < 1e-12)
    return F.when(bad, 1.0).otherwise(clip(ratio, 0.1, 10.0))


# -- composites -----------------------------------------------------------------------------

def participation_score(mean_volume_ratio: Column, quote_slope: Column, taker: Column,
                        taker_persist: Column, bull_bear: Column) -> Column:
    """0..100: is volume behind the move."""
    return 100.0 * (
        0.35 * clip01((mean_volume_ratio - 1.0) / 1.5) + 0.20 * clip01((quote_slope + 0.02) / 0.12)
        + 0.20 * clip01((taker + 0.10) / 0.50) + 0.10 * clip01(taker_persist)
        + 0.15 * clip01((bull_bear + 0.2) / 0.8))


def exhaustion_score(vpin: Column, vpin_slope: Column, taker_slope: Column,
                     upper_wick: Column, close_pos: Column) -> Column:
    """0..100: is the flow behind the move running out."""
    return 100.0 * (
        0.30 * clip01((vpin - 0.50) / 0.30) + 0.20 * clip01((vpin_slope + 0.01) / 0.08)
        + 0.20 * clip01((-taker_slope + 0.01) / 0.10) + 0.15 * clip01((upper_wick - 0.20) / 0.45)
        + 0.15 * clip01((0.55 - close_pos) / 0.55))


def rule_regime(f: Frames, n: int = 30, least: int = 20, threshold: float = 15.0) -> Column:
    """bull / bear / range from the percent change across the last n bars."""
    first = F.first("close").over(f.last(n))
    pct = F.try_divide(F.col("close") - first, first) * 100.0
    return (F.when(~f.full(least), "range").when(pct > threshold, "bull")
            .when(pct < -threshold, "bear").otherwise("range"))
