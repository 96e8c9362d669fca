"""Projections: time, books, positioning, cross-timeframe blocks, hazard limits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.rolling import EPS, clip, clip01


def calendar(ts: Column) -> dict[str, Column]:
    """UTC hour, weekday (Monday = 0), hour of week and ISO week."""
    return {"hour": F.hour(ts), "dow": F.weekday(ts), "hour_of_week": F.weekday(ts) * 24 + F.hour(ts), "iso_week": F.weekofyear(ts)}


def cyclic(ts: Column) -> dict[str, Column]:
    """Sine and cosine of hour and weekday, scaled forms and session flags."""
    h, d = F.hour(ts), F.weekday(ts)
    tau = 2 * math.pi
    return {"hour_sin": F.sin(h * tau / 24), "hour_cos": F.cos(h * tau / 24), "day_sin": F.sin(d * tau / 7), "day_cos": F.cos(d * tau / 7), "hour_norm": h / 24.0, "day_norm": d / 7.0,
            "us_session": h.between(13, 21).cast("int"), "asia_session": h.between(1, 9).cast("int"), "funding_hour": h.isin(0, 8, 16).cast("int")}


def barrier_levels(entry: Column, magnitude: Column, direction: Column, ratios: dict[str, float]) -> dict[str, Column]:
    """Target and stop prices at ``magnitude`` percent times each ratio."""
    sign = F.when(direction == "BULLISH", 1.0).otherwise(-1.0)
    return {k: entry * (1 + sign * (-1 if k == "sl" else 1) * magnitude * r / 100.0) for k, r in ratios.items()}


def expected_magnitude(atr: dict[str, Column], price: Column, confidence: Column) -> Column:
    """Percent move expected over four hours: coarse ATR or a finer one scaled by root time."""
    def some(c: Column) -> Column:
        return F.when(c != 0, c)
    base = F.coalesce(some(atr["4h"]), some(atr["1h"]) * 2.0, some(atr["15m"]) * 4.0, some(atr["5m"]) * 6.92)
    sigma = F.when(price > 0, base / price * 100).otherwise(0.0)
    return F.coalesce(F.least(F.lit(20.0), 2.0 * sigma * clip(0.5 + (confidence - 50) / 50 * 1.5, 0.5, 2.0)), F.lit(0.0))


CASCADE = {"funding": -0.025, "surge": 0.12, "oi_vol": 1.5, "max_dist": 15.0, "boost": 1.25}


def cascade_signal(funding: Column, surge_pct: Column, oi_vol: Column, atr_pct: Column, p: dict = CASCADE) -> dict[str, Column]:
    """Squeeze flag from two of three signs, with target distance, size boost and reasons."""
    tests = {"funding": funding <= p["funding"], "oi_surge": surge_pct >= p["surge"] * 100, "oi_vol_ratio": oi_vol >= p["oi_vol"]}
    met = sum(c.cast("int") for c in tests.values())
    base = F.least(3.0 * atr_pct, F.lit(p["max_dist"] / 2))
    severity = F.greatest(F.lit(0.0), (F.abs(funding) - abs(p["funding"])) / abs(p["funding"]))
    hit = met >= 2
    return {"cascade": hit.cast("int"), "target_dist_pct": F.when(hit, F.round(F.least(base * (1 + severity * 0.5), F.lit(p["max_dist"])), 2)).otherwise(0.0),
            "size_boost": F.when(hit, F.round(F.least(F.lit(p["boost"]), 1.0 + (met - 1) * 0.15), 3)).otherwise(1.0),
            "reason": F.concat_ws("+", *[F.when(c, n) for n, c in tests.items()])}


def book_features(bids: Column, asks: Column, funding: Column) -> dict[str, Column]:
    """17 measures of a ten-level book given as arrays of struct(px, qty), best first."""
    zero = F.lit(0.0)
    b, a = F.slice(bids, 1, 10), F.slice(asks, 1, 10)

    def total(side: Column, f, n: int = 5) -> Column:
        return F.aggregate(F.slice(side, 1, n), zero, lambda acc, x: acc + f(x))

    def qty(x): return x["qty"]
    def cash(x): return x["px"] * x["qty"]
    bq, aq, bc, ac = total(b, qty), total(a, qty), total(b, cash), total(a, cash)
    bb, ba = b[0]["px"], a[0]["px"]

    def balance(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x - y, x + y), zero)
    bv, av = F.coalesce(F.try_divide(bc, bq), bb), F.coalesce(F.try_divide(ac, aq), ba)

    def gap(side: Column) -> Column:
        px = F.slice(side, 1, 5)
        steps = F.zip_with(F.slice(px, 2, 4), F.slice(px, 1, 4), lambda x, y: F.abs(x["px"] - y["px"]) / side[0]["px"] * 100)
        return F.when(F.size(side) >= 5, F.aggregate(steps, zero, lambda acc, x: acc + x) / 4).otherwise(0.0)

    def level(side: Column, i: int) -> Column:
        return F.coalesce(F.get(side, F.lit(i))["qty"], zero)
    cross = F.aggregate(F.zip_with(F.slice(b, 1, 5), F.slice(a, 1, 5), lambda x, y: x["px"] * y["qty"] + y["px"] * x["qty"]), zero, lambda acc, x: acc + x)
    mid = (bb + ba) / 2
    return {
        "imbalance": balance(bq, aq), "cash_imbalance": balance(bc, ac), "spread_pct": (ba - bb) / bb * 100, "depth_ratio": F.coalesce(F.try_divide(bq, aq), F.lit(1.0)),
        "vwap_spread_pct": (av - bv) / bv * 100, "bid_top_share": F.coalesce(F.try_divide(level(b, 0), total(b, qty, 10)), zero), "ask_top_share": F.coalesce(F.try_divide(level(a, 0), total(a, qty, 10)), zero),
        **{f"flow_l{i + 1}": balance(level(b, i), level(a, i)) for i in range(5)}, "bid_gap_pct": gap(b), "ask_gap_pct": gap(a),
        "queue_ratio": F.when((level(b, 0) > 0) & (F.size(b) > 2), level(b, 2) / level(b, 0)).otherwise(1.0), "micro_delta_pct": F.coalesce(F.try_divide(F.try_divide(cross, bq + aq) - mid, mid) * 100, zero),
        "funding_pct": funding * 100}


def book_proxies(range5_mean: Column) -> dict[str, Column]:
    """The same measures estimated from a bar; ``range5_mean`` is the mean range of five bars."""
    vol = F.greatest(F.col("volume"), F.lit(EPS))
    push = clip(F.col("taker_buy_base") / vol * 2 - 1, -1.0, 1.0)
    c = F.col("close") + EPS
    lean = (F.col("close") - (F.col("high") + F.col("low")) / 2) / c * 100
    gap = range5_mean / c * 100 / 5
    one = F.lit(0.5)
    return {"imbalance": push, "cash_imbalance": push, "spread_pct": (F.col("high") - F.col("low")) / c * 100, "depth_ratio": F.col("taker_buy_base") / F.greatest(vol - F.col("taker_buy_base"), F.lit(EPS)),
            "vwap_spread_pct": lean, "bid_top_share": one, "ask_top_share": one, **{f"flow_l{i + 1}": clip(push * k, -1.0, 1.0) for i, k in enumerate((1.0, 0.85, 0.70, 0.55, 0.40))},
            "bid_gap_pct": gap, "ask_gap_pct": gap, "queue_ratio": F.lit(1.0), "micro_delta_pct": lean}


def positioning(oi: Column, price: Column, volume: Column) -> dict[str, Column]:
    """Open-interest intensity and speculation index, capped."""
    return {"oi_intensity": F.least(F.lit(10.0), oi * price / (volume + EPS)), "speculation": F.least(F.lit(5.0), volume / (oi + EPS))}


def regime_entropy(entropy: Column, hurst: Column, transfer: Column, width: Column) -> Column:
    """Blend of entropy, persistence, transfer and multifractal width."""
    return (0.3 * F.when(entropy > 0, F.least(F.lit(1.0), entropy / 2)).otherwise(0.0) + 0.3 * F.abs(hurst - 0.5) * 2
            + 0.2 * F.when(transfer < 1, 1 - transfer).otherwise(0.0) + 0.2 * width)


# Hazard model of a move's collapse.
HAZARD = {"prior": 0.700, "base": 0.517, "growth": 2.92, "bank_min": 2.0, "bank_max": 10.0, "bank": 4.20, "pre": 1.5, "runner": 2.5}


def velocity(entry: Column, close: Column, bars: Column, per_day: float = 288.0) -> Column:
    """Growth per day of the move so far, leaning on the prior while it is young."""
    days = bars / per_day
    blend = F.least(F.lit(1.0), bars / 24.0)
    return F.when((bars >= 3) & (close > entry), blend * F.ln(close / entry) / days + (1 - blend) * HAZARD["prior"]).otherwise(HAZARD["prior"])


def crossing_days(n: Column, k: float = 1.0) -> Column:
    """Days until the hazard has grown to k times the velocity."""
    return F.when(k * n <= HAZARD["base"], 0.0).otherwise(F.ln(k * n / HAZARD["base"]) / HAZARD["growth"])


def bank_distance(n: Column, atr_pct: Column) -> Column:
    slow = F.greatest(F.lit(HAZARD["bank_min"]), HAZARD["bank"] * F.sqrt(F.greatest(n / HAZARD["base"], F.lit(0.1))))
    return F.when(n <= HAZARD["base"], slow).otherwise(clip((F.exp(n * crossing_days(n)) - 1) / atr_pct, HAZARD["bank_min"], HAZARD["bank_max"]))


def pre_bank_limit(n: Column) -> Column:
    return F.greatest(F.lit(12), F.least(F.lit(144), (crossing_days(n, HAZARD["pre"]) * 288).cast("int")))


def post_bank_limit(n: Column, bars_at_bank: Column) -> Column:
    left = F.greatest(F.lit(0.0), crossing_days(n, HAZARD["runner"]) - bars_at_bank / 288.0)
    return F.greatest(F.lit(12), F.least(F.lit(576), (left * 288).cast("int")))


# -- timeframe blocks: ``tf`` maps an interval to a struct column ------------------------------------

def cross_deltas(tf: dict[str, Column]) -> dict[str, Column]:
    """Changes from 15 minutes to 5 and from an hour to 15 minutes."""
    a, b, c = tf["5m"], tf["15m"], tf["1h"]
    return {**{f"{k}_delta": a[k] - b[k] for k in ("rsi", "macd", "bb_position", "adx", "atr", "strength", "vpin")},
            "volume_delta": a["volume"] / F.greatest(b["volume"], F.lit(1e-8)) - 1, "rsi_accel": b["rsi"] - c["rsi"], "macd_accel": b["macd"] - c["macd"]}


def spike_block(tf: dict[str, Column]) -> dict[str, Column]:
    """Spike, dump and reversal measures over 5m, 15m, 1h and 4h structs."""
    a, b, c, e = tf["5m"], tf["15m"], tf["1h"], tf["4h"]
    zero = F.lit(0.0)
    move = F.when(e["price"] > 0, (F.try_divide(a["price"], e["price"]) - 1) * 100).otherwise(0.0)
    spike, dump = F.least(F.lit(50.0), move), F.least(F.lit(50.0), F.abs(F.least(zero, move)))
    ratio = F.try_divide(a["volume"], c["volume"])
    atr = F.try_divide(a["atr"], (b["atr"] + c["atr"]) / 2)
    over = F.when(a["rsi"] > 70, (a["rsi"] - 70) / 30).otherwise(0.0)
    under = F.when(a["rsi"] < 30, (30 - a["rsi"]) / 30).otherwise(0.0)
    steps = F.array(*[F.when(y["price"] > 0, (x["price"] - y["price"]) / y["price"] * 100) for x, y in ((a, b), (b, c), (c, e))])
    falls = F.filter(steps, lambda x: x < 0)
    speed = F.coalesce(F.try_divide(F.aggregate(falls, zero, lambda acc, x: acc - x), F.size(falls)), zero)
    run = F.least(F.lit(10), (a["strength"] / 10).cast("int"))
    green, red = F.when(a["trend"] == "BULLISH", run).otherwise(0), F.when(a["trend"] == "BEARISH", run).otherwise(0)
    return {
        "spike": spike, "volume_spike": F.coalesce(F.when(ratio > 1.5, F.least(F.lit(10.0), ratio)), zero), "overbought": over, "band_top": a["bb_position"], "atr_spike": F.coalesce(F.least(F.lit(5.0), atr), zero),
        "dump": dump, "rsi_fall": F.abs(F.least(zero, c["rsi"] - a["rsi"])) / 50, "macd_bearish": F.when(a["macd"] < 0, 1.0).otherwise(0.0),
        "exhaustion": F.coalesce(F.least(F.lit(1.0), F.greatest(zero, F.try_divide(c["volume"] - a["volume"], a["volume"]))), zero), "dump_speed": F.least(F.lit(10.0), speed), "oversold": under,
        "divergence": ((F.try_divide(a["price"] - e["price"], e["price"]) < -0.01) & (a["rsi"] - c["rsi"] > 0.02)).cast("int"), "macd_turn": ((a["macd"] > b["macd"]) & (b["macd"] < 0)).cast("int"),
        "band_bounce": F.when(a["bb_position"] < 0.2, F.greatest(zero, (0.2 - a["bb_position"]) / 0.2)).otherwise(0.0), "pattern": F.least(F.lit(1.0), spike / 50 * 0.3 + dump / 20 * 0.3 + under * 0.4),
        "green_run": green, "red_run": red, "red_share": F.when(red >= 5, 1.0).otherwise(red / 5), "green_share": F.when(green >= 3, 1.0).otherwise(green / 3)}


def consensus(rows: Column, weights: dict[str, float]) -> dict[str, Column]:
    """Agreement of the timeframes; ``rows`` is an array of structs ordered from fine to coarse."""
    n = F.size(rows)

    def share(test) -> Column:
        return F.size(F.filter(rows, test)) / n

    def vals(f) -> Column:
        return F.transform(rows, f)

    def mean(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)

    def std(arr: Column) -> Column:
        m = mean(arr)
        return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(arr))

    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    sign = lambda x: F.when(x["trend"] == "BULLISH", 1.0).when(x["trend"] == "BEARISH", -1.0).otherwise(0.0)
    rsi, macd, vol = vals(lambda x: x["rsi"]), vals(lambda x: x["macd"]), vals(lambda x: x["volume"])
    atr = vals(lambda x: x["atr"] / F.greatest(x["price"], F.lit(EPS)) * 100)
    adx, bb, st = vals(lambda x: x["adx"]), vals(lambda x: x["bb_position"]), vals(lambda x: x["strength"])
    lv = F.transform(vol, lambda v: F.log1p(v))
    up, down = share(lambda x: x["trend"] == "BULLISH"), share(lambda x: x["trend"] == "BEARISH")
    rise = F.zip_with(F.slice(st, 2, 100), F.slice(st, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)
    return {
        "bull_share": up, "bear_share": down, "net_share": up - down,
        "weighted": F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + sign(x) * F.coalesce(w[x["interval"]], F.lit(0.1)) * x["strength"] / 100),
        "rsi_spread": F.array_max(rsi) - F.array_min(rsi), "rsi_std": std(rsi), "rsi_slope": rsi[n - 1] - rsi[0], "rsi_high": share(lambda x: x["rsi"] > 70), "rsi_mean": mean(rsi),
        "macd_spread": F.array_max(macd) - F.array_min(macd), "macd_up": share(lambda x: x["macd"] > 0), "macd_mean": mean(macd),
        "volume_log_max": F.log1p(F.array_max(vol)), "volume_log_mean": mean(lv), "volume_log_std": std(lv), "volume_last": F.coalesce(F.try_divide(vol[n - 1], mean(vol)), F.lit(1.0)),
        "atr_max": F.array_max(atr), "atr_mean": mean(atr), "atr_std": std(atr), "atr_last": atr[n - 1], "adx_max": F.array_max(adx), "adx_mean": mean(adx), "adx_strong": share(lambda x: x["adx"] > 25),
        "bb_max": F.array_max(bb), "bb_mean": mean(bb), "bb_std": std(bb), "strength_mean": mean(st), "strength_slope": st[n - 1] - st[0],
        "strength_rising": F.coalesce(F.try_divide(F.size(F.filter(rise, lambda x: x > 0)), F.size(rise)), F.lit(0.0)),
        "bull_momentum": share(lambda x: (x["rsi"] > 50) & (x["macd"] > 0)), "bear_momentum": share(lambda x: (x["rsi"] < 50) & (x["macd"] < 0))}


def neutral_vector(vec: Column, size: int, defaults: dict[int, float]) -> Column:
    """Feature array of fixed size; missing or non-finite slots take their default."""
    fill = F.array(*[F.lit(float(defaults.get(i, 0.0))) for i in range(size)])
    padded = F.concat(vec, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(vec), F.lit(0)))) if size else vec
    return F.zip_with(F.slice(padded, 1, size), fill, lambda x, d: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), d).otherwise(x))


def weight_profile(hour: Column, profile: Sequence[float]) -> Column:
    """Hourly volume weight."""
    return F.array(*[F.lit(float(p)) for p in profile])[hour]


def fallback_score(c: dict[str, Column]) -> Column:
    """Breakout score from bars alone: own score, participation, distance to a short mean, body and volume, fade."""
    trend = clip01((clip((c["close"] - c["ema"]) / F.greatest(c["ema"] * 0.001, F.lit(1e-12)), -1.0, 1.0) + 0.1) / 0.7)
    edge = clip01(c["body_pct"] / 100 / F.greatest((c["high"] - c["low"]) / F.greatest(c["close"], F.lit(EPS)), F.lit(EPS)) - 0.5)
    persist = clip01(c["volume"] / F.greatest(c["volume_before"], F.lit(EPS)) - 0.3)
    fade = clip01((c["volume_mean3"] - c["volume"]) / F.greatest(c["volume_mean3"], F.lit(EPS)))
    score = 100.0 * (0.30 * c["score"] / 100 + 0.24 * clip01((c["vol_ratio"] - 1.0) / 4.0) + 0.16 * trend + 0.16 * edge + 0.14 * clip01(0.6 * c["body_eff"] + 0.4 * persist)) - 15.0 * fade
    return clip(score, 0.0, 100.0)
