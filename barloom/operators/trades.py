"""Trade statistics: KPIs, equity, windows, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.aggregates import exact_quantiles, profit_factor
from barloom.operators.series import index_series, over_chunks, running

YEAR = 252 ** 0.5


def sharpe(c: str) -> Column:
    """Mean over population deviation of the returns, times the root of 252; 0 for a single trade."""
    return F.when(F.count(c) > 1, F.avg(c) / F.greatest(F.stddev_pop(c), F.lit(1e-8)) * YEAR).otherwise(0.0)


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], balance: float) -> DataFrame:
    """Running equity, its peak and the percent below the peak, in two levels per pass."""
    e = running(trades, {"_cum": ("sum", F.col("pnl"))}, keys, order, bucket).withColumn("equity", F.col("_cum") + balance).drop("_cum")
    e = running(e, {"peak": ("max", F.col("equity"))}, keys, order, bucket)
    return e.withColumn("drawdown_pct", F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")) * 100)


def trade_kpis(curve: DataFrame, balance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Aggregate performance of trades that carry an equity curve."""
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    down = F.when(F.col("pnl_pct") < 0, F.col("pnl_pct"))
    g = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"),
        F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(F.when(loss, F.col("pnl"))), F.lit(0.0)).alias("mean_loss"),
        sharpe("pnl_pct").alias("sharpe"),
        (F.avg("pnl_pct") / F.greatest(F.when(F.count(down) > 1, F.stddev_pop(down)).otherwise(1.0), F.lit(1e-8)) * YEAR).alias("sortino"),
        (F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(F.col("pnl") < 0, -F.col("pnl"))), F.lit(0.0)), F.lit(1e-8))).alias("profit_factor"),
        F.max("drawdown_pct").alias("max_drawdown_pct"),
        *[F.count_if(F.col("barrier") == b).alias(f"{b.lower()}_hits") for b in ("TP1", "TP2", "TP3", "SL", "TIMEOUT")])
    pct = F.col("total_pnl") / max(balance, 1) * 100
    return g.select("*", (F.col("wins") / F.col("trades") * 100).alias("win_rate"), (pct / F.greatest(F.col("max_drawdown_pct"), F.lit(1e-8))).alias("calmar"),
                    (F.col("total_pnl") / F.greatest(F.col("max_drawdown_pct") * balance / 100, F.lit(1e-8))).alias("recovery"))


def window_kpis(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("win_rate"),
        sharpe("pnl_pct").alias("sharpe"))


def window_stability(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("pnl") > 0).alias("windows_profitable"), F.avg("sharpe").alias("sharpe_mean"),
        F.stddev_pop("sharpe").alias("sharpe_std"), (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("share_profitable"))


def agent_summary(trades: DataFrame, agents: Sequence[str]) -> DataFrame:
    """One row per known agent, zeros where it has no trades, with its share of the total result."""
    dim = trades.sparkSession.createDataFrame([(a,) for a in agents], "agent string")
    tp, sl, to = (F.count_if(F.col("label") == x) for x in ("TP", "SL", "TIMEOUT"))
    n = F.count(F.lit(1))
    g = trades.groupBy("agent").agg(
        n.alias("trades"), tp.alias("wins"), sl.alias("losses"), to.alias("timeouts"), (tp / n * 100).alias("tp_rate_all"),
        F.coalesce(F.try_divide(tp * 100.0, tp + sl), F.lit(0.0)).alias("decided_win_rate"), F.sum("pnl").alias("net_pnl"), F.avg("pnl").alias("avg_pnl"),
        profit_factor("pnl").alias("profit_factor"), F.avg("hold").alias("avg_hold"))
    total = trades.agg(F.sum("pnl").alias("t"))
    numbers = [c for c in g.columns if c != "agent"]
    return dim.join(g, "agent", "left").select("agent", *[F.coalesce(c, F.lit(0)).cast(g.schema[c].dataType).alias(c) for c in numbers],
                                               F.coalesce(F.try_divide(F.col("net_pnl"), total.scalar()) * 100, F.lit(0.0)).alias("contribution_pct"))


def score_histogram(trades: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Trades by score between fixed, uneven edges; scores outside are left out."""
    lo = None
    for a, b in zip(edges[:-1], edges[1:]):
        hit = (F.col("score") >= a) & (F.col("score") < b)
        lo = F.when(hit, float(a)) if lo is None else lo.when(hit, float(a))
    up = F.create_map(*[x for a, b in zip(edges[:-1], edges[1:]) for x in (F.lit(float(a)), F.lit(float(b)))])
    g = trades.withColumn("bucket_lo", lo).filter(F.col("bucket_lo").isNotNull()).groupBy("bucket_lo").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("net_pnl"), F.avg("pnl").alias("avg_pnl"))
    return g.select("bucket_lo", up[F.col("bucket_lo")].alias("bucket_hi"), "trades", "wins", (F.col("wins") / F.col("trades") * 100).alias("win_rate_pct"), "net_pnl", "avg_pnl")


def tag_extremes(trades: DataFrame, q: float = 0.80) -> DataFrame:
    """loss / big_win (at or above the q-th quantile of the gains) / other."""
    cut = exact_quantiles(trades.filter(F.col("pnl") > 0), [], "pnl", [q]).select("value_at_q")
    return trades.withColumn("bucket", F.when(F.col("pnl") < 0, "loss").when((F.col("pnl") > 0) & (F.col("pnl") >= cut.scalar()), "big_win").otherwise("other"))


def feature_comparison(tagged: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and median of each feature among losses and big wins and their median gap."""
    long = tagged.filter(F.col("bucket").isin("loss", "big_win")).select("bucket", F.explode(F.array(*[
        F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in features])).alias("_s")).select("bucket", F.col("_s.f").alias("feature"), F.col("_s.x").alias("x"))
    def side(c: str, b: str) -> Column:
        return F.max(F.when(F.col("bucket") == b, F.col(c)))
    stat = long.groupBy("feature", "bucket").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    med = exact_quantiles(long, ["feature", "bucket"], "x", [0.5]).select("feature", "bucket", F.col("value_at_q").alias("median"))
    g = stat.join(med, ["feature", "bucket"]).groupBy("feature").agg(
        *[side(c, b).alias(f"{b}_{c}") for b in ("loss", "big_win") for c in ("n", "mean", "median")])
    return g.withColumn("median_delta", F.col("big_win_median") - F.col("loss_median"))


def loss_reason(warn_at: float, risk_max: float) -> Column:
    """First matching explanation of a losing trade."""
    return (F.when(F.col("slip") >= 0.25, "slippage").when(F.col("warning_score") >= warn_at, "warning exit")
            .when((F.col("max_runup") < 1.0) & (F.col("max_drawdown") >= 1.5), "failed at once").when(F.col("time_to_drawdown") <= 3, "early reversal")
            .when(F.col("top_risk") > risk_max, "risk grew").when(F.col("volume_decay") < -0.35, "volume left").otherwise("no development"))


def big_win_reason(warn_at: float, risk_max: float, wave_min: float) -> Column:
    return (F.when((F.col("max_runup") >= 5.0) & (F.col("wave") >= wave_min + 10.0), "strong wave")
            .when((F.col("time_to_peak") <= 6) & (F.col("volume_decay") >= -0.10), "fast with volume")
            .when((F.col("warning_score") < 0.5 * warn_at) & (F.col("top_risk") <= 0.8 * risk_max), "low risk trend").otherwise("held through noise"))


def rolling_performance(trades: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], n: int = 100) -> DataFrame:
    """Win rate and Sharpe over the last n trades of each key."""
    numbered = index_series(trades, keys, order, bucket, out="trade_idx")

    def build(x: DataFrame, f) -> DataFrame:
        w = f.last(n)
        sd = F.greatest(F.stddev_pop("pnl_pct").over(w), F.lit(1e-8))
        return x.select("*", (F.avg((F.col("pnl") > 0).cast("int")).over(w) * 100).alias("win_rate"),
                        F.when(F.col("trade_idx") >= 1, F.avg("pnl_pct").over(w) / sd * YEAR).otherwise(0.0).alias("sharpe"))
    return over_chunks(numbered, build, keys=keys, back=n - 1, idx="trade_idx")


# Fold scoring.
FOLD = {"min_trades": 4, "target": 12, "min_conf": 0.25, "low_penalty": 5.0, "stability": 0.5, "dd_weight": 10.0, "dd_limit": 50.0,
        "bonus_cap": 2.0, "bonus_target": 120, "asymmetry": 5.0}


def fold_score(p: dict = FOLD) -> Column:
    """Score of one fold from trades, calmar, avg_win and avg_loss (positive size)."""
    t = F.col("trades").cast("double")
    skew = F.when((F.col("avg_loss") > F.col("avg_win")) & (F.col("avg_win") > 0), (F.try_divide("avg_loss", "avg_win") - 1) * p["asymmetry"]).otherwise(0.0)
    base = F.col("calmar") - skew
    conf = F.when(t <= 0, 0.0).when(t >= p["target"], 1.0).otherwise(F.greatest(F.lit(p["min_conf"]), F.sqrt(F.greatest(t, F.lit(0.0)) / p["target"])))
    s = F.when(base >= 0, base * conf).otherwise(base / F.greatest(conf, F.lit(p["min_conf"])))
    thin = F.when(t < p["min_trades"], p["low_penalty"] * (p["min_trades"] - t) / p["min_trades"]).otherwise(0.0)
    return F.when(t <= 0, -100.0).otherwise(s - thin)


def multi_fold_score(folds: DataFrame, keys: Sequence[str], p: dict = FOLD) -> DataFrame:
    """Median less spread and drawdown penalties plus a trade bonus. Folds per key are few."""
    x = folds.withColumn("_s", fold_score(p))
    g = x.groupBy(*keys).agg(F.percentile("_s", 0.5).alias("median"), F.stddev_pop("_s").alias("spread"), F.max("max_drawdown_pct").alias("worst"), F.sum("trades").alias("total"))
    return g.select(*keys, "median", "spread", "worst", "total", (
        F.col("median") - p["stability"] * F.col("spread") - F.greatest(F.lit(0.0), (F.col("worst") - p["dd_limit"]) / 100) * p["dd_weight"]
        + F.least(F.lit(p["bonus_cap"]), F.col("total") / p["bonus_target"] * p["bonus_cap"])).alias("score"))


def poisson_cuts(steps: int = 65536) -> list[int]:
    """Least of ``steps`` equal chances at which a Poisson(1) weight is 1, 2, ..."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 20):
        total += term
        term /= k
        if total * steps < steps - 0.5:
            out.append(math.ceil(total * steps))
    return out


def bootstrap_chance(ids: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """A number below 65536 for every id and replicate: integer mixing on 32 bits."""
    x = (ids.astype(np.uint32)[:, None] * np.uint32(2654435761)) ^ (reps.astype(np.uint32)[None, :] * np.uint32(2246822519))
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return (x ^ (x >> np.uint32(16))) >> np.uint32(16)


def bootstrap_profit_factor(trades: DataFrame, value: str, id_col: str, reps: int = 1000, q: float = 0.05, floor_rows: int = 0) -> DataFrame:
    """Lower quantile of the bootstrap profit factor.

    Poisson bootstrap: each row draws a Poisson(1) weight per replicate from a hash of its integer id (its low 32 bits) and the
    replicate, so the result does not depend on partitioning; tasks pass on only their replicate sums.
    """
    base = trades.select(F.col(value).cast("double").alias("v"), (F.col(id_col).cast("long").bitwiseAND(F.lit(2**32 - 1))).alias("id"))
    weights = np.searchsorted(np.array(poisson_cuts()), np.arange(65536), side="right").astype(np.float32)
    every = np.arange(reps)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains, losses, rows = np.zeros(reps), np.zeros(reps), 0
        for b in batches:
            v, ids = b["v"].to_numpy(), b["id"].to_numpy()
            for lo in range(0, len(v), 1000):
                w, part = weights[bootstrap_chance(ids[lo:lo + 1000], every)], v[lo:lo + 1000]
                gains += np.maximum(part, 0) @ w
                losses -= np.minimum(part, 0) @ w
            rows += len(b)
        yield pd.DataFrame({"rep": every, "g": gains, "l": losses, "n": rows})

    per = base.mapInPandas(sums, "rep int, g double, l double, n long").groupBy("rep").agg(F.sum("g").alias("g"), F.sum("l").alias("l"), F.sum("n").alias("n"))
    pf = per.select("n", F.when(F.col("l") == 0, 10.0).otherwise(F.try_divide("g", "l")).alias("pf"))
    return pf.agg(F.max("n").alias("rows"), F.percentile("pf", q).alias("pf_low")).select(
        "rows", F.when(F.col("rows") < floor_rows, 0.0).otherwise(F.col("pf_low")).alias("pf_low"))
