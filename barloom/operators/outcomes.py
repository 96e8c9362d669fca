"""Outcome study: exits per stop level, parameter grids and report tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import exits as X
from barloom.operators.aggregates import exact_quantiles, profit_factor
from barloom.operators.episodes import gap_bucket, nearest_choice, outcome_bucket, score_band
from barloom.operators.labels import SWEEP_BARS, path_arrays, staged_exit, sweep

# Stop levels and the exit grid.
STOPS = (0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.4, 3.0)
BANK = (2.4, 3.0, 3.6, 4.2)
FRACTION = (0.15, 0.25, 0.35)
ACTIVATE = (1.5, 2.0)
TRAIL = (2.0, 3.0)
PRE_BANK = (12, 18, 24)
POST_BANK = (24, 36, 48)
BUCKETS = ("<0", "0-1", "1-3", "3-5", "5-10", ">=10")
STAGED = {"bank_atr": 2.0, "fraction": 0.5, "trail": 1.5, "pre": 24, "post": 36}


def staged_outcomes(starts: DataFrame, bars: DataFrame, stops: Sequence[float] = STOPS, p: dict = STAGED) -> DataFrame:
    """Long outcome table: one row per event and stop. ``starts``: symbol, start_bar, close, atr, ..."""
    ev = starts.withColumnRenamed("start_bar", "bar_idx").filter(F.col("atr") > 0)
    paths = path_arrays(ev, bars, p["post"], ["high", "low", "close"], ["symbol", "bar_idx"])
    x = paths.withColumn("sl_atr", F.explode(F.array(*[F.lit(float(s)) for s in stops])))
    out = staged_exit("path", F.col("close"), F.col("atr"), F.lit(p["bank_atr"]), F.col("sl_atr"), p["fraction"], p["trail"], p["pre"], p["post"])
    rest = [c for c in starts.columns if c not in ("symbol", "start_bar")]
    return x.select("symbol", F.col("bar_idx").alias("start_bar"), *rest, "sl_atr", out.alias("_o")).select(
        "symbol", "start_bar", *rest, "sl_atr", F.col("_o.label").alias("outcome"), F.col("_o.realized").alias("realized"),
        (F.col("start_bar") + F.col("_o.off")).alias("exit_bar"), F.col("_o.banked").alias("banked"))


def grid_rows(pre: int, post: int, stops: Sequence[float] = STOPS) -> list[tuple[float, float, float, float, float]]:
    return [(b, f, t, r, s) for b in BANK for f in FRACTION for t in ACTIVATE for r in TRAIL for s in stops]


def decision_matrix(starts: DataFrame, bars: DataFrame, pre: int = 24, post: int = 48, penetration: float = 0.20,
                    slip_cap: float = 0.25, stops: Sequence[float] = STOPS, chunk: int = SWEEP_BARS) -> DataFrame:
    """Outcome totals per exit grid point. Each chunk of a series reduces its own events before the shuffle."""
    grid = grid_rows(pre, post, stops)
    g = np.array(grid)
    names = ["bank_atr", "bank_fraction", "trail_activate_atr", "runner_trail_atr", "sl_atr"]

    def reduce(b: pd.DataFrame, path: dict[str, np.ndarray]) -> pd.DataFrame:
        lab, val, dd = X.grid_exit(
            path["open"], path["high"], path["low"], path["close"], b.close.to_numpy(), b.atr.to_numpy(),
            g[:, 0], g[:, 1], g[:, 3], g[:, 4], pre, post, penetration, slip_cap)
        return pd.DataFrame(dict(
            zip(names, g.T), n=len(b), tp=(lab == X.TP).sum(0), sl=(lab == X.SL).sum(0), timeout=(lab == X.TIMEOUT).sum(0),
            total=val.sum(0), gains=np.maximum(val, 0).sum(0), losses=-np.minimum(val, 0).sum(0), dd_sum=dd.sum(0), dd_max=dd.max(0)))

    schema = ", ".join(f"{n} double" for n in names) + ", n long, tp long, sl long, timeout long, total double, gains double, losses double, dd_sum double, dd_max double"
    ev = starts.select("symbol", F.col("start_bar").alias("bar_idx"), "close", "atr")
    part = sweep(ev, bars, pre + post, ["open", "high", "low", "close"], reduce, schema, chunk=chunk)
    t = part.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("n", "tp", "sl", "timeout", "total", "gains", "losses", "dd_sum")], F.max("dd_max").alias("dd_max"))
    pf = F.when(F.col("losses") == 0, F.when(F.col("gains") > 0, float("inf")).otherwise(0.0)).otherwise(F.try_divide("gains", "losses"))
    return t.select(*names, F.col("n").alias("count"), F.col("tp").alias("tp_count"), F.col("sl").alias("sl_count"), F.col("timeout").alias("timeout_count"),
                    (F.col("total") / F.col("n")).alias("expectancy_atr"), pf.alias("weighted_pf"), F.col("total").alias("sum_realized_atr"),
                    (F.col("dd_sum") / F.col("n")).alias("avg_trade_drawdown_atr"), F.col("dd_max").alias("max_trade_drawdown_atr"))


FLOW = ["open", "high", "low", "close", "volume_ratio", "quote_slope", "taker_slope", "trend", "win_prob", "participation",
        "exhaustion", "close_pos", "upper_wick"]


def adaptive_outcomes(starts: DataFrame, ctx: DataFrame, stops: Sequence[float] = STOPS, bank: float = 5.4, fraction: float = 0.5,
                      activate: float = 5.4, trail: float = 6.0, pre: int = 288, post: int = 288, penetration: float = 0.20,
                      slip_cap: float = 0.25, material: float = 1.0, chunk: int = SWEEP_BARS) -> DataFrame:
    """Flow-adaptive staged exits of every event at every stop level (one walk serves all stops)."""
    levels = np.array(stops, dtype=float)

    def walk(b: pd.DataFrame, path: dict[str, np.ndarray]) -> pd.DataFrame:
        lab, val, off, px, slip, banked, dd = X.adaptive_exit(
            {c: v[:, 1:] for c, v in path.items()}, {c: v[:, 0] for c, v in path.items()}, b.close.to_numpy(), b.atr.to_numpy(), levels,
            bank, fraction, activate, trail, pre, post, penetration, slip_cap, material)
        k = len(levels)
        return pd.DataFrame({
            "symbol": np.repeat(b.symbol.to_numpy(), k), "start_bar": np.repeat(b.bar_idx.to_numpy(), k), "sl_atr": np.tile(levels, len(b)),
            "outcome": X.LABELS[lab].ravel(), "realized": val.ravel(), "exit_bar": (b.bar_idx.to_numpy()[:, None] + off).ravel(),
            "exit_price": px.ravel(), "stop_slip_atr": slip.ravel(), "banked": banked.ravel(), "max_drawdown": dd.ravel()})

    schema = "symbol string, start_bar long, sl_atr double, outcome string, realized double, exit_bar long, exit_price double, stop_slip_atr double, banked boolean, max_drawdown double"
    ev = starts.select("symbol", F.col("start_bar").alias("bar_idx"), "close", "atr")
    return sweep(ev, ctx, pre + post + 12, FLOW, walk, schema, first=0, chunk=chunk)


# -- statistics ---------------------------------------------------------------------------------

MEASURES = {
    "max_mae_entry_atr": (0.25, 0.5, 0.75, 0.9, 0.95, 0.99), "max_mae_peak_atr": (0.25, 0.5, 0.75, 0.9, 0.95),
    "max_runup_atr": (0.5, 0.75, 0.9, 0.95), "time_to_peak": (0.5, 0.9), "bars_to_runup_atr_1": (0.5,), "mae_to_mfe": (0.5,), "volume_decay_to_exit": (0.5,),
}


def tag(q: float) -> str:
    return f"p{round(q * 100)}"


def bucket_stats(rows: DataFrame) -> DataFrame:
    """The same measures overall and along seven separate dimensions, one pass each for sums and quantiles.

    ``rows``: outcome rows joined with outcome, realized, prior_gap and the bucket columns.
    """
    kinds = ["outcome_bucket", "tier", "score_band", "hour_utc", "dow_utc", "regime_bucket", "gap_bucket"]
    sets = F.array(F.struct(F.lit("overall").alias("k"), F.lit("all").alias("v")),
                   *[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in kinds])
    wide = rows.withColumn("_s", F.explode(sets)).select("*", F.col("_s.k").alias("bucket_type"), F.col("_s.v").alias("bucket_value"))
    keys = ["bucket_type", "bucket_value"]
    sums = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), *[F.count_if(F.col("outcome") == o).alias(f"{o.lower()}_count") for o in ("TP", "SL", "TIMEOUT")],
        profit_factor("realized").alias("weighted_pf"), F.avg("realized").alias("expectancy_atr"),
        *[F.avg(m).alias(f"{m}_mean") for m in MEASURES], F.max("max_mae_entry_atr").alias("max_mae_entry_max"), F.max("max_runup_atr").alias("max_runup_max"),
        (F.avg("reversed_6") * 100).alias("reversed_rate"), (F.avg("round_trip_12") * 100).alias("round_trip_rate"),
        (F.avg((F.col("gap_bucket") == "chain").cast("int")) * 100).alias("chain_rate"))
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("x")) for m in MEASURES])).alias("_m")).select(
        *keys, F.col("_m.m").alias("measure"), F.col("_m.x").alias("x"))
    quant = exact_quantiles(long, [*keys, "measure"], "x", sorted({q for v in MEASURES.values() for q in v}))
    cells = [(m, q) for m, qs in MEASURES.items() for q in qs]
    table = quant.groupBy(*keys).agg(*[
        F.max(F.when((F.col("measure") == m) & (F.col("q") == q), F.col("value_at_q"))).alias(f"{m}_{tag(q)}") for m, q in cells])
    return sums.join(table, keys, "left")


def with_buckets(rows: DataFrame) -> DataFrame:
    """Adds the bucket columns used in reports. Needs max_runup_atr, score, prior_gap and win-probability-like regime."""
    return rows.select("*", outcome_bucket(F.col("max_runup_atr")).alias("outcome_bucket"), score_band(F.col("score")).alias("score_band"),
                       gap_bucket(F.col("prior_gap")).alias("gap_bucket"))


def survival_table(long: DataFrame, stops: Sequence[float] = STOPS) -> DataFrame:
    """Percent not stopped out, outcome bucket by stop level."""
    return (long.groupBy("outcome_bucket").pivot("sl_atr", [float(s) for s in stops])
            .agg(F.avg((F.col("outcome") != "SL").cast("int")) * 100))


def drawdown_heatmap(curve: DataFrame, bars: int = 36) -> DataFrame:
    """90th percentile drawdown by bars since entry and outcome bucket."""
    q = exact_quantiles(curve.filter(F.col("off") <= bars), ["off", "outcome_bucket"], "drawdown_atr", [0.9])
    return q.groupBy("off").pivot("outcome_bucket", list(BUCKETS)).agg(F.max("value_at_q"))


def hour_of_week(rows: DataFrame, spark) -> DataFrame:
    """Summed outcome by weekday (rows 0..6, all present) and hour (columns 0..23)."""
    days = spark.range(7).select(F.col("id").cast("int").alias("dow_utc"))
    wide = rows.groupBy("dow_utc").pivot("hour_utc", list(range(24))).agg(F.sum("realized"))
    return days.join(wide, "dow_utc", "left").toDF("dow_utc", *[f"h{h}" for h in range(24)])


def recommendations(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Stop, bank and time limits snapped to the grid from the winners' quantiles and the best grid row."""
    win = rows.filter(F.col("max_runup_atr") >= 3.0)
    long = win.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("x")) for m in (
        "max_mae_entry_atr", "time_to_peak", "bars_to_runup_atr_3")])).alias("_m")).select("_m.m", "_m.x")
    q = exact_quantiles(long, ["m"], "x", [0.5, 0.9])

    def cell(m: str, p: float) -> Column:
        return F.max(F.when((F.col("m") == m) & (F.col("q") == p), F.col("value_at_q")))

    best = matrix.orderBy(F.desc("expectancy_atr"), F.desc("weighted_pf"), F.desc("sum_realized_atr"),
                          "bank_atr", "bank_fraction", "trail_activate_atr", "runner_trail_atr", "sl_atr").limit(1)
    picks = q.agg(nearest_choice(cell("max_mae_entry_atr", 0.9), STOPS).alias("sl_atr"),
                  nearest_choice(cell("bars_to_runup_atr_3", 0.5), PRE_BANK).cast("int").alias("max_bars_pre_bank"),
                  nearest_choice(cell("time_to_peak", 0.9), POST_BANK).cast("int").alias("max_bars_post_bank"),
                  F.coalesce(cell("max_mae_entry_atr", 0.5), F.lit(0.0)).alias("mae_veto_atr"))
    top = best.select(F.lit(1).alias("_k"), "bank_atr", "bank_fraction", "trail_activate_atr", "runner_trail_atr")
    return picks.withColumn("_k", F.lit(1)).join(top, "_k", "left").drop("_k")
