"""Per (symbol, interval) analysis rows and their combination across intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators.bars import INTERVAL_MINUTES, resample_many
from barloom.operators.series import Frames, ema, ema_chunk, ema_halo, index_series, over_chunks, seconds


def interval_bars(base: DataFrame, intervals: Sequence[str], rows_per_bucket: int = 512) -> DataFrame:
    """Numbered bars of several intervals; numbering buckets follow the interval's width."""
    b = resample_many(base, intervals)
    width = F.create_map(*[x for i in intervals for x in (F.lit(i), F.lit(INTERVAL_MINUTES[i] * 60 * rows_per_bucket))])
    return index_series(b, ["symbol", "interval"], ["open_time"], [F.floor(seconds("open_time") / width[F.col("interval")])])


def trend_score(rsi: Column, macd: Column, signal: Column, price: Column, short: Column, long: Column, band: Column, k: Column, d: Column) -> Column:
    """Points for momentum, cross-over, moving-average order, band position and oscillator extremes."""
    hist = macd - signal
    zero = F.lit(0)
    return (F.when(rsi > 70, 20).when(rsi < 30, -20).when(rsi > 50, 10).otherwise(-10)
            + F.when((macd > signal) & (hist > 0), 20).when((macd < signal) & (hist < 0), -20).otherwise(zero)
            + F.when((price > short) & (short > long), 20).when((price < short) & (short < long), -20).otherwise(zero)
            + F.when(band > 0.8, 10).when(band < 0.2, -10).otherwise(zero)
            + F.when((k > 80) & (d > 80), 10).when((k < 20) & (d < 20), -10).otherwise(zero))


def analyse(bars: DataFrame, keys: Sequence[str] = ("symbol", "interval"), ma_short: int = 20, ma_long: int = 50) -> DataFrame:
    """All measures of a timeframe on every bar, one chunk pass; JVM expressions only."""
    a14, a12, a26, a9 = (R.ema_alpha(n) for n in (14, 12, 26, 9))
    # the longest chains: Wilder-14 after a lag, and the directional index (two stacked means)
    halo = max(ema_halo(1 / 14) + 16, ema_halo(a14, a14) + 2, ema_halo(a26, a9))

    def build(x: DataFrame, f: Frames) -> DataFrame:
        step = F.col("close") - f.lag("close")
        plus, minus = R.directional_moves(f)
        zero = F.lit(0.0)
        x = x.select("*", F.greatest(step, zero).alias("gain"), F.greatest(-step, zero).alias("loss"), R.true_range(f).alias("tr"), plus.alias("pdm"), minus.alias("mdm"),
                     (ema(F.col("close"), a12, f) - ema(F.col("close"), a26, f)).alias("macd"), R.stochastic_k(f).alias("k"), F.coalesce(R.simple_return(f), zero).alias("ret"),
                     F.coalesce(step, zero).alias("dclose"))
        first = F.col("bar_idx") == 0
        x = x.select("*", ema(F.col("macd"), a9, f).alias("signal"), R.stochastic_d("k", f).alias("d"), R.rsi("gain", "loss", 14, f).alias("rsi"), ema(F.col("tr"), a14, f).alias("atr"),
                     ema(F.when(first, 0.0).otherwise(F.col("tr")), a14, f).alias("_ta"), ema(F.col("pdm"), a14, f).alias("_pe"), ema(F.col("mdm"), a14, f).alias("_me"))
        p, m = (F.coalesce(F.try_divide(100.0 * F.col(c), F.col("_ta")), zero) for c in ("_pe", "_me"))
        x = x.select("*", F.coalesce(F.try_divide(100.0 * F.abs(p - m), p + m), zero).alias("_dx"))
        up, mid, low = R.bollinger_pop("close", 20, 2.0, f)
        short, long = F.avg("close").over(f.last(ma_short)), F.avg("close").over(f.last(ma_long))
        x = x.select("*", ema(F.col("_dx"), a14, f).alias("adx"), F.when(up - low > 0, (F.col("close") - low) / (up - low)).otherwise(0.5).alias("bb_position"), short.alias("_ms"), long.alias("_ml"))
        x = x.select("*", trend_score(F.col("rsi"), F.col("macd"), F.col("signal"), F.col("close"), F.col("_ms"), F.col("_ml"), F.col("bb_position"), F.col("k"), F.col("d")).alias("trend_score"))
        shift = F.col("_ms") - F.col("_ml")
        return x.select(
            *keys, "bar_idx", "_chunk", "open_time", F.col("close").alias("price"), "volume", "rsi", (F.col("macd") - F.col("signal")).alias("macd"), "bb_position", "adx", "atr", "k", "d", "trend_score",
            F.when(F.col("trend_score") > 30, "BULLISH").when(F.col("trend_score") < -30, "BEARISH").otherwise("NEUTRAL").alias("trend"),
            F.floor(F.round(F.least(F.lit(100.0), F.abs("trend_score") * F.col("adx") / 25), 9)).cast("int").alias("strength"),
            F.when(F.col("bar_idx") >= 20, F.stddev_pop("ret").over(f.last(20))).otherwise(0.0).alias("volatility"),
            F.coalesce(F.try_divide(F.col("atr") - f.lag("atr", 9), F.col("atr")), zero).alias("volatility_accel"),
            *[F.coalesce(R.simple_return(f, n), zero).alias(f"momentum_{n}") for n in (5, 10, 20, 50)],
            F.coalesce(F.try_divide(F.col("volume"), F.avg("volume").over(f.last(20))), F.lit(1.0)).alias("volume_ratio"), shift.alias("mean_shift"),
            F.coalesce(F.try_divide(F.abs(shift), F.col("atr")), zero).alias("trend_strength"), R.vpin_bulk(f).alias("vpin"), R.taker_imbalance(f).alias("taker_imbalance"))

    return over_chunks(bars, build, keys=keys, back=halo, chunk=ema_chunk(halo, 1 / 14, a14, a12, a26, a9))


FIELDS = ("price", "volume", "rsi", "macd", "bb_position", "adx", "atr", "strength", "trend", "vpin")


def latest_by_interval(rows: DataFrame) -> DataFrame:
    """Newest analysis row per (symbol, interval)."""
    return rows.groupBy("symbol", "interval").agg(F.max_by(F.struct(*FIELDS), "bar_idx").alias("r")).select("symbol", "interval", "r.*")


def as_array(rows: DataFrame) -> DataFrame:
    """Per symbol: array of interval structs from fine to coarse."""
    width = F.create_map(*[x for i, m in INTERVAL_MINUTES.items() for x in (F.lit(i), F.lit(m))])
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(width[F.col("interval")].alias("w"), "interval", *FIELDS))).alias("tfs"))


def as_columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Per symbol: one struct column per interval, renamed by ``names``."""
    return rows.groupBy("symbol").agg(*[F.max_by(F.struct(*FIELDS), F.when(F.col("interval") == i, 1)).alias(n) for i, n in names.items()])
