"""Bars: build, clean, merge, resample and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import seconds

# Minutes per bar interval.
INTERVAL_MINUTES = {"5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "1d": 1440}


def floor_time(col: Column | str, width_s: int | Column) -> Column:
    """Start of the epoch-aligned time bucket."""
    return F.timestamp_seconds(F.floor(seconds(col) / width_s) * width_s)


def bars_from_ticks(ticks: DataFrame, width_s: int) -> DataFrame:
    """OHLCV bars from prints; open and close follow the total order (ts, seq)."""
    at = F.struct("ts", "seq")
    return (
        ticks.groupBy("symbol", floor_time("ts", width_s).alias("open_time"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
            F.sum(F.col("price") * F.col("volume")).alias("quote_volume"),
            F.count(F.lit(1)).alias("trades"),
            F.sum("taker_buy").alias("taker_buy_base"),
            F.sum(F.col("taker_buy") * F.col("price")).alias("taker_buy_quote"),
        )
    )


def ohlcv_rollup() -> list[Column]:
    """Aggregates that fold finer bars into one coarser bar."""
    return [
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("quote_volume").alias("quote_volume"),
        F.sum("trades").alias("trades"),
        F.sum("taker_buy_base").alias("taker_buy_base"),
        F.sum("taker_buy_quote").alias("taker_buy_quote"),
    ]


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Coarser bars; empty buckets do not appear; close_time is the last millisecond of the bucket."""
    width = INTERVAL_MINUTES[interval] * 60
    return (
        bars.withColumn("_start", floor_time("open_time", width))
        .groupBy("symbol", "_start").agg(*ohlcv_rollup())
        .withColumnRenamed("_start", "open_time")
        .withColumn("close_time", F.timestamp_millis(F.unix_millis("open_time") + width * 1000 - 1))
    )


def resample_many(bars: DataFrame, intervals: Sequence[str]) -> DataFrame:
    """Several coarser intervals in one pass over the base bars."""
    grid = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(INTERVAL_MINUTES[i] * 60).alias("width"))
                     for i in intervals])
    return (
        bars.withColumn("_g", F.explode(grid))
        .select("*", F.col("_g.interval").alias("interval"),
                floor_time("open_time", F.col("_g.width")).alias("_start"))
        .groupBy("symbol", "interval", "_start").agg(*ohlcv_rollup())
        .withColumnRenamed("_start", "open_time")
    )


def count_resample(bars: DataFrame, per_block: int, min_blocks: int = 0) -> DataFrame:
    """Blocks of ``per_block`` bars counted back from the newest; the oldest remainder is dropped.

    Takes bars with ``bar_idx``. With ``min_blocks``, series with fewer blocks are left out.
    """
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    rest = F.col("_n") % per_block
    return (
        bars.join(sizes.filter(F.floor(F.col("_n") / per_block) >= min_blocks), "symbol")
        .filter(F.col("bar_idx") >= rest)
        .withColumn("block", F.floor((F.col("bar_idx") - rest) / per_block))
        .groupBy("symbol", "block").agg(F.min("open_time").alias("block_start"), *ohlcv_rollup())
    )


def normalize_bars(rows: DataFrame, keys: Sequence[str] = ("symbol", "interval", "open_time"),
                   seq: str = "ingest_seq") -> DataFrame:
    """One row per key, the one ingested last; a plain aggregate, so partial results merge map-side."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_bars(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "interval", "open_time")) -> DataFrame:
    """Upsert: for equal keys the new row wins; within one side the later ingest wins."""
    tagged = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    ranked = tagged.withColumn("_at", F.struct("_gen", "ingest_seq"))
    return normalize_bars(ranked, keys, "_at").drop("_gen", "_at")


def tail_bars(bars: DataFrame, limit: int) -> DataFrame:
    """Latest ``limit`` bars of each indexed series, by a comparison with the series length."""
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return bars.join(sizes, "symbol").filter(F.col("bar_idx") >= F.col("_n") - limit).drop("_n")


def count_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))


def load_window(bars: DataFrame, days: int, min_bars: int = 0) -> DataFrame:
    """Bars of the last ``days`` before the newest bar of all; with ``min_bars``, series with fewer of them are left out."""
    newest = bars.agg((F.max("open_time") - F.expr(f"INTERVAL {days} DAYS")).alias("cut"))
    recent = bars.filter(F.col("open_time") >= newest.scalar())
    long_enough = count_bars(recent).filter(F.col("n_bars") >= min_bars).select("symbol")
    return recent.join(long_enough, "symbol", "left_semi")


def cached_universe(bars: DataFrame, min_bars: int = 0, limit: int | None = None) -> DataFrame:
    """Symbols with enough history; with ``limit`` those with most data."""
    enough = count_bars(bars).filter(F.col("n_bars") >= min_bars)
    return enough if limit is None else enough.orderBy(F.desc("n_bars"), "symbol").limit(limit)


def clean_bars(rows: DataFrame, numeric: Sequence[str] = ("open", "high", "low", "close", "volume"), seq: str = "ingest_seq") -> DataFrame:
    """Numbers from text where possible; rows with a missing number go; of equal bars the one ingested last stays."""
    cast = rows
    for c in numeric:
        cast = cast.withColumn(c, F.expr(f"try_cast(`{c}` AS double)"))
    return normalize_bars(cast.dropna(subset=list(numeric)).withColumn("_seq", F.col(seq)), ["symbol", "open_time"], "_seq").drop("_seq")


# Column spellings accepted for bars.
COLUMN_VARIANTS = {
    "open": ("open", "open_price", "o"),
    "high": ("high", "high_price", "h"),
    "low": ("low", "low_price", "l"),
    "close": ("close", "close_price", "c"),
    "volume": ("volume", "vol", "v"),
}


def standard_columns(rows: DataFrame) -> DataFrame:
    """Lower-case the names, map known spellings, require the five columns, drop incomplete rows."""
    low = rows.toDF(*[c.lower() for c in rows.columns])
    for target, spellings in COLUMN_VARIANTS.items():
        found = next((s for s in spellings if s in low.columns), None)
        if found is None:
            raise ValueError(f"no column for {target}; found {low.columns}")
        low = low.withColumnRenamed(found, target)
    return low.dropna(subset=list(COLUMN_VARIANTS))
