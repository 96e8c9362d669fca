"""Live pipelines over streamed bars, prices, picks and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.bars import ohlcv_rollup
from barloom.session import scratch
from barloom.streaming import steps as S
from barloom.streaming.fold import keyed_fold


def closed_bars(messages: DataFrame) -> DataFrame:
    """Emit on bar close only."""
    return messages.filter("closed")


def latest_bars(bars: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Open bars replaced by their newest update: one row per (symbol, interval, open_time)."""
    rest = [c for c in bars.columns if c not in ("symbol", "interval", "open_time")]
    return (bars.withWatermark("open_time", watermark).groupBy("symbol", "interval", "open_time")
            .agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("symbol", "interval", "open_time", "r.*"))


def rollup(bars: DataFrame, width: str, watermark: str = "1 hour") -> DataFrame:
    """Tumbling roll-up of live bars to a coarser interval, final once the watermark passes."""
    return (bars.withWatermark("open_time", watermark).groupBy("symbol", F.window("open_time", width).alias("w")).agg(*ohlcv_rollup())
            .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "quote_volume", "trades"))


def fresh_titles(feed: DataFrame, watermark: str = "12 hours") -> DataFrame:
    """News window: a title counts once within the watermark."""
    from barloom.functions.text import title_key
    return feed.withColumn("_k", title_key(F.col("title"))).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def breakouts(bars: DataFrame, p: dict, cooldown: int = 48) -> DataFrame:
    return keyed_fold(bars, ["symbol"], ["t"], S.breakout(p, cooldown=cooldown), {}, "t long, bar_idx long, tier string, close double, atr double, symbol string")


def gated_prices(prices: DataFrame, threshold: float) -> DataFrame:
    return keyed_fold(prices, ["symbol"], ["t", "seq"], S.price_gate(threshold), {}, "t long, seq long, price double, symbol string")


def rate_history(rates: DataFrame, size: int = 100) -> DataFrame:
    return keyed_fold(rates, ["symbol"], ["t", "seq"], S.ring(size), {}, "t long, held int, mean double, symbol string")


def drift(preds: DataFrame, delta: float = 0.002) -> DataFrame:
    return keyed_fold(preds, ["model"], ["t", "id"], S.adwin(delta), {}, "t long, id long, drift boolean, mean double, held int, model string")


def page_hinkley(preds: DataFrame, delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    return keyed_fold(preds, ["model"], ["t", "id"], S.page_hinkley(delta, limit), {}, "t long, id long, drift boolean, stat double, model string")


def confirmed_drift(preds: DataFrame, pause: float = 3600.0) -> DataFrame:
    return keyed_fold(preds, ["model"], ["t", "id"], S.confirmed_drift(pause), {}, "t long, id long, confirmed boolean, model string")


def adaptive_coverage(preds: DataFrame, scores: Sequence[float], target: float = 0.1, gamma: float = 0.005) -> DataFrame:
    """``scores`` is the calibration sample; its size is fixed by the calibration step."""
    return keyed_fold(preds, ["model"], ["t", "id"], S.adaptive_alpha(scores, target, gamma), {}, "t long, id long, covered boolean, alpha double, threshold double, model string")


def health_alerts(preds: DataFrame, **limits: float) -> DataFrame:
    return keyed_fold(preds, ["model"], ["t", "id"], S.rolling_monitor(**limits), {}, "t long, id long, accuracy double, ece double, model string")


def loss_streaks(trades: DataFrame, limit: int = 3, factor: float = 0.5) -> DataFrame:
    return keyed_fold(trades, ["agent"], ["t", "id"], S.loss_streak(limit, factor), {}, "t long, id long, daily_pnl double, losses int, size_factor double, agent string")


def timed(rows: DataFrame, watermark: str) -> DataFrame:
    """Rows with the event time of ``t`` (seconds) and a watermark; later ones than that are dropped by Spark."""
    return rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", watermark)


def picks(rows: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Status of the picks of each symbol. A pick of a symbol without further rows expires when the watermark passes its end."""
    return keyed_fold(timed(rows, watermark), ["symbol"], ["t", "seq"], S.pick_lifecycle(), {},
                      "id long, t long, status string, best double, worst double, final boolean, symbol string", S.quiet_picks())


def capped_picks(picked: DataFrame, limit: int = 20) -> DataFrame:
    """At most ``limit`` picks per day, keyed by day."""
    return keyed_fold(picked.withColumn("day", F.floor(F.col("t") / 86400)), ["day"], ["t", "id"], S.daily_cap(limit), {}, "t long, id long, day long")


def decisions(rows: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Outcome of vetoed decisions; one that reaches nothing expires by its rows or by the watermark."""
    return keyed_fold(timed(rows, watermark), ["symbol"], ["t", "seq"], S.decision_outcome(), {}, "id long, t long, outcome string, accuracy double, symbol string", S.quiet_decisions())


def in_order(rows: DataFrame, time: Column, name: str, most: int = 1_000_000) -> DataFrame:
    """A table as a file stream of about ``most`` rows a micro-batch, by whole values of ``time`` (a long) in ascending order.

    Pieces are cut at quantiles of ``time`` and land one after the other, each as one file, so the source takes them in
    that order; a key has at most the rows of a piece in a micro-batch, however long the table is.
    """
    spark, root = rows.sparkSession, scratch(rows.sparkSession, name)
    pieces = -(-rows.count() // most)
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = sorted(set(rows.agg(F.percentile_approx(time, shares, 100 * pieces)).first()[0] or [])) if pieces > 1 else []
    if not cuts:
        rows.coalesce(1).write.parquet(f"{root}/000000")
    else:
        # rows without a time come first
        piece = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.coalesce(time, F.lit(cuts[0])))), F.lit(0))
        rows.withColumn("_piece", piece).repartition("_piece").write.partitionBy("_piece").parquet(f"{root}-pieces")
        landed = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_piece", T.IntegerType())])).parquet(f"{root}-pieces")
        for k in range(len(cuts) + 1):
            landed.filter(F.col("_piece") == k).drop("_piece").coalesce(1).write.parquet(f"{root}/{k:06d}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(root)


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything that has landed, into a table, and return the table."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    q = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
