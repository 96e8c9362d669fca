"""Prediction quality: calibration, Brier, AUC, drift, ensemble weights, conformal sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import clip
from barloom.operators.series import index_series, over_chunks, running


def calibration_error(preds: DataFrame, keys: Sequence[str] = (), bins: int = 5, low: float = 0.5, high: float = 1.0, least: int = 20) -> DataFrame:
    """Expected calibration error over equal bins of [low, high); NULL for few predictions."""
    p = F.col("prob")
    b = F.when((p >= low) & (p < high), F.least(F.floor((p - low) / ((high - low) / bins)), F.lit(bins - 1)))
    cells = preds.withColumn("_b", b).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("conf"), F.avg("correct").alias("acc"))
    gap = F.sum(F.when(F.col("_b").isNotNull(), F.col("n") * F.abs(F.col("conf") - F.col("acc"))))
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(gap, F.lit(0.0)).alias("_g")).select(
        *keys, "n", F.when(F.col("n") >= least, F.col("_g") / F.col("n")).alias("ece"))


def brier(preds: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], n: int = 50) -> DataFrame:
    """Squared error per prediction with its rolling mean over the last n of each model."""
    x = index_series(preds.withColumn("brier", F.pow(F.col("prob") - F.col("y"), 2)), keys, order, bucket, out="pred_idx")
    return over_chunks(x, lambda d, f: d.withColumn("rolling_brier", F.avg("brier").over(f.last(n))), keys=keys, back=n - 1, idx="pred_idx")


def ensemble_weights(models: DataFrame, low: float = 0.05, high: float = 0.25, temperature: float = 0.3) -> DataFrame:
    """Softmax of 0.4 AUC + 0.6 (1 - Brier), clipped and renormalised. One row per model."""
    q = 0.4 * F.coalesce("auc", F.lit(0.5)) + 0.6 * F.coalesce(1 - F.col("brier"), F.lit(0.5))
    x = models.withColumn("quality", q).withColumn("_e", F.exp(F.col("quality") / temperature))
    total = x.agg(F.sum("_e").alias("s"))
    x = x.withColumn("_w", clip(F.col("_e") / total.scalar(), low, high))
    kept = x.agg(F.sum("_w").alias("s"))
    return x.withColumn("weight", F.col("_w") / kept.scalar()).drop("_e", "_w")


def entropy_vote(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sample: mean probability weighted by 1/entropy, its uncertainty and the disagreement."""
    p = F.col("prob")
    h = -(p * F.ln(p + 1e-10) + (1 - p) * F.ln(1 - p + 1e-10))
    w = 1.0 / (h + 1e-6)
    g = votes.groupBy(*keys).agg((F.sum(w * p) / F.sum(w)).alias("prob"), F.sqrt(F.var_pop("prob")).alias("_d"))
    top = F.greatest(F.col("prob"), 1 - F.col("prob"))
    return g.select(*keys, "prob", (F.sqrt(top * (1 - top)) * 100).alias("uncertainty"), (F.col("_d") * 100).alias("disagreement"),
                    ((F.sqrt(top * (1 - top)) * 100 + F.col("_d") * 100) / 2).alias("total_uncertainty"), (top * 100).alias("confidence"))


def regime_routing(preds: DataFrame, regimes: Sequence[str], default: float, least: int = 10) -> DataFrame:
    """Weight of a model in a regime from its accuracy there; the default stands where data is thin."""
    axis = preds.select("model").distinct().withColumn("regime", F.explode(F.array(*[F.lit(r) for r in regimes])))
    g = preds.groupBy("model", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))
    n = F.coalesce("n", F.lit(0))
    return axis.join(g, ["model", "regime"], "left").select(
        "model", "regime", n.cast("long").alias("n"), "accuracy", F.when(n < least, default).otherwise(F.round(clip(F.col("accuracy") / 0.5, 0.10, 1.0), 3)).alias("weight"))


def auc(preds: DataFrame, keys: Sequence[str], bins: int = 1024) -> DataFrame:
    """Area under the curve by ranks, ties shared; counts per distinct score, then a two-level running sum."""
    scores = preds.groupBy(*keys, "prob").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = running(scores, {"below": ("sum", F.col("neg"))}, keys, ["prob"], [F.floor(F.col("prob") * bins)], exclusive=True)
    below = F.coalesce("below", F.lit(0))
    return r.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def classifier_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = (F.col("prob") >= 0.5).cast("int")
    y = F.col("y")
    tp, pp, ap = F.sum(hit * y), F.sum(hit), F.sum(y)
    q = clip(F.col("prob"), 1e-7, 1 - 1e-7)
    zero = F.lit(0.0)
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((hit == y).cast("int")).alias("accuracy"), F.coalesce(F.try_divide(tp, pp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, ap), zero).alias("recall"), F.coalesce(F.try_divide(2 * tp, pp + ap), zero).alias("f1"),
        F.avg(F.pow(F.col("prob") - y, 2)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss")).join(auc(preds, keys), list(keys)).withColumn(
        "auc", F.coalesce("auc", F.lit(0.5)))


def feature_drift(rows: DataFrame, keys: Sequence[str], order: str, first: int = 50, recent: int = 50) -> DataFrame:
    """Mean |z| of the recent feature means against the first rows. ``rows``: keys, idx, features array.

    idx is the 0-based ordinal of the row in its key.
    """
    sizes = rows.groupBy(*keys).agg((F.max(order) + 1).alias("_n"))
    x = rows.join(sizes, list(keys)).filter((F.col(order) < first) | (F.col(order) >= F.col("_n") - recent))
    slot = x.select(*keys, order, "_n", F.posexplode("features").alias("slot", "v"))
    old, new = F.col(order) < first, F.col(order) >= F.col("_n") - recent
    m = slot.groupBy(*keys, "slot").agg(F.avg(F.when(old, F.col("v"))).alias("m0"), F.stddev_pop(F.when(old, F.col("v"))).alias("s0"), F.avg(F.when(new, F.col("v"))).alias("m1"))
    return m.groupBy(*keys).agg(F.avg(F.abs(F.col("m1") - F.col("m0")) / (F.col("s0") + 1e-8)).alias("drift"))


def normalise(rows: DataFrame, keys: Sequence[str], value: str, cut: float = 10.0) -> DataFrame:
    """Value in deviations of its key, clipped; moments merge from partial aggregates."""
    m = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return rows.join(m, list(keys)).withColumn("z", clip((F.col(value) - F.col("_m")) / (F.sqrt("_v") + 1e-8), -cut, cut)).drop("_m", "_v")


def conformal_threshold(preds: DataFrame, keys: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """Finite-sample corrected quantile of 1 - p(true class) per key.

    The wanted rank depends on the key's size, so the quantile is picked among ranked scores.
    """
    s = preds.withColumn("_s", F.when(F.col("y") == 1, 1 - F.col("prob")).otherwise(F.col("prob")))
    size = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counted = s.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    r = running(counted, {"_cum": ("sum", F.col("_c"))}, keys, ["_s"], [F.floor(F.col("_s") * 1024)]).join(size, list(keys))
    level = F.least(F.lit(1.0), F.ceil((1 - alpha) * (F.col("n") + 1)) / F.col("n"))
    pos = (F.col("n") - 1) * level
    lo, hi = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= lo) & (rank <= hi), F.col("_s")))
    return r.groupBy(*keys).agg(F.first("n").alias("n"), at(F.floor(pos)).alias("_a"), at(F.ceil(pos)).alias("_b"), F.first(pos - F.floor(pos)).alias("_f")).select(
        *keys, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("threshold"))


def conformal_sets(preds: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set size, calibrated probability, width and coverage flag of each prediction."""
    x = preds.join(thresholds.select(*keys, "threshold"), list(keys))
    p, q = F.col("prob"), F.col("threshold")
    one, zero = 1 - p <= q, p <= q
    size = one.cast("int") + zero.cast("int")
    shrunk = 0.5 + (p - 0.5) * (1.0 - F.least(F.lit(0.5), q))
    cal = F.when(size == 2, shrunk).when(size == 0, clip(p, 0.02, 0.98)).otherwise(p)
    return x.select(*preds.columns, size.alias("set_size"), clip(cal, 0.01, 0.99).alias("calibrated"),
                    F.when(size == 2, 0.5).when(size == 1, 0.1).otherwise(0.0).alias("width"), F.when(F.col("y") == 1, one).otherwise(zero).cast("int").alias("covered"))


def registry_history(gens: DataFrame, min_acc: float = 0.50, max_brier: float = 0.30, tolerance: float = -0.02) -> DataFrame:
    """Deploy decision and reason of each model generation, and the running streak of AUC declines.

    A model has few generations, so its window is small.
    """
    w = Window.partitionBy("model").orderBy("generation")
    x = gens.select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in ("auc", "brier", "accuracy", "sharpe")])
    decline = F.coalesce(F.col("auc") < F.col("_auc"), F.lit(False))
    x = x.withColumn("_grp", F.sum((~decline).cast("int")).over(w))
    streak = F.sum(decline.cast("int")).over(Window.partitionBy("model", "_grp").orderBy("generation"))
    better = F.col("brier") <= F.col("_brier")
    gap = F.col("auc") - F.col("_auc")
    reason = (F.when(F.col("_auc").isNull(), "first").when(F.col("accuracy") < min_acc, "accuracy floor").when(F.col("brier") > max_brier, "brier ceiling")
              .when((F.col("_sharpe") > 0) & (F.col("sharpe") < F.col("_sharpe")), "sharpe regression").when(gap >= 0, "auc improved")
              .when((gap >= tolerance) & better, "brier improved").when((F.col("accuracy") - F.col("_accuracy") > 0.01) & better, "accuracy improved").otherwise("no improvement"))
    ok = ("first", "auc improved", "brier improved", "accuracy improved")
    x = x.withColumn("reason", reason).withColumn("decline_streak", streak)
    return x.select("model", "generation", "auc", "reason", F.col("reason").isin(*ok).alias("deploy"), "decline_streak")


def log_stats(log: DataFrame, top: int = 5, least: int = 3) -> DataFrame:
    """Counts per status, accuracy, mean absolute move and the best symbols, in one long table."""
    done = F.col("outcome").isin("correct", "wrong")
    n = F.count_if(done)
    head = log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome").isNull()).alias("pending"), F.count_if(F.col("outcome") == "replaced").alias("replaced"),
        F.count_if(F.col("outcome") == "neutral").alias("neutral"), n.alias("completed"), F.count_if(F.col("outcome") == "correct").alias("correct"),
        F.coalesce(F.try_divide(F.count_if(F.col("outcome") == "correct") * 100.0, n), F.lit(0.0)).alias("correct_pct"), F.coalesce(F.avg(F.when(done, F.abs(F.col("move")))), F.lit(0.0)).alias("avg_move"))
    rows = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in head.columns])).alias("s")).select("s.*")
    best = (log.filter(done).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("outcome") == "correct") / F.count(F.lit(1)) * 100).alias("rate"))
            .filter(F.col("n") >= least).orderBy(F.desc("rate"), F.desc("n"), "symbol").limit(top))
    return rows.unionByName(best.select(F.concat(F.lit("top:"), "symbol").alias("item"), F.col("rate").alias("value")))


def news_sentiment(headlines: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(global, per ticker) sentiment; with ``cap`` a ticker counts only its first so many headlines in order ``seq``."""
    mood = [F.count_if(F.col("s") > 0.05).alias("bullish"), F.count_if(F.col("s") < -0.05).alias("bearish")]
    measures = [clip(F.avg("s"), -1.0, 1.0).alias("score"), F.count(F.lit(1)).alias("volume"), *mood]
    g = headlines.select(F.col("sentiment").alias("s")).agg(*measures)
    long = headlines.select(F.explode("tickers").alias("ticker"), "seq", "sentiment")
    if cap is not None:
        # the filter on the rank runs before the shuffle too: at most ``cap`` rows of a ticker leave a task
        long = long.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy("seq"))).filter(F.col("_r") <= cap)
    return g, long.select("ticker", F.col("sentiment").alias("s")).groupBy("ticker").agg(*measures)


def first_headlines(headlines: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` headlines in order ``seq``."""
    return headlines.orderBy("seq").limit(n)


def fills(orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filled quantity, volume-weighted price and progress of each plan."""
    done = F.col("status") == "FILLED"
    q = F.sum(F.when(done, F.col("qty")))
    return orders.groupBy(*keys).agg(
        F.coalesce(q, F.lit(0.0)).alias("filled_qty"), F.try_divide(F.sum(F.when(done, F.col("qty") * F.col("price"))), q).alias("avg_fill_price"),
        F.count_if(done).alias("filled"), (F.count_if(done) / F.count(F.lit(1)) * 100).alias("progress_pct"))


def evicted(log: DataFrame, memory: int, neutral: int) -> DataFrame:
    """What a memory of ``memory`` rows keeps of a log (id, ts, cls): everything completed, the newest ``neutral``
    neutral rows, and the newest pending rows in the room that is left."""
    n = log.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    held = n.agg(F.coalesce(F.sum(F.when(F.col("cls") == "completed", F.col("n"))), F.lit(0)).alias("done"),
                 F.least(F.coalesce(F.sum(F.when(F.col("cls") == "neutral", F.col("n"))), F.lit(0)), F.lit(neutral)).alias("neutral")).first()
    newest = [F.desc("ts"), F.desc("id")]
    keep = log.filter(F.col("cls") == "completed")
    for cls, room in (("neutral", neutral), ("pending", max(0, memory - held["done"] - held["neutral"]))):
        keep = keep.unionByName(log.filter(F.col("cls") == cls).orderBy(*newest).limit(room))
    return keep
