"""Episodes: what happens after a breakout, bar by bar and in total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.functions.scores import WAVE_PARTS, top_score, wave_score
from barloom.operators.labels import forward_bars
from barloom.operators.series import Frames, carry_last, over_chunks

EP = ["symbol", "start_bar"]
# columns of the bar context an episode reads
CONTEXT = ["open", "high", "low", "close", "volume_ratio", "quote_slope", "taker_slope", "vpin_slope", "trend",
           "win_prob", "participation", "exhaustion", "close_pos", "upper_wick", "t"]


def bar_context(bars: DataFrame, trend: Column | None = None, win_prob: Column | None = None) -> DataFrame:
    """Per-bar flow context in one chunk pass.

    ``trend`` and ``win_prob`` come from the multi-timeframe and barrier models where those
    are joined in; by default the signed straight-line fit and the taker flow serve.
    """

    def build(x: DataFrame, f: Frames) -> DataFrame:
        c = R.candle()
        x = x.select("*", R.volume_ratio(f).alias("volume_ratio"),
                     F.log1p(F.greatest(F.col("close") * F.col("volume"), F.lit(0.0))).alias("_lq"),
                     R.taker_imbalance(f).alias("taker"), R.vpin_taker(f).alias("vpin"),
                     c["close_pos"].alias("close_pos"), c["upper_wick"].alias("upper_wick"),
                     (F.coalesce(R.signed_r2("close", f), F.lit(0.0)) if trend is None else trend).alias("trend"),
                     (R.flow_proxy(f) / 100.0 if win_prob is None else win_prob).alias("win_prob"))
        x = x.select("*", R.rolling_slope("_lq", f).alias("quote_slope"), R.rolling_slope("taker", f).alias("taker_slope"),
                     R.rolling_slope("vpin", f).alias("vpin_slope"))
        return x.select(
            "symbol", "bar_idx", "_chunk", "volume", *CONTEXT[:10],
            R.participation_score(F.col("volume_ratio"), F.col("quote_slope"), F.col("taker"), F.lit(0.0), F.col("taker")).alias("participation"),
            R.exhaustion_score(F.col("vpin"), F.col("vpin_slope"), F.col("taker_slope"), F.col("upper_wick"), F.col("close_pos")).alias("exhaustion"),
            "close_pos", "upper_wick", "t", "taker", "vpin")

    return over_chunks(bars, build, back=25)


def wave_strength(drawdown: Column, scale: float, g=F.col) -> Column:
    return wave_score({p: g(p) for p in WAVE_PARTS}, drawdown / max(scale, 1e-12), R.clip01)


def top_risk(runup: Column, drawdown: Column, scale: float, vol_decay: Column, quote_decay: Column,
             since_peak: Column, g=F.col) -> Column:
    return top_score(runup, drawdown / max(scale, 1e-12), -vol_decay, -quote_decay, g("exhaustion"), since_peak, R.clip01)


def episode_path(starts: DataFrame, ctx: DataFrame, horizon: int, material: float = 1.0) -> DataFrame:
    """One row per episode bar, from the entry bar (off 0) to ``horizon`` bars later.

    ``starts`` needs symbol, start_bar, close (entry price) and atr. Every window below lies
    inside one episode, which has horizon + 1 rows at most.
    """
    p = forward_bars(starts.withColumnRenamed("close", "entry"), ctx, horizon, CONTEXT, first=0, at="start_bar")
    w = Window.partitionBy(*EP).orderBy("off")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    atr0 = F.greatest(F.col("atr"), F.lit(1e-12))
    p = p.select("*", F.max("f_high").over(sofar).alias("peak"),
                 F.max("f_high").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_peak_before"))
    new_high = F.col("_peak_before").isNull() | (F.col("f_high") > F.col("_peak_before"))
    at_top = F.col("f_high") >= F.greatest("peak", "entry")
    p = p.select(
        "*",
        F.last(F.when(new_high, F.col("off")), ignorenulls=True).over(sofar).alias("peak_off"),
        F.last(F.when(new_high, F.struct("f_volume_ratio", "f_quote_slope")), ignorenulls=True).over(sofar).alias("_top"),
        F.coalesce(F.last(F.when(at_top, F.col("off")), ignorenulls=True).over(sofar), F.lit(0)).alias("_last_top"))
    zero = F.lit(0.0)
    p = p.select(
        *[c for c in p.columns if c not in ("_peak_before", "_top")],
        F.greatest(zero, (F.col("peak") - F.col("entry")) / atr0).alias("runup_atr"),
        F.greatest(zero, (F.col("peak") - F.col("f_low")) / atr0).alias("drawdown_peak_atr"),
        F.greatest(zero, (F.col("entry") - F.col("f_low")) / atr0).alias("drawdown_entry_atr"),
        F.greatest(zero, (F.col("peak") - F.col("f_close")) / atr0).alias("drawdown_atr"),
        ((F.col("f_close") - F.col("entry")) / atr0).alias("close_delta_atr"),
        (F.col("off") - F.col("peak_off")).alias("bars_since_peak"),
        (F.col("f_volume_ratio") - F.col("_top.f_volume_ratio")).alias("volume_decay"),
        (F.col("f_quote_slope") - F.col("_top.f_quote_slope")).alias("quote_decay"))

    def g(name: str) -> Column:
        return F.col(f"f_{name}")

    return p.select(
        "*", wave_strength(F.col("drawdown_atr"), material, g).alias("wave_strength"),
        top_risk(F.col("runup_atr"), F.col("drawdown_atr"), material, F.col("volume_decay"), F.col("quote_decay"),
                 F.col("bars_since_peak"), g).alias("top_risk"))


def episode_summary(path: DataFrame, material: float = 1.0) -> DataFrame:
    """One row per episode; everything is an aggregate over the path, so no second sort."""
    last = F.max_by(F.struct("wave_strength", "top_risk", "volume_decay", "f_t"), "off")
    return path.groupBy(*EP).agg(
        F.max("off").alias("bars"),
        F.max("runup_atr").alias("max_runup_atr"),
        F.max("drawdown_atr").alias("max_drawdown_atr"),
        F.max("drawdown_entry_atr").alias("max_mae_entry_atr"),
        F.max("drawdown_peak_atr").alias("max_mae_peak_atr"),
        # the first bar at which the greatest run-up stands
        F.min_by("off", F.struct((-F.col("runup_atr")).alias("r"), "off")).alias("time_to_peak"),
        F.min_by(F.col("off") - F.col("_last_top"), F.when(F.col("drawdown_atr") >= material, F.col("off"))).alias("time_to_material"),
        last.alias("_end"),
    ).select(*EP, "bars", "max_runup_atr", "max_drawdown_atr", "max_mae_entry_atr", "max_mae_peak_atr", "time_to_peak",
             "time_to_material", F.col("_end.volume_decay").alias("volume_decay_after_peak"),
             F.col("_end.wave_strength").alias("final_wave_strength"), F.col("_end.top_risk").alias("final_top_risk"))


def first_reach(series: str, threshold: float) -> Column:
    """Aggregate: first offset at which the series reaches the threshold, NULL if never."""
    return F.min(F.when(F.col(series) >= threshold, F.col("off"))).alias(f"bars_to_{series}_{threshold:g}")


def value_at(series: str, k: int) -> Column:
    """Aggregate: value of the series at offset k, NULL when the path is shorter."""
    return F.max(F.when(F.col("off") == k, F.col(series))).alias(f"{series}_at_{k}")


def outcome_rows(path: DataFrame) -> DataFrame:
    """Wide measures per episode: thresholds, snapshots, entry and peak context, flags."""
    head = F.max(F.when(F.col("off") <= 3, F.col("runup_atr")))
    half = F.max(F.when(F.col("off") <= 12, F.col("runup_atr")))
    ctx = ["volume_ratio", "quote_slope", "taker_slope", "participation", "exhaustion", "upper_wick", "close_pos"]
    at = F.struct((-F.col("runup_atr")).alias("r"), "off")
    rows = path.groupBy(*EP).agg(
        F.first("entry").alias("entry"), F.first("atr").alias("atr"), F.first("score").alias("score"), F.first("tier").alias("tier"),
        F.max("runup_atr").alias("max_runup_atr"), F.max("drawdown_entry_atr").alias("max_mae_entry_atr"),
        F.max("drawdown_peak_atr").alias("max_mae_peak_atr"), F.min_by("off", at).alias("time_to_peak"),
        F.min_by("off", F.struct((-F.col("drawdown_entry_atr")).alias("r"), "off")).alias("mae_entry_off"),
        *[first_reach("runup_atr", k) for k in (1.0, 3.0, 5.0)], *[first_reach("drawdown_entry_atr", k) for k in (1.0, 2.0)],
        *[value_at("close_delta_atr", k) for k in (6, 12, 24)], *[value_at("drawdown_peak_atr", k) for k in (1, 3, 12)],
        *[value_at("runup_atr", k) for k in (1, 3, 12)],
        *[F.max(F.when(F.col("off") == 0, F.col(f"f_{c}"))).alias(f"{c}_at_entry") for c in ctx],
        *[F.min_by(f"f_{c}", at).alias(f"{c}_at_peak") for c in ctx],
        F.max("f_upper_wick").alias("max_upper_wick"), F.max_by("volume_decay", "off").alias("volume_decay_to_exit"),
        F.min(F.when(F.col("off") == 0, F.col("f_t"))).alias("entry_t"),
        head.alias("_head"), half.alias("_half"))
    hour = F.timestamp_seconds("entry_t")
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        F.when(F.col("max_runup_atr") > 0, F.col("max_mae_entry_atr") / F.col("max_runup_atr")).alias("mae_to_mfe"),
        ((F.col("_head") >= 1.0) & F.coalesce(F.col("close_delta_atr_at_6") <= -0.5, F.lit(False))).cast("int").alias("reversed_6"),
        ((F.col("_half") >= 1.0) & F.coalesce(F.col("close_delta_atr_at_12") <= 0.0, F.lit(False))).cast("int").alias("round_trip_12"),
        F.hour(hour).alias("hour_utc"), F.weekday(hour).alias("dow_utc"))


def prior_gap(events: DataFrame, bucket: int = 4096) -> DataFrame:
    """Rows since the previous event of the series, in two levels."""
    marked = events.withColumn("_start", F.col("start_bar"))
    return (carry_last(marked, "_start", ["symbol"], ["start_bar"], F.floor(F.col("start_bar") / bucket), "_prev", inclusive=False)
            .withColumn("prior_gap", F.col("start_bar") - F.col("_prev")).drop("_prev", "_start"))


# -- buckets ------------------------------------------------------------------------------------

def outcome_bucket(runup: Column) -> Column:
    return (F.when(runup < 0, "<0").when(runup < 1, "0-1").when(runup < 3, "1-3").when(runup < 5, "3-5")
            .when(runup < 10, "5-10").otherwise(">=10"))


def score_band(score: Column) -> Column:
    return (F.when(score >= 99, "99+").when(score >= 95, "95-99").when(score >= 90, "90-95")
            .when(score >= 80, "80-90").otherwise("<80"))


def gap_bucket(gap: Column, limit: int = 48) -> Column:
    return F.when(gap <= limit, "chain").otherwise("solo")


def regime_bucket(value: Column) -> Column:
    return (F.when(value.isNull() | F.isnan(value), "na").when(value >= 0.75, "bull").when(value >= 0.50, "range-up")
            .when(value >= 0.25, "range-down").otherwise("bear"))


def nearest_choice(value: Column, choices: Sequence[float]) -> Column:
    """Grid point nearest to the value; the smaller one wins a tie, the first one stands for no value."""
    grid = F.array(*[F.lit(float(c)) for c in choices])
    best = F.array_min(F.transform(grid, lambda c: F.struct(F.abs(c - value).alias("d"), c.alias("c"))))["c"]
    return F.when(value.isNull() | F.isnan(value), float(choices[0])).otherwise(best)


# -- detectors that live inside an episode ---------------------------------------------------------

def active_rows(path: DataFrame) -> DataFrame:
    """Where episodes overlap, a bar belongs to the one that started last."""
    bar = F.col("start_bar") + F.col("off")
    return (path.withColumn("bar_idx", bar).groupBy("symbol", "bar_idx")
            .agg(F.max_by(F.struct(*[c for c in path.columns if c != "symbol"]), "start_bar").alias("_a"))
            .select("symbol", "bar_idx", "_a.*"))


def active_context(bars: DataFrame, contexts: DataFrame, expiry: int) -> DataFrame:
    """Each bar with the latest context that started before it and has not expired."""
    hit = forward_bars(contexts, bars, expiry, ["close"], first=1, at="start_bar")
    return (hit.groupBy("symbol", (F.col("start_bar") + F.col("off")).alias("bar_idx"))
            .agg(F.max_by(F.struct(*[c for c in contexts.columns if c != "symbol"]), "start_bar").alias("_c"))
            .select("symbol", "bar_idx", "_c.*"))


def _inside(contexts: DataFrame, bars: DataFrame, expiry: int) -> DataFrame:
    """Episode bars with the bar before, the next bar and running extremes, active episode only."""
    cols = ["open", "high", "low", "close", "volume", "vol_avg20", "bar_atr", "c1", "c2", "o1", "h1", "nc", "nl", "no", "low1", "low2"]
    p = forward_bars(contexts.withColumnRenamed("close", "entry"), bars, expiry, cols, first=0, at="start_bar")
    w = Window.partitionBy(*EP).orderBy("off")
    p = p.select("*", F.max("f_high").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("peak_before"),
                 F.max("f_high").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak_now"))
    return active_rows(p.filter(F.col("off") >= 1))


def neighbour_bars(bars: DataFrame) -> DataFrame:
    """Bars with what the in-episode detectors need from neighbours, one chunk pass. Needs atr (Wilder)."""

    def build(x: DataFrame, f: Frames) -> DataFrame:
        return x.select(
            "*", R.prior_mean("volume", 20, f).alias("vol_avg20"), F.col("atr").alias("bar_atr"),
            f.lag("close").alias("c1"), f.lag("close", 2).alias("c2"), f.lag("open").alias("o1"), f.lag("high").alias("h1"),
            f.lag("low").alias("low1"), f.lag("low", 2).alias("low2"),
            f.lead("close").alias("nc"), f.lead("low").alias("nl"), f.lead("open").alias("no"))

    return over_chunks(bars, build, back=20, ahead=1)


# Gates of the re-acceleration detector.
REACCEL = {"min_score": 60.0, "allow_c": False, "wait": 2, "runup": 0.8, "pull_min": 0.20, "pull_max": 1.10, "floor": 0.20,
           "reclaim": 0.05, "extension": 0.30, "gap_max": 0.75, "chase_floor": 0.02, "chase_vol": 1.50, "chase_move": 0.40,
           "wick": 0.25, "close_pos": 0.65, "quote": 20000.0, "move": 0.25, "body_eff": 0.50, "vol": 1.20, "cooldown": 4}
TOP_WARNING = {"runup": 1.0, "wick": 0.25, "close_pos": 0.40, "drop": 0.25}


def reaccelerations(contexts: DataFrame, bars: DataFrame, expiry: int = 24, p: dict = REACCEL) -> DataFrame:
    """First bar of each episode that resumes the move after a shallow pull-back.

    Contexts must lie more than ``wait`` + ``cooldown`` bars apart. Then only the signal of
    the episode before can block, and only the earliest bar of this one.
    """
    x = _inside(contexts, bars, expiry)
    atr = F.greatest(F.col("atr"), F.lit(1e-12))
    low2 = F.when(F.col("off") >= 3, F.least("f_low1", "f_low2")).otherwise(F.col("f_low1"))
    body, span = F.col("f_close") - F.col("f_open"), F.col("f_high") - F.col("f_low")
    x = x.select(
        "*", ((F.col("peak_before") - F.col("entry")) / atr).alias("runup"), low2.alias("recent_low"),
        ((F.col("peak_before") - low2) / atr).alias("pullback"), F.try_divide(body, span).alias("eff"),
        F.try_divide(F.col("f_high") - F.col("f_close"), span).alias("wick"), F.try_divide(F.col("f_close") - F.col("f_low"), span).alias("cpos"),
        ((F.col("f_close") / F.greatest(F.col("f_c1"), F.lit(1e-12)) - 1.0) * 100.0).alias("move"),
        (F.col("f_volume") / F.greatest(F.col("f_vol_avg20"), F.lit(1e-12))).alias("vol"),
        ((F.col("f_close") - F.greatest("f_c1", "f_o1")) / atr).alias("reclaim"),
        F.greatest(F.lit(0.0), (F.col("f_close") - F.col("peak_before")) / atr).alias("extension"),
        F.greatest(F.lit(0.0), (F.col("peak_before") - F.col("f_close")) / atr).alias("peak_gap"))
    chase = (F.col("peak_gap") <= p["chase_floor"]) & ((F.col("vol") > p["chase_vol"]) | (F.col("move") > p["chase_move"]))
    ok = ((F.col("bar_idx") >= 21) & (F.col("f_bar_atr") > 0) & (F.col("f_vol_avg20") > 0) & (F.col("off") > p["wait"])
          & (F.col("score") >= p["min_score"]) & (F.lit(p["allow_c"]) | (F.col("tier") != "C")) & (F.col("runup") >= p["runup"])
          & F.col("pullback").between(p["pull_min"], p["pull_max"]) & (F.col("recent_low") >= F.col("entry") + p["floor"] * F.col("atr"))
          & (F.col("f_c1") < F.col("f_h1")) & (F.col("f_c1") <= F.col("f_c2")) & (body > 0) & (span > 0)
          & (F.col("move") >= p["move"]) & (F.col("eff") >= p["body_eff"]) & (F.col("vol") >= p["vol"])
          & (F.col("f_close") * F.col("f_vol_avg20") >= p["quote"]) & (F.col("reclaim") >= p["reclaim"])
          & (F.col("extension") <= p["extension"]) & (F.col("peak_gap") <= p["gap_max"]) & (F.col("wick") <= p["wick"])
          & (F.col("cpos") >= p["close_pos"]) & (F.col("f_close") >= F.col("entry")) & (F.col("f_high") >= F.col("f_h1")) & ~chase)
    score = 100.0 * (
        0.25 * R.clip01((F.col("score") - p["min_score"]) / 20.0)
        + 0.25 * R.clip01((F.col("reclaim") - p["reclaim"]) / max(0.25, p["gap_max"] - p["reclaim"]))
        + 0.20 * R.clip01((F.col("pullback") - p["pull_min"]) / max(p["pull_max"] - p["pull_min"], 1e-6))
        + 0.15 * R.clip01((F.col("vol") - p["vol"]) / 1.5) + 0.15 * (1.0 - R.clip01(F.col("peak_gap") / max(p["gap_max"], 1e-6))))
    cand = x.filter(ok).select(*EP, "bar_idx", "runup", "pullback", "reclaim", "peak_gap", F.round(score, 2).alias("signal_score"))
    row = F.struct("bar_idx", "runup", "pullback", "reclaim", "peak_gap", "signal_score")
    firsts = cand.groupBy(*EP).agg(
        F.min(row).alias("one"), F.min(F.when(F.col("bar_idx") > F.col("start_bar") + p["wait"] + 1, row)).alias("two"))
    firsts = firsts.withColumn("_hit", F.col("one.bar_idx"))
    chained = carry_last(firsts, "_hit", ["symbol"], ["start_bar"], F.floor(F.col("start_bar") / 4096), "_before", inclusive=False)
    blocked = F.coalesce(F.col("one.bar_idx") - F.col("_before") < p["cooldown"], F.lit(False))
    return chained.select(*EP, F.when(blocked, F.col("two")).otherwise(F.col("one")).alias("s")).filter(
        F.col("s").isNotNull()).select(*EP, "s.*")


def top_warnings(contexts: DataFrame, bars: DataFrame, expiry: int = 24, p: dict = TOP_WARNING) -> DataFrame:
    """Bars of an episode that look like its top; ``confirmed`` when the next bar falls."""
    x = _inside(contexts, bars, expiry)
    span = F.col("f_high") - F.col("f_low")
    runup = (F.col("peak_now") - F.col("entry")) / F.greatest(F.col("atr"), F.lit(1e-12))
    wick = F.try_divide(F.col("f_high") - F.greatest("f_open", "f_close"), span)
    cpos = F.try_divide(F.col("f_close") - F.col("f_low"), span)
    drop = (F.col("f_close") / F.greatest(F.col("f_nc"), F.lit(1e-12)) - 1.0) * 100.0
    confirmed = (F.col("f_nc") < F.col("f_close")) & (F.col("f_nl") < F.col("f_low")) & (drop >= p["drop"])
    score = 100.0 * (0.45 * R.clip01(runup / (p["runup"] * 1.5)) + 0.30 * R.clip01(wick) + 0.25 * R.clip01(drop / (p["drop"] * 3.0)))
    x = x.select("*", runup.alias("runup"), wick.alias("wick"), cpos.alias("cpos"), confirmed.alias("confirmed"),
                 F.when(confirmed, F.round(score, 2)).alias("signal_score"))
    return x.filter(
        (F.col("bar_idx") >= 22) & F.col("f_nc").isNotNull() & (F.col("f_bar_atr") > 0) & (F.col("runup") >= p["runup"])
        & (F.col("f_high") >= F.col("peak_now") * 0.95) & ((F.col("f_close") < F.col("f_open")) | (F.col("f_close") < F.col("f_c1")))
        & (F.col("wick") >= p["wick"] * 0.5) & (F.col("cpos") <= p["close_pos"] * 1.5)
    ).select(*EP, "bar_idx", "entry", "atr", "score", "tier", "runup", "wick", "cpos", "confirmed", "signal_score",
             F.col("f_no").alias("next_open"), F.col("f_close").alias("close"))


def earliest_warning(warnings: DataFrame) -> DataFrame:
    """First warning of each episode with the open of the bar after it."""
    return warnings.groupBy(*EP).agg(F.min_by(F.struct("bar_idx", "runup", "next_open"), "bar_idx").alias("w")).select(
        *EP, F.col("w.bar_idx").alias("warning_bar"), F.col("w.runup").alias("warning_runup"), F.col("w.next_open").alias("warning_exit_price"))


# -- quality scores -----------------------------------------------------------------------------

def breakout_quality(base: Column, c: dict[str, Column]) -> Column:
    """Score of a breakout from its own score and the bar context (0..100)."""
    cont = R.clip01(0.5 * c["taker_persist"] + 0.3 * R.clip01((c["fit"] + 1.0) / 2.0) + 0.2 * R.clip01(c["range_rank"]))
    score = 100.0 * (0.30 * R.clip01(base / 100.0) + 0.24 * R.clip01(c["participation"] / 100.0)
                     + 0.16 * R.clip01((c["trend"] + 0.10) / 0.70) + 0.16 * R.clip01((c["win_prob"] - 0.35) / 0.35) + 0.14 * cont)
    return R.clip(score - 18.0 * R.clip01((-c["quote_slope"] + 0.02) / 0.10) - 12.0 * R.clip01((c["exhaustion"] - 55.0) / 45.0), 0.0, 100.0)


def warning_quality(risk: Column, runup: Column, wick: Column, close_pos: Column, exhaustion: Column) -> Column:
    return R.clip(100.0 * (0.38 * R.clip01(risk / 100.0) + 0.22 * R.clip01((wick - 0.25) / 0.50) + 0.16 * R.clip01((0.55 - close_pos) / 0.55)
                           + 0.14 * R.clip01((exhaustion - 40.0) / 60.0) + 0.10 * R.clip01((runup - 1.5) / 3.0)), 0.0, 100.0)


def confirmed_quality(warning: Column, risk: Column, drop_pct: Column, exhaustion: Column) -> Column:
    return R.clip(100.0 * (0.32 * R.clip01(warning / 100.0) + 0.30 * R.clip01(risk / 100.0) + 0.20 * R.clip01(drop_pct)
                           + 0.18 * R.clip01((exhaustion - 45.0) / 55.0)), 0.0, 100.0)


def reaccel_quality(base: Column, wave: Column, participation: Column, close_pos: Column, quote_slope: Column) -> Column:
    return R.clip(100.0 * (0.28 * R.clip01(base / 100.0) + 0.28 * R.clip01(wave / 100.0) + 0.18 * R.clip01(participation / 100.0)
                           + 0.14 * R.clip01((close_pos - 0.45) / 0.55) + 0.12 * R.clip01((quote_slope + 0.01) / 0.08)), 0.0, 100.0)


def refresh_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing outcome rows with newly computed measures: a new value wins where there is one."""
    fresh = [c for c in new.columns if c not in keys]
    j = old.join(new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fresh]), list(keys), "left")
    return j.select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) if c in fresh else F.col(c) for c in old.columns if c not in keys],
                    *[F.col(f"_n_{c}").alias(c) for c in fresh if c not in old.columns])
