"""Event detectors. A detector yields candidates; labels and min-gap thinning are separate steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators.labels import barrier_label
from barloom.operators.series import Frames, cusum, ema_chunk, ema_halo, over_chunks, thin, wilder

# Detector thresholds and barrier settings.
UP_BREAK = {"mult": 1.5, "floor": 0.003, "tp": 2.5, "sl": 1.0, "bars": 72}
DOWN_BREAK = {"mult": 1.5, "floor": 0.003, "tp": 2.5, "sl": 1.0, "bars": 72}
RANGE_TURN = {"mult": 0.015, "floor": 0.005, "buy": 0.2, "sell": 0.8, "tp": 1.5, "sl": 1.0, "bars": 48}
STEALTH = {"mult": 1.2, "floor": 0.003, "surge": 1.8, "tp": 2.0, "sl": 1.0, "bars": 60}
EXTREME = {"mult": 2.0, "floor": 0.004, "tp": 2.0, "sl": 1.2, "bars": 72}
BOUNCE = {"mult": 0.5, "floor": 0.005, "tp": 2.0, "sl": 1.0, "bars": 60}
MIN_GAP = 12
LOOKBACK = 50
BREAKOUT = {
    "body_eff": 0.55, "body_ratio": 1.8, "quiet_pct": 1.5, "vol": 1.5,
    "now_body_eff": 0.65, "now_body_ratio": 2.2, "now_vol": 2.0, "cont_vol": 1.2,
}
SCORE_WEIGHTS = {"body_ratio": 0.30, "vol_ratio": 0.25, "body_eff": 0.20, "quiet": 0.10, "confirm": 0.15}
TIERS = {"A": (84.0, 1.15, 0.0), "B": (78.0, 1.0, 0.30), "C": (72.0, 0.75, 0.35)}


def event_features(bars: DataFrame) -> DataFrame:
    """What the structural detectors look at, in one pass over chunks plus the CUSUM carry."""

    def build(x: DataFrame, f: Frames) -> DataFrame:
        hi, lo, _ = R.range_position(f, LOOKBACK)
        sup, res = R.support_resistance(f)
        x = x.withColumn("tr", R.true_range(f)).withColumn("ret", R.simple_return(f))
        return x.select(
            "symbol", "bar_idx", "_chunk", "open", "high", "low", "close", "volume", "ret",
            R.atr_sma(f).alias("atr"), hi.alias("range_high"), lo.alias("range_low"),
            F.when(f.full(50), F.avg("volume").over(f.last(50))).alias("vol_avg50"),
            sup.alias("support"), res.alias("resistance"),
        ).withColumn("atr_pct", F.col("atr") / (F.col("close") + R.EPS))

    return cusum(over_chunks(bars, build, back=97), F.col("ret"))


def _threshold(p: dict) -> Column:
    return F.greatest(p["mult"] * F.col("atr_pct"), F.lit(p["floor"]))


def up_break(p: dict = UP_BREAK) -> Column:
    """Direction of a candidate on this bar, else NULL: CUSUM beyond threshold and a new high."""
    return F.when((F.col("cusum_pos") > _threshold(p)) & (F.col("high") >= F.col("range_high")), 1)


def down_break(p: dict = DOWN_BREAK) -> Column:
    return F.when(F.col("cusum_neg") < -_threshold(p), -1)


def range_turn(p: dict = RANGE_TURN) -> Column:
    """Tight range with the close near one of its ends."""
    span = F.col("range_high") - F.col("range_low")
    tight = (span / (F.col("close") + R.EPS) < _threshold(p)) & (span >= R.EPS)
    where = F.try_divide(F.col("close") - F.col("range_low"), span)
    return F.when(tight & (where < p["buy"]), 1).when(tight & (where > p["sell"]), -1)


def stealth_volume(side: int, p: dict = STEALTH) -> Column:
    """Pressure and a volume surge without a new extreme; the two sides are separate detectors."""
    surge = (F.col("vol_avg50") > 0) & (F.col("volume") > p["surge"] * F.col("vol_avg50"))
    if side == 1:
        hit = (F.col("cusum_pos") > _threshold(p)) & ~(F.col("close") > F.col("range_high"))
    else:
        hit = (F.col("cusum_neg") < -_threshold(p)) & ~(F.col("close") < F.col("range_low"))
    return F.when(hit & surge, side)


def extreme_turn(side: int, p: dict = EXTREME) -> Column:
    """Bet against an exhausted move."""
    hit = F.col("cusum_neg") < -_threshold(p) if side == 1 else F.col("cusum_pos") > _threshold(p)
    return F.when(hit, side)


def level_bounce(p: dict = BOUNCE) -> Column:
    """Close within tolerance of support (long) or else of resistance (short)."""
    def near(level: str) -> Column:
        return F.abs(F.col("close") - F.col(level)) / (F.col(level) + R.EPS) < _threshold(p)
    return F.when(near("support"), 1).when(near("resistance"), -1)


def detect(features: DataFrame, bars: DataFrame, direction: Column, p: dict, warmup: int = LOOKBACK,
           gap: int = MIN_GAP) -> DataFrame:
    """Candidates, their barrier labels, then thinning: only labelled events start a cool-down."""
    found = (features.withColumn("direction", direction)
             .filter((F.col("bar_idx") >= warmup) & F.col("direction").isNotNull())
             .select("symbol", "bar_idx", "direction", "close", "atr"))
    return thin(barrier_label(found, bars, p["tp"], p["sl"], p["bars"]), gap)


# -- tiered breakout --------------------------------------------------------------------------

def breakout_setup(f: Frames, p: dict, lookback: int = 20) -> Column:
    """Setup measures of this bar as a struct, NULL when the bar is no setup.

    Needs vol_avg20 and prior_body columns. The quiet filter rejects at equality.
    """
    body = F.col("close") - F.col("open")
    eff = F.try_divide(body, F.col("high") - F.col("low"))
    ratio = F.try_divide(body, F.col("prior_body"))
    quiet = F.try_divide(F.col("prior_body"), F.greatest(F.col("open"), F.lit(1e-12))) * 100.0
    vol = F.try_divide(F.col("volume"), F.col("vol_avg20"))
    ok = ((F.col(f.idx) >= lookback) & (body > 0) & (body / F.greatest(F.col("open"), F.lit(1e-12)) >= 0.01)
          & (F.col("prior_body") > 0) & (F.col("vol_avg20") > 0) & (eff >= p["body_eff"])
          & (ratio >= p["body_ratio"]) & (quiet < p["quiet_pct"]) & (vol >= p["vol"]))
    now = (eff >= p["now_body_eff"]) & (ratio >= p["now_body_ratio"]) & (vol >= p["now_vol"])
    return F.when(ok, F.struct(
        F.col("close").alias("close"), F.col("high").alias("high"), (0.5 * (F.col("open") + F.col("close"))).alias("mid"),
        ratio.alias("body_ratio"), eff.alias("body_eff"), quiet.alias("quiet_pct"), vol.alias("vol_ratio"), now.alias("now")))


def confirm_strength(setup: Column) -> Column:
    """How firmly the entry bar holds, pushes and breaks the setup (0..1)."""
    hold_span = F.greatest(setup["close"] - setup["mid"], F.lit(1e-12))
    break_span = F.greatest(setup["high"] - setup["mid"], F.lit(1e-12))
    return (R.clip01((F.col("low") - setup["mid"]) / hold_span) + R.clip01((F.col("close") - setup["close"]) / hold_span)
            + R.clip01((F.col("high") - setup["high"]) / break_span)) / 3.0


def breakout_score(setup: Column, confirm: Column, p: dict) -> Column:
    """0..100 from the setup's measures and its confirmation, 2 decimals."""
    w = SCORE_WEIGHTS
    ratio = R.clip01((setup["body_ratio"] - p["body_ratio"]) / max(4.0, p["now_body_ratio"] - p["body_ratio"]))
    vol = R.clip01((setup["vol_ratio"] - p["vol"]) / max(2.0, p["now_vol"] - p["vol"] + 1.5))
    eff = R.clip01((setup["body_eff"] - p["body_eff"]) / max(0.20, p["now_body_eff"] - p["body_eff"] + 0.05))
    quiet = R.clip01((p["quiet_pct"] - setup["quiet_pct"]) / max(p["quiet_pct"], 1e-12))
    return F.round(100.0 * (w["body_ratio"] * ratio + w["vol_ratio"] * vol + w["body_eff"] * eff
                            + w["quiet"] * quiet + w["confirm"] * R.clip01(confirm)), 2)


def tier_value(tier: Column, slot: int) -> Column:
    """Confidence (0), size multiple (1) or probability floor (2) of a tier."""
    return F.when(tier == "A", TIERS["A"][slot]).when(tier == "B", TIERS["B"][slot]).otherwise(TIERS["C"][slot])


def breakout_candidates(bars: DataFrame, p: dict = BREAKOUT, lookback: int = 20) -> DataFrame:
    """Bars that enter on a setup: at once (A), confirmed one bar later (B) or continued after two (C).

    The ATR is Wilder's. One chunk pass; the first matching tier wins.
    """
    halo = ema_halo(1 / 14) + lookback + 18

    def build(x: DataFrame, f: Frames) -> DataFrame:
        x = (x.withColumn("tr", R.true_range(f)).withColumn("prior_body", R.prior_body(f, lookback))
             .withColumn("vol_avg20", R.prior_mean("volume", 20, f)))
        x = x.withColumn("atr", F.coalesce(wilder(F.col("tr"), 14, f), F.lit(0.0))).withColumn("s0", breakout_setup(f, p, lookback))
        x = x.withColumn("s1", f.lag("s0")).withColumn("s2", f.lag("s0", 2)).withColumn("low1", f.lag("low"))
        s0, s1, s2 = F.col("s0"), F.col("s1"), F.col("s2")
        b = s1.isNotNull() & (F.col("low") >= s1["mid"]) & (F.col("close") >= s1["close"]) & (F.col("high") >= s1["high"])
        c = (s2.isNotNull() & (F.col("low1") >= s2["mid"]) & (F.col("close") >= s2["close"]) & (F.col("high") >= s2["high"])
             & (F.try_divide(F.col("volume"), F.col("vol_avg20")) >= p["cont_vol"]))
        tier = F.when((F.col("bar_idx") > lookback) & F.coalesce(s0["now"], F.lit(False)), "A").when(b, "B").when(c, "C")
        hold = R.clip01((F.col("low1") - s2["mid"]) / F.greatest(s2["close"] - s2["mid"], F.lit(1e-12)))
        x = x.withColumn("tier", tier).withColumn(
            "setup", F.when(tier == "A", s0).when(tier == "B", s1).when(tier == "C", s2))
        confirm = (F.when(tier == "A", 1.0).when(tier == "B", confirm_strength(s1))
                   .when(tier == "C", 0.5 * hold + 0.5 * confirm_strength(s2)))
        return x.withColumn("score", breakout_score(F.col("setup"), confirm, p))

    found = over_chunks(bars, build, back=halo, chunk=ema_chunk(halo, 1 / 14)).filter(
        (F.col("bar_idx") > lookback) & F.col("tier").isNotNull())
    return found.select("symbol", "bar_idx", "t", "tier", "score", "close", "atr", F.lit(1).alias("direction"),
                        F.col("setup.body_ratio").alias("body_ratio"), F.col("setup.vol_ratio").alias("vol_ratio"),
                        F.col("setup.body_eff").alias("body_eff"), F.col("setup.quiet_pct").alias("quiet_pct"),
                        tier_value(F.col("tier"), 0).alias("confidence"), tier_value(F.col("tier"), 1).alias("size_mult"),
                        tier_value(F.col("tier"), 2).alias("prob_floor"))


def breakouts(bars: DataFrame, p: dict = BREAKOUT, lookback: int = 20) -> DataFrame:
    """Candidates with at least lookback+1 bars between accepted ones (label-free cool-down)."""
    return thin(breakout_candidates(bars, p, lookback), max(lookback + 1, 6))


def band_break(bars: DataFrame, vol_mult: float = 2.5, horizon: int = 12, hard_negative: float = 10.0) -> DataFrame:
    """Close above the sample-deviation band on heavy volume; a break that does not hold weighs more."""

    def build(x: DataFrame, f: Frames) -> DataFrame:
        up, _, _ = R.bollinger_samp("close", 20, 2.0, f)
        x = x.withColumn("upper", up).withColumn("anomaly", R.volume_anomaly(f))
        held = sum((f.lead("close", k) > F.col("upper")).cast("int") for k in (1, 2, 3)) == 3
        wick = F.coalesce(F.try_divide(F.col("high") - F.greatest("open", "close"), F.col("high") - F.col("low")), F.lit(0.0))
        return (x.withColumn("far", f.lead("close", horizon)).withColumn("real", held & (wick < 0.3))
                .filter((F.col("close") > F.col("upper")) & (F.col("anomaly") > vol_mult) & F.col("far").isNotNull())
                .select("symbol", "bar_idx", "_chunk", "close", "upper", "anomaly",
                        F.col("real").cast("int").alias("label"), F.when(F.col("real"), 1.0).otherwise(hard_negative).alias("weight")))

    return over_chunks(bars, build, back=50, ahead=horizon)
