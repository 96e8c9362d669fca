"""Episodes after breakouts: paths, summaries, in-episode detectors, interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import episodes as P
from barloom.operators import joins as J
from barloom.operators.series import ema_chunk, ema_halo, over_chunks, wilder
from barloom.functions import rolling as R
from barloom.plans.events import SIGNALS_SQL, signals
from barloom.plans.inputs import BARS_SQL, bars, bars_table, rnd
from barloom.plans.registry import query
from barloom.plans.windows import W, last, prior

H = 36


def c01(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


CTX_SQL = f"""cx0 AS (SELECT *, CASE WHEN bar_idx >= 20 AND avg(volume) OVER {prior(20)} > 0 THEN volume / avg(volume) OVER {prior(20)} ELSE 1.0 END AS volume_ratio,
   ln(1 + greatest(close * volume, 0)) AS lq, sum(taker_buy_base) OVER {last(10)} AS b10, sum(volume) OVER {last(10)} AS v10,
   sum(taker_buy_base) OVER {last(14)} AS b14, sum(volume) OVER {last(14)} AS v14, sum(taker_buy_base) OVER {last(21)} AS b21, sum(volume) OVER {last(21)} AS v21,
   greatest(high - low, 1e-12) AS span, covar_pop(bar_idx, close) OVER {last(10)} AS cov, var_pop(bar_idx) OVER {last(10)} AS vx, var_pop(close) OVER {last(10)} AS vy FROM bars),
cx1 AS (SELECT *, (2 * b10 - v10) / (v10 + 1e-8) AS taker, CASE WHEN bar_idx >= 13 AND v14 > 0 THEN abs(2 * b14 - v14) / v14 ELSE 0.5 END AS vpin,
   CASE WHEN bar_idx >= 4 THEN regr_slope(lq, bar_idx) OVER {last(5)} ELSE 0 END AS quote_slope, (close - low) / span AS close_pos, (high - greatest(open, close)) / span AS upper_wick,
   CASE WHEN bar_idx >= 9 THEN least(coalesce(cov * cov / nullif(vx * vy, 0), 0), 1) * CASE WHEN cov >= 0 THEN 1 ELSE -1 END ELSE 0 END AS trend,
   CASE WHEN bar_idx >= 4 AND v21 >= 1e-8 THEN {c01('((2 * b21 - v21) / v21 + 1) / 2')} ELSE 0.5 END AS win_prob FROM cx0),
cx2 AS (SELECT *, CASE WHEN bar_idx >= 4 THEN regr_slope(taker, bar_idx) OVER {last(5)} ELSE 0 END AS taker_slope,
   CASE WHEN bar_idx >= 4 THEN regr_slope(vpin, bar_idx) OVER {last(5)} ELSE 0 END AS vpin_slope FROM cx1),
cx AS MATERIALIZED (SELECT *, 100 * (0.35 * {c01('(volume_ratio - 1) / 1.5')} + 0.20 * {c01('(quote_slope + 0.02) / 0.12')} + 0.20 * {c01('(taker + 0.10) / 0.50')} + 0.15 * {c01('(taker + 0.2) / 0.8')}) AS participation,
   100 * (0.30 * {c01('(vpin - 0.5) / 0.3')} + 0.20 * {c01('(vpin_slope + 0.01) / 0.08')} + 0.20 * {c01('(-taker_slope + 0.01) / 0.10')} + 0.15 * {c01('(upper_wick - 0.20) / 0.45')} + 0.15 * {c01('(0.55 - close_pos) / 0.55')}) AS exhaustion FROM cx2)"""


def sql_path(src: str, name: str, horizon: int, back: int = 0) -> str:
    """Episode path of rows (symbol, start_bar, entry, atr, ...) in ``src``."""
    wp = "PARTITION BY symbol, start_bar ORDER BY off"
    return f"""{name}0 AS (SELECT s.*, b.bar_idx - s.start_bar AS off, b.open AS o, b.high AS h, b.low AS l, b.close AS c, b.volume_ratio AS vr, b.quote_slope AS qs, b.taker_slope AS ts, b.trend AS tr,
    b.win_prob AS wp, b.participation AS pa, b.exhaustion AS ex, b.close_pos AS cp, b.upper_wick AS uw, b.t AS bt FROM {src} s JOIN cx b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.start_bar AND s.start_bar + {horizon}),
{name}1 AS (SELECT *, max(h) OVER ({wp}) AS peak, max(h) OVER ({wp} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pbefore FROM {name}0),
{name}2 AS (SELECT *, last_value(CASE WHEN pbefore IS NULL OR h > pbefore THEN off END IGNORE NULLS) OVER ({wp}) AS peak_off,
    last_value(CASE WHEN pbefore IS NULL OR h > pbefore THEN vr END IGNORE NULLS) OVER ({wp}) AS pvr, last_value(CASE WHEN pbefore IS NULL OR h > pbefore THEN qs END IGNORE NULLS) OVER ({wp}) AS pqs,
    coalesce(last_value(CASE WHEN h >= greatest(peak, entry) THEN off END IGNORE NULLS) OVER ({wp}), 0) AS ltop FROM {name}1),
{name}3 AS (SELECT *, greatest(0, (peak - entry) / greatest(atr, 1e-12)) AS runup_atr, greatest(0, (peak - l) / greatest(atr, 1e-12)) AS drawdown_peak_atr, greatest(0, (entry - l) / greatest(atr, 1e-12)) AS drawdown_entry_atr,
    greatest(0, (peak - c) / greatest(atr, 1e-12)) AS drawdown_atr, (c - entry) / greatest(atr, 1e-12) AS close_delta_atr, off - peak_off AS bars_since_peak, vr - pvr AS volume_decay, qs - pqs AS quote_decay FROM {name}2),
{name} AS MATERIALIZED (SELECT *, 100 * (0.28 * {c01('(pa - 45) / 45')} + 0.22 * {c01('(ts + 0.02) / 0.10')} + 0.18 * {c01('(wp - 0.35) / 0.35')} + 0.18 * {c01('(tr + 0.15) / 0.60')} + 0.14 * (1 - {c01('drawdown_atr')})) AS wave_strength,
    100 * (0.22 * {c01('(runup_atr - 1.5) / 3')} + 0.20 * {c01('drawdown_atr')} + 0.18 * {c01('-volume_decay')} + 0.14 * {c01('-quote_decay / 0.10')} + 0.14 * {c01('(ex - 45) / 55')} + 0.12 * {c01('bars_since_peak / 6.0')}) AS top_risk FROM {name}3)"""


STARTS_SQL = f"{SIGNALS_SQL}, {CTX_SQL}, st AS MATERIALIZED (SELECT symbol, bar_idx AS start_bar, close AS entry, atr, score, tier, t FROM sig)"
PATH_SQL = f"{STARTS_SQL}, {sql_path('st', 'pth', H)}"


def starts(spark, d, b):
    return signals(spark, d, b).select("symbol", F.col("bar_idx").alias("start_bar"), "close", "atr", "score", "tier")


def path(spark, d, horizon=H):
    b = bars_table(spark, d)
    return P.episode_path(starts(spark, d, b), P.bar_context(b), horizon)


@query("episode_ledger", "W29 E18", f"""WITH RECURSIVE {PATH_SQL}
SELECT symbol, start_bar, off, bars_since_peak, round((c / greatest(entry, 1e-12) - 1) * 100, 4) AS return_pct, round(runup_atr, 6) AS runup_atr, round(drawdown_atr, 6) AS drawdown_atr,
  round(volume_decay, 6) AS volume_decay, round(wave_strength, 4) AS wave_strength, round(top_risk, 4) AS top_risk FROM pth""")
def _(spark, d):
    return path(spark, d).select(
        *P.EP, "off", "bars_since_peak", rnd((F.col("f_close") / F.greatest(F.col("entry"), F.lit(1e-12)) - 1) * 100, 4).alias("return_pct"),
        rnd("runup_atr").alias("runup_atr"), rnd("drawdown_atr").alias("drawdown_atr"), rnd("volume_decay").alias("volume_decay"),
        rnd("wave_strength", 4).alias("wave_strength"), rnd("top_risk", 4).alias("top_risk"))


@query("episode_summary", "E18", f"""WITH RECURSIVE {PATH_SQL},
g AS (SELECT symbol, start_bar, max(off) AS bars, max(runup_atr) AS mr, max(drawdown_atr) AS md, max(drawdown_entry_atr) AS me, max(drawdown_peak_atr) AS mp,
   arg_max(volume_decay, off) AS vd, arg_max(wave_strength, off) AS ws, arg_max(top_risk, off) AS tk, arg_min(off - ltop, off) FILTER (WHERE drawdown_atr >= 1) AS tm FROM pth GROUP BY ALL),
k AS (SELECT pth.symbol, pth.start_bar, min(off) AS tp FROM pth JOIN g USING (symbol, start_bar) WHERE runup_atr = mr GROUP BY ALL)
SELECT symbol, start_bar, bars, round(mr, 6) AS max_runup_atr, round(md, 6) AS max_drawdown_atr, round(me, 6) AS max_mae_entry_atr, round(mp, 6) AS max_mae_peak_atr, tp AS time_to_peak,
   tm AS time_to_material, round(vd, 6) AS volume_decay_after_peak, round(ws, 4) AS final_wave_strength, round(tk, 4) AS final_top_risk FROM g JOIN k USING (symbol, start_bar)""")
def _(spark, d):
    s = P.episode_summary(path(spark, d))
    r = {c: 4 if c.startswith("final") else 6 for c in s.columns if c.startswith(("max_", "volume", "final"))}
    return s.select(*[rnd(c, r[c]).alias(c) if c in r else F.col(c) for c in s.columns])


@query("episode_state_before_entry", "W30", f"""WITH RECURSIVE {STARTS_SQL},
pre AS (SELECT st.symbol, greatest(0, st.start_bar - 6) AS start_bar, st.start_bar AS at_bar, b.close AS entry, coalesce(aw.y, 0) AS atr FROM st
   JOIN bars b ON b.symbol = st.symbol AND b.bar_idx = greatest(0, st.start_bar - 6) LEFT JOIN aw ON aw.symbol = b.symbol AND aw.bar_idx = b.bar_idx),
{sql_path('pre', 'pp', 6)}
SELECT symbol, at_bar, round(arg_max(runup_atr, off), 4) AS runup_atr, round(arg_max(drawdown_atr, off), 4) AS drawdown_atr, round(max(drawdown_peak_atr), 4) AS max_drawdown_atr,
   CAST(arg_max(bars_since_peak, off) AS BIGINT) AS bars_since_peak, round(arg_max(wave_strength, off), 4) AS wave_strength, round(arg_max(top_risk, off), 4) AS top_risk FROM pp GROUP BY symbol, at_bar""")
def _(spark, d):
    b = bars_table(spark, d)
    with_atr = wilder_bars(b)
    st = starts(spark, d, b)
    pre = (st.select("symbol", F.greatest(F.lit(0), F.col("start_bar") - 6).alias("bar_idx"), F.col("start_bar").alias("at_bar"))
           .join(with_atr.select("symbol", "bar_idx", "close", "atr"), ["symbol", "bar_idx"]).withColumnRenamed("bar_idx", "start_bar"))
    p = P.episode_path(pre, P.bar_context(b), 6)
    end = F.max_by(F.struct("runup_atr", "drawdown_atr", "bars_since_peak", "wave_strength", "top_risk"), "off")
    return p.groupBy("symbol", "at_bar").agg(end.alias("e"), rnd(F.max("drawdown_peak_atr"), 4).alias("max_drawdown_atr")).select(
        "symbol", "at_bar", "max_drawdown_atr", "e.bars_since_peak", *[rnd(f"e.{c}", 4).alias(c) for c in ("runup_atr", "drawdown_atr", "wave_strength", "top_risk")])


def wilder_bars(b):
    halo = ema_halo(1 / 14) + 16

    def build(x, f):
        x = x.withColumn("tr", R.true_range(f))
        return x.withColumn("atr", F.coalesce(wilder(F.col("tr"), 14, f), F.lit(0.0))).drop("tr")
    return over_chunks(b, build, back=halo, chunk=ema_chunk(halo, 1 / 14))


CTX = ["volume_ratio", "quote_slope", "taker_slope", "participation", "exhaustion", "upper_wick", "close_pos"]
SHORT = {"volume_ratio": "vr", "quote_slope": "qs", "taker_slope": "ts", "participation": "pa", "exhaustion": "ex", "upper_wick": "uw", "close_pos": "cp"}
OUT_SQL = f"""{PATH_SQL},
og AS (SELECT symbol, start_bar, first(entry) AS entry, first(atr) AS atr, first(score) AS score, first(tier) AS tier, max(runup_atr) AS max_runup_atr, max(drawdown_entry_atr) AS max_mae_entry_atr,
   max(drawdown_peak_atr) AS max_mae_peak_atr, {', '.join(f'min(off) FILTER (WHERE runup_atr >= {k}) AS bars_to_runup_atr_{k}' for k in (1, 3, 5))},
   {', '.join(f'min(off) FILTER (WHERE drawdown_entry_atr >= {k}) AS bars_to_drawdown_entry_atr_{k}' for k in (1, 2))},
   {', '.join(f'max(close_delta_atr) FILTER (WHERE off = {k}) AS close_delta_atr_at_{k}' for k in (6, 12, 24))}, {', '.join(f'max(drawdown_peak_atr) FILTER (WHERE off = {k}) AS drawdown_peak_atr_at_{k}' for k in (1, 3, 12))},
   {', '.join(f'max(runup_atr) FILTER (WHERE off = {k}) AS runup_atr_at_{k}' for k in (1, 3, 12))}, {', '.join(f'max({SHORT[c]}) FILTER (WHERE off = 0) AS {c}_at_entry' for c in CTX)},
   max(uw) AS max_upper_wick, arg_max(volume_decay, off) AS volume_decay_to_exit, min(bt) FILTER (WHERE off = 0) AS entry_t, max(runup_atr) FILTER (WHERE off <= 3) AS hd, max(runup_atr) FILTER (WHERE off <= 12) AS hf FROM pth GROUP BY symbol, start_bar),
ok1 AS (SELECT p.symbol, p.start_bar, min(off) AS time_to_peak, {', '.join(f'arg_min({SHORT[c]}, off) AS {c}_at_peak' for c in CTX)} FROM pth p JOIN og USING (symbol, start_bar) WHERE p.runup_atr = og.max_runup_atr GROUP BY ALL),
ok2 AS (SELECT p.symbol, p.start_bar, min(off) AS mae_entry_off FROM pth p JOIN og USING (symbol, start_bar) WHERE p.drawdown_entry_atr = og.max_mae_entry_atr GROUP BY ALL),
outc AS MATERIALIZED (SELECT * EXCLUDE (hd, hf), CASE WHEN max_runup_atr > 0 THEN max_mae_entry_atr / max_runup_atr END AS mae_to_mfe, CASE WHEN hd >= 1 AND close_delta_atr_at_6 <= -0.5 THEN 1 ELSE 0 END AS reversed_6,
   CASE WHEN hf >= 1 AND close_delta_atr_at_12 <= 0 THEN 1 ELSE 0 END AS round_trip_12, CAST(hour(to_timestamp(entry_t) AT TIME ZONE 'UTC') AS INT) AS hour_utc,
   CAST(isodow(to_timestamp(entry_t) AT TIME ZONE 'UTC') - 1 AS INT) AS dow_utc FROM og JOIN ok1 USING (symbol, start_bar) JOIN ok2 USING (symbol, start_bar))"""
INTS = {"symbol", "start_bar", "tier", "time_to_peak", "mae_entry_off", "bars_to_runup_atr_1", "bars_to_runup_atr_3", "bars_to_runup_atr_5", "bars_to_drawdown_entry_atr_1",
        "bars_to_drawdown_entry_atr_2", "entry_t", "reversed_6", "round_trip_12", "hour_utc", "dow_utc"}
OUT_COLS = (["symbol", "start_bar", "entry", "atr", "score", "tier", "max_runup_atr", "max_mae_entry_atr", "max_mae_peak_atr", "time_to_peak", "mae_entry_off"]
            + [f"bars_to_runup_atr_{k}" for k in (1, 3, 5)] + [f"bars_to_drawdown_entry_atr_{k}" for k in (1, 2)] + [f"close_delta_atr_at_{k}" for k in (6, 12, 24)]
            + [f"drawdown_peak_atr_at_{k}" for k in (1, 3, 12)] + [f"runup_atr_at_{k}" for k in (1, 3, 12)] + [f"{c}_at_entry" for c in CTX] + [f"{c}_at_peak" for c in CTX]
            + ["max_upper_wick", "volume_decay_to_exit", "entry_t", "mae_to_mfe", "reversed_6", "round_trip_12", "hour_utc", "dow_utc"])


@query("outcome_rows", "E19 W31", f"""WITH RECURSIVE {OUT_SQL}
SELECT {', '.join(c if c in INTS else f'round({c}, 4) AS {c}' for c in OUT_COLS)} FROM outc""")
def _(spark, d):
    o = P.outcome_rows(path(spark, d))
    return o.select(*[F.col(c) if c in INTS else rnd(c, 4).alias(c) for c in OUT_COLS])


@query("prior_event_gap", "W32 P07", f"""WITH RECURSIVE {SIGNALS_SQL},
g AS (SELECT *, bar_idx - lag(bar_idx) OVER ({W}) AS gap FROM sig)
SELECT symbol, bar_idx AS start_bar, gap AS prior_gap, CASE WHEN gap <= 48 THEN 'chain' ELSE 'solo' END AS gap_bucket,
  CASE WHEN score >= 99 THEN '99+' WHEN score >= 95 THEN '95-99' WHEN score >= 90 THEN '90-95' WHEN score >= 80 THEN '80-90' ELSE '<80' END AS score_band,
  CASE WHEN body_eff >= 0.75 THEN 'bull' WHEN body_eff >= 0.5 THEN 'range-up' WHEN body_eff >= 0.25 THEN 'range-down' ELSE 'bear' END AS regime,
  CASE WHEN atr < 0 THEN '<0' WHEN atr < 1 THEN '0-1' WHEN atr < 3 THEN '1-3' WHEN atr < 5 THEN '3-5' WHEN atr < 10 THEN '5-10' ELSE '>=10' END AS size_bucket FROM g""")
def _(spark, d):
    s = signals(spark, d).withColumnRenamed("bar_idx", "start_bar")
    return P.prior_gap(s, 64).select(
        *P.EP, "prior_gap", P.gap_bucket(F.col("prior_gap")).alias("gap_bucket"), P.score_band(F.col("score")).alias("score_band"),
        P.regime_bucket(F.col("body_eff")).alias("regime"), P.outcome_bucket(F.col("atr")).alias("size_bucket"))


@query("active_context", "J01", f"""WITH RECURSIVE {SIGNALS_SQL}
SELECT b.symbol, b.bar_idx, max(s.bar_idx) AS start_bar, arg_max(s.tier, s.bar_idx) AS tier, round(arg_max(s.score, s.bar_idx), 2) AS score
FROM bars b JOIN sig s ON s.symbol = b.symbol AND s.bar_idx < b.bar_idx AND b.bar_idx <= s.bar_idx + 24 WHERE s.atr > 0 GROUP BY b.symbol, b.bar_idx""")
def _(spark, d):
    b = bars_table(spark, d)
    ctx = starts(spark, d, b).filter(F.col("atr") > 0).select("symbol", "start_bar", "tier", "score")
    return P.active_context(b, ctx, 24).select("symbol", "bar_idx", "start_bar", "tier", rnd("score", 2).alias("score"))


LOOSE = {**P.REACCEL, "min_score": 0.0, "allow_c": True, "runup": 0.1, "pull_min": 0.0, "pull_max": 8.0, "floor": -4.0, "extension": 4.0, "gap_max": 6.0,
         "chase_vol": 50.0, "chase_move": 1e9, "wick": 0.9, "close_pos": 0.2, "quote": 0.0, "vol": 0.3, "body_eff": 0.1}
WARN = {**P.TOP_WARNING, "runup": 0.2}
INSIDE_SQL = f"""{SIGNALS_SQL}, nb AS MATERIALIZED (SELECT q0.*, lag(close) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2, lag(open) OVER ({W}) AS o1, lag(high) OVER ({W}) AS h1, lag(low) OVER ({W}) AS l1, lag(low, 2) OVER ({W}) AS l2,
   lead(close) OVER ({W}) AS nc, lead(low) OVER ({W}) AS nl, lead(open) OVER ({W}) AS no FROM q0),
ins0 AS (SELECT s.symbol, s.bar_idx AS start_bar, s.close AS entry, s.atr AS eatr, s.score, s.tier, nb.* EXCLUDE (symbol, t), nb.bar_idx - s.bar_idx AS off FROM sig s JOIN nb ON nb.symbol = s.symbol AND nb.bar_idx BETWEEN s.bar_idx AND s.bar_idx + 24 WHERE s.atr > 0),
ins1 AS (SELECT *, max(high) OVER (PARTITION BY symbol, start_bar ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb4, max(high) OVER (PARTITION BY symbol, start_bar ORDER BY off) AS pnow FROM ins0),
ins AS MATERIALIZED (SELECT * FROM ins1 WHERE off >= 1 QUALIFY row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY start_bar DESC) = 1)"""


def contexts(spark, d, b):
    return starts(spark, d, b).filter(F.col("atr") > 0)


_l = LOOSE


@query("reacceleration_signals", "E15", f"""WITH RECURSIVE {INSIDE_SQL},
m AS (SELECT *, (pb4 - entry) / eatr AS runup, CASE WHEN off >= 3 THEN least(l1, l2) ELSE l1 END AS rl FROM ins),
m2 AS (SELECT *, (pb4 - rl) / eatr AS pullback, (close - open) / nullif(high - low, 0) AS eff, (high - close) / nullif(high - low, 0) AS wick, (close - low) / nullif(high - low, 0) AS cpos, (close / greatest(c1, 1e-12) - 1) * 100 AS move,
   volume / greatest(va, 1e-12) AS vol, (close - greatest(c1, o1)) / eatr AS reclaim, greatest(0, (close - pb4) / eatr) AS ext, greatest(0, (pb4 - close) / eatr) AS gap FROM m),
cnd AS MATERIALIZED (SELECT symbol, start_bar, bar_idx, runup, pullback, reclaim, gap, round(100 * (0.25 * {c01('score / 20')} + 0.25 * {c01('(reclaim - 0.05) / 5.95')} + 0.20 * {c01('pullback / 8')} + 0.15 * {c01('(vol - 0.3) / 1.5')} + 0.15 * (1 - {c01('gap / 6')})), 2) AS signal_score
  FROM m2 WHERE bar_idx >= 21 AND atr > 0 AND va > 0 AND off > 2 AND runup >= 0.1 AND pullback BETWEEN 0 AND 8 AND rl >= entry - 4 * eatr AND c1 < h1 AND c1 <= c2 AND close > open AND high > low AND move >= 0.25 AND eff >= 0.1 AND vol >= 0.3
   AND close * va >= 0 AND reclaim >= 0.05 AND ext <= 4 AND gap <= 6 AND wick <= 0.9 AND cpos >= 0.2 AND close >= entry AND high >= h1 AND NOT (gap <= 0.02 AND (vol > 50 OR move > 1e9))),
acc AS (SELECT symbol, min(bar_idx) AS bar_idx, arg_min(start_bar, bar_idx) AS start_bar FROM cnd GROUP BY symbol
   UNION ALL SELECT c.symbol, min(c.bar_idx), arg_min(c.start_bar, c.bar_idx) FROM acc a JOIN cnd c ON c.symbol = a.symbol AND c.bar_idx >= a.bar_idx + 4 AND c.start_bar > a.start_bar GROUP BY c.symbol)
SELECT symbol, start_bar, bar_idx, round(runup, 5) AS runup, round(pullback, 5) AS pullback, round(reclaim, 5) AS reclaim, round(gap, 5) AS peak_gap, signal_score FROM cnd JOIN acc USING (symbol, start_bar, bar_idx)""")
def _(spark, d):
    b = bars_table(spark, d)
    r = P.reaccelerations(contexts(spark, d, b), P.neighbour_bars(wilder_bars(b)), 24, LOOSE)
    return r.select(*P.EP, "bar_idx", *[rnd(c, 5).alias(c) for c in ("runup", "pullback", "reclaim", "peak_gap")], "signal_score")


WARN_SQL = f"""{INSIDE_SQL},
wm AS (SELECT *, (pnow - entry) / eatr AS runup, (high - greatest(open, close)) / nullif(high - low, 0) AS wick, (close - low) / nullif(high - low, 0) AS cpos, (close / greatest(nc, 1e-12) - 1) * 100 AS dropp FROM ins),
warn AS MATERIALIZED (SELECT *, nc < close AND nl < low AND dropp >= 0.25 AS confirmed FROM wm WHERE bar_idx >= 22 AND nc IS NOT NULL AND atr > 0 AND runup >= 0.2 AND high >= pnow * 0.95 AND (close < open OR close < c1) AND wick >= 0.125 AND cpos <= 0.6)"""


def warnings(spark, d, b):
    return P.top_warnings(contexts(spark, d, b), P.neighbour_bars(wilder_bars(b)), 24, WARN)


@query("top_warnings", "E16", f"""WITH RECURSIVE {WARN_SQL}
SELECT symbol, start_bar, bar_idx, round(runup, 5) AS runup, round(wick, 5) AS wick, round(cpos, 5) AS cpos, CAST(confirmed AS INT) AS confirmed,
   CASE WHEN confirmed THEN round(100 * (0.45 * {c01('runup / (0.2::DOUBLE * 1.5)')} + 0.30 * {c01('wick')} + 0.25 * {c01('dropp / 0.75')}), 2) END AS signal_score FROM warn""")
def _(spark, d):
    return warnings(spark, d, bars_table(spark, d)).select(
        *P.EP, "bar_idx", *[rnd(c, 5).alias(c) for c in ("runup", "wick", "cpos")], F.col("confirmed").cast("int").alias("confirmed"), "signal_score")


@query("earliest_warning_per_episode", "J06", f"""WITH RECURSIVE {WARN_SQL}
SELECT symbol, start_bar, min(bar_idx) AS warning_bar, round(arg_min(runup, bar_idx), 5) AS warning_runup, round(arg_min(no, bar_idx), 6) AS warning_exit_price FROM warn GROUP BY symbol, start_bar""")
def _(spark, d):
    return P.earliest_warning(warnings(spark, d, bars_table(spark, d))).select(
        *P.EP, "warning_bar", rnd("warning_runup", 5).alias("warning_runup"), rnd("warning_exit_price").alias("warning_exit_price"))


EXIT_SQL = """exh AS (SELECT s.symbol, s.bar_idx AS start_bar, s.close, s.atr, b.bar_idx AS j, b.close AS c, b.low <= s.close - s.atr AS sl, b.high >= s.close + 3.0 * s.atr AS tp
  FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx + 1 AND s.bar_idx + 24 WHERE s.atr > 0),
exq AS (SELECT symbol, start_bar, close, atr, min(j) FILTER (WHERE sl OR tp) AS hj, arg_min(sl, j) FILTER (WHERE sl OR tp) AS hsl, max(j) AS lj, arg_max(c, j) AS lc FROM exh GROUP BY ALL),
trd AS MATERIALIZED (SELECT symbol, start_bar, close AS entry, atr, coalesce(hj, lj) AS exit_bar, CASE WHEN hj IS NULL THEN (lc - close) / atr WHEN hsl THEN -1.0 ELSE 3.0 END AS realized FROM exq)"""


def exits(spark, d, b):
    from barloom.operators.labels import directional_exit
    ev = signals(spark, d, b).select("symbol", "bar_idx", "direction", "close", "atr", "score", "tier")
    return directional_exit(ev, b, 3.0, 1.0, 24).select(
        "symbol", F.col("bar_idx").alias("start_bar"), F.col("close").alias("entry"), "atr", "exit_bar", F.col("realized_atr").alias("realized"), "score", "tier")


@query("warning_exit_override", "J07", f"""WITH RECURSIVE {WARN_SQL}, {EXIT_SQL},
o AS (SELECT t.*, min(w.bar_idx) AS wb, arg_min(w.no, w.bar_idx) AS wp FROM trd t LEFT JOIN warn w ON w.symbol = t.symbol AND w.start_bar = t.start_bar AND w.bar_idx > t.start_bar AND w.bar_idx < t.exit_bar AND w.wick >= 0.2 GROUP BY ALL)
SELECT symbol, start_bar, coalesce(wb + 1, exit_bar) AS exit_bar, round(CASE WHEN wb IS NULL THEN realized ELSE (wp - entry) / atr END, 5) AS realized, CASE WHEN wb IS NULL THEN 0 ELSE 1 END AS overridden FROM o""")
def _(spark, d):
    b = bars_table(spark, d)
    t = exits(spark, d, b)
    w = warnings(spark, d, b).filter(F.col("wick") >= 0.2).select(*P.EP, F.col("bar_idx").alias("wb"), "next_open")
    inside = (F.col("wb") > F.col("start_bar")) & (F.col("wb") < F.col("exit_bar"))
    first = F.min_by(F.when(inside, F.struct("wb", "next_open")), F.when(inside, F.col("wb")))
    j = t.join(w, P.EP, "left").groupBy(*P.EP).agg(*[F.first(c).alias(c) for c in ("entry", "atr", "exit_bar", "realized")], first.alias("w"))
    return j.select(*P.EP, F.coalesce(F.col("w.wb") + 1, F.col("exit_bar")).alias("exit_bar"),
                    rnd(F.when(F.col("w").isNull(), F.col("realized")).otherwise((F.col("w.next_open") - F.col("entry")) / F.col("atr")), 5).alias("realized"),
                    F.col("w").isNotNull().cast("int").alias("overridden"))


@query("first_child_in_trade", "J08", f"""WITH RECURSIVE {SIGNALS_SQL}, {EXIT_SQL},
ch AS (SELECT symbol, bar_idx, volume / nullif(avg(volume) OVER {last(20)}, 0) AS vr FROM bars)
SELECT t.symbol, t.start_bar, min(c.bar_idx) AS child_bar, round(arg_min(c.vr, c.bar_idx), 6) AS child_ratio FROM trd t JOIN ch c ON c.symbol = t.symbol AND c.bar_idx > t.start_bar AND c.bar_idx < t.exit_bar WHERE c.vr > 1.2 GROUP BY ALL""")
def _(spark, d):
    b = bars_table(spark, d)
    ch = over_chunks(b, lambda x, f: x.select("symbol", "bar_idx", "_chunk", F.try_divide(F.col("volume"), F.avg("volume").over(f.last(20))).alias("vr")), back=19)
    hit = J.within_parent(ch.filter(F.col("vr") > 1.2), exits(spark, d, b), 24, ["start_bar", "exit_bar"], ["bar_idx", "vr"])
    return hit.groupBy(*P.EP).agg(F.min("c_bar_idx").alias("child_bar"), rnd(F.min_by("c_vr", "c_bar_idx")).alias("child_ratio"))


@query("band_overlap", "J10", f"""WITH RECURSIVE {SIGNALS_SQL},
ch AS (SELECT symbol, bar_idx FROM bars WHERE close > open)
SELECT ch.symbol, count(*) AS children, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sig s WHERE s.symbol = ch.symbol AND abs(s.bar_idx - ch.bar_idx) <= 6)) AS near,
  round(100.0 * count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sig s WHERE s.symbol = ch.symbol AND abs(s.bar_idx - ch.bar_idx) <= 6)) / count(*), 6) AS overlap_pct FROM ch GROUP BY ch.symbol""")
def _(spark, d):
    b = bars_table(spark, d)
    child = b.filter(F.col("close") > F.col("open")).select("symbol", "bar_idx")
    near = J.band_semi(child, signals(spark, d, b).select("symbol", "bar_idx"), 6).groupBy("symbol").agg(F.count(F.lit(1)).alias("near"))
    return (child.groupBy("symbol").agg(F.count(F.lit(1)).alias("children")).join(near, "symbol", "left")
            .select("symbol", "children", F.coalesce("near", F.lit(0)).alias("near"),
                    rnd(100.0 * F.coalesce("near", F.lit(0)) / F.col("children")).alias("overlap_pct")))


@query("event_quality_scores", "E17", f"""WITH RECURSIVE {PATH_SQL},
q AS (SELECT symbol, start_bar, score, off, wave_strength, top_risk, runup_atr, pa, tr, wp, qs, ex, cp, uw FROM pth)
SELECT symbol, start_bar, off,
  round(greatest(0, least(100, 100 * (0.30 * {c01('score / 100')} + 0.24 * {c01('pa / 100')} + 0.16 * {c01('(tr + 0.10) / 0.70')} + 0.16 * {c01('(wp - 0.35) / 0.35')} + 0.14 * {c01('0.5 * wp + 0.3 * ' + c01('(tr + 1) / 2') + ' + 0.2 * ' + c01('cp'))}) - 18 * {c01('(-qs + 0.02) / 0.10')} - 12 * {c01('(ex - 55) / 45')})), 4) AS breakout_quality,
  round(greatest(0, least(100, 100 * (0.38 * {c01('top_risk / 100')} + 0.22 * {c01('(uw - 0.25) / 0.50')} + 0.16 * {c01('(0.55 - cp) / 0.55')} + 0.14 * {c01('(ex - 40) / 60')} + 0.10 * {c01('(runup_atr - 1.5) / 3')}))), 4) AS warning_quality,
  round(greatest(0, least(100, 100 * (0.32 * {c01('score / 100')} + 0.30 * {c01('top_risk / 100')} + 0.20 * {c01('uw')} + 0.18 * {c01('(ex - 45) / 55')}))), 4) AS confirmed_quality,
  round(greatest(0, least(100, 100 * (0.28 * {c01('score / 100')} + 0.28 * {c01('wave_strength / 100')} + 0.18 * {c01('pa / 100')} + 0.14 * {c01('(cp - 0.45) / 0.55')} + 0.12 * {c01('(qs + 0.01) / 0.08')}))), 4) AS reaccel_quality FROM q""")
def _(spark, d):
    c = {"participation": "f_participation", "trend": "f_trend", "win_prob": "f_win_prob", "quote_slope": "f_quote_slope", "exhaustion": "f_exhaustion",
         "taker_persist": "f_win_prob", "fit": "f_trend", "range_rank": "f_close_pos"}
    c = {k: F.col(v) for k, v in c.items()}
    return path(spark, d).select(
        *P.EP, "off", rnd(P.breakout_quality(F.col("score"), c), 4).alias("breakout_quality"),
        rnd(P.warning_quality(F.col("top_risk"), F.col("runup_atr"), F.col("f_upper_wick"), F.col("f_close_pos"), F.col("f_exhaustion")), 4).alias("warning_quality"),
        rnd(P.confirmed_quality(F.col("score"), F.col("top_risk"), F.col("f_upper_wick"), F.col("f_exhaustion")), 4).alias("confirmed_quality"),
        rnd(P.reaccel_quality(F.col("score"), F.col("wave_strength"), F.col("f_participation"), F.col("f_close_pos"), F.col("f_quote_slope")), 4).alias("reaccel_quality"))


FUND_SQL = """fund AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS at, arg_max(value, event_id) AS rate
  FROM events WHERE json_extract_string(props, '$.k')::INT < 20 GROUP BY ALL)"""


def funding(spark, d):
    """Irregular readings per symbol: the prints with a small volume."""
    from barloom.plans.inputs import table
    e = table(spark, d, "events").filter(F.get_json_object("props", "$.k").cast("int") < 20)
    return e.groupBy(F.col("event_type").alias("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).agg(
        F.max_by("value", "event_id").alias("rate"))


@query("nearest_reading", "J02", f"""WITH {BARS_SQL}, {FUND_SQL}
SELECT b.symbol, b.bar_idx, b.t, f.at AS reading_at, round(f.rate, 6) AS rate FROM bars b JOIN fund f ON f.symbol = b.symbol QUALIFY row_number() OVER (PARTITION BY b.symbol, b.bar_idx ORDER BY abs(f.at - b.t), f.at DESC) = 1""")
def _(spark, d):
    b = bars(spark, d).select("symbol", "bar_idx", "t")
    return J.nearest_join(b, funding(spark, d), ["symbol"], "t", "at", "r", 86400).filter(F.col("r").isNotNull()).select(
        "symbol", "bar_idx", "t", F.col("r.at").alias("reading_at"), rnd("r.rate").alias("rate"))


@query("reference_premium", "J21", f"""WITH {BARS_SQL}, ref AS (SELECT t, close FROM bars WHERE symbol = 'purchase'), oth AS (SELECT symbol, bar_idx, t, close FROM bars WHERE symbol = 'click')
SELECT o.bar_idx, o.t, round((r.close - o.close) / o.close * 100, 5) AS premium_pct FROM oth o ASOF JOIN ref r ON o.t >= r.t WHERE o.close <> 0""")
def _(spark, d):
    b = bars(spark, d).select("symbol", "bar_idx", "t", "close")
    one = F.lit("anchor").alias("anchor")
    left = b.filter((F.col("symbol") == "click") & (F.col("close") != 0)).select(one, "bar_idx", "t", "close")
    ref = b.filter(F.col("symbol") == "purchase").select(one, F.col("t").alias("rt"), F.col("close").alias("ref"))
    return J.asof_join(left, ref, ["anchor"], "t", "rt", "m", 86400).filter(F.col("m").isNotNull()).select(
        "bar_idx", "t", rnd((F.col("m.ref") - F.col("close")) / F.col("close") * 100, 5).alias("premium_pct"))


@query("feature_positions", "J19", f"""WITH RECURSIVE {SIGNALS_SQL}
SELECT DISTINCT b.symbol, b.bar_idx, round(b.close, 6) AS close FROM bars b JOIN sig s ON s.symbol = b.symbol AND b.bar_idx BETWEEN s.bar_idx - 6 AND s.bar_idx""")
def _(spark, d):
    b = bars_table(spark, d)
    wanted = signals(spark, d, b).select("symbol", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bar_idx") - 6), F.col("bar_idx"))).alias("bar_idx"))
    return b.join(wanted, ["symbol", "bar_idx"], "left_semi").select("symbol", "bar_idx", rnd("close").alias("close"))


@query("closed_coarse_bar", "J20", f"""WITH {BARS_SQL}, co AS (SELECT symbol, t // 14400 AS k, last(close ORDER BY t) AS c4, sum(volume) AS v4 FROM bars GROUP BY ALL)
SELECT b.symbol, b.bar_idx, round(co.c4, 6) AS coarse_close, round(co.v4, 6) AS coarse_volume FROM bars b JOIN co ON co.symbol = b.symbol AND co.k = b.t // 14400 - 1""")
def _(spark, d):
    b = bars_table(spark, d)
    # the last closed coarse bar is the one before the bucket the bar lies in
    coarse = b.groupBy("symbol", (F.floor(F.col("t") / 14400) + 1).alias("k")).agg(
        rnd(F.max_by("close", "t")).alias("coarse_close"), rnd(F.sum("volume")).alias("coarse_volume"))
    return b.withColumn("k", F.floor(F.col("t") / 14400)).join(coarse, ["symbol", "k"]).select("symbol", "bar_idx", "coarse_close", "coarse_volume")


@query("benchmark_correlation", "J16", f"""WITH {BARS_SQL}, r AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret FROM bars), bm AS (SELECT t, ret AS bret FROM r WHERE symbol = 'signup'),
j AS (SELECT r.symbol, r.bar_idx, r.ret, bm.bret, row_number() OVER (PARTITION BY r.symbol ORDER BY r.bar_idx) AS n FROM r JOIN bm USING (t) WHERE r.ret IS NOT NULL AND bm.bret IS NOT NULL),
k AS (SELECT *, covar_pop(ret, bret) OVER {last(20)} AS cv, stddev_pop(ret) OVER {last(20)} AS s1, stddev_pop(bret) OVER {last(20)} AS s2 FROM j)
SELECT symbol, bar_idx, CASE WHEN n >= 20 THEN round(coalesce(cv / nullif(s1 * s2, 0), 0.5), 5) ELSE 0.5 END AS corr20 FROM k""")
def _(spark, d):
    from barloom.operators.series import index_series
    r = over_chunks(bars(spark, d), lambda x, f: x.select("symbol", "bar_idx", "t", "_chunk", R.simple_return(f).alias("ret")), back=1).filter(F.col("ret").isNotNull())
    bm = r.filter(F.col("symbol") == "signup").select("t", F.col("ret").alias("bret"))
    j = index_series(r.join(bm, "t"), ["symbol"], ["bar_idx"], [F.floor(F.col("bar_idx") / 512)], out="n")

    def build(x, f):
        c = F.try_divide(F.covar_pop("ret", "bret").over(f.last(20)), F.stddev_pop("ret").over(f.last(20)) * F.stddev_pop("bret").over(f.last(20)))
        return x.select("symbol", "bar_idx", "n", "_chunk", F.when(f.full(20), rnd(F.coalesce(c, F.lit(0.5)), 5)).otherwise(0.5).alias("corr20"))
    return over_chunks(j, build, back=19, idx="n").select("symbol", "bar_idx", "corr20")
