"""Detectors and labels over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import events as E
from barloom.operators import labels as L
from barloom.plans.inputs import BARS_SQL, bars, bars_table, rnd
from barloom.plans.registry import query
from barloom.plans.windows import CUSUM_SQL, TR_SQL, W, last, sql_recur

FEATURES_SQL = f"""{BARS_SQL}, {TR_SQL}, {CUSUM_SQL},
feat AS MATERIALIZED (
  SELECT c.*, CASE WHEN c.bar_idx >= 13 THEN avg(tr.tr) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr,
    max(c.high) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS range_high,
    min(c.low) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS range_low,
    CASE WHEN c.bar_idx >= 49 THEN avg(c.volume) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS vol_avg50,
    CASE WHEN c.bar_idx >= 96 THEN quantile_cont(c.low, 0.1) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) END AS support,
    CASE WHEN c.bar_idx >= 96 THEN quantile_cont(c.high, 0.9) OVER (PARTITION BY c.symbol ORDER BY c.bar_idx ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) END AS resistance
  FROM cus c JOIN tr ON tr.symbol = c.symbol AND tr.bar_idx = c.bar_idx),
fp AS (SELECT *, atr / (close + 1e-8) AS atr_pct FROM feat)"""


def sql_label(src: str, p: dict, name: str = "lab") -> str:
    """Barrier labels of candidates in ``src``."""
    return f"""{name}_hit AS (
  SELECT e.symbol, e.bar_idx, e.direction, e.close, e.atr, b.bar_idx - e.bar_idx AS off,
    CASE WHEN direction = 1 THEN b.high >= e.close + e.atr * {p['tp']} ELSE b.low <= e.close - e.atr * {p['tp']} END AS tp,
    CASE WHEN direction = 1 THEN b.low <= e.close - e.atr * {p['sl']} ELSE b.high >= e.close + e.atr * {p['sl']} END AS sl,
    (b.close - e.close) * direction >= 0 AS good
  FROM {src} e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + {p['bars']}
  WHERE e.atr > 0 AND e.close > 0),
{name} AS (
  SELECT symbol, bar_idx, direction, label, CASE WHEN won THEN 1.0::DOUBLE ELSE 1.5 END AS weight, bars_to_hit FROM (
    SELECT symbol, bar_idx, direction, count(*) AS n, arg_min(CASE WHEN tp AND sl THEN good ELSE tp END, off) FILTER (WHERE tp OR sl) AS won,
           min(off) FILTER (WHERE tp OR sl) AS bars_to_hit,
           CAST(arg_min(CASE WHEN tp AND sl THEN good ELSE tp END, off) FILTER (WHERE tp OR sl) = (direction = 1) AS INT) AS label
    FROM {name}_hit GROUP BY ALL HAVING count(*) = {p['bars']}) WHERE bars_to_hit IS NOT NULL)""".replace("GROUP BY ALL", "GROUP BY symbol, bar_idx, direction")


def sql_thin(src: str, gap: int, name: str = "kept") -> str:
    return f"""{name} AS (
  SELECT symbol, min(bar_idx) AS bar_idx FROM {src} GROUP BY symbol
  UNION ALL
  SELECT c.symbol, min(c.bar_idx) FROM {name} k JOIN {src} c ON c.symbol = k.symbol AND c.bar_idx >= k.bar_idx + {gap} GROUP BY c.symbol)"""


def sql_detect(direction: str, p: dict, warmup: int = 50) -> str:
    return f"""WITH RECURSIVE {FEATURES_SQL},
cand AS MATERIALIZED (SELECT symbol, bar_idx, close, atr, direction FROM (SELECT *, {direction} AS direction FROM fp) WHERE bar_idx >= {warmup} AND direction IS NOT NULL),
{sql_label('cand', p)}, labm AS MATERIALIZED (SELECT * FROM lab), {sql_thin('labm', E.MIN_GAP)}
SELECT symbol, bar_idx, direction, label, weight, bars_to_hit FROM labm JOIN kept USING (symbol, bar_idx)"""


def thr(p: dict) -> str:
    return f"greatest({p['mult']} * atr_pct, {p['floor']})"


EVENT = ["symbol", "bar_idx", "direction", "label", "weight", "bars_to_hit"]
# Stand-in prices swing by whole multiples, so "tight" and "heavy" are set wider here.
RANGE_WIDE = {**E.RANGE_TURN, "mult": 8.0}
STEALTH_WIDE = {**E.STEALTH, "mult": 0.2, "surge": 1.2, "bars": 24}
EXTREME_WIDE = {**E.EXTREME, "mult": 0.5, "bars": 24}
DOWN_WIDE = {**E.DOWN_BREAK, "mult": 0.5, "bars": 24}


def run_detector(spark, d, direction, p, warmup=50):
    b = bars_table(spark, d)
    return E.detect(E.event_features(b), b, direction, p, warmup).select(*EVENT)


@query("up_break_events", "E01 E06 R07", sql_detect(
    f"CASE WHEN cusum_pos > {thr(E.UP_BREAK)} AND high >= range_high THEN 1 END", E.UP_BREAK))
def _(spark, d):
    return run_detector(spark, d, E.up_break(), E.UP_BREAK)


@query("down_break_events", "E07", sql_detect(f"CASE WHEN cusum_neg < -{thr(DOWN_WIDE)} THEN -1 END", DOWN_WIDE))
def _(spark, d):
    return run_detector(spark, d, E.down_break(DOWN_WIDE), DOWN_WIDE)


@query("range_turn_events", "E08", sql_detect(f"""CASE WHEN (range_high - range_low) / (close + 1e-8) < {thr(RANGE_WIDE)} AND range_high - range_low >= 1e-8
  THEN CASE WHEN (close - range_low) / (range_high - range_low) < 0.2 THEN 1 WHEN (close - range_low) / (range_high - range_low) > 0.8 THEN -1 END END""", RANGE_WIDE))
def _(spark, d):
    return run_detector(spark, d, E.range_turn(RANGE_WIDE), RANGE_WIDE)


@query("stealth_volume_events", "E09", sql_detect(
    f"CASE WHEN cusum_pos > {thr(STEALTH_WIDE)} AND NOT (close > range_high) AND vol_avg50 > 0 AND volume > 1.2 * vol_avg50 THEN 1 END", STEALTH_WIDE)
    + " UNION ALL SELECT * FROM (" + sql_detect(
    f"CASE WHEN cusum_neg < -{thr(STEALTH_WIDE)} AND NOT (close < range_low) AND vol_avg50 > 0 AND volume > 1.2 * vol_avg50 THEN -1 END", STEALTH_WIDE) + ")")
def _(spark, d):
    b = bars_table(spark, d)
    feats = E.event_features(b)
    sides = [E.detect(feats, b, E.stealth_volume(s, STEALTH_WIDE), STEALTH_WIDE) for s in (1, -1)]
    return sides[0].unionByName(sides[1]).select(*EVENT)


@query("extreme_turn_events", "E10", sql_detect(
    f"CASE WHEN cusum_neg < -{thr(EXTREME_WIDE)} THEN 1 END", EXTREME_WIDE, 48)
    + " UNION ALL SELECT * FROM (" + sql_detect(f"CASE WHEN cusum_pos > {thr(EXTREME_WIDE)} THEN -1 END", EXTREME_WIDE, 48) + ")")
def _(spark, d):
    b = bars_table(spark, d)
    feats = E.event_features(b)
    sides = [E.detect(feats, b, E.extreme_turn(s, EXTREME_WIDE), EXTREME_WIDE, warmup=48) for s in (1, -1)]
    return sides[0].unionByName(sides[1]).select(*EVENT)


@query("level_bounce_events", "E11", sql_detect(f"""CASE WHEN abs(close - support) / (support + 1e-8) < {thr(E.BOUNCE)} THEN 1
  WHEN abs(close - resistance) / (resistance + 1e-8) < {thr(E.BOUNCE)} THEN -1 END""", E.BOUNCE, 96))
def _(spark, d):
    return run_detector(spark, d, E.level_bounce(), E.BOUNCE, warmup=96)


PF = "CASE WHEN losses = 0 THEN CASE WHEN wins > 0 THEN 'inf'::DOUBLE ELSE 0.0 END ELSE round(wins / losses, 6) END"


@query("breakout_outcome_by_symbol", "A05 E06", f"""WITH RECURSIVE {FEATURES_SQL},
cand AS MATERIALIZED (SELECT symbol, bar_idx, close, atr, 1 AS direction FROM fp WHERE bar_idx >= 50 AND cusum_pos > {thr(E.UP_BREAK)} AND high >= range_high),
{sql_label('cand', E.UP_BREAK)}, labm AS MATERIALIZED (SELECT * FROM lab), {sql_thin('labm', E.MIN_GAP)},
ev AS (SELECT * FROM labm JOIN kept USING (symbol, bar_idx)),
agg AS (SELECT symbol, count(*) AS events, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS sl,
   coalesce(sum(2.5) FILTER (WHERE label = 1), 0)::DOUBLE AS wins, coalesce(sum(1.0) FILTER (WHERE label = 0), 0)::DOUBLE AS losses FROM ev GROUP BY symbol)
SELECT symbol, events, tp, sl, {PF} AS profit_factor FROM agg""")
def _(spark, d):
    from barloom.operators.aggregates import profit_factor
    p = E.UP_BREAK
    b = bars_table(spark, d)
    ev = E.detect(E.event_features(b), b, E.up_break(), p).withColumn(
        "realized", F.when(F.col("label") == 1, p["tp"]).otherwise(-p["sl"]))
    return ev.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("sl"),
        rnd(profit_factor("realized")).alias("profit_factor"))


# -- tiered breakouts -------------------------------------------------------------------------

BREAKOUT_WIDE = {**E.BREAKOUT, "body_eff": 0.3, "body_ratio": 0.8, "quiet_pct": 2000.0, "vol": 0.7,
                 "now_body_eff": 0.4, "now_body_ratio": 1.0, "now_vol": 0.9, "cont_vol": 0.6}
_p = BREAKOUT_WIDE


def _setup_fields(s: str) -> str:
    return ", ".join(f"lag({c}, {s}) OVER ({W}) AS {c}{s}" for c in ("ok", "close", "high", "mid", "body_ratio", "body_eff", "quiet", "vr"))


def _clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _strength(k: int) -> str:
    return (f"({_clip(f'(low - mid{k}) / greatest(close{k} - mid{k}, 1e-12)')} + {_clip(f'(close - close{k}) / greatest(close{k} - mid{k}, 1e-12)')}"
            f" + {_clip(f'(high - high{k}) / greatest(high{k} - mid{k}, 1e-12)')}) / 3.0")


def _pick(c: str) -> str:
    return f"CASE tier WHEN 'A' THEN {c} WHEN 'B' THEN {c}1 ELSE {c}2 END"


WILDER_SQL = f"""s AS MATERIALIZED (SELECT *, avg(tr) OVER {last(14)} AS t0 FROM trm), {sql_recur('aw', 's', 't0', '(p.y * 13 + b.tr) / 14', 'bar_idx = 14')}"""

CANDIDATES_SQL = f"""{BARS_SQL}, {TR_SQL}, trm AS MATERIALIZED (SELECT * FROM tr), {WILDER_SQL},
q0 AS (SELECT trm.*, coalesce(aw.y, 0) AS atr, close - open AS body, 0.5 * (open + close) AS mid,
   CASE WHEN trm.bar_idx >= 20 THEN avg(abs(close - open)) OVER (PARTITION BY trm.symbol ORDER BY trm.bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS pb,
   CASE WHEN trm.bar_idx >= 20 THEN avg(volume) OVER (PARTITION BY trm.symbol ORDER BY trm.bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) ELSE 0 END AS va
   FROM trm LEFT JOIN aw ON aw.symbol = trm.symbol AND aw.bar_idx = trm.bar_idx),
q1 AS (SELECT *, body / nullif(high - low, 0) AS body_eff, body / nullif(pb, 0) AS body_ratio, pb / greatest(open, 1e-12) * 100 AS quiet, volume / nullif(va, 0) AS vr FROM q0),
q2 AS (SELECT *, coalesce(bar_idx >= 20 AND body > 0 AND body / greatest(open, 1e-12) >= 0.01 AND pb > 0 AND va > 0 AND body_eff >= {_p['body_eff']}
   AND body_ratio >= {_p['body_ratio']} AND quiet < {_p['quiet_pct']} AND vr >= {_p['vol']}, false) AS ok FROM q1),
q3 AS (SELECT *, {_setup_fields('1')}, {_setup_fields('2')}, lag(low) OVER ({W}) AS low1 FROM q2),
q4 AS (SELECT *, CASE WHEN ok AND body_eff >= {_p['now_body_eff']} AND body_ratio >= {_p['now_body_ratio']} AND vr >= {_p['now_vol']} THEN 'A'
   WHEN ok1 AND low >= mid1 AND close >= close1 AND high >= high1 THEN 'B'
   WHEN ok2 AND low1 >= mid2 AND close >= close2 AND high >= high2 AND vr >= {_p['cont_vol']} THEN 'C' END AS tier FROM q3 WHERE bar_idx > 20),
q5 AS (SELECT *, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN {_strength(1)}
   ELSE 0.5 * {_clip('(low1 - mid2) / greatest(close2 - mid2, 1e-12)')} + 0.5 * {_strength(2)} END AS confirm,
   {_pick('body_ratio')} AS s_ratio, {_pick('body_eff')} AS s_eff, {_pick('quiet')} AS s_quiet, {_pick('vr')} AS s_vol FROM q4 WHERE tier IS NOT NULL),
bcand AS MATERIALIZED (SELECT symbol, bar_idx, t, tier, close, atr, 1 AS direction, s_ratio AS body_ratio, s_eff AS body_eff, s_quiet AS quiet_pct, s_vol AS vol_ratio,
   round(100.0 * (0.30 * {_clip(f"(s_ratio - {_p['body_ratio']}) / 4.0")} + 0.25 * {_clip(f"(s_vol - {_p['vol']}) / 2.0")}
     + 0.20 * {_clip(f"(s_eff - {_p['body_eff']}) / 0.2")} + 0.10 * {_clip(f"({_p['quiet_pct']} - s_quiet) / {_p['quiet_pct']}")} + 0.15 * {_clip('confirm')}), 2) AS score FROM q5)"""

SIGNALS_SQL = f"""{CANDIDATES_SQL}, {sql_thin('bcand', 21, 'bkept')},
sig AS MATERIALIZED (SELECT bcand.* FROM bcand JOIN bkept USING (symbol, bar_idx))"""


def signals(spark, d, b=None):
    return E.breakouts(bars_table(spark, d) if b is None else b, BREAKOUT_WIDE)


@query("tiered_breakouts", "E13", f"""WITH RECURSIVE {SIGNALS_SQL}
SELECT symbol, bar_idx, tier, score, round(atr, 6) AS atr, round(body_ratio, 6) AS body_ratio, round(vol_ratio, 6) AS vol_ratio, round(body_eff, 6) AS body_eff,
   CASE tier WHEN 'A' THEN 84.0::DOUBLE WHEN 'B' THEN 78.0 ELSE 72.0 END AS confidence, CASE tier WHEN 'A' THEN 1.15::DOUBLE WHEN 'B' THEN 1.0 ELSE 0.75 END AS size_mult,
   CASE tier WHEN 'A' THEN 0.0::DOUBLE WHEN 'B' THEN 0.30 ELSE 0.35 END AS prob_floor FROM sig""")
def _(spark, d):
    return signals(spark, d).select("symbol", "bar_idx", "tier", "score", *[rnd(c).alias(c) for c in ("atr", "body_ratio", "vol_ratio", "body_eff")],
                                    "confidence", "size_mult", "prob_floor")


TIER_BARRIER = {"tp": 5.4, "sl": 2.0, "bars": 48}


@query("tiered_breakout_labels", "E12", f"""WITH RECURSIVE {CANDIDATES_SQL}, {sql_label('bcand', TIER_BARRIER)},
labm AS MATERIALIZED (SELECT l.*, c.tier FROM lab l JOIN bcand c USING (symbol, bar_idx)), {sql_thin('labm', 12)}
SELECT symbol, bar_idx, tier, label, weight, bars_to_hit FROM labm JOIN kept USING (symbol, bar_idx)""")
def _(spark, d):
    from barloom.operators.series import thin
    b = bars_table(spark, d)
    found = E.breakout_candidates(b, BREAKOUT_WIDE).select("symbol", "bar_idx", "direction", "tier", "close", "atr")
    lab = L.barrier_label(found, b, TIER_BARRIER["tp"], TIER_BARRIER["sl"], TIER_BARRIER["bars"])
    return thin(lab, 12).select("symbol", "bar_idx", "tier", "label", "weight", "bars_to_hit")


@query("band_break_hard_negatives", "E14", f"""WITH {BARS_SQL},
q AS (SELECT *, avg(close) OVER {last(20)} + 2 * stddev_samp(close) OVER {last(20)} AS upper, volume / nullif(avg(volume) OVER {last(50)}, 0) AS anomaly,
   lead(close, 1) OVER ({W}) AS c1, lead(close, 2) OVER ({W}) AS c2, lead(close, 3) OVER ({W}) AS c3, lead(close, 12) OVER ({W}) AS far,
   coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) AS wick FROM bars),
r AS (SELECT *, c1 > upper AND c2 > upper AND c3 > upper AND wick < 0.3 AS real FROM q WHERE bar_idx >= 49 AND close > upper AND anomaly > 1.0 AND far IS NOT NULL)
SELECT symbol, bar_idx, round(upper, 6) AS upper, round(anomaly, 6) AS anomaly, CAST(real AS INT) AS label, CASE WHEN real THEN 1.0::DOUBLE ELSE 10.0 END AS weight FROM r""")
def _(spark, d):
    return E.band_break(bars(spark, d), vol_mult=1.0).select("symbol", "bar_idx", rnd("upper").alias("upper"), rnd("anomaly").alias("anomaly"), "label", "weight")


@query("directional_exits", "J03 E02", f"""WITH RECURSIVE {SIGNALS_SQL},
h AS (SELECT s.symbol, s.bar_idx, s.close, s.atr, b.bar_idx AS j, b.close AS c, b.low <= s.close - 1.0 * s.atr AS sl, b.high >= s.close + 2.0 * s.atr AS tp
  FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx + 1 AND s.bar_idx + 24 WHERE s.atr > 0),
x AS (SELECT symbol, bar_idx, close, atr, min(j) FILTER (WHERE sl OR tp) AS hj, arg_min(sl, j) FILTER (WHERE sl OR tp) AS hsl, max(j) AS lj, arg_max(c, j) AS lc FROM h GROUP BY ALL)
SELECT symbol, bar_idx, CASE WHEN hj IS NULL THEN 'TIMEOUT' WHEN hsl THEN 'SL' ELSE 'TP' END AS outcome,
   round(CASE WHEN hj IS NULL THEN (lc - close) / atr WHEN hsl THEN -1.0 ELSE 2.0 END, 6) AS realized_atr, coalesce(hj, lj) AS exit_bar FROM x""")
def _(spark, d):
    b = bars_table(spark, d)
    ev = signals(spark, d, b).select("symbol", "bar_idx", "direction", "close", "atr")
    return L.directional_exit(ev, b, 2.0, 1.0, 24).select("symbol", "bar_idx", "outcome", rnd("realized_atr").alias("realized_atr"), "exit_bar")


@query("directional_exits_slippage", "E03", f"""WITH RECURSIVE {SIGNALS_SQL},
e AS (SELECT symbol, bar_idx, close, atr, CASE WHEN tier = 'B' THEN -1 ELSE 1 END AS dir FROM sig WHERE atr > 0),
h AS (SELECT e.*, b.bar_idx AS j, b.open AS o, b.high AS h, b.low AS l, b.close AS c, e.close - dir * 1.0 * atr AS stop, e.close + dir * 2.0 * atr AS tgt
  FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + 24),
k AS (SELECT *, CASE WHEN dir = 1 THEN l <= stop ELSE h >= stop END AS sl, CASE WHEN dir = 1 THEN h >= tgt ELSE l <= tgt END AS tp,
  CASE WHEN (dir = 1 AND o <= stop) OR (dir = -1 AND o >= stop) THEN o
       ELSE stop - dir * least(0.2 * CASE WHEN dir = 1 THEN stop - l ELSE h - stop END, 0.25 * atr) END AS fill FROM h),
x AS (SELECT symbol, bar_idx, dir, close, atr, stop, tgt, min(j) FILTER (WHERE sl OR tp) AS hj, arg_min(sl, j) FILTER (WHERE sl OR tp) AS hsl,
  arg_min(fill, j) FILTER (WHERE sl OR tp) AS fill, max(j) AS lj, arg_max(c, j) AS lc FROM k GROUP BY ALL),
y AS (SELECT *, CASE WHEN hj IS NULL THEN lc WHEN hsl THEN fill ELSE tgt END AS px FROM x)
SELECT symbol, bar_idx, CASE WHEN hj IS NULL THEN 'TIMEOUT' WHEN hsl THEN 'SL' ELSE 'TP' END AS outcome, round(dir * (px - close) / atr, 6) AS realized_atr,
  coalesce(hj, lj) AS exit_bar, round(CASE WHEN hsl THEN greatest(0, dir * (stop - px) / atr) ELSE 0.0 END, 6) AS stop_slip_atr FROM y""")
def _(spark, d):
    b = bars_table(spark, d)
    ev = signals(spark, d, b).select("symbol", "bar_idx", F.when(F.col("tier") == "B", -1).otherwise(1).alias("direction"), "close", "atr")
    return L.directional_exit(ev, b, 2.0, 1.0, 24, penetration=0.2).select(
        "symbol", "bar_idx", "outcome", rnd("realized_atr").alias("realized_atr"), "exit_bar", rnd("stop_slip_atr").alias("stop_slip_atr"))


@query("drop_after_signal", "E04", f"""WITH RECURSIVE {SIGNALS_SQL}
SELECT s.symbol, s.bar_idx, min(b.bar_idx - s.bar_idx) FILTER (WHERE s.atr > 0 AND b.low <= s.close - 0.5 * s.atr) AS delay_bars,
   CASE WHEN count(*) FILTER (WHERE s.atr > 0 AND b.low <= s.close - 0.5 * s.atr) > 0 THEN 1 ELSE 0 END AS success
FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx + 1 AND s.bar_idx + 12 GROUP BY s.symbol, s.bar_idx""")
def _(spark, d):
    b = bars_table(spark, d)
    ev = signals(spark, d, b).select("symbol", "bar_idx", "close", "atr")
    return L.drop_touch(ev, b, 0.5, 12).select("symbol", "bar_idx", "delay_bars", F.col("success").cast("int").alias("success"))


RATIOS = {"tp1": 1.5, "tp2": 3.0, "tp3": 4.5, "sl": 1.5}
WEIGHTS = {"tp1": 1.0, "tp2": 2.5, "tp3": 5.0, "sl": 0.5}


@query("three_tier_labels", "E05", f"""WITH RECURSIVE {SIGNALS_SQL},
e AS (SELECT symbol, bar_idx, close, CASE WHEN tier = 'A' THEN 1 ELSE -1 END AS dir, least(atr / greatest(close, 1e-8) * 100, 10.0) / 100 AS base FROM sig),
lv AS (SELECT *, close * (1 + dir * base * 1.5) AS p1, close * (1 + dir * base * 3.0) AS p2, close * (1 + dir * base * 4.5) AS p3, close * (1 - dir * base * 1.5) AS ps FROM e),
h AS (SELECT lv.*, b.bar_idx - lv.bar_idx AS off, b.high AS h, b.low AS l FROM lv JOIN bars b ON b.symbol = lv.symbol AND b.bar_idx BETWEEN lv.bar_idx + 1 AND lv.bar_idx + 24),
g AS (SELECT symbol, bar_idx, close, dir, p3, coalesce(min(off) FILTER (WHERE CASE WHEN dir = 1 THEN h >= p1 ELSE l <= p1 END), 1000) AS t1,
   coalesce(min(off) FILTER (WHERE CASE WHEN dir = 1 THEN h >= p2 ELSE l <= p2 END), 1000) AS t2,
   coalesce(min(off) FILTER (WHERE CASE WHEN dir = 1 THEN h >= p3 ELSE l <= p3 END), 1000) AS t3,
   coalesce(min(off) FILTER (WHERE CASE WHEN dir = 1 THEN l <= ps ELSE h >= ps END), 1000) AS ts FROM h GROUP BY ALL),
m AS (SELECT g.symbol, g.bar_idx, max(CASE WHEN h.dir = 1 THEN h.h ELSE -h.l END) AS reach FROM g JOIN h ON h.symbol = g.symbol AND h.bar_idx = g.bar_idx AND h.off <= g.ts GROUP BY ALL),
r AS (SELECT g.*, greatest(reach, dir * close) * dir AS best, CASE WHEN ts < 1000 AND ts <= least(t1, t2, t3) THEN 'SL' WHEN ts < 1000 AND t1 < ts THEN 'TP1'
   WHEN t3 < 1000 AND t3 < ts THEN 'TP3' WHEN t2 < 1000 AND t2 < ts THEN 'TP2' WHEN t1 < 1000 AND t1 < ts THEN 'TP1' ELSE 'NONE' END AS tier FROM g JOIN m USING (symbol, bar_idx))
SELECT symbol, bar_idx, tier, round(CASE tier WHEN 'SL' THEN 0.5 WHEN 'TP1' THEN 1.0 WHEN 'TP2' THEN 2.5 WHEN 'TP3' THEN least(20.0, 5.0 * greatest(1.0, (best - close) / (p3 - close))) ELSE 0.0 END, 6) AS weight,
   CASE tier WHEN 'SL' THEN 'wrong' WHEN 'NONE' THEN 'neutral' ELSE 'correct' END AS outcome FROM r""")
def _(spark, d):
    b = bars_table(spark, d)
    preds = signals(spark, d, b).select(
        "symbol", "bar_idx", "close", F.when(F.col("tier") == "A", 1).otherwise(-1).alias("direction"),
        (F.col("atr") / F.greatest(F.col("close"), F.lit(1e-8)) * 100).alias("magnitude"))
    return L.tier_label(preds, b, 24, RATIOS, WEIGHTS).select("symbol", "bar_idx", "tier", rnd("weight").alias("weight"), "outcome")
