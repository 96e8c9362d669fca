"""Outcome study over episodes: exits, grids and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import episodes as P
from barloom.operators import outcomes as O
from barloom.operators.aggregates import exact_quantiles, profit_factor
from barloom.plans.episodes import H, OUT_SQL, WARN_SQL, path, starts, warnings
from barloom.plans.events import SIGNALS_SQL
from barloom.plans.inputs import bars_table, rnd
from barloom.plans.registry import query
from barloom.session import settle

STOP_LIST = ", ".join(f"({s}::DOUBLE)" for s in O.STOPS)
# staged exit, one recursion step per bar; state columns mirror the rule's text
STAGED_SQL = f"""s0 AS MATERIALIZED (SELECT sig.symbol, sig.bar_idx AS start_bar, close AS entry, atr, score, tier, body_eff, x.sl FROM sig, (VALUES {STOP_LIST}) x(sl) WHERE atr > 0),
w0 AS (
  SELECT symbol, start_bar, sl, entry, atr, start_bar AS j, false AS done, false AS banked, entry AS peak, entry AS rstop, 0.0::DOUBLE AS realized, 'OPEN' AS label, entry AS tail FROM s0
  UNION ALL
  SELECT symbol, start_bar, sl, entry, atr, j, stopped OR idle OR trailed OR expired, banked OR banks,
    CASE WHEN banked THEN pk WHEN banks THEN greatest(entry + 2.0 * atr, h) ELSE peak END, CASE WHEN banked THEN rs ELSE rstop END,
    CASE WHEN stopped THEN -sl WHEN idle THEN (c - entry) / atr WHEN trailed THEN 1.0 + 0.5 * (rs - entry) / atr ELSE 1.0 + 0.5 * (c - entry) / atr END,
    CASE WHEN stopped THEN 'SL' WHEN idle THEN 'TIMEOUT' WHEN trailed OR expired THEN 'TP' ELSE 'OPEN' END, c
  FROM (SELECT *, (banked OR banks) AND NOT trailed AND j - start_bar >= 36 AS expired FROM (
    SELECT *, NOT banked AND NOT stopped AND NOT banks AND j - start_bar >= 24 AS idle, banked AND l <= rs AS trailed FROM (
    SELECT *, NOT banked AND NOT stopped AND h >= entry + 2.0 * atr AS banks, greatest(rstop, pk - 1.5 * atr) AS rs FROM (
    SELECT w.symbol, w.start_bar, w.sl, w.entry, w.atr, b.bar_idx AS j, w.banked, w.peak, w.rstop, b.high AS h, b.low AS l, b.close AS c, greatest(w.peak, b.high) AS pk,
      NOT w.banked AND b.low <= w.entry - w.sl * w.atr AS stopped
    FROM w0 w JOIN bars b ON b.symbol = w.symbol AND b.bar_idx = w.j + 1 WHERE NOT w.done AND w.j < w.start_bar + 36))))),
so AS MATERIALIZED (SELECT symbol, start_bar, sl AS sl_atr, CASE WHEN label <> 'OPEN' THEN label WHEN banked THEN 'TP' ELSE 'TIMEOUT' END AS outcome,
   CASE WHEN label <> 'OPEN' THEN realized WHEN banked THEN 1.0 + 0.5 * (tail - entry) / atr ELSE (tail - entry) / atr END AS realized, j AS exit_bar
   FROM w0 WHERE j > start_bar QUALIFY row_number() OVER (PARTITION BY symbol, start_bar, sl ORDER BY j DESC) = 1)"""
RUNS_SQL = f"{OUT_SQL}, {STAGED_SQL}"


def staged(spark, d, b=None):
    b = bars_table(spark, d) if b is None else b
    return O.staged_outcomes(starts(spark, d, b), b)


@query("staged_exit_outcomes", "R08", f"""WITH RECURSIVE {SIGNALS_SQL}, {STAGED_SQL}
SELECT symbol, start_bar, sl_atr, outcome, round(realized, 5) AS realized, exit_bar FROM so""")
def _(spark, d):
    return staged(spark, d).select("symbol", "start_bar", "sl_atr", "outcome", rnd("realized", 5).alias("realized"), "exit_bar")


@query("adaptive_exit_sweep", "R09 R10")
def _(spark, d):
    b = bars_table(spark, d)
    out = O.adaptive_outcomes(starts(spark, d, b), P.bar_context(b), pre=48, post=48)
    return out.select("symbol", "start_bar", "sl_atr", "outcome", rnd("realized", 5).alias("realized"), "exit_bar", rnd("stop_slip_atr", 5).alias("stop_slip_atr"),
                      "banked", rnd("max_drawdown", 5).alias("max_drawdown"))


GRID_SQL = ", ".join(f"({b}::DOUBLE, {f}::DOUBLE, {t}::DOUBLE, {r}::DOUBLE, {s}::DOUBLE)" for b, f, t, r, s in O.grid_rows(24, 48))
MATRIX_SQL = f"""gs AS MATERIALIZED (SELECT sig.symbol, sig.bar_idx AS sb, close AS e, greatest(atr, 1e-12) AS a, g.* FROM sig, (VALUES {GRID_SQL}) g(bank, frac, act, trail, sl)),
gw AS (
  SELECT symbol, sb, bank, frac, act, trail, sl, e, a, sb AS j, false AS done, false AS banked, e AS peak, e - sl * a AS lvl, 0.0::DOUBLE AS val, 'TIMEOUT' AS label, 0.0::DOUBLE AS dd FROM gs
  UNION ALL
  SELECT symbol, sb, bank, frac, act, trail, sl, e, a, j, stopped OR late, banked OR hit, top, lv,
    CASE WHEN banked OR hit THEN bank * frac + (1 - frac) * (CASE WHEN stopped THEN fill ELSE c END - e) / a ELSE (CASE WHEN stopped THEN fill ELSE c END - e) / a END,
    CASE WHEN stopped THEN CASE WHEN banked THEN 'TP' ELSE 'SL' END ELSE 'TIMEOUT' END, dd
  FROM (SELECT *, NOT hit AND NOT stopped AND j - sb >= CASE WHEN banked THEN 72 ELSE 24 END AS late, greatest(eff - least(o - eff, 0.25 * a), l) AS fill FROM (
    SELECT *, NOT hit AND l <= lv - 0.2 * a AS stopped, lv - 0.2 * a AS eff FROM (
    SELECT *, CASE WHEN hit THEN top - trail * a WHEN banked THEN greatest(lvl, top - trail * a) ELSE lvl END AS lv FROM (
    SELECT *, CASE WHEN banked OR hit THEN greatest(peak, c) ELSE peak END AS top FROM (
    SELECT w.symbol, w.sb, w.bank, w.frac, w.act, w.trail, w.sl, w.e, w.a, b.bar_idx AS j, w.banked, w.peak, w.lvl, b.open AS o, b.low AS l, b.close AS c,
      NOT w.banked AND b.high >= w.e + w.bank * w.a AS hit, greatest(w.dd, (w.e - b.low) / w.a) AS dd
    FROM gw w JOIN bars b ON b.symbol = w.symbol AND b.bar_idx = w.j + 1 WHERE NOT w.done AND w.j < w.sb + 72)))))),
gx AS (SELECT * FROM gw WHERE j > sb QUALIFY row_number() OVER (PARTITION BY symbol, sb, bank, frac, act, trail, sl ORDER BY j DESC) = 1),
dm AS MATERIALIZED (SELECT bank AS bank_atr, frac AS bank_fraction, act AS trail_activate_atr, trail AS runner_trail_atr, sl AS sl_atr, count(*) AS count, count(*) FILTER (WHERE label = 'TP') AS tp_count,
   count(*) FILTER (WHERE label = 'SL') AS sl_count, count(*) FILTER (WHERE label = 'TIMEOUT') AS timeout_count, sum(val) / count(*) AS expectancy_atr,
   coalesce(sum(val) FILTER (WHERE val > 0) / nullif(-sum(val) FILTER (WHERE val < 0), 0), 'inf'::DOUBLE) AS weighted_pf, sum(val) AS sum_realized_atr, avg(dd) AS avg_trade_drawdown_atr, max(dd) AS max_trade_drawdown_atr FROM gx GROUP BY ALL)"""


def matrix(spark, d, b):
    return O.decision_matrix(starts(spark, d, b), b, 24, 48)


@query("exit_decision_matrix", "A07 J18", f"""WITH RECURSIVE {SIGNALS_SQL}, {MATRIX_SQL}
SELECT bank_atr, bank_fraction, trail_activate_atr, runner_trail_atr, sl_atr, count, tp_count, sl_count, timeout_count, round(expectancy_atr, 5) AS expectancy_atr, round(weighted_pf, 5) AS weighted_pf,
  round(sum_realized_atr, 4) AS sum_realized_atr, round(avg_trade_drawdown_atr, 5) AS avg_trade_drawdown_atr, round(max_trade_drawdown_atr, 5) AS max_trade_drawdown_atr FROM dm""")
def _(spark, d):
    r = {"sum_realized_atr": 4}
    m = matrix(spark, d, bars_table(spark, d))
    return m.select(*[rnd(c, r.get(c, 5)).alias(c) if c in ("expectancy_atr", "weighted_pf", "sum_realized_atr", "avg_trade_drawdown_atr", "max_trade_drawdown_atr") else F.col(c) for c in m.columns])


BUCKET_SQL = """CASE WHEN max_runup_atr < 0 THEN '<0' WHEN max_runup_atr < 1 THEN '0-1' WHEN max_runup_atr < 3 THEN '1-3' WHEN max_runup_atr < 5 THEN '3-5' WHEN max_runup_atr < 10 THEN '5-10' ELSE '>=10' END"""
ROWS_SQL = f"""{RUNS_SQL},
gp AS (SELECT symbol, start_bar, start_bar - lag(start_bar) OVER (PARTITION BY symbol ORDER BY start_bar) AS prior_gap FROM st),
rr AS MATERIALIZED (SELECT o.*, s.outcome, s.realized, {BUCKET_SQL} AS outcome_bucket,
   CASE WHEN score >= 99 THEN '99+' WHEN score >= 95 THEN '95-99' WHEN score >= 90 THEN '90-95' WHEN score >= 80 THEN '80-90' ELSE '<80' END AS score_band,
   CASE WHEN prior_gap <= 48 THEN 'chain' ELSE 'solo' END AS gap_bucket,
   CASE WHEN close_pos_at_entry >= 0.75 THEN 'bull' WHEN close_pos_at_entry >= 0.5 THEN 'range-up' WHEN close_pos_at_entry >= 0.25 THEN 'range-down' ELSE 'bear' END AS regime_bucket
   FROM outc o JOIN so s USING (symbol, start_bar) JOIN gp USING (symbol, start_bar) WHERE s.sl_atr = 2.0)"""


def report_rows(spark, d, b):
    """Outcome rows with the baseline stop's result and all bucket columns."""
    st = settle(starts(spark, d, b), "starts")
    wide = P.outcome_rows(P.episode_path(st, P.bar_context(b), H))
    gaps = P.prior_gap(st.select("symbol", "start_bar"), 512)
    base = O.staged_outcomes(st, b, stops=(2.0,)).select("symbol", "start_bar", "outcome", "realized")
    x = O.with_buckets(wide.join(gaps, P.EP).join(base, P.EP))
    return settle(x.withColumn("regime_bucket", P.regime_bucket(F.col("close_pos_at_entry"))), "outcomes")


_QS = [(m, q) for m, qs in O.MEASURES.items() for q in qs]
STAT_SQL = ", ".join([
    "count(*) AS count", *[f"count(*) FILTER (WHERE outcome = '{o}') AS {o.lower()}_count" for o in ("TP", "SL", "TIMEOUT")],
    "round(CASE WHEN coalesce(sum(realized) FILTER (WHERE realized < 0), 0) = 0 THEN CASE WHEN coalesce(sum(realized) FILTER (WHERE realized > 0), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE coalesce(sum(realized) FILTER (WHERE realized > 0), 0) / -sum(realized) FILTER (WHERE realized < 0) END, 5) AS weighted_pf",
    "round(avg(realized), 5) AS expectancy_atr", *[f"round(avg({m}), 4) AS {m}_mean" for m in O.MEASURES], "round(max(max_mae_entry_atr), 4) AS max_mae_entry_max", "round(max(max_runup_atr), 4) AS max_runup_max",
    "round(avg(reversed_6) * 100, 4) AS reversed_rate", "round(avg(round_trip_12) * 100, 4) AS round_trip_rate", "round(avg(CAST(gap_bucket = 'chain' AS INT)) * 100, 4) AS chain_rate",
    *[f"round(quantile_cont({m}::DOUBLE, {q}), 4) AS {m}_{O.tag(q)}" for m, q in _QS]])
KINDS = ["outcome_bucket", "tier", "score_band", "hour_utc", "dow_utc", "regime_bucket", "gap_bucket"]


@query("outcome_bucket_stats", "A04 A05 A06", f"""WITH RECURSIVE {ROWS_SQL}, rx AS (SELECT * REPLACE (CAST(hour_utc AS VARCHAR) AS hour_utc, CAST(dow_utc AS VARCHAR) AS dow_utc) FROM rr)
SELECT CASE {' '.join(f"WHEN GROUPING({k}) = 0 THEN '{k}'" for k in KINDS)} ELSE 'overall' END AS bucket_type,
  CASE {' '.join(f"WHEN GROUPING({k}) = 0 THEN {k}" for k in KINDS)} ELSE 'all' END AS bucket_value, {STAT_SQL} FROM rx GROUP BY GROUPING SETS ((), {', '.join(f'({k})' for k in KINDS)})""")
def _(spark, d):
    s = O.bucket_stats(report_rows(spark, d, bars_table(spark, d)))
    fixed = {"bucket_type", "bucket_value", "count", "tp_count", "sl_count", "timeout_count"}
    return s.select(*[F.col(c) if c in fixed else rnd(c, 5 if c in ("weighted_pf", "expectancy_atr") else 4).alias(c) for c in s.columns])


@query("winner_survival_by_stop", "A08", f"""WITH RECURSIVE {RUNS_SQL}, j AS (SELECT so.*, {BUCKET_SQL} AS outcome_bucket FROM so JOIN outc USING (symbol, start_bar))
SELECT outcome_bucket, {', '.join(f"round(100 * avg(CAST(outcome <> 'SL' AS INT)) FILTER (WHERE sl_atr = {s}), 5) AS sl_{str(s).replace('.', 'p')}" for s in O.STOPS)} FROM j GROUP BY outcome_bucket""")
def _(spark, d):
    b = bars_table(spark, d)
    st = settle(starts(spark, d, b), "starts")
    run = P.episode_path(st, P.bar_context(b), H).groupBy(*P.EP).agg(P.outcome_bucket(F.max("runup_atr")).alias("outcome_bucket"))
    t = O.survival_table(O.staged_outcomes(st, b).join(run, P.EP))
    return t.select("outcome_bucket", *[rnd(F.col(f"`{s}`"), 5).alias(f"sl_{str(s).replace('.', 'p')}") for s in O.STOPS])


BCOL = {"<0": "lt0", "0-1": "b0_1", "1-3": "b1_3", "3-5": "b3_5", "5-10": "b5_10", ">=10": "ge10"}


@query("drawdown_heatmap", "A09 J05", f"""WITH RECURSIVE {OUT_SQL}, j AS (SELECT off, drawdown_atr, {BUCKET_SQL.replace('max_runup_atr', 'o.max_runup_atr')} AS k FROM pth p JOIN outc o USING (symbol, start_bar) WHERE off <= 24)
SELECT off, {', '.join(f"round(quantile_cont(drawdown_atr, 0.9) FILTER (WHERE k = '{k}'), 5) AS {v}" for k, v in BCOL.items())} FROM j GROUP BY off""")
def _(spark, d):
    p = path(spark, d)
    bucket = p.groupBy(*P.EP).agg(P.outcome_bucket(F.max("runup_atr")).alias("outcome_bucket"))
    t = O.drawdown_heatmap(p.join(bucket, P.EP, "left"), 24)
    return t.select("off", *[rnd(F.col(f"`{k}`"), 5).alias(v) for k, v in BCOL.items()])


@query("hour_of_week_outcome", "A10", f"""WITH RECURSIVE {ROWS_SQL}
SELECT CAST(d.range AS INT) AS dow_utc, {', '.join(f"round(sum(realized) FILTER (WHERE hour_utc = {h}), 5) AS h{h}" for h in range(24))} FROM range(7) d LEFT JOIN rr ON rr.dow_utc = d.range GROUP BY d.range""")
def _(spark, d):
    t = O.hour_of_week(report_rows(spark, d, bars_table(spark, d)), spark)
    return t.select("dow_utc", *[rnd(f"h{h}", 5).alias(f"h{h}") for h in range(24)])


PF_SQL = "CASE WHEN coalesce(sum(realized) FILTER (WHERE realized < 0), 0) = 0 THEN CASE WHEN coalesce(sum(realized) FILTER (WHERE realized > 0), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE coalesce(sum(realized) FILTER (WHERE realized > 0), 0) / -sum(realized) FILTER (WHERE realized < 0) END"


@query("tier_by_stop", "A11", f"""WITH RECURSIVE {SIGNALS_SQL}, {STAGED_SQL}
SELECT s.tier, so.sl_atr, count(*) AS count, round(avg(realized), 5) AS expectancy_atr, round({PF_SQL}, 5) AS weighted_pf FROM so JOIN sig s ON s.symbol = so.symbol AND s.bar_idx = so.start_bar GROUP BY ALL""")
def _(spark, d):
    return staged(spark, d).groupBy("tier", "sl_atr").agg(
        F.count(F.lit(1)).alias("count"), rnd(F.avg("realized"), 5).alias("expectancy_atr"), rnd(profit_factor("realized"), 5).alias("weighted_pf"))


@query("outcome_report_slices", "A12", f"""WITH RECURSIVE {ROWS_SQL}
SELECT 'gap' AS slice, gap_bucket AS value, count(*) AS n, round(avg(realized), 5) AS metric, round(sum(realized), 5) AS total FROM rr GROUP BY gap_bucket
UNION ALL SELECT 'regime', regime_bucket, count(*), round(avg(realized), 5), round(sum(realized), 5) FROM rr GROUP BY regime_bucket
UNION ALL SELECT 'fake_by_tier', tier, count(*), round(avg(reversed_6) * 100, 5), NULL FROM rr GROUP BY tier
UNION ALL SELECT 'fake_by_score', score_band, count(*), round(avg(reversed_6) * 100, 5), NULL FROM rr GROUP BY score_band
UNION ALL (SELECT 'symbol', symbol, count(*), round(avg(realized), 5), round(sum(realized), 5) FROM rr GROUP BY symbol ORDER BY sum(realized) DESC LIMIT 20)""")
def _(spark, d):
    sets = [("gap", "gap_bucket"), ("regime", "regime_bucket"), ("fake_by_tier", "tier"), ("fake_by_score", "score_band"), ("symbol", "symbol")]
    r = report_rows(spark, d, bars_table(spark, d)).withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(k).alias("slice"), F.col(c).alias("value")) for k, c in sets])))
    g = r.groupBy("_s.slice", "_s.value").agg(F.count(F.lit(1)).alias("n"), F.avg("realized").alias("mean"), F.sum("realized").alias("sum"), F.avg("reversed_6").alias("fake"))
    fake = F.col("slice").startswith("fake")
    out = g.select("slice", "value", "n", rnd(F.when(fake, F.col("fake") * 100).otherwise(F.col("mean")), 5).alias("metric"),
                   F.when(~fake, rnd("sum", 5)).alias("total"), F.col("sum").alias("_sum"))
    top = out.filter(F.col("slice") == "symbol").orderBy(F.desc("_sum")).limit(20)
    return out.filter(F.col("slice") != "symbol").unionByName(top).drop("_sum")


@query("warning_efficacy", "A13", f"""WITH RECURSIVE {WARN_SQL}, {STAGED_SQL}, fw AS (SELECT symbol, start_bar, min(bar_idx) AS wb, arg_min(no, bar_idx) AS px FROM warn GROUP BY ALL),
pk AS (SELECT s.symbol, s.bar_idx AS start_bar, arg_max(b.bar_idx, (b.high, -b.bar_idx)) AS peak_bar FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx AND s.bar_idx + 24 GROUP BY ALL)
SELECT count(*) AS warning_rows, round(avg(so.realized), 5) AS current_expectancy, round(avg((px - s.close) / s.atr), 5) AS warning_expectancy, round(quantile_cont((wb - peak_bar)::DOUBLE, 0.5), 5) AS median_delay
FROM fw JOIN so USING (symbol, start_bar) JOIN sig s ON s.symbol = fw.symbol AND s.bar_idx = fw.start_bar JOIN pk ON pk.symbol = fw.symbol AND pk.start_bar = fw.start_bar WHERE so.sl_atr = 2.0""")
def _(spark, d):
    from barloom.operators.labels import forward_bars
    b = bars_table(spark, d)
    st = settle(starts(spark, d, b), "starts")
    base = O.staged_outcomes(st, b, stops=(2.0,))
    peak = forward_bars(st.select(*P.EP), b, 24, ["high"], first=0, at="start_bar").groupBy(*P.EP).agg(
        F.max_by("off", F.struct("f_high", (-F.col("off")).alias("o"))).alias("peak_off"))
    j = (P.earliest_warning(warnings(spark, d, b)).join(base, P.EP).join(peak, P.EP)
         .select("realized", ((F.col("warning_exit_price") - F.col("close")) / F.col("atr")).alias("wx"),
                 (F.col("warning_bar") - F.col("start_bar") - F.col("peak_off")).cast("double").alias("delay")))
    mid = exact_quantiles(j, [], "delay", [0.5]).select(F.col("value_at_q"))
    return j.agg(F.count(F.lit(1)).alias("warning_rows"), rnd(F.avg("realized"), 5).alias("current_expectancy"), rnd(F.avg("wx"), 5).alias("warning_expectancy")).withColumn(
        "median_delay", rnd(mid.scalar(), 5))


@query("exit_recommendations", "A14 P08", f"""WITH RECURSIVE {OUT_SQL}, {MATRIX_SQL},
wn AS (SELECT quantile_cont(max_mae_entry_atr, 0.9) AS a, quantile_cont(bars_to_runup_atr_3::DOUBLE, 0.5) AS b, quantile_cont(time_to_peak::DOUBLE, 0.9) AS c, quantile_cont(max_mae_entry_atr, 0.5) AS v FROM outc WHERE max_runup_atr >= 3),
bs AS (SELECT * FROM dm ORDER BY round(expectancy_atr, 9) DESC, round(weighted_pf, 9) DESC, round(sum_realized_atr, 9) DESC, bank_atr, bank_fraction, trail_activate_atr, runner_trail_atr, sl_atr LIMIT 1)
SELECT (SELECT x FROM (VALUES {', '.join(f'({s}::DOUBLE)' for s in O.STOPS)}) t(x) ORDER BY abs(x - a), x LIMIT 1) AS sl_atr, bs.bank_atr, bs.bank_fraction, bs.trail_activate_atr, bs.runner_trail_atr,
  (SELECT x FROM (VALUES (12), (18), (24)) t(x) ORDER BY abs(x - b), x LIMIT 1) AS max_bars_pre_bank, (SELECT x FROM (VALUES (24), (36), (48)) t(x) ORDER BY abs(x - c), x LIMIT 1) AS max_bars_post_bank, round(v, 5) AS mae_veto_atr FROM wn, bs""")
def _(spark, d):
    b = bars_table(spark, d)
    st = settle(starts(spark, d, b), "starts")
    rows = P.outcome_rows(P.episode_path(st, P.bar_context(b), H))
    m = matrix(spark, d, b)
    near = m.withColumns({c: F.round(c, 9) for c in ("expectancy_atr", "weighted_pf", "sum_realized_atr")})
    return O.recommendations(rows, near).withColumn("mae_veto_atr", rnd("mae_veto_atr", 5))


@query("trades_with_episode_summary", "J04", f"""WITH RECURSIVE {OUT_SQL}, {STAGED_SQL}
SELECT so.symbol, so.start_bar, so.outcome, round(so.realized, 5) AS realized, round(o.max_runup_atr, 4) AS max_runup_atr_episode, o.time_to_peak AS time_to_peak_episode
FROM so LEFT JOIN outc o ON o.symbol = so.symbol AND o.start_bar = so.start_bar AND o.max_runup_atr >= 1 WHERE so.sl_atr = 1.0""")
def _(spark, d):
    b = bars_table(spark, d)
    st = settle(starts(spark, d, b), "starts")
    trades = O.staged_outcomes(st, b, stops=(1.0,)).select(*P.EP, "outcome", rnd("realized", 5).alias("realized"))
    s = P.episode_summary(P.episode_path(st, P.bar_context(b), H)).filter(F.col("max_runup_atr") >= 1)
    return trades.join(s.select(*P.EP, rnd("max_runup_atr", 4).alias("max_runup_atr_episode"), F.col("time_to_peak").alias("time_to_peak_episode")), P.EP, "left")


@query("signal_summary_by_tier", "A21 A22", f"""WITH RECURSIVE {SIGNALS_SQL}, {STAGED_SQL}, j AS (SELECT so.*, s.tier FROM so JOIN sig s ON s.symbol = so.symbol AND s.bar_idx = so.start_bar WHERE sl_atr = 0.8)
SELECT coalesce(symbol, '*') AS symbol, coalesce(tier, '*') AS tier, count(*) AS n, count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'SL') AS sl,
  round(100.0 * count(*) FILTER (WHERE outcome = 'TP') / nullif(count(*) FILTER (WHERE outcome IN ('TP', 'SL')), 0), 5) AS decided_accuracy, round(avg(realized), 5) AS expectancy, round({PF_SQL}, 5) AS profit_factor,
  round(avg(exit_bar - start_bar), 5) AS mean_hold, round(quantile_cont((exit_bar - start_bar)::DOUBLE, 0.5), 5) AS median_hold FROM j GROUP BY ROLLUP (symbol, tier)""")
def _(spark, d):
    b = bars_table(spark, d)
    x = O.staged_outcomes(starts(spark, d, b), b, stops=(0.8,)).withColumn("hold", (F.col("exit_bar") - F.col("start_bar")).cast("double"))
    # the three roll-up levels as rows, so that the median can share the same keys
    star = F.lit("*")
    levels = F.array(F.struct(F.col("symbol").alias("a"), F.col("tier").alias("b")), F.struct(F.col("symbol").alias("a"), star.alias("b")), F.struct(star.alias("a"), star.alias("b")))
    r = x.select(F.explode(levels).alias("_l"), "outcome", "realized", "hold").select(F.col("_l.a").alias("symbol"), F.col("_l.b").alias("tier"), "outcome", "realized", "hold")
    tp, sl = F.count_if(F.col("outcome") == "TP"), F.count_if(F.col("outcome") == "SL")
    agg = r.groupBy("symbol", "tier").agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), sl.alias("sl"), rnd(F.try_divide(100.0 * tp, tp + sl), 5).alias("decided_accuracy"),
                                          rnd(F.avg("realized"), 5).alias("expectancy"), rnd(profit_factor("realized"), 5).alias("profit_factor"), rnd(F.avg("hold"), 5).alias("mean_hold"))
    mid = exact_quantiles(r, ["symbol", "tier"], "hold", [0.5]).select("symbol", "tier", rnd("value_at_q", 5).alias("median_hold"))
    return agg.join(mid, ["symbol", "tier"])
