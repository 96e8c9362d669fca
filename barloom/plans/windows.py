"""Window-frame operators over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators.series import carry_last, cusum, ema, ema_chunk, ema_halo, over_chunks, wilder
from barloom.plans.inputs import BARS_SQL, bars, rnd
from barloom.plans.registry import query

KEY = ["symbol", "bar_idx"]
W = "PARTITION BY symbol ORDER BY bar_idx"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query("rolling_mean_std", "W01 W02", f"""WITH {BARS_SQL}
SELECT symbol, bar_idx, round(avg(close) OVER {last(20)}, 6) AS mean20,
       CASE WHEN bar_idx >= 19 THEN round(stddev_pop(close) OVER {last(20)}, 6) ELSE 0.0 END AS std20
FROM bars""")
def _(spark, d):
    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", rnd(R.rolling_mean("close", 20, f)).alias("mean20"),
        rnd(R.rolling_std_pop("close", 20, f)).alias("std20")), back=19)


@query("volume_ratios", "W03 W07", f"""WITH {BARS_SQL},
v AS (SELECT *, CASE WHEN bar_idx >= 20 THEN avg(volume) OVER {prior(20)} ELSE 0.0 END AS base FROM bars)
SELECT symbol, bar_idx, round(base, 6) AS vol_avg20,
       round(CASE WHEN base > 0 THEN volume / base ELSE 1.0 END, 6) AS vol_ratio,
       round(CASE WHEN bar_idx >= 49 THEN volume / nullif(avg(volume) OVER {last(50)}, 0) END, 6) AS vol_anomaly
FROM v""")
def _(spark, d):
    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", rnd(R.prior_mean("volume", 20, f)).alias("vol_avg20"),
        rnd(R.volume_ratio(f)).alias("vol_ratio"), rnd(R.volume_anomaly(f)).alias("vol_anomaly")), back=50)


TR_SQL = f"""tr AS (
  SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr
  FROM bars)"""


@query("atr_simple", "W05", f"""WITH {BARS_SQL}, {TR_SQL}
SELECT symbol, bar_idx, round(tr, 6) AS tr,
       round(CASE WHEN bar_idx >= 13 THEN avg(tr) OVER {last(14)} END, 6) AS atr,
       round(CASE WHEN bar_idx >= 13 THEN avg(tr) OVER {last(14)} END / (close + 1e-8), 6) AS atr_pct
FROM tr""")
def _(spark, d):
    def build(x, f):
        x = x.withColumn("tr", R.true_range(f)).withColumn("atr", R.atr_sma(f))
        return x.select(*KEY, "_chunk", rnd("tr").alias("tr"), rnd("atr").alias("atr"),
                        rnd(F.col("atr") / (F.col("close") + R.EPS)).alias("atr_pct"))
    return over_chunks(bars(spark, d), build, back=15)


@query("bollinger_bands", "W06", f"""WITH {BARS_SQL},
b AS (SELECT *, avg(close) OVER {last(20)} AS m, stddev_pop(close) OVER {last(20)} AS sp,
             stddev_samp(close) OVER {last(20)} AS ss FROM bars)
SELECT symbol, bar_idx,
       CASE WHEN bar_idx >= 19 THEN round(m + 2 * sp, 6) ELSE 0.0 END AS upper_pop,
       CASE WHEN bar_idx >= 19 THEN round(m - 2 * sp, 6) ELSE 0.0 END AS lower_pop,
       CASE WHEN bar_idx >= 19 AND sp > 0 THEN round((close - m) / (4 * sp + 1e-8), 6) ELSE 0.5 END AS position_pop,
       CASE WHEN bar_idx >= 19 THEN round(m + 2 * ss, 6) END AS upper_samp,
       CASE WHEN bar_idx >= 19 THEN round(4 * ss / nullif(m, 0), 6) END AS width_samp
FROM b""")
def _(spark, d):
    def build(x, f):
        up, mid, lo = R.bollinger_pop("close", 20, 2.0, f)
        us, ms, ls = R.bollinger_samp("close", 20, 2.0, f)
        return x.select(*KEY, "_chunk", rnd(up).alias("upper_pop"), rnd(lo).alias("lower_pop"),
                        F.when(up - lo > 0, rnd((F.col("close") - mid) / (up - lo + R.EPS))).otherwise(0.5).alias("position_pop"),
                        rnd(us).alias("upper_samp"), rnd(F.try_divide(us - ls, ms)).alias("width_samp"))
    return over_chunks(bars(spark, d), build, back=19)


CUSUM_SQL = f"""ret AS (
  SELECT *, coalesce(close / nullif(lag(close) OVER ({W}), 0) - 1, 0) AS r FROM bars),
walk AS (SELECT *, sum(r) OVER ({W}) AS s FROM ret),
cus AS (SELECT *, s - least(0, min(s) OVER ({W})) AS cusum_pos, s - greatest(0, max(s) OVER ({W})) AS cusum_neg FROM walk)"""


@query("cusum_filter", "W08", f"""WITH {BARS_SQL}, {CUSUM_SQL}
SELECT symbol, bar_idx, round(cusum_pos, 6) AS cusum_pos, round(cusum_neg, 6) AS cusum_neg FROM cus""")
def _(spark, d):
    b = over_chunks(bars(spark, d), lambda x, f: x.withColumn("ret", R.simple_return(f)), back=1)
    return cusum(b, F.col("ret"), size=256).select(*KEY, rnd("cusum_pos").alias("cusum_pos"), rnd("cusum_neg").alias("cusum_neg"))


def log_ratio(k: int) -> str:
    return (f"CASE WHEN bar_idx >= {k} THEN ln(greatest(close, 1e-12) / "
            f"greatest(lag(close, {k}) OVER ({W}), 1e-12)) / {k} END")


@query("momentum_returns", "W09", f"""WITH {BARS_SQL}
SELECT symbol, bar_idx,
       round(close / nullif(lag(close, 5) OVER ({W}), 0) - 1, 6) AS mom5,
       round(close / nullif(lag(close, 10) OVER ({W}), 0) - 1, 6) AS mom10,
       round(close / nullif(lag(close, 20) OVER ({W}), 0) - 1, 6) AS mom20,
       round(close / nullif(lag(close, 50) OVER ({W}), 0) - 1, 6) AS mom50,
       round({log_ratio(1)}, 6) AS lr1, round({log_ratio(12)}, 6) AS lr12, round({log_ratio(48)}, 6) AS lr48
FROM bars""")
def _(spark, d):
    def log_k(f, k):
        return F.when(F.col("bar_idx") >= k, R.log_return(f, k))

    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", *[rnd(R.simple_return(f, k)).alias(f"mom{k}") for k in (5, 10, 20, 50)],
        rnd(log_k(f, 1)).alias("lr1"), rnd(log_k(f, 12) / 12).alias("lr12"), rnd(log_k(f, 48) / 48).alias("lr48")), back=50)


@query("volatility_mean_shift", "W10", f"""WITH {BARS_SQL},
r AS (SELECT *, coalesce((close - lag(close) OVER ({W})) / (lag(close) OVER ({W}) + 1e-8), 0) AS ret FROM bars)
SELECT symbol, bar_idx,
       CASE WHEN bar_idx >= 19 THEN round(stddev_pop(ret) OVER {last(20)}, 6) ELSE 0.0 END AS volatility,
       round((close - avg(close) OVER {last(50)}) / ((CASE WHEN bar_idx >= 10 THEN stddev_pop(close) OVER {last(50)} ELSE 1e-8 END) + 1e-8), 4) AS mean_shift,
       round(volume / (avg(volume) OVER {last(20)} + 1e-8), 6) AS volume_ratio
FROM r""")
def _(spark, d):
    def build(x, f):
        prev = f.lag("close")
        x = x.withColumn("ret", F.coalesce((F.col("close") - prev) / (prev + R.EPS), F.lit(0.0)))
        return x.select(*KEY, "_chunk", rnd(R.rolling_std_pop("ret", 20, f)).alias("volatility"),
                        rnd(R.mean_shift(f), 4).alias("mean_shift"),
                        rnd(F.col("volume") / (R.rolling_mean("volume", 20, f) + R.EPS)).alias("volume_ratio"))
    return over_chunks(bars(spark, d), build, back=50)


@query("atr_percentile_rank", "W11 W12", f"""WITH {BARS_SQL}, {TR_SQL},
a AS (SELECT *, avg(tr) OVER {last(14)} AS atr, high - low AS span FROM tr),
s AS (SELECT *, list(CASE WHEN bar_idx >= 14 AND (bar_idx - 14) % 5 = 0 THEN atr END) OVER {last(240)} AS atrs,
             list(span) OVER {last(100)} AS spans FROM a)
SELECT symbol, bar_idx,
       CASE WHEN bar_idx >= 99 THEN round(len(list_filter(atrs, lambda x: x <= atr)) / greatest(len(list_filter(atrs, lambda x: x IS NOT NULL)), 1), 6) ELSE 0.5 END AS atr_percentile,
       round(len(list_filter(spans, lambda x: x <= span)) / len(spans), 6) AS range_rank
FROM s""")
def _(spark, d):
    def build(x, f):
        x = x.withColumn("tr", R.true_range(f)).withColumn("atr", F.avg("tr").over(f.last(14)))
        x = x.withColumn("atr_percentile", rnd(R.atr_percentile("atr", f)))
        return x.select(*KEY, "_chunk", "atr_percentile", rnd(R.range_rank(f)).alias("range_rank"))
    return over_chunks(bars(spark, d), build, back=254)


@query("slope_and_fit", "W13", f"""WITH {BARS_SQL},
s AS (SELECT *, regr_slope(close, bar_idx) OVER {last(5)} AS slope, covar_pop(bar_idx, close) OVER {last(10)} AS cov,
             var_pop(bar_idx) OVER {last(10)} AS vx, var_pop(close) OVER {last(10)} AS vy FROM bars)
SELECT symbol, bar_idx, CASE WHEN bar_idx >= 4 THEN round(slope, 6) ELSE 0.0 END AS slope5,
       CASE WHEN bar_idx >= 9 THEN round(least(coalesce(cov * cov / nullif(vx * vy, 0), 0), 1) * CASE WHEN cov >= 0 THEN 1 ELSE -1 END, 6) END AS fit10
FROM s""")
def _(spark, d):
    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", rnd(R.rolling_slope("close", f)).alias("slope5"), rnd(R.signed_r2("close", f)).alias("fit10")), back=9)


@query("forward_fill_series", "W14", f"""WITH {BARS_SQL},
g AS (SELECT *, CASE WHEN trades >= 5 THEN close END AS x FROM bars)
SELECT symbol, bar_idx, round(coalesce(last_value(x IGNORE NULLS) OVER ({W}), 0.5), 6) AS filled,
       round(coalesce(last_value(x IGNORE NULLS) OVER {last(24)}, 0.5), 6) AS filled24
FROM g""")
def _(spark, d):
    b = over_chunks(
        bars(spark, d).withColumn("x", F.when(F.col("trades") >= 5, F.col("close"))),
        lambda x, f: x.withColumn("filled24", rnd(R.forward_fill("x", f, 24, 0.5))), back=23)
    return carry_last(b, "x", ["symbol"], ["bar_idx"], F.floor(F.col("bar_idx") / 256), "near").select(
        *KEY, rnd(F.coalesce("near", F.lit(0.5))).alias("filled"), "filled24")


@query("stochastic_oscillator", "W15", f"""WITH {BARS_SQL},
k AS (SELECT *, CASE WHEN bar_idx >= 13 THEN coalesce(100.0 * (close - min(low) OVER {last(14)}) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0), 50.0) ELSE 50.0 END AS k FROM bars)
SELECT symbol, bar_idx, round(k, 6) AS k, round(CASE WHEN bar_idx >= 15 THEN avg(k) OVER {last(3)} ELSE k END, 6) AS d FROM k""")
def _(spark, d):
    def build(x, f):
        x = x.withColumn("k", R.stochastic_k(f))
        return x.select(*KEY, "_chunk", rnd("k").alias("k"), rnd(R.stochastic_d("k", f)).alias("d"))
    return over_chunks(bars(spark, d), build, back=15)


@query("support_resistance_levels", "W16 W17", f"""WITH {BARS_SQL},
s AS (SELECT *, max(high) OVER {prior(50)} AS hi, min(low) OVER {prior(50)} AS lo FROM bars)
SELECT symbol, bar_idx,
       CASE WHEN bar_idx >= 96 THEN round(quantile_cont(low, 0.1) OVER {prior(96)}, 6) END AS support,
       CASE WHEN bar_idx >= 96 THEN round(quantile_cont(high, 0.9) OVER {prior(96)}, 6) END AS resistance,
       round(hi, 6) AS range_high, round(lo, 6) AS range_low,
       CASE WHEN hi - lo >= 1e-8 THEN round((close - lo) / (hi - lo), 6) END AS range_pos
FROM s""")
def _(spark, d):
    def build(x, f):
        sup, res = R.support_resistance(f)
        hi, lo, pos = R.range_position(f)
        return x.select(*KEY, "_chunk", rnd(sup).alias("support"), rnd(res).alias("resistance"),
                        rnd(hi).alias("range_high"), rnd(lo).alias("range_low"), rnd(pos).alias("range_pos"))
    return over_chunks(bars(spark, d), build, back=96)


@query("candle_anatomy", "W18 W19", f"""WITH {BARS_SQL},
c AS (SELECT *, close - open AS body, high - low AS rng, greatest(high - low, 1e-12) AS span,
             CASE WHEN bar_idx >= 20 THEN avg(abs(close - open)) OVER {prior(20)} END AS prior_body FROM bars)
SELECT symbol, bar_idx, round(body, 6) AS body, round(rng, 6) AS candle_range, round(body / span, 6) AS body_eff,
       round((close - low) / span, 6) AS close_pos, round((high - greatest(open, close)) / span, 6) AS upper_wick,
       round(prior_body, 6) AS prior_body, round(body / nullif(prior_body, 0), 6) AS body_ratio,
       CASE WHEN prior_body / greatest(open, 1e-12) * 100 < 40 THEN 1 WHEN prior_body IS NOT NULL THEN 0 END AS quiet
FROM c""")
def _(spark, d):
    def build(x, f):
        x = x.withColumns(R.candle()).withColumn("prior_body", R.prior_body(f))
        return x.select(*KEY, "_chunk", *[rnd(c).alias(c) for c in R.candle()], rnd("prior_body").alias("prior_body"),
                        rnd(F.try_divide("body", "prior_body")).alias("body_ratio"),
                        (F.col("prior_body") / F.greatest(F.col("open"), F.lit(1e-12)) * 100 < 40).cast("int").alias("quiet"))
    return over_chunks(bars(spark, d), build, back=20)


@query("vpin_measures", "W20 W21", f"""WITH {BARS_SQL},
s AS (SELECT *, coalesce(close - lag(close) OVER ({W}), 0) AS dc FROM bars),
l AS (SELECT *, list(dc) OVER {last(13)} AS ds, list(volume) OVER {last(13)} AS vs,
             sum(taker_buy_base) OVER {last(14)} AS buy, sum(greatest(volume - taker_buy_base, 0)) OVER {last(14)} AS sell FROM s),
g AS (SELECT *, list_stddev_pop(list_append(ds, 0.0)) AS sigma FROM l)
SELECT symbol, bar_idx,
       CASE WHEN bar_idx >= 13 AND sigma > 0 AND list_sum(vs) > 0 THEN round(abs(list_sum(list_transform(list_zip(ds, vs), lambda z: z[2] * tanh(z[1] / sigma * 0.79788456)))) / list_sum(vs), 6) ELSE 0.5 END AS vpin_bulk,
       CASE WHEN bar_idx >= 13 AND buy + sell > 0 THEN round(abs(buy - sell) / (buy + sell), 6) ELSE 0.5 END AS vpin_taker
FROM g""")
def _(spark, d):
    def build(x, f):
        x = x.withColumn("dclose", F.coalesce(F.col("close") - f.lag("close"), F.lit(0.0)))
        return x.select(*KEY, "_chunk", rnd(R.vpin_bulk(f)).alias("vpin_bulk"), rnd(R.vpin_taker(f)).alias("vpin_taker"))
    return over_chunks(bars(spark, d), build, back=14)


@query("taker_flow", "W22 W26", f"""WITH {BARS_SQL},
s AS (SELECT *, 2 * taker_buy_base - volume AS lean, sum(taker_buy_base) OVER {last(10)} AS b10, sum(volume) OVER {last(10)} AS v10,
             sum(taker_buy_base) OVER {last(21)} AS b21, sum(volume) OVER {last(21)} AS v21 FROM bars),
p AS (SELECT *, close > lag(close) OVER ({W}) AS up, lag(lean, 1) OVER ({W}) AS l1, lag(lean, 2) OVER ({W}) AS l2, lag(lean, 3) OVER ({W}) AS l3 FROM s)
SELECT symbol, bar_idx, round((2 * b10 - v10) / (v10 + 1e-8), 6) AS imbalance10,
       CASE WHEN bar_idx >= 4 AND v21 >= 1e-8 THEN round(greatest(0, least(100, ((2 * b21 - v21) / v21 + 1) / 2 * 100)), 6) ELSE 50.0 END AS flow21,
       round((CASE WHEN up THEN CAST(l1 > 0 AS INT) + CAST(l2 > 0 AS INT) + CAST(l3 > 0 AS INT)
                   ELSE CAST(l1 < 0 AS INT) + CAST(l2 < 0 AS INT) + CAST(l3 < 0 AS INT) END) / 3.0, 6) AS taker_persist,
       round((volume - lag(volume, 5) OVER ({W})) / (avg(volume) OVER {last(20)} + 1e-8), 6) AS depth_delta
FROM p""")
def _(spark, d):
    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", rnd(R.taker_imbalance(f)).alias("imbalance10"), rnd(R.flow_proxy(f)).alias("flow21"),
        rnd(R.taker_persistence(f)).alias("taker_persist"), rnd(R.depth_delta(f)).alias("depth_delta")), back=20)


@query("price_impact", "W23 W24", f"""WITH {BARS_SQL},
r AS (SELECT *, coalesce(close / nullif(lag(close) OVER ({W}), 0) - 1, 0) AS ret FROM bars),
s AS (SELECT *, CASE WHEN ret >= 0 THEN volume ELSE -volume END AS sv FROM r)
SELECT symbol, bar_idx,
       CASE WHEN bar_idx >= 20 THEN round(coalesce(regr_slope(ret, sv) OVER {last(20)}, 0), 6) ELSE 0.0 END AS kyle_lambda,
       CASE WHEN bar_idx >= 20 THEN round(coalesce(avg(CASE WHEN volume > 0 THEN abs(ret) / volume END) OVER {last(20)}, 0), 6) ELSE 0.0 END AS amihud
FROM s""")
def _(spark, d):
    def build(x, f):
        x = x.withColumn("ret", F.coalesce(R.simple_return(f), F.lit(0.0)))
        return x.select(*KEY, "_chunk", rnd(R.kyle_lambda(f)).alias("kyle_lambda"), rnd(R.amihud(f)).alias("amihud"))
    return over_chunks(bars(spark, d), build, back=21)


TAPS = R.frac_diff_weights()


@query("fractional_difference", "W25", f"""WITH {BARS_SQL},
l AS (SELECT *, list(close) OVER {last(len(TAPS))} AS cs FROM bars)
SELECT symbol, bar_idx, CASE WHEN bar_idx >= {len(TAPS) - 1} THEN
       round(list_sum(list_transform(list_zip(cs, {list(reversed(TAPS))}::DOUBLE[]), lambda z: z[1] * z[2])), 6) END AS frac_diff
FROM l""")
def _(spark, d):
    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", rnd(R.frac_diff("close", f, TAPS)).alias("frac_diff")), back=len(TAPS))


@query("run_length", "W27", f"""WITH {BARS_SQL},
m AS (SELECT *, sign(close - lag(close) OVER ({W})) AS dir FROM bars),
g AS (SELECT *, max(CASE WHEN dir IS DISTINCT FROM 1 THEN bar_idx END) OVER ({W}) AS not_up,
             max(CASE WHEN dir IS DISTINCT FROM -1 THEN bar_idx END) OVER ({W}) AS not_down FROM m)
SELECT symbol, bar_idx, least(bar_idx - not_up, 10) AS up_run, least(bar_idx - not_down, 10) AS down_run FROM g""")
def _(spark, d):
    # a run is cut at 10, so ten rows of history decide it
    def build(x, f):
        step = F.col("close") - f.lag("close")
        x = x.withColumn("not_up", F.when(~F.coalesce(step > 0, F.lit(False)), F.col("bar_idx"))) \
             .withColumn("not_down", F.when(~F.coalesce(step < 0, F.lit(False)), F.col("bar_idx")))
        def run(c):
            return F.least(F.col("bar_idx") - F.coalesce(F.max(c).over(f.last(11)), F.col("bar_idx") - 10), F.lit(10))
        return x.select(*KEY, "_chunk", run("not_up").alias("up_run"), run("not_down").alias("down_run"))
    return over_chunks(bars(spark, d), build, back=12)


@query("flow_scores", "W28", f"""WITH {BARS_SQL},
s AS (SELECT *, CASE WHEN bar_idx >= 20 AND avg(volume) OVER {prior(20)} > 0 THEN volume / avg(volume) OVER {prior(20)} ELSE 1.0 END AS vr,
             ln(1 + greatest(close * volume, 0)) AS lq,
             sum(taker_buy_base) OVER {last(10)} AS b10, sum(volume) OVER {last(10)} AS v10,
             sum(taker_buy_base) OVER {last(14)} AS b14, sum(volume) OVER {last(14)} AS v14, greatest(high - low, 1e-12) AS span FROM bars),
t AS (SELECT *, (2 * b10 - v10) / (v10 + 1e-8) AS taker, CASE WHEN bar_idx >= 13 AND v14 > 0 THEN abs(2 * b14 - v14) / v14 ELSE 0.5 END AS vpin,
             CASE WHEN bar_idx >= 4 THEN regr_slope(lq, bar_idx) OVER {last(5)} ELSE 0 END AS qs FROM s),
u AS (SELECT *, CASE WHEN bar_idx >= 4 THEN regr_slope(taker, bar_idx) OVER {last(5)} ELSE 0 END AS ts,
             CASE WHEN bar_idx >= 4 THEN regr_slope(vpin, bar_idx) OVER {last(5)} ELSE 0 END AS vs FROM t)
SELECT symbol, bar_idx,
  round(100 * (0.35 * greatest(0, least(1, (vr - 1) / 1.5)) + 0.20 * greatest(0, least(1, (qs + 0.02) / 0.12))
    + 0.20 * greatest(0, least(1, (taker + 0.10) / 0.50)) + 0.15 * greatest(0, least(1, (taker + 0.2) / 0.8))), 5) AS participation,
  round(100 * (0.30 * greatest(0, least(1, (vpin - 0.5) / 0.3)) + 0.20 * greatest(0, least(1, (vs + 0.01) / 0.08))
    + 0.20 * greatest(0, least(1, (-ts + 0.01) / 0.10)) + 0.15 * greatest(0, least(1, ((high - greatest(open, close)) / span - 0.20) / 0.45))
    + 0.15 * greatest(0, least(1, (0.55 - (close - low) / span) / 0.55))), 5) AS exhaustion
FROM u""")
def _(spark, d):
    def build(x, f):
        x = (x.withColumn("vr", R.volume_ratio(f))
             .withColumn("lq", F.log1p(F.greatest(F.col("close") * F.col("volume"), F.lit(0.0))))
             .withColumn("taker", R.taker_imbalance(f)).withColumn("vpin", R.vpin_taker(f)))
        c = R.candle()
        return x.select(
            *KEY, "_chunk",
            rnd(R.participation_score(F.col("vr"), R.rolling_slope("lq", f), F.col("taker"), F.lit(0.0), F.col("taker")), 5).alias("participation"),
            rnd(R.exhaustion_score(F.col("vpin"), R.rolling_slope("vpin", f), R.rolling_slope("taker", f),
                                   c["upper_wick"], c["close_pos"]), 5).alias("exhaustion"))
    return over_chunks(bars(spark, d), build, back=25)


@query("oi_surge", "W33", f"""WITH {BARS_SQL},
o AS (SELECT *, first_value(quote_volume) OVER {last(4)} AS old FROM bars)
SELECT symbol, bar_idx, round(CASE WHEN bar_idx >= 1 AND old > 0 THEN (quote_volume - old) / old * 100 ELSE 0.0 END, 6) AS surge_pct FROM o""")
def _(spark, d):
    def build(x, f):
        old = F.first("quote_volume").over(f.last(4))
        surge = F.when((F.col("bar_idx") >= 1) & (old > 0), F.try_divide(F.col("quote_volume") - old, old) * 100).otherwise(0.0)
        return x.select(*KEY, "_chunk", rnd(surge).alias("surge_pct"))
    return over_chunks(bars(spark, d), build, back=3)


@query("book_pressure_change", "W35", f"""WITH {BARS_SQL},
p AS (SELECT *, volume - taker_buy_base AS ask, lag(taker_buy_base) OVER ({W}) AS pb, lag(volume - taker_buy_base) OVER ({W}) AS pa,
             lag(volume, 4) OVER ({W}) AS d5 FROM bars)
SELECT symbol, bar_idx, round(coalesce((taker_buy_base - pb) / (pb + 1e-8), 0), 4) AS bid_decay,
       round(coalesce((ask - pa) / (pa + 1e-8), 0), 4) AS ask_decay,
       round(coalesce((volume - d5) / (d5 + 1e-8), 0), 4) AS depth_delta FROM p""")
def _(spark, d):
    def change(now, before):
        return rnd(F.coalesce((now - before) / (before + R.EPS), F.lit(0.0)), 4)
    def build(x, f):
        x = x.withColumn("ask", F.col("volume") - F.col("taker_buy_base"))
        return x.select(*KEY, "_chunk", change(F.col("taker_buy_base"), f.lag("taker_buy_base")).alias("bid_decay"),
                        change(F.col("ask"), f.lag("ask")).alias("ask_decay"),
                        change(F.col("volume"), f.lag("volume", 4)).alias("depth_delta"))
    return over_chunks(bars(spark, d), build, back=4)


@query("barrier_probability", "W36", f"""WITH {BARS_SQL}, {TR_SQL},
r AS (SELECT *, CASE WHEN bar_idx >= 1 THEN ln(greatest(close, 1e-12) / greatest(lag(close) OVER ({W}), 1e-12)) END AS lr,
             avg(tr) OVER {last(14)} AS atr FROM tr),
m AS (SELECT *, count(lr) OVER {last(100)} AS n, avg(lr) OVER {last(20)} AS mf, avg(lr) OVER {last(100)} AS ms,
             coalesce(var_samp(lr) OVER {last(20)}, 0) AS v0, list(lr) OVER {last(20)} AS recent,
             CASE WHEN bar_idx >= 20 THEN stddev_pop(lr) OVER {last(20)} ELSE 0 END AS sig,
             1.5 * atr / greatest(close, 1e-8) AS tp, 1.0 * atr / greatest(close, 1e-8) AS sl FROM r),
g AS (SELECT *, greatest(list_reduce(list_filter(recent, lambda x: x IS NOT NULL), lambda v, x: 1e-6 + 0.10 * (x - mf) * (x - mf) + 0.85 * v, v0), 1e-20) AS var FROM m WHERE n > 0
      UNION ALL BY NAME SELECT *, CAST(1e-20 AS DOUBLE) AS var FROM m WHERE n = 0),
a AS (SELECT *, 0.6 * mf + 0.4 * ms - 0.5 * var AS pull, var + 0.5 * (0.4 / 225 + 0.6 / 100 + 0.24 * (1/15.0 + 1/10.0) * (1/15.0 + 1/10.0)) AS spread FROM g),
e AS (SELECT *, exp(greatest(-500, least(500, 2 * pull / spread * sl))) AS es, exp(greatest(-500, least(500, -2 * pull / spread * tp))) AS et FROM a),
z AS (SELECT *, CASE WHEN sig < 1e-12 OR tp <= 0 THEN 0.0 ELSE greatest(0, least(1, 1 - tanh(tp / (sig * sqrt(48)) * 0.79788456))) END AS tc FROM e),
p AS (SELECT *, CASE WHEN n < 3 OR tp <= 0 OR sl <= 0 THEN 0.5 WHEN abs(pull) < 1e-10 THEN sl / (tp + sl)
             WHEN abs(et - es) < 1e-15 THEN 0.5 ELSE greatest(0, least(1, (1 - es) / (et - es))) END AS kp FROM z)
SELECT symbol, bar_idx, round(kp, 6) AS win_prob, round(tc, 6) AS time_prob,
       round(greatest(0, least(1, 0.7 * kp + 0.3 * tc)), 6) AS blended,
       round(CASE WHEN sig < 1e-12 OR tp <= 0 THEN 1.0 ELSE greatest(0.1, least(10, tp / sqrt(12.0) / sig)) END, 6) AS iv_ratio
FROM p""")
def _(spark, d):
    def build(x, f):
        x = (x.withColumn("tr", R.true_range(f)).withColumn("atr", F.avg("tr").over(f.last(14)))
             .withColumn("lr", F.when(F.col("bar_idx") >= 1, R.log_return(f)))
             .withColumn("price", F.greatest(F.col("close"), F.lit(R.EPS)))
             .withColumn("tp", 1.5 * F.col("atr") / F.col("price")).withColumn("sl", F.col("atr") / F.col("price")))
        sigma = F.when(F.col("bar_idx") >= 20, F.stddev_pop("lr").over(f.last(20))).otherwise(0.0)
        x = (x.withColumn("kp", R.barrier_prob(f, F.col("tp"), F.col("sl"))).withColumn("sig", sigma)
             .withColumn("tc", R.crossing_in_time(F.col("sig"), F.col("tp"), 48)))
        return x.select(*KEY, "_chunk", rnd("kp").alias("win_prob"), rnd("tc").alias("time_prob"),
                        rnd(R.clip01(0.7 * F.col("kp") + 0.3 * F.col("tc"))).alias("blended"),
                        rnd(R.implied_vol_ratio(F.lit(12.0), F.col("tp"), F.col("sig"))).alias("iv_ratio"))
    return over_chunks(bars(spark, d), build, back=101)


@query("regime_observations", "W37 W38", f"""WITH {BARS_SQL}, {TR_SQL},
r AS (SELECT *, CASE WHEN bar_idx >= 1 THEN ln(greatest(close, 1e-12) / greatest(lag(close) OVER ({W}), 1e-12)) END AS lr1,
      CASE WHEN bar_idx >= 12 THEN ln(greatest(close, 1e-12) / greatest(lag(close, 12) OVER ({W}), 1e-12)) / 12 END AS lr12,
      CASE WHEN bar_idx >= 48 THEN ln(greatest(close, 1e-12) / greatest(lag(close, 48) OVER ({W}), 1e-12)) / 48 END AS lr48,
      CASE WHEN bar_idx >= 14 THEN avg(tr) OVER {last(14)} / greatest(close, 1e-12) END AS atr_pct,
      avg(volume) OVER (PARTITION BY symbol) AS vm, first_value(close) OVER {last(30)} AS c0 FROM tr)
SELECT symbol, bar_idx, round(lr1, 6) AS lr1, round(coalesce(lr12, lr1), 6) AS lr12, round(coalesce(lr48, lr1), 6) AS lr48,
       round(atr_pct, 5) AS atr_pct, round(volume / (vm + 1e-6), 6) AS vol_ratio,
       CASE WHEN bar_idx < 19 THEN 'range' WHEN (close - c0) / nullif(c0, 0) * 100 > 15 THEN 'bull'
            WHEN (close - c0) / nullif(c0, 0) * 100 < -15 THEN 'bear' ELSE 'range' END AS regime
FROM r""")
def _(spark, d):
    def build(x, f):
        def lr(k):
            return F.when(F.col("bar_idx") >= k, R.log_return(f, k) / k)
        x = x.withColumn("tr", R.true_range(f))
        return x.select(*KEY, "_chunk", "volume", rnd(lr(1)).alias("lr1"), rnd(F.coalesce(lr(12), lr(1))).alias("lr12"),
                        rnd(F.coalesce(lr(48), lr(1))).alias("lr48"),
                        rnd(F.when(F.col("bar_idx") >= 14, F.avg("tr").over(f.last(14)) / F.greatest(F.col("close"), F.lit(1e-12))), 5).alias("atr_pct"),
                        R.rule_regime(f).alias("regime"))
    b = bars(spark, d)
    level = b.groupBy("symbol").agg(F.avg("volume").alias("vm"))
    return over_chunks(b, build, back=49).join(level, "symbol").select(
        *KEY, "lr1", "lr12", "lr48", "atr_pct", rnd(F.col("volume") / (F.col("vm") + 1e-6)).alias("vol_ratio"), "regime")


# -- recurrences ----------------------------------------------------------------------------

def sql_recur(name: str, source: str, seed: str, step: str, first: str = "bar_idx = 0") -> str:
    """Recursive CTE ``name``(symbol, bar_idx, y) over rows of ``source``."""
    return f"""{name} AS (
  SELECT symbol, bar_idx, {seed} AS y FROM {source} WHERE {first}
  UNION ALL
  SELECT b.symbol, b.bar_idx, {step} FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx + 1)"""


def sql_ema(name: str, source: str, x: str, period: int) -> str:
    a = f"(2.0::DOUBLE / {period + 1})"
    return sql_recur(name, source, x, f"b.{x} * {a} + p.y * (1 - {a})")


@query("ema_series", "R01", f"""WITH RECURSIVE {BARS_SQL}, {sql_ema('e12', 'bars', 'close', 12)}, {sql_ema('e50', 'bars', 'close', 50)}
SELECT symbol, bar_idx, round(e12.y, 6) AS ema12, round(e50.y, 6) AS ema50 FROM e12 JOIN e50 USING (symbol, bar_idx)""")
def _(spark, d):
    a12, a50 = R.ema_alpha(12), R.ema_alpha(50)
    halo = ema_halo(a50)
    return over_chunks(bars(spark, d), lambda x, f: x.select(
        *KEY, "_chunk", rnd(ema(F.col("close"), a12, f)).alias("ema12"), rnd(ema(F.col("close"), a50, f)).alias("ema50")),
        back=halo, chunk=ema_chunk(halo, a12, a50))


@query("rsi_series", "R02", f"""WITH RECURSIVE {BARS_SQL},
g AS MATERIALIZED (SELECT symbol, bar_idx, greatest(close - lag(close) OVER ({W}), 0) AS gain, greatest(lag(close) OVER ({W}) - close, 0) AS loss FROM bars),
s AS MATERIALIZED (SELECT *, avg(gain) OVER {last(14)} AS g0, avg(loss) OVER {last(14)} AS l0 FROM g),
{sql_recur('up', 's', 'g0', '(p.y * 13 + b.gain) / 14', 'bar_idx = 14')}, {sql_recur('dn', 's', 'l0', '(p.y * 13 + b.loss) / 14', 'bar_idx = 14')}
SELECT bars.symbol, bars.bar_idx, CASE WHEN up.y IS NULL THEN 50.0 WHEN dn.y = 0 THEN 100.0 ELSE round(100 - 100 / (1 + up.y / dn.y), 6) END AS rsi
FROM bars LEFT JOIN up USING (symbol, bar_idx) LEFT JOIN dn USING (symbol, bar_idx)""")
def _(spark, d):
    halo = ema_halo(1 / 14) + 15

    def build(x, f):
        step = F.col("close") - f.lag("close")
        x = x.withColumn("gain", F.greatest(step, F.lit(0.0))).withColumn("loss", F.greatest(-step, F.lit(0.0)))
        return x.select(*KEY, "_chunk", rnd(R.rsi("gain", "loss", 14, f)).alias("rsi"))
    return over_chunks(bars(spark, d), build, back=halo, chunk=ema_chunk(halo, 1 / 14))


@query("macd_series", "R03", f"""WITH RECURSIVE {BARS_SQL}, {sql_ema('e12', 'bars', 'close', 12)}, {sql_ema('e26', 'bars', 'close', 26)},
m AS MATERIALIZED (SELECT symbol, bar_idx, e12.y - e26.y AS macd FROM e12 JOIN e26 USING (symbol, bar_idx)), {sql_ema('sg', 'm', 'macd', 9)}
SELECT symbol, bar_idx, round(macd, 6) AS macd, round(sg.y, 6) AS signal, round(macd - sg.y, 6) AS histogram FROM m JOIN sg USING (symbol, bar_idx)""")
def _(spark, d):
    a12, a26, a9 = R.ema_alpha(12), R.ema_alpha(26), R.ema_alpha(9)
    halo = ema_halo(a26, a9)

    def build(x, f):
        x = x.withColumn("macd", ema(F.col("close"), a12, f) - ema(F.col("close"), a26, f))
        x = x.withColumn("signal", ema(F.col("macd"), a9, f))
        return x.select(*KEY, "_chunk", rnd("macd").alias("macd"), rnd("signal").alias("signal"),
                        rnd(F.col("macd") - F.col("signal")).alias("histogram"))
    return over_chunks(bars(spark, d), build, back=halo, chunk=ema_chunk(halo, a12, a26, a9))


@query("atr_recursive", "R04 R05", f"""WITH RECURSIVE {BARS_SQL}, {TR_SQL.replace('tr AS (', 'tr AS MATERIALIZED (', 1)},
s AS MATERIALIZED (SELECT *, avg(tr) OVER {last(14)} AS t0 FROM tr),
{sql_ema('ae', 'tr', 'tr', 14)}, {sql_recur('aw', 's', 't0', '(p.y * 13 + b.tr) / 14', 'bar_idx = 14')}
SELECT tr.symbol, tr.bar_idx, round(ae.y, 6) AS atr_ema, round(coalesce(aw.y, 0), 6) AS atr_wilder
FROM tr JOIN ae USING (symbol, bar_idx) LEFT JOIN aw USING (symbol, bar_idx)""")
def _(spark, d):
    halo = ema_halo(1 / 14) + 16

    def build(x, f):
        x = x.withColumn("tr", R.true_range(f))
        return x.select(*KEY, "_chunk", rnd(ema(F.col("tr"), R.ema_alpha(14), f)).alias("atr_ema"),
                        rnd(F.coalesce(wilder(F.col("tr"), 14, f), F.lit(0.0))).alias("atr_wilder"))
    return over_chunks(bars(spark, d), build, back=halo, chunk=ema_chunk(halo, 1 / 14, R.ema_alpha(14)))


@query("adx_series", "R06", f"""WITH RECURSIVE {BARS_SQL},
m AS MATERIALIZED (SELECT *, CASE WHEN bar_idx = 0 THEN 0 ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr,
      high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM bars),
dm AS MATERIALIZED (SELECT symbol, bar_idx, CAST(tr AS DOUBLE) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0::DOUBLE END AS mdm FROM m),
{sql_ema('ta', 'dm', 'tr', 14)}, {sql_ema('pa', 'dm', 'pdm', 14)}, {sql_ema('ma', 'dm', 'mdm', 14)},
di AS MATERIALIZED (SELECT symbol, bar_idx, coalesce(100 * pa.y / nullif(ta.y, 0), 0) AS pdi, coalesce(100 * ma.y / nullif(ta.y, 0), 0) AS mdi
       FROM ta JOIN pa USING (symbol, bar_idx) JOIN ma USING (symbol, bar_idx)),
dx AS MATERIALIZED (SELECT *, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx FROM di), {sql_ema('ad', 'dx', 'dx', 14)}
SELECT symbol, bar_idx, round(ad.y, 6) AS adx, round(pdi, 6) AS plus_di, round(mdi, 6) AS minus_di FROM dx JOIN ad USING (symbol, bar_idx)""")
def _(spark, d):
    a = R.ema_alpha(14)
    halo = ema_halo(a, a) + 2

    def build(x, f):
        p, m = R.directional_moves(f)
        x = (x.withColumn("tr", F.when(F.col("bar_idx") == 0, 0.0).otherwise(R.true_range(f)))
             .withColumn("pdm", p).withColumn("mdm", m))
        x = x.withColumn("ta", ema(F.col("tr"), a, f))
        for side in ("pdm", "mdm"):
            x = x.withColumn(f"{side[0]}di", F.coalesce(
                                 F.try_divide(100.0 * ema(F.col(side), a, f), F.col("ta")), F.lit(0.0)))
        x = x.withColumn("dx", F.coalesce(F.try_divide(100.0 * F.abs(F.col("pdi") - F.col("mdi")), F.col("pdi") + F.col("mdi")), F.lit(0.0)))
        return x.select(*KEY, "_chunk", rnd(ema(F.col("dx"), a, f)).alias("adx"), rnd("pdi").alias("plus_di"), rnd("mdi").alias("minus_di"))
    return over_chunks(bars(spark, d), build, back=halo, chunk=ema_chunk(halo, a))


ETA = 0.02


@query("differential_sharpe", "R12", f"""WITH RECURSIVE {BARS_SQL},
r AS MATERIALIZED (SELECT symbol, bar_idx, coalesce(close / nullif(lag(close) OVER ({W}), 0) - 1, 0)::DOUBLE AS x, (coalesce(close / nullif(lag(close) OVER ({W}), 0) - 1, 0)::DOUBLE) ** 2 AS x2 FROM bars),
{sql_recur('ea', 'r', f'{ETA} * x', f'p.y * (1 - {ETA}) + {ETA} * b.x')}, {sql_recur('eb', 'r', f'{ETA} * x2', f'p.y * (1 - {ETA}) + {ETA} * b.x2')},
j AS (SELECT symbol, bar_idx, x, x2, coalesce(lag(ea.y) OVER ({W}), 0) AS a, coalesce(lag(eb.y) OVER ({W}), 0) AS b
      FROM r JOIN ea USING (symbol, bar_idx) JOIN eb USING (symbol, bar_idx))
SELECT symbol, bar_idx, round(greatest(-5, least(5, CASE WHEN b - a * a < 1e-6 THEN x * 0.1
       ELSE (b * (x - a) - 0.5 * a * (x2 - b)) / ((b - a * a) ** 1.5 + 1e-6) END)), 5) AS reward FROM j""")
def _(spark, d):
    halo = ema_halo(ETA) + 2

    def build(x, f):
        r = F.coalesce(R.simple_return(f), F.lit(0.0))
        x = x.withColumn("x", r).withColumn("x2", r * r)
        x = x.withColumn("ea", ema(F.col("x"), ETA, f, from_zero=True)).withColumn("eb", ema(F.col("x2"), ETA, f, from_zero=True))
        a, b = F.coalesce(f.lag("ea"), F.lit(0.0)), F.coalesce(f.lag("eb"), F.lit(0.0))
        den = b - a * a
        dsr = F.when(den < 1e-6, F.col("x") * 0.1).otherwise(
            (b * (F.col("x") - a) - 0.5 * a * (F.col("x2") - b)) / (F.pow(F.greatest(den, F.lit(0.0)), F.lit(1.5)) + 1e-6))
        return x.select(*KEY, "_chunk", rnd(R.clip(dsr, -5.0, 5.0), 5).alias("reward"))
    return over_chunks(bars(spark, d), build, back=halo, chunk=ema_chunk(halo, ETA))
