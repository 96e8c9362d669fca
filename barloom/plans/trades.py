"""Trade statistics on shipments: flag = agent, line status = label, ship date = time."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import trades as T
from barloom.plans.inputs import rnd, table
from barloom.plans.registry import query

BALANCE = 1e6
ORDER = ["ts", "id", "symbol_id", "notional"]


def trades(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("agent"), F.when(F.col("l_linestatus") == "F", "TP").when(F.col("l_quantity") > 40, "TIMEOUT").otherwise("SL").alias("label"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("pnl"), ((0.05 - F.col("l_discount")) * 100).alias("pnl_pct"), F.col("l_quantity").alias("hold"),
        F.when(F.col("l_tax") <= 0.01, "TP1").when(F.col("l_tax") <= 0.03, "TP2").when(F.col("l_tax") <= 0.04, "TP3").when(F.col("l_tax") <= 0.06, "SL").otherwise("TIMEOUT").alias("barrier"),
        (50 + F.col("l_quantity")).alias("score"), F.col("l_partkey").alias("symbol_id"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"), F.col("l_extendedprice").alias("notional"))


TR = """trd AS MATERIALIZED (SELECT l_returnflag AS agent, CASE WHEN l_linestatus = 'F' THEN 'TP' WHEN l_quantity > 40 THEN 'TIMEOUT' ELSE 'SL' END AS label, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS id,
  l_extendedprice * (0.05 - l_discount) AS pnl, (0.05 - l_discount) * 100 AS pnl_pct, l_quantity AS hold, CASE WHEN l_tax <= 0.01 THEN 'TP1' WHEN l_tax <= 0.03 THEN 'TP2' WHEN l_tax <= 0.04 THEN 'TP3' WHEN l_tax <= 0.06 THEN 'SL' ELSE 'TIMEOUT' END AS barrier,
  50 + l_quantity AS score, l_partkey AS symbol_id, l_tax AS tax, l_discount AS disc, l_extendedprice AS notional FROM lineitem)"""


def bucket():
    # ship day, then blocks of order keys inside a day
    return [F.unix_date(F.col("ts").cast("date")), F.floor(F.col("id") / 2**30)]


@query("equity_curve", "W04", f"""WITH {TR}, e AS (SELECT *, 1e6 + sum(pnl) OVER (PARTITION BY agent ORDER BY ts, id, symbol_id, notional ROWS UNBOUNDED PRECEDING) AS equity FROM trd),
p AS (SELECT *, max(equity) OVER (PARTITION BY agent ORDER BY ts, id, symbol_id, notional ROWS UNBOUNDED PRECEDING) AS peak FROM e) SELECT agent, id, round(equity, 2) AS equity, round(peak, 2) AS peak, round((peak - equity) / nullif(peak, 0) * 100, 5) AS drawdown_pct FROM p""")
def _(spark, d):
    e = T.equity_curve(trades(spark, d), ["agent"], ORDER, bucket(), BALANCE)
    return e.select("agent", "id", rnd("equity", 2).alias("equity"), rnd("peak", 2).alias("peak"), rnd("drawdown_pct", 5).alias("drawdown_pct"))


YR = 252 ** 0.5
KPI = f"""count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses, round(sum(pnl), 2) AS total_pnl, round(avg(pnl), 5) AS mean_pnl, round(avg(pnl) FILTER (WHERE pnl > 0), 5) AS mean_win, round(avg(pnl) FILTER (WHERE pnl <= 0), 5) AS mean_loss,
 round(avg(pnl_pct) / greatest(stddev_pop(pnl_pct), 1e-8) * {YR}, 5) AS sharpe, round(avg(pnl_pct) / greatest(stddev_pop(pnl_pct) FILTER (WHERE pnl_pct < 0), 1e-8) * {YR}, 5) AS sortino, round(sum(pnl) FILTER (WHERE pnl > 0) / greatest(-sum(pnl) FILTER (WHERE pnl < 0), 1e-8), 6) AS profit_factor,
 round(max(dd), 5) AS max_drawdown_pct, {', '.join(f"count(*) FILTER (WHERE barrier = '{b}') AS {b.lower()}_hits" for b in ('TP1', 'TP2', 'TP3', 'SL', 'TIMEOUT'))},
 round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate, round(sum(pnl) / 1e6 * 100 / greatest(max(dd), 1e-8), 4) AS calmar, round(sum(pnl) / greatest(max(dd) * 1e6 / 100, 1e-8), 4) AS recovery"""


@query("trade_kpis", "A16", f"""WITH {TR}, e AS (SELECT *, 1e6 + sum(pnl) OVER (PARTITION BY agent ORDER BY ts, id, symbol_id, notional ROWS UNBOUNDED PRECEDING) AS equity FROM trd), p AS (SELECT *, max(equity) OVER (PARTITION BY agent ORDER BY ts, id, symbol_id, notional ROWS UNBOUNDED PRECEDING) AS peak FROM e),
q AS (SELECT *, (peak - equity) / nullif(peak, 0) * 100 AS dd FROM p) SELECT agent, {KPI} FROM q GROUP BY agent""")
def _(spark, d):
    k = T.trade_kpis(T.equity_curve(trades(spark, d), ["agent"], ORDER, bucket(), BALANCE), BALANCE, ["agent"])
    digits = {"total_pnl": 2, "profit_factor": 6, "win_rate": 6, "calmar": 4, "recovery": 4}
    return k.select(*[rnd(c, digits.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in k.dtypes])


@query("window_kpis", "A17", f"""WITH {TR}, w AS (SELECT agent, CAST(year(ts) AS INT) AS window_id, count(*) AS trades, sum(pnl) AS pnl, 100.0 * count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate,
  CASE WHEN count(*) > 1 THEN avg(pnl_pct) / greatest(stddev_pop(pnl_pct), 1e-8) * {YR} ELSE 0 END AS sharpe FROM trd GROUP BY ALL)
SELECT agent, count(*) AS windows, count(*) FILTER (WHERE pnl > 0) AS windows_profitable, round(avg(sharpe), 5) AS sharpe_mean, round(stddev_pop(sharpe), 5) AS sharpe_std, round(count(*) FILTER (WHERE pnl > 0) / count(*), 5) AS share_profitable FROM w GROUP BY agent""")
def _(spark, d):
    w = T.window_kpis(trades(spark, d).withColumn("window_id", F.year("ts")), ["agent", "window_id"])
    s = T.window_stability(w, ["agent"])
    return s.select(*[rnd(c, 5).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("agent_summary", "A15", f"""WITH {TR}, dim AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('Z')) t(agent)),
g AS (SELECT agent, count(*) AS trades, count(*) FILTER (WHERE label = 'TP') AS wins, count(*) FILTER (WHERE label = 'SL') AS losses, count(*) FILTER (WHERE label = 'TIMEOUT') AS timeouts, sum(pnl) AS net, avg(pnl) AS ap, avg(hold) AS ah,
  sum(pnl) FILTER (WHERE pnl > 0) / nullif(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS pf FROM trd GROUP BY agent)
SELECT dim.agent, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(timeouts, 0) AS timeouts, round(coalesce(100.0 * wins / trades, 0), 5) AS tp_rate_all, round(coalesce(100.0 * wins / nullif(wins + losses, 0), 0), 5) AS decided_win_rate,
  round(coalesce(net, 0), 2) AS net_pnl, round(coalesce(ap, 0), 5) AS avg_pnl, round(coalesce(pf, 0), 6) AS profit_factor, round(coalesce(ah, 0), 5) AS avg_hold, round(coalesce(net / (SELECT sum(pnl) FROM trd) * 100, 0), 5) AS contribution_pct FROM dim LEFT JOIN g USING (agent)""")
def _(spark, d):
    s = T.agent_summary(trades(spark, d), ["A", "N", "R", "Z"])
    digits = {"net_pnl": 2, "profit_factor": 6}
    return s.select(*[rnd(c, digits.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


EDGES = [68, 72, 76, 80, 85, 90, 100]


@query("score_histogram", "A18", f"""WITH {TR}, b AS (SELECT *, CASE {' '.join(f'WHEN score >= {a} AND score < {b} THEN {a}::DOUBLE' for a, b in zip(EDGES[:-1], EDGES[1:]))} END AS lo FROM trd)
SELECT lo AS bucket_lo, CASE lo {' '.join(f'WHEN {a} THEN {b}::DOUBLE' for a, b in zip(EDGES[:-1], EDGES[1:]))} END AS bucket_hi, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 5) AS win_rate_pct, round(sum(pnl), 2) AS net_pnl, round(avg(pnl), 5) AS avg_pnl FROM b WHERE lo IS NOT NULL GROUP BY lo""")
def _(spark, d):
    h = T.score_histogram(trades(spark, d), EDGES)
    return h.select("bucket_lo", "bucket_hi", "trades", "wins", rnd("win_rate_pct", 5).alias("win_rate_pct"), rnd("net_pnl", 2).alias("net_pnl"), rnd("avg_pnl", 5).alias("avg_pnl"))


FEATS = ["score", "pnl", "hold", "tax", "notional"]


@query("loss_vs_big_win_features", "A19", f"""WITH {TR}, cut AS (SELECT quantile_cont(pnl, 0.8) AS c FROM trd WHERE pnl > 0), t AS (SELECT *, CASE WHEN pnl < 0 THEN 'loss' WHEN pnl > 0 AND pnl >= c THEN 'big_win' END AS b FROM trd, cut),
l AS (UNPIVOT (SELECT b, {', '.join(f'{c}::DOUBLE AS {c}' for c in FEATS)} FROM t WHERE b IS NOT NULL) ON {', '.join(FEATS)} INTO NAME feature VALUE x)
SELECT feature, count(*) FILTER (WHERE b = 'loss') AS loss_n, round(avg(x) FILTER (WHERE b = 'loss'), 4) AS loss_mean, round(quantile_cont(x, 0.5) FILTER (WHERE b = 'loss'), 4) AS loss_median, count(*) FILTER (WHERE b = 'big_win') AS big_win_n,
  round(avg(x) FILTER (WHERE b = 'big_win'), 4) AS big_win_mean, round(quantile_cont(x, 0.5) FILTER (WHERE b = 'big_win'), 4) AS big_win_median, round(quantile_cont(x, 0.5) FILTER (WHERE b = 'big_win') - quantile_cont(x, 0.5) FILTER (WHERE b = 'loss'), 4) AS median_delta FROM l GROUP BY feature""")
def _(spark, d):
    c = T.feature_comparison(T.tag_extremes(trades(spark, d)), FEATS)
    return c.select(*[rnd(x, 4).alias(x) if t == "double" else F.col(x) for x, t in c.dtypes])


def diagnosed(spark, d):
    """Trades with stand-ins for the measures the reasons look at."""
    return trades(spark, d).select("*", (F.col("tax") * 4).alias("slip"), (F.col("hold") * 2).alias("warning_score"), (F.col("hold") / 10).alias("max_runup"), (F.col("disc") * 30).alias("max_drawdown"),
                                   (F.col("id") % 12).alias("time_to_drawdown"), (F.col("notional") / 1000).alias("top_risk"), (F.col("disc") * -8 + 0.1).alias("volume_decay"), (F.col("hold") * 1.5).alias("wave"), (F.col("id") % 20).alias("time_to_peak"))


@query("trade_reasons", "P12 A20", f"""WITH {TR}, cut AS (SELECT quantile_cont(pnl, 0.8) AS c FROM trd WHERE pnl > 0), t AS (SELECT *, CASE WHEN pnl < 0 THEN 'loss' WHEN pnl > 0 AND pnl >= c THEN 'big_win' END AS bucket, tax * 4 AS slip, hold * 2 AS ws, hold / 10 AS ru, disc * 30 AS md,
  id % 12 AS td, notional / 1000 AS tr, disc * -8 + 0.1 AS vd, hold * 1.5 AS wv, id % 20 AS tp FROM trd, cut),
r AS (SELECT bucket, CASE WHEN bucket = 'loss' THEN CASE WHEN slip >= 0.25 THEN 'slippage' WHEN ws >= 90 THEN 'warning exit' WHEN ru < 1 AND md >= 1.5 THEN 'failed at once' WHEN td <= 3 THEN 'early reversal' WHEN tr > 60 THEN 'risk grew' WHEN vd < -0.35 THEN 'volume left' ELSE 'no development' END
  ELSE CASE WHEN ru >= 5 AND wv >= 70 THEN 'strong wave' WHEN tp <= 6 AND vd >= -0.10 THEN 'fast with volume' WHEN ws < 45 AND tr <= 48 THEN 'low risk trend' ELSE 'held through noise' END END AS reason FROM t WHERE bucket IS NOT NULL)
SELECT bucket, reason, count(*) AS count FROM r GROUP BY ALL""")
def _(spark, d):
    t = T.tag_extremes(diagnosed(spark, d)).filter(F.col("bucket") != "other")
    reason = F.when(F.col("bucket") == "loss", T.loss_reason(90.0, 60.0)).otherwise(T.big_win_reason(90.0, 60.0, 60.0))
    return t.select("bucket", reason.alias("reason")).groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("count"))


@query("rolling_trade_performance", "W34", f"""WITH {TR}, w AS (SELECT agent, id, row_number() OVER o - 1 AS i, avg(CAST(pnl > 0 AS INT)) OVER r * 100 AS wr, avg(pnl_pct) OVER r AS m, stddev_pop(pnl_pct) OVER r AS s FROM trd WINDOW o AS (PARTITION BY agent ORDER BY ts, id, symbol_id, notional), r AS (PARTITION BY agent ORDER BY ts, id, symbol_id, notional ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT agent, id, round(wr, 5) AS win_rate, CASE WHEN i >= 1 THEN round(m / greatest(s, 1e-8) * {YR}, 3) ELSE 0.0 END AS sharpe FROM w WHERE i >= 20""")
def _(spark, d):
    r = T.rolling_performance(trades(spark, d), ["agent"], ORDER, bucket())
    return r.filter(F.col("trade_idx") >= 20).select("agent", "id", rnd("win_rate", 5).alias("win_rate"), rnd("sharpe", 3).alias("sharpe"))


@query("session_summary", "A26 A45", f"""WITH {TR} SELECT CAST(year(ts) AS INT) AS session, count(*) AS trades, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 5) AS win_rate, round(sum(pnl), 2) AS total_pnl, round(avg(pnl_pct) / greatest(stddev_pop(pnl_pct), 1e-8) * {YR}, 5) AS sharpe,
  round(max(pnl), 4) AS best_trade, round(min(pnl), 4) AS worst_trade, round(avg(hold), 5) AS avg_hold, {', '.join(f"count(*) FILTER (WHERE barrier = '{b}') AS {b.lower()}" for b in ('TP1', 'TP2', 'TP3', 'SL', 'TIMEOUT'))} FROM trd GROUP BY 1""")
def _(spark, d):
    return trades(spark, d).groupBy(F.year("ts").alias("session")).agg(
        F.count(F.lit(1)).alias("trades"), rnd(F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100, 5).alias("win_rate"), rnd(F.sum("pnl"), 2).alias("total_pnl"), rnd(T.sharpe("pnl_pct"), 5).alias("sharpe"),
        rnd(F.max("pnl"), 4).alias("best_trade"), rnd(F.min("pnl"), 4).alias("worst_trade"), rnd(F.avg("hold"), 5).alias("avg_hold"), *[F.count_if(F.col("barrier") == b).alias(b.lower()) for b in ("TP1", "TP2", "TP3", "SL", "TIMEOUT")])


FOLD_SQL = f"""{TR}, f AS MATERIALIZED (SELECT agent, CAST(year(ts) AS INT) AS fold, count(*) AS trades, sum(pnl) / 1e4 AS calmar, coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) AS aw, coalesce(-avg(pnl) FILTER (WHERE pnl < 0), 0) AS al, max(hold) * 1.5 AS dd FROM trd GROUP BY ALL),
s0 AS (SELECT *, calmar - CASE WHEN al > aw AND aw > 0 THEN (al / aw - 1) * 5 ELSE 0 END AS base, CASE WHEN trades >= 12 THEN 1 ELSE greatest(0.25, sqrt(trades / 12)) END AS conf FROM f),
s1 AS (SELECT *, CASE WHEN base >= 0 THEN base * conf ELSE base / greatest(conf, 0.25) END - CASE WHEN trades < 4 THEN 5 * (4 - trades) / 4 ELSE 0 END AS s FROM s0)"""


@query("fold_scores", "A38", f"""WITH {FOLD_SQL}, g AS (SELECT agent, quantile_cont(s, 0.5) AS m, stddev_pop(s) AS sd, max(dd) AS w, sum(trades) AS t FROM s1 GROUP BY agent)
SELECT agent, round(m, 5) AS median, round(sd, 5) AS spread, round(w, 5) AS worst, CAST(t AS BIGINT) AS total, round(m - 0.5 * sd - greatest(0, (w - 50) / 100) * 10 + least(2.0, t / 120 * 2.0), 5) AS score FROM g""")
def _(spark, d):
    f = trades(spark, d).groupBy("agent", F.year("ts").alias("fold")).agg(
        F.count(F.lit(1)).alias("trades"), (F.sum("pnl") / 1e4).alias("calmar"), F.coalesce(F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(F.col("pnl") < 0, -F.col("pnl"))), F.lit(0.0)).alias("avg_loss"), (F.max("hold") * 1.5).alias("max_drawdown_pct"))
    m = T.multi_fold_score(f, ["agent"])
    return m.select(*[rnd(c, 5).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


BOOT_WEIGHT = " + ".join(f"(c >= {cut})::INT" for cut in T.poisson_cuts())


@query("bootstrap_profit_factor", "A37", f"""WITH {TR}, i AS (SELECT (id & 4294967295)::UBIGINT AS id, pnl FROM trd), r AS (SELECT i::UBIGINT AS rep FROM range(1000) t(i)),
x0 AS (SELECT rep, pnl, xor((id * 2654435761::UBIGINT) & 4294967295, (rep * 2246822519::UBIGINT) & 4294967295) AS x FROM i, r),
x1 AS (SELECT rep, pnl, (xor(x, x >> 16) * 2246822507::UBIGINT) & 4294967295 AS x FROM x0),
x2 AS (SELECT rep, pnl, (xor(x, x >> 13) * 3266489909::UBIGINT) & 4294967295 AS x FROM x1),
x3 AS (SELECT rep, pnl, (xor(x, x >> 16) >> 16)::INT AS c FROM x2), w AS (SELECT rep, pnl, {BOOT_WEIGHT} AS w FROM x3),
g AS (SELECT rep, sum(w * greatest(pnl, 0)) AS g, -sum(w * least(pnl, 0)) AS l, count(*) AS n FROM w GROUP BY rep)
SELECT max(n) AS rows, round(quantile_cont(CASE WHEN l = 0 THEN 10.0 ELSE g / l END, 0.05), 8) AS pf_low FROM g""")
def _(spark, d):
    return T.bootstrap_profit_factor(trades(spark, d), "pnl", "id", reps=1000).select("rows", rnd("pf_low", 8).alias("pf_low"))


@query("parameter_perturbation", "F16", f"""WITH {FOLD_SQL}, b AS (SELECT agent, quantile_cont(s, 0.5) AS base FROM s1 GROUP BY agent), x AS (SELECT agent, base, dir, base * (1 + dir * 0.2) AS value, base - abs(base) * 0.1 * (dir + 2) AS trial FROM b, (VALUES (-1), (1)) t(dir))
SELECT agent, dir AS direction, round(value, 5) AS value, round(CASE WHEN base <= 0 THEN 0 ELSE greatest(0, (base - trial) / base) END, 5) AS drop FROM x""")
def _(spark, d):
    f = trades(spark, d).groupBy("agent", F.year("ts").alias("fold")).agg(
        F.count(F.lit(1)).alias("trades"), (F.sum("pnl") / 1e4).alias("calmar"), F.coalesce(F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(F.col("pnl") < 0, -F.col("pnl"))), F.lit(0.0)).alias("avg_loss"), (F.max("hold") * 1.5).alias("max_drawdown_pct"))
    b = T.multi_fold_score(f, ["agent"]).select("agent", F.col("median").alias("base"))
    x = b.withColumn("direction", F.explode(F.array(F.lit(-1), F.lit(1))))
    trial = F.col("base") - F.abs(F.col("base")) * 0.1 * (F.col("direction") + 2)
    return x.select("agent", "direction", rnd(F.col("base") * (1 + F.col("direction") * 0.2), 5).alias("value"),
                    rnd(F.when(F.col("base") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.col("base") - trial, F.col("base")))), 5).alias("drop"))


@query("summary_reconciliation", "A43", f"""WITH {TR}, a AS (SELECT agent, sum(pnl) + 1e6 AS c1, max(hold) AS d1 FROM trd GROUP BY agent), b AS (SELECT agent, sum(pnl * (1 - tax)) + 1e6 AS c2, max(hold) - min(hold) AS d2 FROM trd GROUP BY agent)
SELECT agent, round(abs(c1 - c2) / greatest(abs(c1), 1), 6) AS capital_gap, round(abs(d1 - d2), 5) AS drawdown_gap, CASE WHEN abs(c1 - c2) / greatest(abs(c1), 1) > 0.05 OR abs(d1 - d2) > 3 THEN 1 ELSE 0 END AS divergent FROM a JOIN b USING (agent)""")
def _(spark, d):
    t = trades(spark, d)
    a = t.groupBy("agent").agg((F.sum("pnl") + 1e6).alias("c1"), F.max("hold").alias("d1"))
    b = t.groupBy("agent").agg((F.sum(F.col("pnl") * (1 - F.col("tax"))) + 1e6).alias("c2"), (F.max("hold") - F.min("hold")).alias("d2"))
    gap, dd = F.abs(F.col("c1") - F.col("c2")) / F.greatest(F.abs(F.col("c1")), F.lit(1.0)), F.abs(F.col("d1") - F.col("d2"))
    return a.join(b, "agent").select("agent", rnd(gap).alias("capital_gap"), rnd(dd, 5).alias("drawdown_gap"), ((gap > 0.05) | (dd > 3)).cast("int").alias("divergent"))


@query("fill_summary", "A47", """WITH o AS (SELECT l_orderkey AS plan, l_quantity AS qty, l_extendedprice / l_quantity AS price, CASE WHEN l_linestatus = 'F' THEN 'FILLED' ELSE 'OPEN' END AS status FROM lineitem)
SELECT plan, coalesce(sum(qty) FILTER (WHERE status = 'FILLED'), 0) AS filled_qty, round(sum(qty * price) FILTER (WHERE status = 'FILLED') / nullif(sum(qty) FILTER (WHERE status = 'FILLED'), 0), 9) AS avg_fill_price, count(*) FILTER (WHERE status = 'FILLED') AS filled, round(100.0 * count(*) FILTER (WHERE status = 'FILLED') / count(*), 5) AS progress_pct FROM o GROUP BY plan""")
def _(spark, d):
    from barloom.operators.monitor import fills
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_linestatus") == "F", "FILLED").otherwise("OPEN").alias("status"))
    f = fills(o, ["plan"])
    return f.select("plan", "filled_qty", rnd("avg_fill_price", 9).alias("avg_fill_price"), "filled", rnd("progress_pct", 5).alias("progress_pct"))


@query("mean_bars_to_hit", "A48", f"""WITH {TR} SELECT symbol_id, CASE WHEN count(*) >= 25 THEN round(avg(hold), 5) END AS mean_bars FROM trd GROUP BY symbol_id""")
def _(spark, d):
    return trades(spark, d).groupBy("symbol_id").agg(F.when(F.count(F.lit(1)) >= 25, rnd(F.avg("hold"), 5)).alias("mean_bars"))


@query("best_trial", "K11", f"""WITH {TR}, t AS (SELECT symbol_id, round(sum(pnl), 4) AS net, count(*) FILTER (WHERE pnl > 0) AS wins, round(max(-pnl), 4) AS dd FROM trd GROUP BY symbol_id) SELECT * FROM t ORDER BY wins DESC, net DESC, dd, symbol_id LIMIT 1""")
def _(spark, d):
    t = trades(spark, d).groupBy("symbol_id").agg(rnd(F.sum("pnl"), 4).alias("net"), F.count_if(F.col("pnl") > 0).alias("wins"), rnd(F.max(-F.col("pnl")), 4).alias("dd"))
    return t.orderBy(F.desc("wins"), F.desc("net"), "dd", "symbol_id").limit(1)


@query("trade_union_and_difference", "K14", f"""WITH {TR}, u AS (SELECT agent, symbol_id FROM trd WHERE agent = 'A' UNION ALL SELECT agent, symbol_id FROM trd WHERE agent = 'R'), o AS (SELECT DISTINCT symbol_id FROM trd WHERE ts < TIMESTAMP '1997-01-01'), n AS (SELECT DISTINCT symbol_id FROM trd WHERE ts >= TIMESTAMP '1999-06-01')
SELECT 'union' AS part, count(*) AS n, CAST(sum(symbol_id) AS BIGINT) AS check_sum FROM u UNION ALL SELECT 'new', count(*), coalesce(CAST(sum(symbol_id) AS BIGINT), 0) FROM (FROM n EXCEPT FROM o) UNION ALL SELECT 'gone', count(*), coalesce(CAST(sum(symbol_id) AS BIGINT), 0) FROM (FROM o EXCEPT FROM n)""")
def _(spark, d):
    t = trades(spark, d)
    a, r = (t.filter(F.col("agent") == x).select("agent", "symbol_id") for x in ("A", "R"))
    old = t.filter(F.col("ts") < "1997-01-01").select("symbol_id").distinct()
    new = t.filter(F.col("ts") >= "1999-06-01").select("symbol_id").distinct()
    parts = [(a.unionByName(r), "union"), (new.join(old, "symbol_id", "left_anti"), "new"), (old.join(new, "symbol_id", "left_anti"), "gone")]
    out = [x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("symbol_id"), F.lit(0)).alias("check_sum")).select(F.lit(k).alias("part"), "n", "check_sum") for x, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
