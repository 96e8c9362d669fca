"""Prediction monitoring on events: probability from value, outcome from volume parity, model = type."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import monitor as M
from barloom.operators.joins import asof_join
from barloom.operators.series import index_series
from barloom.plans.inputs import rnd, table
from barloom.plans.registry import query

HALF_DAY = 43200
# seconds whose rows are sorted together
SPAN = 60


def preds(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    p = F.least(F.lit(1.0), F.col("value") / 150)
    return e.select(
        F.col("event_type").alias("model"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.round(p, 4).alias("prob"), (k % 2).alias("y"),
        F.when((F.round(p, 4) >= 0.5).cast("int") == k % 2, 1.0).otherwise(0.0).alias("correct"), F.col("user_id").cast("string").alias("symbol"), (F.col("value") - 50).alias("move"), k.alias("k"))


PR = """prd AS MATERIALIZED (SELECT event_type AS model, event_id AS id, ts, round(least(1.0, value / 150), 4) AS prob, CAST(json_extract_string(props, '$.k') AS INT) % 2 AS y,
  CASE WHEN CAST(round(least(1.0, value / 150), 4) >= 0.5 AS INT) = CAST(json_extract_string(props, '$.k') AS INT) % 2 THEN 1.0::DOUBLE ELSE 0.0 END AS correct, CAST(user_id AS VARCHAR) AS symbol, value - 50 AS move, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
ORDER = ["ts", "id"]


def bucket():
    """Rows of one minute are sorted together."""
    return [F.floor(F.unix_seconds("ts") / SPAN)]


def rounded(df, digits=5, **over):
    return df.select(*[rnd(c, over.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("calibration_error", "A28", f"""WITH {PR}, b AS (SELECT *, CASE WHEN prob >= 0.5 AND prob < 1.0 THEN least(floor((prob - 0.5) / 0.1), 4) END AS bin FROM prd), c AS (SELECT model, bin, count(*) AS n, avg(prob) AS p, avg(correct) AS a FROM b GROUP BY ALL)
SELECT model, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) >= 20 THEN round(coalesce(sum(n * abs(p - a)) FILTER (WHERE bin IS NOT NULL), 0) / sum(n), 6) END AS ece FROM c GROUP BY model""")
def _(spark, d):
    return rounded(M.calibration_error(preds(spark, d), ["model"]), 6)


@query("brier_scores", "A30", f"""WITH {PR} SELECT model, id, round(power(prob - y, 2), 6) AS brier, round(avg(power(prob - y, 2)) OVER (PARTITION BY model ORDER BY ts, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS rolling_brier FROM prd""")
def _(spark, d):
    return M.brier(preds(spark, d), ["model"], ORDER, bucket()).select("model", "id", rnd("brier").alias("brier"), rnd("rolling_brier", 9).alias("rolling_brier"))


@query("brier_totals", "A30", f"WITH {PR} SELECT model, count(*) AS n, round(avg(power(prob - y, 2)), 6) AS brier FROM prd GROUP BY model")
def _(spark, d):
    return preds(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.pow(F.col("prob") - F.col("y"), 2))).alias("brier"))


AUC_SQL = f"""{PR}, rk AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0 AS r FROM prd),
auc AS (SELECT model, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))::DOUBLE AS auc FROM rk GROUP BY model)"""


@query("classifier_metrics", "A33", f"""WITH {AUC_SQL}, m AS (SELECT model, count(*) AS n, avg(correct) AS accuracy, count(*) FILTER (WHERE prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5) AS pp, count(*) FILTER (WHERE y = 1) AS ap,
  avg(power(prob - y, 2)) AS brier, avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, prob))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, prob))))) AS log_loss FROM prd GROUP BY model)
SELECT model, n, round(accuracy, 5) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 5) AS precision, round(coalesce(tp / nullif(ap, 0), 0), 5) AS recall, round(coalesce(2 * tp / nullif(pp + ap, 0), 0), 5) AS f1, round(brier, 5) AS brier, round(log_loss, 5) AS log_loss, round(auc, 5) AS auc FROM m JOIN auc USING (model)""")
def _(spark, d):
    return rounded(M.classifier_metrics(preds(spark, d), ["model"]))


@query("oos_metrics", "A34", f"""WITH {PR} SELECT model, count(*) AS trades, CASE WHEN stddev_pop(move) > 1e-8 THEN round(avg(move) / stddev_pop(move) * {252 ** 0.5}, 5) END AS sharpe, round(sum(move) FILTER (WHERE move > 0) / greatest(-sum(move) FILTER (WHERE move < 0), 1e-8), 5) AS profit_factor FROM prd GROUP BY model""")
def _(spark, d):
    g, l = F.sum(F.when(F.col("move") > 0, F.col("move"))), F.sum(F.when(F.col("move") < 0, -F.col("move")))
    return preds(spark, d).groupBy("model").agg(
        F.count(F.lit(1)).alias("trades"), F.when(F.stddev_pop("move") > 1e-8, rnd(F.avg("move") / F.stddev_pop("move") * 252 ** 0.5, 5)).alias("sharpe"), rnd(g / F.greatest(l, F.lit(1e-8)), 5).alias("profit_factor"))


@query("ensemble_weights", "A31", f"""WITH {AUC_SQL}, q AS (SELECT model, 0.4 * auc + 0.6 * (1 - avg(power(prob - y, 2))) AS quality FROM prd JOIN auc USING (model) GROUP BY model, auc), e AS (SELECT *, exp(quality / 0.3) AS x FROM q),
w AS (SELECT *, greatest(0.05, least(0.25, x / (SELECT sum(x) FROM e))) AS w FROM e) SELECT model, round(quality, 5) AS quality, round(w / (SELECT sum(w) FROM w), 5) AS weight FROM w""")
def _(spark, d):
    p = preds(spark, d)
    m = p.groupBy("model").agg(F.avg(F.pow(F.col("prob") - F.col("y"), 2)).alias("brier")).join(M.auc(p, ["model"]), "model")
    return M.ensemble_weights(m).select("model", rnd("quality", 5).alias("quality"), rnd("weight", 5).alias("weight"))


@query("entropy_weighted_vote", "A46", f"""WITH {PR}, v AS (SELECT symbol, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS slot, prob, 1 / (-(prob * ln(prob + 1e-10) + (1 - prob) * ln(1 - prob + 1e-10)) + 1e-6) AS w FROM prd), g AS (SELECT symbol, slot, sum(w * prob) / sum(w) AS p, sqrt(var_pop(prob)) * 100 AS dis FROM v GROUP BY ALL),
t AS (SELECT *, greatest(p, 1 - p) AS top FROM g) SELECT symbol, slot, round(p, 4) AS prob, round(sqrt(greatest(top * (1 - top), 0)) * 100, 2) AS uncertainty, round(dis, 4) AS disagreement, round(top * 100, 3) AS confidence FROM t""")
def _(spark, d):
    v = preds(spark, d).withColumn("slot", F.floor(F.unix_seconds("ts") / HALF_DAY))
    r = M.entropy_vote(v, ["symbol", "slot"])
    top = F.greatest(F.col("prob"), 1 - F.col("prob"))
    return r.select("symbol", "slot", rnd("prob", 4).alias("prob"), rnd(F.sqrt(F.greatest(top * (1 - top), F.lit(0.0))) * 100, 2).alias("uncertainty"), rnd("disagreement", 4).alias("disagreement"), rnd("confidence", 3).alias("confidence"))


@query("regime_routing", "A32", f"""WITH {PR}, r AS (SELECT *, CASE WHEN k > 75 THEN 'bull' WHEN k > 25 THEN 'range' ELSE 'bear' END AS regime FROM prd WHERE k > 8), a AS (SELECT DISTINCT model, x.regime FROM r, (VALUES ('bull'), ('range'), ('bear'), ('none')) x(regime)), g AS (SELECT model, regime, count(*) AS n, avg(correct) AS acc FROM r GROUP BY ALL)
SELECT model, regime, coalesce(n, 0) AS n, round(acc, 5) AS accuracy, CASE WHEN coalesce(n, 0) < 10 THEN 0.33 ELSE round(greatest(0.1, least(1.0, acc / 0.5)), 3) END::DOUBLE AS weight FROM a LEFT JOIN g USING (model, regime)""")
def _(spark, d):
    p = preds(spark, d).filter(F.col("k") > 8).withColumn("regime", F.when(F.col("k") > 75, "bull").when(F.col("k") > 25, "range").otherwise("bear"))
    return M.regime_routing(p, ["bull", "range", "bear", "none"], 0.33).select("model", "regime", "n", rnd("accuracy", 5).alias("accuracy"), "weight")


@query("feature_drift", "A29", f"""WITH {PR}, i AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM prd), l AS (SELECT model, i, n, unnest([prob, y::DOUBLE, k::DOUBLE, move]) AS v, unnest([0, 1, 2, 3]) AS slot FROM i),
m AS (SELECT model, slot, avg(v) FILTER (WHERE i < 50) AS m0, stddev_pop(v) FILTER (WHERE i < 50) AS s0, avg(v) FILTER (WHERE i >= n - 50) AS m1 FROM l GROUP BY ALL) SELECT model, round(avg(abs(m1 - m0) / (s0 + 1e-8)), 5) AS drift FROM m GROUP BY model""")
def _(spark, d):
    p = preds(spark, d).withColumn("features", F.array("prob", F.col("y").cast("double"), F.col("k").cast("double"), "move"))
    return rounded(M.feature_drift(index_series(p, ["model"], ORDER, bucket(), out="idx"), ["model"], "idx"))


@query("normalised_values", "A39", f"""WITH {PR} SELECT p.model, id, round(greatest(-10, least(10, (move - m) / (sqrt(v) + 1e-8))), 6) AS z FROM prd p JOIN (SELECT model, avg(move) AS m, var_pop(move) AS v FROM prd GROUP BY model) s ON s.model = p.model""")
def _(spark, d):
    return M.normalise(preds(spark, d), ["model"], "move").select("model", "id", rnd("z").alias("z"))


CONF_SQL = f"""{PR}, sc AS (SELECT *, CASE WHEN y = 1 THEN 1 - prob ELSE prob END AS s FROM prd), th AS MATERIALIZED (SELECT model, n, list_extract(ss, CAST(floor(pos) AS INT) + 1) + (list_extract(ss, CAST(ceil(pos) AS INT) + 1) - list_extract(ss, CAST(floor(pos) AS INT) + 1)) * (pos - floor(pos)) AS q
  FROM (SELECT model, count(*) AS n, list(s ORDER BY s) AS ss, (count(*) - 1) * least(1.0, ceil(0.9 * (count(*) + 1)) / count(*))::DOUBLE AS pos FROM sc GROUP BY model))"""


@query("conformal_threshold", "A40", f"WITH {CONF_SQL} SELECT model, n, round(q, 6) AS threshold FROM th")
def _(spark, d):
    return rounded(M.conformal_threshold(preds(spark, d), ["model"]), 6)


@query("conformal_sets", "A40", f"""WITH {CONF_SQL}, z AS (SELECT p.*, q, CAST(1 - prob <= q AS INT) AS one, CAST(prob <= q AS INT) AS zer FROM prd p JOIN th USING (model))
SELECT model, id, one + zer AS set_size, round(greatest(0.01, least(0.99, CASE one + zer WHEN 2 THEN 0.5 + (prob - 0.5) * (1 - least(0.5, q)) WHEN 0 THEN greatest(0.02, least(0.98, prob)) ELSE prob END)), 6) AS calibrated, CASE one + zer WHEN 2 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0.0 END::DOUBLE AS width, CASE WHEN y = 1 THEN one ELSE zer END AS covered FROM z""")
def _(spark, d):
    p = preds(spark, d)
    return M.conformal_sets(p, M.conformal_threshold(p, ["model"]), ["model"]).select("model", "id", "set_size", rnd("calibrated").alias("calibrated"), "width", "covered")


@query("prediction_log_stats", "A25", f"""WITH {PR}, l AS (SELECT symbol, move, CASE WHEN k < 10 THEN NULL WHEN k < 15 THEN 'replaced' WHEN k < 25 THEN 'neutral' WHEN correct = 1 THEN 'correct' ELSE 'wrong' END AS outcome FROM prd),
h AS (SELECT count(*)::DOUBLE AS total, count(*) FILTER (WHERE outcome IS NULL)::DOUBLE AS pending, count(*) FILTER (WHERE outcome = 'replaced')::DOUBLE AS replaced, count(*) FILTER (WHERE outcome = 'neutral')::DOUBLE AS neutral, count(*) FILTER (WHERE outcome IN ('correct', 'wrong'))::DOUBLE AS completed, count(*) FILTER (WHERE outcome = 'correct')::DOUBLE AS correct,
  round(100.0 * count(*) FILTER (WHERE outcome = 'correct') / count(*) FILTER (WHERE outcome IN ('correct', 'wrong')), 5)::DOUBLE AS correct_pct, round(avg(abs(move)) FILTER (WHERE outcome IN ('correct', 'wrong')), 5) AS avg_move FROM l)
FROM (UNPIVOT h ON total, pending, replaced, neutral, completed, correct, correct_pct, avg_move INTO NAME item VALUE value) UNION ALL
SELECT * FROM (SELECT 'top:' || symbol, round(100.0 * count(*) FILTER (WHERE outcome = 'correct') / count(*), 5)::DOUBLE FROM l WHERE outcome IN ('correct', 'wrong') GROUP BY symbol HAVING count(*) >= 3 ORDER BY count(*) FILTER (WHERE outcome = 'correct') / count(*) DESC, count(*) DESC, symbol LIMIT 5)""")
def _(spark, d):
    k = F.col("k")
    log = preds(spark, d).select("symbol", "move", F.when(k < 10, None).when(k < 15, "replaced").when(k < 25, "neutral").when(F.col("correct") == 1, "correct").otherwise("wrong").alias("outcome"))
    return M.log_stats(log).select("item", rnd("value", 5).alias("value"))


@query("tier_counts", "A42", f"""WITH {PR} SELECT model, count(*) AS completed, count(*) FILTER (WHERE correct = 1) AS wins, round(100.0 * count(*) FILTER (WHERE correct = 1) / count(*), 5) AS win_rate, count(*) FILTER (WHERE k >= 90) AS tp3, count(*) FILTER (WHERE k >= 75 AND k < 90) AS tp2, count(*) FILTER (WHERE k >= 50 AND k < 75) AS tp1 FROM prd WHERE k >= 25 GROUP BY model""")
def _(spark, d):
    k = F.col("k")
    return preds(spark, d).filter(k >= 25).groupBy("model").agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(F.col("correct") == 1).alias("wins"), rnd(F.count_if(F.col("correct") == 1) / F.count(F.lit(1)) * 100, 5).alias("win_rate"),
        F.count_if(k >= 90).alias("tp3"), F.count_if((k >= 75) & (k < 90)).alias("tp2"), F.count_if((k >= 50) & (k < 75)).alias("tp1"))


GEN_SQL = f"""{PR}, gn AS (SELECT model, CAST(floor(epoch(ts) / 259200) AS BIGINT) AS generation, round(avg(correct), 6) AS accuracy, round(avg(power(prob - y, 2)) * 0.7, 6) AS brier, round(avg(prob), 6) AS auc, round(avg(move) / 100, 6) AS sharpe FROM prd GROUP BY ALL)"""


@query("model_registry_history", "A41", f"""WITH {GEN_SQL}, l AS (SELECT *, lag(auc) OVER w AS pa, lag(brier) OVER w AS pb, lag(accuracy) OVER w AS pc, lag(sharpe) OVER w AS ps FROM gn WINDOW w AS (PARTITION BY model ORDER BY generation)), g AS (SELECT *, sum(CASE WHEN auc < pa THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY generation) AS grp FROM l),
r AS (SELECT *, CASE WHEN pa IS NULL THEN 'first' WHEN accuracy < 0.5 THEN 'accuracy floor' WHEN brier > 0.3 THEN 'brier ceiling' WHEN ps > 0 AND sharpe < ps THEN 'sharpe regression' WHEN auc - pa >= 0 THEN 'auc improved' WHEN auc - pa >= -0.02 AND brier <= pb THEN 'brier improved' WHEN accuracy - pc > 0.01 AND brier <= pb THEN 'accuracy improved' ELSE 'no improvement' END AS reason FROM g)
SELECT model, generation, auc, reason, CAST(reason IN ('first', 'auc improved', 'brier improved', 'accuracy improved') AS INT) AS deploy, CAST(sum(CASE WHEN auc < pa THEN 1 ELSE 0 END) OVER (PARTITION BY model, grp ORDER BY generation) AS BIGINT) AS decline_streak FROM r""")
def _(spark, d):
    g = preds(spark, d).groupBy("model", F.floor(F.unix_seconds("ts") / 259200).alias("generation")).agg(
        rnd(F.avg("correct")).alias("accuracy"), rnd(F.avg(F.pow(F.col("prob") - F.col("y"), 2)) * 0.7).alias("brier"), rnd(F.avg("prob")).alias("auc"), rnd(F.avg("move") / 100).alias("sharpe"))
    return M.registry_history(g).withColumn("deploy", F.col("deploy").cast("int"))


@query("trade_to_prediction_link", "J14", f"""WITH {PR}, t AS (SELECT symbol, id AS trade_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, move FROM prd WHERE k >= 80), p AS (SELECT symbol, id AS pred_id, CAST(floor(epoch(ts)) AS BIGINT) AS pat, CASE WHEN k < 40 THEN 1 ELSE 0 END AS open FROM prd WHERE k < 80)
SELECT t.symbol, t.trade_id, p.pred_id, CASE WHEN t.move > 0 THEN 'correct' ELSE 'wrong' END AS outcome FROM t JOIN p ON p.symbol = t.symbol AND p.pat <= t.at AND (p.open = 1 OR t.at - p.pat < 86400) QUALIFY row_number() OVER (PARTITION BY t.trade_id ORDER BY p.pat DESC, p.pred_id DESC) = 1""")
def _(spark, d):
    p = preds(spark, d).withColumn("at", F.unix_seconds("ts"))
    t = p.filter(F.col("k") >= 80).select("symbol", F.col("id").alias("trade_id"), "at", "move")
    # the newest open prediction and the newest one at all; the latter counts for a day
    allp = p.filter(F.col("k") < 80).groupBy("symbol", F.col("at").alias("pat")).agg(F.max("id").alias("pred_id"))
    openp = p.filter(F.col("k") < 40).groupBy("symbol", F.col("at").alias("pat")).agg(F.max("id").alias("pred_id"))
    j = asof_join(asof_join(t, allp, ["symbol"], "at", "pat", "any", SPAN), openp, ["symbol"], "at", "pat", "open", SPAN)
    fresh = F.when(F.col("at") - F.col("any.pat") < 86400, F.col("any"))
    pick = F.when(fresh.isNotNull(), fresh).otherwise(F.col("open"))
    return j.select("symbol", "trade_id", pick["pred_id"].alias("pred_id"), F.when(F.col("move") > 0, "correct").otherwise("wrong").alias("outcome")).filter(F.col("pred_id").isNotNull())


# rows of the memory, and of its neutral part, in the registered query
MEMORY, NEUTRAL = 5000, 500


@query("memory_eviction", "P15", f"""WITH {PR}, l AS (SELECT id, ts, CASE WHEN k < 20 THEN 'pending' WHEN k < 60 THEN 'neutral' ELSE 'completed' END AS cls FROM prd),
c AS (SELECT count(*) FILTER (WHERE cls = 'completed') AS done, least(count(*) FILTER (WHERE cls = 'neutral'), {NEUTRAL}) AS neutral FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ts DESC, id DESC) AS r FROM l)
SELECT id, cls FROM r, c WHERE cls = 'completed' OR (cls = 'neutral' AND r <= {NEUTRAL}) OR (cls = 'pending' AND r <= greatest(0, {MEMORY} - done - neutral))""")
def _(spark, d):
    k = F.col("k")
    log = preds(spark, d).select("id", "ts", F.when(k < 20, "pending").when(k < 60, "neutral").otherwise("completed").alias("cls"))
    return M.evicted(log, MEMORY, NEUTRAL).select("id", "cls")


@query("training_export", "P16", f"""WITH {PR} SELECT id, y AS label, round(greatest(CASE WHEN k >= 90 THEN 5.0 WHEN k >= 75 THEN 2.5 WHEN k >= 50 THEN 1.0 ELSE 0.005 END, 0.01), 4)::DOUBLE AS weight FROM prd WHERE k >= 25 AND k % 10 <> 3 AND isfinite(CASE WHEN k % 17 = 0 THEN 'nan'::DOUBLE ELSE prob END)""")
def _(spark, d):
    k = F.col("k")
    x = preds(spark, d).filter(k >= 25).select("id", "y", F.array(F.when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("prob")), "move").alias("features"),
                                               F.when(k % 10 == 3, 0.0).when(k >= 90, 5.0).when(k >= 75, 2.5).when(k >= 50, 1.0).otherwise(0.005).alias("weight"))
    finite = ~F.exists("features", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return x.filter(finite & (F.col("weight") != 0)).select("id", F.col("y").alias("label"), rnd(F.greatest("weight", F.lit(0.01)), 4).alias("weight"))


@query("expired_predictions", "P14", f"""WITH {PR} SELECT model, count(*) AS kept FROM prd WHERE epoch((SELECT max(ts) FROM prd)) - epoch(ts) <= 86400 GROUP BY model""")
def _(spark, d):
    p = preds(spark, d)
    now = p.agg(F.max("ts"))
    return p.filter(F.col("ts") >= now.scalar() - F.expr("INTERVAL 24 HOURS")).groupBy("model").agg(F.count(F.lit(1)).alias("kept"))
