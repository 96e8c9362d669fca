"""Training-set preparation on events and shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import episodes as P
from barloom.operators import events as E
from barloom.operators import labels as L
from barloom.operators import filters as FL
from barloom.operators import joins as J
from barloom.operators import monitor as MO
from barloom.operators import specialists as SP
from barloom.operators import training as T
from barloom.operators import universe as U
from barloom.operators.series import thin
from barloom.plans.episodes import wilder_bars
from barloom.plans.events import FEATURES_SQL, SIGNALS_SQL, WILDER_SQL, signals, sql_label, sql_thin, thr
from barloom.plans.inputs import BARS_SQL, bars, bars_table, rnd, table
from barloom.plans.monitoring import ORDER, PR, bucket, preds
from barloom.plans.registry import query
from barloom.plans.windows import TR_SQL
from barloom.session import settle


def rows(spark, d):
    """Predictions in time order with position and total."""
    p = preds(spark, d).withColumn("label", (F.col("k") < 7).cast("int"))
    return T.number_rows(p.select("id", "ts", "model", "prob", "y", "label", "k", "correct", "move"), ORDER, bucket())


RW = f"""{PR}, rws AS MATERIALIZED (SELECT *, CAST(k < 7 AS INT) AS label, row_number() OVER (ORDER BY ts, id) - 1 AS pos, count(*) OVER () AS n FROM prd)"""


@query("chronological_split", "M01", f"WITH {RW} SELECT id, CASE WHEN pos < greatest(0, floor(n * 0.8) - 288) THEN 'train' WHEN pos >= floor(n * 0.8) THEN 'val' ELSE 'purged' END AS role FROM rws")
def _(spark, d):
    return T.chronological_split(rows(spark, d), 288).select("id", "role")


PATHS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate((a, b) for a in range(6) for b in range(a + 1, 6)))


@query("purged_cv_paths", "M02", f"""WITH {RW}, p AS (SELECT * FROM (VALUES {PATHS}) t(path, a, b)), g AS (SELECT *, n // 6 AS sz, CAST(least(pos // (n // 6), 5) AS INT) AS g FROM rws), x AS (SELECT g.*, path, a, b, 48 + CAST(floor(sz * 0.01) AS BIGINT) AS gap FROM g, p),
r AS (SELECT path, pos, CASE WHEN g IN (a, b) THEN 'test' WHEN NOT ((pos >= a * sz - 48 AND pos < a * sz) OR (pos >= CASE WHEN a = 5 THEN n ELSE (a + 1) * sz END AND pos < CASE WHEN a = 5 THEN n ELSE (a + 1) * sz END + gap) OR (pos >= b * sz - 48 AND pos < b * sz) OR (pos >= CASE WHEN b = 5 THEN n ELSE (b + 1) * sz END AND pos < CASE WHEN b = 5 THEN n ELSE (b + 1) * sz END + gap)) THEN 'train' END AS role FROM x)
SELECT path, role, count(*) AS n_rows, CAST(sum(pos) AS BIGINT) AS pos_sum, min(pos) AS first_pos, max(pos) AS last_pos FROM r WHERE role IS NOT NULL GROUP BY path, role""")
def _(spark, d):
    return T.purged_paths(rows(spark, d)).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("pos").alias("pos_sum"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("walk_forward_windows", "M03", f"""WITH {BARS_SQL}, s AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), w AS (SELECT symbol, n, unnest(range(300, n - 100 + 1, 100)) AS ts FROM s)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS window_id, greatest(0, ts - 300) AS train_start, greatest(0, ts - 48) AS train_end, ts AS test_start, ts + 100 AS test_end FROM w""")
def _(spark, d):
    s = bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return T.walk_forward_windows(s, 300, 100, 100).drop("n")


@query("window_assignment", "J22", f"""WITH {BARS_SQL}, s AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), w AS (SELECT symbol, unnest(range(300, n - 100 + 1, 100)) AS ts FROM s), v AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS window_id FROM w)
SELECT b.symbol, CAST(window_id AS INT) AS window_id, count(*) AS n_bars, round(sum(close), 4) AS total FROM bars b JOIN v ON v.symbol = b.symbol AND b.bar_idx >= v.ts AND b.bar_idx < v.ts + 100 GROUP BY ALL""")
def _(spark, d):
    b = bars_table(spark, d)
    w = T.walk_forward_windows(b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), 300, 100, 100)
    blocks = w.select("symbol", "window_id", F.col("test_start").alias("lo"), F.col("test_end").alias("hi")).withColumnRenamed("symbol", "s2")
    x = J.assign_windows(b, blocks, "bar_idx", "lo", "hi", 100).filter(F.col("symbol") == F.col("s2"))
    return x.groupBy("symbol", "window_id").agg(F.count(F.lit(1)).alias("n_bars"), rnd(F.sum("close"), 4).alias("total"))


@query("fold_bounds", "M04", f"""WITH {RW}, f AS (SELECT pos, CASE WHEN pos >= floor(n * 0.2) THEN CAST(least(floor((pos - floor(n * 0.2)) / floor((n - floor(n * 0.2)) / 5)), 4) AS INT) END AS fold FROM rws) SELECT fold, min(pos) AS lo, max(pos) + 1 AS hi, count(*) AS n_rows FROM f WHERE fold IS NOT NULL GROUP BY fold""")
def _(spark, d):
    f = T.assign_folds(rows(spark, d), 5, 0.2).filter(F.col("fold").isNotNull())
    return f.groupBy("fold").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.count(F.lit(1)).alias("n_rows"))


@query("recency_weights", "M05", f"WITH {RW} SELECT id, round(1.0 + 2.0 * pos / n, 6)::DOUBLE AS weight, round((1.0 + 2.0 * pos / n) * CASE WHEN pos >= floor(n * 0.7) THEN 1.5 ELSE 1 END, 6)::DOUBLE AS boosted FROM rws")
def _(spark, d):
    w = T.recency_weight()
    return rows(spark, d).select("id", rnd(w).alias("weight"), rnd(T.recent_boost(w, 1.5)).alias("boosted"))


@query("class_weights", "M06", f"""WITH {RW}, c AS (SELECT model, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM rws GROUP BY model)
SELECT r.model, label, count(*) AS n_rows, round(CASE WHEN label = 1 AND p < q THEN q / p WHEN label = 0 AND q <= p THEN p / q ELSE 1.0 END, 6)::DOUBLE AS class_weight FROM rws r JOIN c USING (model) GROUP BY r.model, label, p, q""")
def _(spark, d):
    w = T.class_weights(rows(spark, d), keys=["model"])
    return w.groupBy("model", "label", rnd("class_weight").alias("class_weight")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("temporal_undersample", "M07", f"""WITH {RW}, t AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM rws), m AS (SELECT id, label, p, q, row_number() OVER (ORDER BY pos) - 1 AS i, md5(CAST(id AS VARCHAR)) AS h FROM rws, t WHERE label = 0),
b AS (SELECT *, least(i * 10 // q, 9) AS b FROM m), z AS (SELECT *, count(*) OVER (PARTITION BY b) AS bn, row_number() OVER (PARTITION BY b ORDER BY h, id) AS r FROM b)
SELECT id, label FROM z WHERE r <= greatest(1, floor(floor(p * 3) * bn / q)) UNION ALL SELECT id, label FROM rws WHERE label = 1""")
def _(spark, d):
    return T.temporal_undersample(rows(spark, d).select("id", "label", "pos", "n"), "id", ratio=3.0).select("id", "label")


@query("hard_negative_weights", "M12", f"""WITH {RW}, b AS (SELECT id, correct = 0 AS miss, (1.0 + 2.0 * pos / n)::DOUBLE AS w0 FROM rws), w AS (SELECT *, CASE WHEN miss THEN w0 * 2 ELSE w0 END AS w FROM b), t AS (SELECT sum(w) FILTER (WHERE miss) AS h, sum(w) AS a FROM w)
SELECT id, round(CASE WHEN miss THEN w * CASE WHEN h > 0.5 * a THEN 0.5 * a / h ELSE 1 END ELSE w END, 6) AS new_weight FROM w, t""")
def _(spark, d):
    r = rows(spark, d).select("id", T.recency_weight().alias("weight"), F.col("y").alias("label"), F.when(F.col("correct") == 1, F.col("y")).otherwise(1 - F.col("y")).alias("pred"))
    return T.hard_negative_weights(r).select("id", rnd("new_weight").alias("new_weight"))


@query("capped_events", "K09", f"""WITH {RW}, w AS (SELECT model, id, round(abs(move), 4) AS weight FROM rws), c AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY model ORDER BY weight DESC, id) <= 300) SELECT * FROM c ORDER BY weight DESC, id LIMIT 1000""")
def _(spark, d):
    return T.cap_events(preds(spark, d).select("model", "id", rnd(F.abs("move"), 4).alias("weight")), ["model"], 300, 1000, tie=["id"])


SEQ_P = {"tp": 2.0, "sl": 1.0, "bars": 24}


@query("sequence_windows", "M08", f"""WITH RECURSIVE {BARS_SQL}, {TR_SQL}, trm AS MATERIALIZED (SELECT * FROM tr), {WILDER_SQL},
sq0 AS (SELECT t.symbol, t.bar_idx, t.close, coalesce(aw.y, 0) AS atr, list(t.close) OVER (PARTITION BY t.symbol ORDER BY t.bar_idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s1, list(t.volume) OVER (PARTITION BY t.symbol ORDER BY t.bar_idx ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s2 FROM trm t LEFT JOIN aw ON aw.symbol = t.symbol AND aw.bar_idx = t.bar_idx),
sq AS MATERIALIZED (SELECT *, 1 AS direction FROM sq0 WHERE bar_idx >= 80 AND (bar_idx - 80) % 10 = 0), {sql_label('sq', SEQ_P)}
SELECT l.symbol, l.bar_idx, l.label, CAST(len(s1) AS INT) AS steps, round(list_sum(s1), 4) AS close_sum, round(list_sum(s2), 4) AS volume_sum FROM lab l JOIN sq USING (symbol, bar_idx)""")
def _(spark, d):
    b = settle(wilder_bars(bars(spark, d)), "bars")
    s = T.sequences(b, ["close", "volume"], 30).withColumn("direction", F.lit(1))
    lab = L.barrier_label(s, b, SEQ_P["tp"], SEQ_P["sl"], SEQ_P["bars"])

    def total(i):
        return F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[i])
    return lab.select("symbol", "bar_idx", "label", F.size("sequence").alias("steps"), rnd(total(0), 4).alias("close_sum"), rnd(total(1), 4).alias("volume_sum"))


@query("training_matrix", "M09", f"""WITH RECURSIVE {FEATURES_SQL}, un AS (SELECT symbol, count(*) AS nb FROM bars GROUP BY symbol HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT symbol, bar_idx, close, atr, 1 AS direction FROM fp WHERE symbol IN (SELECT symbol FROM un) AND bar_idx >= 50 AND cusum_pos > {thr(E.EXTREME)} AND close < range_high),
{sql_label('cand', SEQ_P)}, labm AS MATERIALIZED (SELECT * FROM lab), {sql_thin('labm', E.MIN_GAP)}
SELECT k.symbol, k.bar_idx, label, round(weight * (1 + 2.0 * k.bar_idx / un.nb), 6) AS weight, round(f.atr_pct, 5) AS atr_pct, round(f.cusum_pos, 5) AS cusum_pos,
  round((f.close - f.range_low) / nullif(f.range_high - f.range_low, 0), 6) AS range_pos
FROM labm JOIN kept k USING (symbol, bar_idx) JOIN fp f ON f.symbol = k.symbol AND f.bar_idx = k.bar_idx JOIN un ON un.symbol = k.symbol""")
def _(spark, d):
    from barloom.operators.bars import cached_universe
    b = bars_table(spark, d)
    chosen = b.join(cached_universe(b, 100).select("symbol"), "symbol", "left_semi")
    feats = E.event_features(chosen)
    side = F.when((F.col("cusum_pos") > F.greatest(E.EXTREME["mult"] * F.col("atr_pct"), F.lit(E.EXTREME["floor"]))) & (F.col("close") < F.col("range_high")), 1)
    # every event takes part; capped_events shows the cap. Later bars of a series weigh more, by its own length
    ev = E.detect(feats, chosen, side, SEQ_P).select("symbol", "bar_idx", "label", "weight")
    x = ev.join(feats, ["symbol", "bar_idx"]).join(chosen.groupBy("symbol").agg(F.count("*").alias("n")), "symbol").withColumn("pos", F.col("bar_idx"))
    return x.select("symbol", "bar_idx", "label", rnd(F.col("weight") * T.recency_weight()).alias("weight"), rnd("atr_pct", 5).alias("atr_pct"), rnd("cusum_pos", 5).alias("cusum_pos"),
                    rnd(F.try_divide(F.col("close") - F.col("range_low"), F.col("range_high") - F.col("range_low"))).alias("range_pos"))


COLS = ["prob", "k_num", "move", "hour"]


def model_rows(spark, d):
    r = T.assign_folds(rows(spark, d), 3, 0.25)
    target = (F.col("move") + F.col("k") > 30).cast("int")
    return r.select("id", "fold", "prob", F.col("k").cast("double").alias("k_num"), "move", F.hour("ts").cast("double").alias("hour"), target.alias("label"), T.recency_weight().alias("weight"))


@query("learned_filter", "M10")
def _(spark, d):
    return T.learned_filter(model_rows(spark, d), COLS, "label", "weight", [0, 1, 2]).select("id", "fold", "label", rnd("proba", 4).alias("proba"))


STOP_TARGETS = [f"up_{level}" for level in range(15, 55, 5)]


def filter_rows(spark, d):
    """Prediction rows with one target for each of eight levels."""
    r = T.assign_folds(rows(spark, d), 3, 0.25)
    hits = [(F.col("move") + F.col("k") > int(name[3:])).cast("int").alias(name) for name in STOP_TARGETS]
    return r.select("id", "fold", "prob", F.col("k").cast("double").alias("k_num"), "move", F.hour("ts").cast("double").alias("hour"), *hits)


def filtered(spark, d):
    r = settle(filter_rows(spark, d), "filter-input")
    return FL.scored_by_filters(r, FL.fit_filters(r, COLS, STOP_TARGETS, 3), COLS, STOP_TARGETS)


@query("learned_filters_by_target", "M10")
def _(spark, d):
    names = F.array(*[F.lit(t) for t in STOP_TARGETS])
    one = filtered(spark, d).select("id", "fold", F.posexplode("proba").alias("t", "proba"))
    return one.select("id", "fold", F.element_at(names, F.col("t") + 1).alias("target"), rnd("proba", 5).alias("proba"))


@query("learned_filter_quality", "M10")
def _(spark, d):
    q = FL.filter_quality(filtered(spark, d), STOP_TARGETS)
    return q.select("target", "fold", "rows", "positives", rnd("auc", 4).alias("auc"), "weak")


@query("top_coefficients", "K10")
def _(spark, d):
    return T.top_coefficients(model_rows(spark, d), COLS, "label", "weight", 3)


@query("boosted_event_classifier", "M11")
def _(spark, d):
    r = model_rows(spark, d)
    train, test = r.filter(F.coalesce("fold", F.lit(-1)) < 2), r.filter(F.col("fold") == 2)
    return T.boosted_classifier(train, test, COLS, "label", "weight").select("id", "label", rnd("proba", 4).alias("proba"))


@query("specialist_classifiers", "M11 A40")
def _(spark, d):
    # the first three fifths fit, the next fifth stops the trees and sets the conformal limits, the last is scored
    part = F.floor(F.col("pos") * 5 / F.col("n"))
    target = (F.col("move") + F.col("k") > 30).cast("int")
    r = settle(rows(spark, d).select("id", "model", "prob", F.col("k").cast("double").alias("k_num"), "move", F.hour("ts").cast("double").alias("hour"), target.alias("y"),
                                     T.recency_weight().alias("weight"), part.alias("part")).withColumnRenamed("prob", "given"), "specialists")
    names = ["given", "move", "hour"]
    fitted = SP.fit_specialists(r.filter("part < 4").withColumn("valid", F.col("part") == 3), names, "y", "weight", "model", "valid", trees=20)
    # limits and sets both read the scores
    scored = settle(SP.scored_by_specialists(r.filter("part >= 3"), fitted, names, "model"), "specialist-scores")
    limits = MO.conformal_threshold(scored.filter("part = 3"), ["model"])
    return MO.conformal_sets(scored.filter("part = 4").select("id", "model", "y", "prob"), limits, ["model"]).select(
        "id", "model", "y", rnd("prob", 5).alias("prob"), "set_size", "covered")


VAR_SQL = """v AS (SELECT CAST(slot AS INT) AS slot, var_pop(x) AS variance FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings) GROUP BY slot)"""


@query("varying_columns", "P18", f"WITH {VAR_SQL} SELECT slot, round(variance, 8) AS variance FROM v ORDER BY variance DESC, slot LIMIT (SELECT CAST(floor(count(*) * 0.7) AS BIGINT) FROM v)")
def _(spark, d):
    return T.keep_slots(T.slot_variances(table(spark, d, "embeddings"), "embedding")).select("slot", rnd("variance", 8).alias("variance"))


@query("random_columns", "P18", f"WITH {VAR_SQL} SELECT slot FROM v ORDER BY md5('42:' || CAST(slot AS VARCHAR)) LIMIT (SELECT CAST(floor(count(*) * 0.7) AS BIGINT) FROM v)")
def _(spark, d):
    return T.keep_slots(T.slot_variances(table(spark, d, "embeddings"), "embedding"), seed=42).select("slot")


@query("event_filter", "P05 P06", f"""WITH RECURSIVE {SIGNALS_SQL}, se AS (SELECT *, CAST(hour(to_timestamp(t) AT TIME ZONE 'UTC') AS INT) AS h, CASE WHEN bar_idx % 3 = 0 THEN NULL ELSE body_eff END AS proba FROM sig)
SELECT symbol, bar_idx, tier, h AS hour, round(proba, 5) AS proba FROM se WHERE h IN (1, 2, 3, 4, 5, 9, 13, 14, 15, 16, 17, 20, 21, 22) AND tier IN ('A', 'C') AND score >= 20 AND atr <= 400 AND vol_ratio >= 0.5 AND quiet_pct < 1500 AND (proba IS NULL OR proba >= 0.5)""")
def _(spark, d):
    s = signals(spark, d).select("*", F.hour(F.timestamp_seconds("t")).alias("hour"), F.when(F.col("bar_idx") % 3 != 0, F.col("body_eff")).alias("proba"))
    hours, tiers = U.number_list(F.lit("1-5,9,13-17,20-22")), U.name_list(F.lit("a, c"))
    keep = (F.array_contains(hours, F.col("hour")) & F.array_contains(tiers, F.col("tier")) & (F.col("score") >= 20) & (F.col("atr") <= 400) & (F.col("vol_ratio") >= 0.5)
            & (F.col("quiet_pct") < 1500) & (F.col("proba").isNull() | (F.col("proba") >= 0.5)))
    return s.filter(keep).select("symbol", "bar_idx", "tier", "hour", rnd("proba", 5).alias("proba"))


GRID = [(r, q, v) for r in (0.6, 0.8, 1.2) for q in (500.0, 2000.0) for v in (0.5, 0.8)]


@query("detector_grid_search", "A23", f"""WITH RECURSIVE {BARS_SQL}, {TR_SQL}, trm AS MATERIALIZED (SELECT * FROM tr), {WILDER_SQL},
q0 AS (SELECT trm.*, coalesce(aw.y, 0) AS atr, close - open AS body, CASE WHEN trm.bar_idx >= 20 THEN avg(abs(close - open)) OVER (PARTITION BY trm.symbol ORDER BY trm.bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS pb,
   CASE WHEN trm.bar_idx >= 20 THEN avg(volume) OVER (PARTITION BY trm.symbol ORDER BY trm.bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) ELSE 0 END AS va FROM trm LEFT JOIN aw ON aw.symbol = trm.symbol AND aw.bar_idx = trm.bar_idx),
g AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r}::DOUBLE, {q}::DOUBLE, {v}::DOUBLE)' for i, (r, q, v) in enumerate(GRID))}) t(gid, r, q, v)),
cnd AS MATERIALIZED (SELECT gid, q0.symbol || '#' || gid AS symbol, q0.symbol AS sym, bar_idx, close, atr FROM q0, g WHERE bar_idx > 20 AND body > 0 AND body / greatest(open, 1e-12) >= 0.01 AND pb > 0 AND va > 0 AND body / nullif(high - low, 0) >= 0.3 AND body / pb >= r AND pb / greatest(open, 1e-12) * 100 < q AND volume / va >= v),
{sql_thin('cnd', 21)}, e AS (SELECT cnd.* FROM cnd JOIN kept USING (symbol, bar_idx)),
h AS (SELECT e.gid, e.symbol, e.bar_idx, b.bar_idx AS j, b.low <= e.close - 1.0 * e.atr AS sl, b.high >= e.close + 2.0 * e.atr AS tp FROM e JOIN bars b ON b.symbol = e.sym AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + 24 WHERE e.atr > 0),
x AS (SELECT gid, symbol, bar_idx, arg_min(sl, j) FILTER (WHERE sl OR tp) AS hsl FROM h GROUP BY ALL), sz AS (SELECT gid, count(*) AS n_sig, count(*) FILTER (WHERE NOT hsl) AS tp, count(*) FILTER (WHERE hsl) AS sl FROM x GROUP BY gid)
SELECT r AS body_ratio, q AS quiet_pct, v AS vol_mult, n_sig, tp, sl, round(coalesce(100.0 * tp / nullif(tp + sl, 0), 0), 1) AS accuracy, round(CASE WHEN sl > 0 THEN tp * 2.0 / (sl * 1.0) ELSE 'inf'::DOUBLE END, 2)::DOUBLE AS profit_factor FROM sz JOIN g USING (gid)""")
def _(spark, d):
    from barloom.functions import rolling as R
    from barloom.operators.series import over_chunks
    b = settle(wilder_bars(bars(spark, d)), "bars")
    body = F.col("close") - F.col("open")
    x = over_chunks(b, lambda x, f: x.select("symbol", "bar_idx", "_chunk", "close", "atr", body.alias("body"), F.col("open"), (F.col("high") - F.col("low")).alias("span"), "volume", R.prior_body(f).alias("pb"), R.prior_mean("volume", 20, f).alias("va")), back=20)
    base = x.filter((F.col("bar_idx") > 20) & (F.col("body") > 0) & (F.col("body") / F.greatest(F.col("open"), F.lit(1e-12)) >= 0.01) & (F.col("pb") > 0) & (F.col("va") > 0) & (F.try_divide("body", "span") >= 0.3))
    ratio, quiet, vol = F.try_divide("body", "pb"), F.col("pb") / F.greatest(F.col("open"), F.lit(1e-12)) * 100, F.try_divide("volume", "va")
    grid = F.array(*[F.struct(F.lit(i).alias("gid"), F.lit(r).alias("r"), F.lit(q).alias("q"), F.lit(v).alias("v")) for i, (r, q, v) in enumerate(GRID)])
    hit = F.filter(grid, lambda g: (ratio >= g["r"]) & (quiet < g["q"]) & (vol >= g["v"]))
    cand = base.withColumn("g", F.explode(hit)).select("symbol", F.col("g.gid").alias("gid"), "g.r", "g.q", "g.v", "bar_idx", "close", "atr", F.lit(1).alias("direction"))
    kept = thin(cand, 21, keys=("symbol", "gid"))
    out = L.directional_exit(kept, b, 2.0, 1.0, 24, keys=("symbol", "gid", "bar_idx", "direction"))
    g = out.groupBy("r", "q", "v").agg(F.count(F.lit(1)).alias("n_sig"), F.count_if(F.col("outcome") == "TP").alias("tp"), F.count_if(F.col("outcome") == "SL").alias("sl"))
    return g.select(F.col("r").alias("body_ratio"), F.col("q").alias("quiet_pct"), F.col("v").alias("vol_mult"), "n_sig", "tp", "sl", rnd(F.coalesce(F.try_divide(100.0 * F.col("tp"), F.col("tp") + F.col("sl")), F.lit(0.0)), 1).alias("accuracy"),
                    rnd(F.when(F.col("sl") > 0, F.try_divide(F.col("tp") * 2.0, F.col("sl") * 1.0)).otherwise(float("inf")), 2).alias("profit_factor"))


@query("refreshed_outcomes", "E20", f"""WITH RECURSIVE {SIGNALS_SQL}, o AS (SELECT symbol, bar_idx AS start_bar, round(atr, 4) AS a, round(score, 2) AS b FROM sig), n AS (SELECT symbol, start_bar, CASE WHEN start_bar % 2 = 0 THEN a * 2 END AS a, round(body_eff, 5) AS c FROM o JOIN sig s USING (symbol) WHERE s.bar_idx = o.start_bar AND start_bar % 3 <> 0)
SELECT o.symbol, o.start_bar, round(coalesce(n.a, o.a), 4) AS atr, o.b AS score, n.c AS body_eff FROM o LEFT JOIN n USING (symbol, start_bar)""")
def _(spark, d):
    s = signals(spark, d).select("symbol", F.col("bar_idx").alias("start_bar"), rnd("atr", 4).alias("atr"), rnd("score", 2).alias("score"), rnd("body_eff", 5).alias("body_eff"))
    new = s.filter(F.col("start_bar") % 3 != 0).select("symbol", "start_bar", F.when(F.col("start_bar") % 2 == 0, F.col("atr") * 2).alias("atr"), "body_eff")
    return P.refresh_rows(s.drop("body_eff"), new, ["symbol", "start_bar"]).withColumn("atr", rnd("atr", 4))
