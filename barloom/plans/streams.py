"""Streams replayed over the landed tables, and the batch forms of their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import features as X
from barloom.operators.labels import forward_bars
from barloom.operators.series import index_series, running, seconds
from barloom.plans.events import BREAKOUT_WIDE, SIGNALS_SQL, signals
from barloom.plans.inputs import bars, bars_table, rnd, table
from barloom.plans.monitoring import ORDER, PR, bucket, preds
from barloom.plans.registry import query
from barloom.plans.trades import TR, trades
from barloom.plans.trades import bucket as trade_bucket
from barloom.plans.trades import ORDER as TRADE_ORDER
from barloom.session import settle
from barloom.streaming import live
from barloom.streaming.fold import use_rocksdb


def event_stream(spark, d):
    """The events table as a file stream."""
    use_rocksdb(spark)
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def event_feed(spark, d):
    """The events table as a file stream in the order of its seconds and in bounded micro-batches, for keyed folds."""
    use_rocksdb(spark)
    return live.in_order(table(spark, d, "events"), F.unix_seconds(F.col("ts").cast("timestamp")), "feed")


def tick_stream(e):
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("price"), k.alias("volume"),
                    F.when(F.col("user_id") % 2 == 0, k).otherwise(0.0).alias("taker_buy"))


@query("stream_bar_rollup", "T05", """WITH b AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 14400) * 14400 AS BIGINT) AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS trades FROM events GROUP BY ALL)
SELECT * FROM b WHERE t + 14400 <= (SELECT max(epoch(ts)) FROM events) - 3600""")
def _(spark, d):
    x = tick_stream(event_stream(spark, d))
    at = F.struct("ts", "seq")
    r = x.withWatermark("ts", "1 hour").groupBy("symbol", F.window("ts", "4 hours").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("trades"))
    return live.replay(r.select("symbol", seconds("w.start").alias("t"), "open", "high", "low", "close", "trades"), "rollup")


@query("stream_latest_bars", "T01 T02", """SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, arg_max(value, event_id) AS close, max(event_id) AS seq FROM events GROUP BY ALL
  HAVING CAST(floor(epoch(min(ts)) / 3600) * 3600 AS BIGINT) <= (SELECT max(floor(epoch(ts) / 3600) * 3600) FROM events) - 7200""")
def _(spark, d):
    x = tick_stream(event_stream(spark, d)).select("symbol", F.lit("1h").alias("interval"), F.timestamp_seconds(F.col("t") - F.col("t") % 3600).alias("open_time"), F.col("price").alias("close"), "seq", F.lit(True).alias("closed"))
    out = live.latest_bars(live.closed_bars(x.withColumn("n", F.col("seq"))).drop("closed"))
    return live.replay(out.select("symbol", seconds("open_time").alias("t"), "close", F.col("n").alias("seq")), "latest")


@query("stream_breakouts", "T03", f"""WITH RECURSIVE {SIGNALS_SQL} SELECT symbol, t, bar_idx, tier, round(close, 6) AS close, round(atr, 6) AS atr FROM sig""")
def _(spark, d):
    use_rocksdb(spark)
    # the bars are the batch ones, landed as files and streamed
    b = settle(bars(spark, d).select("symbol", "t", "open", "high", "low", "close", "volume"), "bars")
    s = live.in_order(b, F.col("t"), "feed")
    return live.replay(live.breakouts(s, BREAKOUT_WIDE, cooldown=21), "breakouts").select("symbol", "t", "bar_idx", "tier", rnd("close").alias("close"), rnd("atr").alias("atr"))


@query("stream_price_gate", "T04", """WITH RECURSIVE o AS MATERIALIZED (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
w AS (SELECT symbol, i, t, seq, price, price AS last, true AS emit FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.i, o.t, o.seq, o.price, CASE WHEN w.last <> 0 AND o.price > 0 AND abs(o.price - w.last) / w.last < 0.9 THEN w.last ELSE o.price END, NOT (w.last <> 0 AND o.price > 0 AND abs(o.price - w.last) / w.last < 0.9) FROM w JOIN o ON o.symbol = w.symbol AND o.i = w.i + 1)
SELECT symbol, t, seq, price FROM w WHERE emit""")
def _(spark, d):
    return live.replay(live.gated_prices(tick_stream(event_feed(spark, d)).select("symbol", "t", "seq", "price"), 0.9), "gate").select("symbol", "t", "seq", "price")


@query("stream_rate_history", "T13", """SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(least(row_number() OVER w, 100) AS INT) AS held, round(avg(value) OVER (w ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id)""")
def _(spark, d):
    x = tick_stream(event_feed(spark, d)).select("symbol", "t", "seq", F.col("price").alias("value"))
    return live.replay(live.rate_history(x), "rates").select("symbol", "t", "held", rnd("mean", 9).alias("mean"))


def pred_stream(spark, d):
    e = event_feed(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    p = F.round(F.least(F.lit(1.0), F.col("value") / 150), 4)
    ok = F.when((p >= 0.5).cast("int") == k % 2, 1.0).otherwise(0.0)
    return e.select(F.col("event_type").alias("model"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), p.alias("prob"), (k % 2).alias("y"), ok.alias("correct"), k.alias("k"))


@query("stream_drift", "T07")
def _(spark, d):
    # accuracy that falls in the second half of the month
    x = pred_stream(spark, d).select("model", "t", "id", F.when((F.col("t") > 1705363200) & (F.col("k") > 30), 0.0).otherwise(F.col("correct")).alias("x"))
    return live.replay(live.drift(x), "drift").select("model", "t", "id", "drift", rnd("mean").alias("mean"), "held")


@query("stream_confirmed_drift", "T09")
def _(spark, d):
    late = (F.col("t") > 1705363200) & (F.col("k") > 30)
    x = pred_stream(spark, d).select("model", "t", "id", F.when(late, 0.0).otherwise(F.col("correct")).alias("acc"), F.when(late, 1.0).otherwise(F.abs(F.col("prob") - F.col("y"))).alias("cal"), (F.col("k") / 100).alias("feat"))
    return live.replay(live.confirmed_drift(x), "confirmed")


@query("stream_page_hinkley", "T08", f"""WITH {PR}, a AS (SELECT model, id, CAST(floor(epoch(ts)) AS BIGINT) AS t, correct AS x FROM prd), b AS (SELECT *, row_number() OVER w AS n, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM a WINDOW w AS (PARTITION BY model ORDER BY t, id)),
c AS (SELECT *, sum(x - s / n - 0.005) OVER (PARTITION BY model ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS cum FROM b) SELECT model, id, round(cum - min(cum) OVER (PARTITION BY model ORDER BY t, id ROWS UNBOUNDED PRECEDING), 5) AS stat FROM c""")
def _(spark, d):
    x = pred_stream(spark, d).select("model", "t", "id", F.col("correct").alias("x"))
    return live.replay(live.page_hinkley(x), "hinkley").select("model", "id", rnd("stat", 5).alias("stat"))


@query("page_hinkley_batch", "T08", f"""WITH {PR}, b AS (SELECT model, id, correct AS x, ts, row_number() OVER w AS n, sum(correct) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM prd WINDOW w AS (PARTITION BY model ORDER BY ts, id)), c AS (SELECT *, sum(x - s / n - 0.005) OVER (PARTITION BY model ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS cum FROM b),
m AS (SELECT *, cum - min(cum) OVER (PARTITION BY model ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS stat FROM c) SELECT model, id, round(stat, 5) AS stat, CAST(n >= 30 AND stat > 20 AS INT) AS drift FROM m""")
def _(spark, d):
    p = preds(spark, d).select("model", "id", "ts", "correct")
    a = running(p, {"n": ("count", F.lit(1)), "s": ("sum", F.col("correct"))}, ["model"], ORDER, bucket())
    c = running(a, {"cum": ("sum", F.col("correct") - F.col("s") / F.col("n") - 0.005)}, ["model"], ORDER, bucket())
    m = running(c, {"low": ("min", F.col("cum"))}, ["model"], ORDER, bucket())
    stat = F.col("cum") - F.col("low")
    return m.select("model", "id", rnd(stat, 5).alias("stat"), ((F.col("n") >= 30) & (stat > 20)).cast("int").alias("drift"))


@query("stream_adaptive_coverage", "T10")
def _(spark, d):
    # calibration sample of fixed size: scores on a grid from the observed quantiles
    p = preds(spark, d)
    s = F.when(F.col("y") == 1, 1 - F.col("prob")).otherwise(F.col("prob"))
    grid = p.agg(F.percentile_approx(s, F.array(*[F.lit(i / 200) for i in range(1, 200)]), 10000)).first()[0]
    return live.replay(live.adaptive_coverage(pred_stream(spark, d).select("model", "t", "id", "prob", "y"), grid), "coverage").select("model", "id", "covered", rnd("alpha").alias("alpha"), rnd("threshold").alias("threshold"))


def ece_sql() -> str:
    """Weighted gap of mean probability and hit rate in each of five cells of the last 100 rows."""
    parts = []
    for i in range(5):
        inside = f"FILTER (WHERE prob >= {0.5 + i * 0.1!r}::DOUBLE AND prob < {0.6 + i * 0.1!r}::DOUBLE) OVER w"
        parts.append(f"coalesce(count(*) {inside} / (count(*) OVER w)::DOUBLE * abs(avg(prob) {inside} - avg(correct) {inside}), 0)")
    return " + ".join(parts)


@query("stream_health_alerts", "T11", f"""WITH RECURSIVE {PR}, z AS (SELECT model, CAST(floor(epoch(ts)) AS BIGINT) AS t, id, prob, correct, row_number() OVER (PARTITION BY model ORDER BY floor(epoch(ts)), id) AS n FROM prd),
m AS (SELECT model, t, id, n, avg(correct) OVER w AS accuracy, {ece_sql()} AS ece FROM z WINDOW w AS (PARTITION BY model ORDER BY n ROWS 99 PRECEDING)),
c AS MATERIALIZED (SELECT * FROM m WHERE n % 10 = 0 AND n >= 30 AND (accuracy < 0.5 OR ece > 0.15)),
kept AS (SELECT model, min(n) AS n FROM c GROUP BY model UNION ALL SELECT c.model, min(c.n) FROM kept k JOIN c l ON l.model = k.model AND l.n = k.n JOIN c ON c.model = k.model AND c.n > k.n AND c.t >= l.t + 3600 GROUP BY c.model)
SELECT model, t, id, round(accuracy, 6) AS accuracy, round(ece, 6) AS ece FROM c JOIN kept USING (model, n)""")
def _(spark, d):
    return live.replay(live.health_alerts(pred_stream(spark, d).select("model", "t", "id", "prob", "correct")), "health").select("model", "t", "id", rnd("accuracy").alias("accuracy"), rnd("ece").alias("ece"))


@query("loss_streaks", "T12", f"""WITH {TR}, z AS (SELECT *, row_number() OVER w - 1 AS i FROM trd WINDOW w AS (PARTITION BY agent ORDER BY ts, id, symbol_id, notional)), g AS (SELECT *, max(CASE WHEN pnl >= 0 THEN i END) OVER (PARTITION BY agent ORDER BY i ROWS UNBOUNDED PRECEDING) AS ok, sum(pnl) OVER (PARTITION BY agent, CAST(ts AS DATE) ORDER BY i ROWS UNBOUNDED PRECEDING) AS daily FROM z)
SELECT agent, i AS trade_idx, round(daily, 6) AS daily_pnl, i - coalesce(ok, -1) AS losses, CASE WHEN i - coalesce(ok, -1) >= 3 THEN greatest(0.25, 0.5 ** (i - coalesce(ok, -1) - 2)) ELSE 1.0 END::DOUBLE AS size_factor FROM g""")
def _(spark, d):
    t = index_series(trades(spark, d), ["agent"], TRADE_ORDER, trade_bucket(), out="trade_idx").withColumn("day", F.to_date("ts"))
    r = running(t, {"ok": ("max", F.when(F.col("pnl") >= 0, F.col("trade_idx")))}, ["agent"], ["trade_idx"], [F.floor(F.col("trade_idx") / 4096)])
    r = running(r, {"daily": ("sum", F.col("pnl"))}, ["agent", "day"], ["trade_idx"], [F.floor(F.col("trade_idx") / 4096)])
    losses = F.col("trade_idx") - F.coalesce("ok", F.lit(-1))
    return r.select("agent", "trade_idx", rnd("daily", 6).alias("daily_pnl"), losses.alias("losses"), F.when(losses >= 3, F.greatest(F.lit(0.25), F.pow(F.lit(0.5), (losses - 2).cast("double")))).otherwise(1.0).alias("size_factor"))


@query("stream_loss_streaks", "T12", """WITH x AS (SELECT event_type AS agent, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS id, value - 40 AS pnl FROM events),
z AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY t, id) - 1 AS i FROM x), g AS (SELECT *, max(CASE WHEN pnl >= 0 THEN i END) OVER (PARTITION BY agent ORDER BY i ROWS UNBOUNDED PRECEDING) AS ok, sum(pnl) OVER (PARTITION BY agent, t // 86400 ORDER BY i ROWS UNBOUNDED PRECEDING) AS daily FROM z)
SELECT agent, t, id, round(daily, 4) AS daily_pnl, CAST(i - coalesce(ok, -1) AS INT) AS losses, CASE WHEN i - coalesce(ok, -1) >= 3 THEN greatest(0.25, 0.5 ** (i - coalesce(ok, -1) - 2)) ELSE 1.0 END::DOUBLE AS size_factor FROM g""")
def _(spark, d):
    x = event_feed(spark, d).select(F.col("event_type").alias("agent"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), (F.col("value") - 40).alias("pnl"))
    return live.replay(live.loss_streaks(x), "streaks").select("agent", "t", "id", rnd("daily_pnl", 4).alias("daily_pnl"), "losses", "size_factor")


def pick_rows(spark, d):
    """Prices of a symbol with a pick at every print of volume 97 or more."""
    e = event_feed(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    direction = F.when(F.col("user_id") % 2 == 0, "BULLISH").otherwise("BEARISH")
    lv = X.barrier_levels(F.col("value"), F.lit(20.0), direction, {"tp1": 1.5, "tp2": 3.0, "tp3": 4.5, "sl": 1.5})
    return e.select(F.col("event_type").alias("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), F.col("event_id").alias("id"), F.when(k >= 97, "pick").otherwise("price").alias("kind"),
                    direction.alias("direction"), F.col("value").alias("price"), *[c.alias(n) for n, c in lv.items()])


PICK_SQL = """e AS MATERIALIZED (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS id, value AS price, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 97 THEN 'pick' ELSE 'price' END AS kind, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s,
  row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
p AS MATERIALIZED (SELECT *, price * (1 + s * 20.0 * 1.5 / 100.0::DOUBLE) AS tp1, price * (1 + s * 20.0 * 3.0 / 100.0::DOUBLE) AS tp2, price * (1 + s * 20.0 * 4.5 / 100.0::DOUBLE) AS tp3, price * (1 + s * -1 * 20.0 * 1.5 / 100.0::DOUBLE) AS sl FROM e WHERE kind = 'pick')"""


@query("stream_picks", "T06 R13", f"""WITH RECURSIVE {PICK_SQL}, tk AS (SELECT symbol, min(i) AS i FROM p GROUP BY symbol UNION ALL SELECT c.symbol, min(c.i) FROM tk k JOIN p l ON l.symbol = k.symbol AND l.i = k.i JOIN p c ON c.symbol = k.symbol AND c.i > k.i AND c.t - l.t >= 43200 GROUP BY c.symbol),
a AS MATERIALIZED (SELECT p.* FROM p JOIN tk USING (symbol, i)), x AS (SELECT a.id AS pick, min(e.i) AS xi FROM a JOIN e ON e.symbol = a.symbol AND e.i > a.i AND e.t - a.t > 86400 GROUP BY a.id),
h AS (SELECT a.id AS pick, a.symbol, e.i, e.t, a.s, (a.s * e.price >= a.s * a.tp1)::INT + (a.s * e.price >= a.s * a.tp2)::INT + (a.s * e.price >= a.s * a.tp3)::INT AS reached, a.s * e.price <= a.s * a.sl AS stop,
  greatest(a.s * a.price, max(a.s * e.price) OVER w) AS best, least(a.s * a.price, min(a.s * e.price) OVER w) AS worst
  FROM a JOIN e ON e.symbol = a.symbol AND e.i > a.i AND e.kind = 'price' LEFT JOIN x ON x.pick = a.id WHERE e.i < coalesce(xi, 9223372036854775807) WINDOW w AS (PARTITION BY a.id ORDER BY e.i ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, coalesce(max(reached) OVER (PARTITION BY pick ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was, min(CASE WHEN reached >= 1 THEN i END) OVER (PARTITION BY pick) AS hit, min(CASE WHEN stop THEN i END) OVER (PARTITION BY pick) AS si FROM h),
lost AS (SELECT DISTINCT pick FROM r WHERE si < coalesce(hit, 9223372036854775807)), won AS (SELECT DISTINCT pick FROM r WHERE reached = 3 AND pick NOT IN (FROM lost)),
lst AS (SELECT pick, max(was) FILTER (WHERE true) AS w0, max(reached) AS top, arg_max(best, i) AS best, arg_max(worst, i) AS worst FROM r GROUP BY pick),
o AS (SELECT a.symbol, a.id, a.t, 'PENDING' AS status, a.s, a.s * a.price AS best, a.s * a.price AS worst, FALSE AS final FROM a
UNION ALL SELECT symbol, pick, t, 'SL', s, best, worst, TRUE FROM r WHERE i = si AND pick IN (FROM lost)
UNION ALL SELECT symbol, pick, t, 'TP' || reached, s, best, worst, reached = 3 FROM r WHERE reached > was AND pick NOT IN (FROM lost)
UNION ALL SELECT a.symbol, a.id, e.t, CASE WHEN coalesce(top, 0) = 0 THEN 'EXPIRED' ELSE 'TP' || top END, a.s, coalesce(l.best, a.s * a.price), coalesce(l.worst, a.s * a.price), TRUE FROM a JOIN x ON x.pick = a.id JOIN e ON e.symbol = a.symbol AND e.i = x.xi LEFT JOIN lst l ON l.pick = a.id WHERE a.id NOT IN (FROM lost) AND a.id NOT IN (FROM won))
SELECT symbol, id, t, status, round(s * best, 6) AS best, round(s * worst, 6) AS worst, final FROM o""")
def _(spark, d):
    return live.replay(live.picks(pick_rows(spark, d)), "picks").select("symbol", "id", "t", "status", rnd("best").alias("best"), rnd("worst").alias("worst"), "final")


@query("stream_daily_cap", "T06", """WITH p AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90) SELECT id, t, day FROM p QUALIFY row_number() OVER (PARTITION BY day ORDER BY t, id) <= 20""")
def _(spark, d):
    x = event_feed(spark, d).filter(F.get_json_object("props", "$.k").cast("int") >= 90).select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return live.replay(live.capped_picks(x), "cap").select("id", "t", "day")


@query("stream_decisions", "T14", f"""WITH {PICK_SQL}, h AS (SELECT p.symbol, p.id, p.i AS pi, min(e.i) AS i FROM p JOIN e ON e.symbol = p.symbol AND e.kind = 'price' AND e.i > p.i AND (p.s * e.price >= p.s * p.tp1 OR p.s * e.price <= p.s * p.sl) GROUP BY ALL),
o AS (SELECT h.symbol, h.id, e.t, h.pi, h.i, CASE WHEN p.s * e.price >= p.s * p.tp1 THEN 0.0 ELSE 1.0 END::DOUBLE AS saved FROM h JOIN p ON p.id = h.id JOIN e ON e.symbol = h.symbol AND e.i = h.i)
SELECT symbol, id, t, CASE WHEN saved = 1 THEN 'SAVED FROM LOSS' ELSE 'MISSED PROFIT' END AS outcome, round(avg(saved) OVER (PARTITION BY symbol ORDER BY i, pi ROWS 99 PRECEDING), 6) AS accuracy FROM o""")
def _(spark, d):
    return live.replay(live.decisions(pick_rows(spark, d)), "decisions").select("symbol", "id", "t", "outcome", rnd("accuracy").alias("accuracy"))


@query("stream_fresh_titles", "T15", """WITH d AS (SELECT arg_min(event_id, event_id) AS id FROM events GROUP BY lower(event_type || ' ' || CAST(value AS VARCHAR))) SELECT count(*) AS titles FROM d""")
def _(spark, d):
    x = event_stream(spark, d).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("title"))
    return live.replay(live.fresh_titles(x, "40 days").select("id"), "titles").agg(F.count(F.lit(1)).alias("titles"))


@query("pick_status", "R13 P10", f"""WITH RECURSIVE {SIGNALS_SQL}, e AS (SELECT symbol, bar_idx, close, CASE WHEN tier = 'A' THEN 1 ELSE -1 END AS s FROM sig), h AS (SELECT e.symbol, e.bar_idx, e.s, e.close AS e0, b.bar_idx - e.bar_idx AS off, b.close AS c FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + 24),
g AS (SELECT symbol, bar_idx, min(off) FILTER (WHERE s * c <= s * e0 * (1 - s * 0.30::DOUBLE)) AS ts, {', '.join(f'min(off) FILTER (WHERE s * c >= s * e0 * (1 + s * {m}::DOUBLE)) AS t{i}' for i, m in ((1, '0.30'), (2, '0.60'), (3, '0.90')))}, max(s * c) AS best FROM h GROUP BY symbol, bar_idx)
SELECT symbol, bar_idx, CASE WHEN ts IS NOT NULL AND (t1 IS NULL OR ts < t1) THEN 'SL' WHEN t3 IS NOT NULL THEN 'TP3' WHEN t2 IS NOT NULL THEN 'TP2' WHEN t1 IS NOT NULL THEN 'TP1' ELSE 'PENDING' END AS status FROM g""")
def _(spark, d):
    b = bars_table(spark, d)
    ev = signals(spark, d, b).select("symbol", "bar_idx", "close", F.when(F.col("tier") == "A", "BULLISH").otherwise("BEARISH").alias("direction"))
    lv = X.barrier_levels(F.col("close"), F.lit(20.0), F.col("direction"), {"tp1": 1.5, "tp2": 3.0, "tp3": 4.5, "sl": 1.5})
    p = forward_bars(ev.select("*", *[c.alias(n) for n, c in lv.items()]), b, 24, ["close"])
    s = F.when(F.col("direction") == "BULLISH", 1).otherwise(-1)

    def first(name):
        hit = s * F.col("f_close") <= s * F.col(name) if name == "sl" else s * F.col("f_close") >= s * F.col(name)
        return F.min(F.when(hit, F.col("off"))).alias(f"t_{name}")
    g = p.groupBy("symbol", "bar_idx").agg(*[first(n) for n in ("sl", "tp1", "tp2", "tp3")])
    stop = F.col("t_sl").isNotNull() & (F.col("t_tp1").isNull() | (F.col("t_sl") < F.col("t_tp1")))
    return g.select("symbol", "bar_idx", F.when(stop, "SL").when(F.col("t_tp3").isNotNull(), "TP3").when(F.col("t_tp2").isNotNull(), "TP2").when(F.col("t_tp1").isNotNull(), "TP1").otherwise("PENDING").alias("status"))
