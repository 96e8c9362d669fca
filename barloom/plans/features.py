"""Scalar blocks, order books, timeframes and positioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import complexity as C
from barloom.functions import features as X
from barloom.functions import rolling as R
from barloom.operators import timeframes as TF
from barloom.operators import universe as U
from barloom.operators.series import over_chunks
from barloom.plans.events import SIGNALS_SQL
from barloom.plans.inputs import BARS_SQL, bars, raw_bars, rnd, sql_bars, table
from barloom.plans.registry import query
from barloom.session import settle
from barloom.plans.windows import W, last, sql_ema, sql_recur


def rounded(df, digits=6):
    return df.select(*[rnd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("calendar_fields", "F05 F06", """SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS dow, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INT) AS hour_of_week, CAST(weekofyear(ts) AS INT) AS iso_week, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_cos, round(hour(ts) / 24.0::DOUBLE, 6) AS hour_norm, round((isodow(ts) - 1) / 7.0::DOUBLE, 6) AS day_norm, CAST(hour(ts) BETWEEN 13 AND 21 AS INT) AS us_session, CAST(hour(ts) BETWEEN 1 AND 9 AS INT) AS asia_session,
  CAST(hour(ts) IN (0, 8, 16) AS INT) AS funding_hour FROM events""")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    return rounded(table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in {**X.calendar(ts), **X.cyclic(ts)}.items()]))


@query("math_functions", "F07", """SELECT event_id, round(greatest(1.0, least(100.0, value)), 6) AS clipped, round(log10(greatest(value, 1e-9)), 6) AS lg, round(ln(1 + value), 6) AS l1p, round(tanh(value / 100), 6) AS th, round(exp(-value / 100), 6) AS ex, round(sqrt(value), 6) AS sq, round(value / nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0), 9) AS safe FROM events""")
def _(spark, d):
    v = F.col("value")
    safe = F.try_divide(v, F.get_json_object("props", "$.k").cast("double"))
    parts = {"clipped": R.clip(v, 1.0, 100.0), "lg": F.log10(F.greatest(v, F.lit(1e-9))), "l1p": F.log1p(v), "th": F.tanh(v / 100), "ex": F.exp(-v / 100), "sq": F.sqrt(v)}
    return table(spark, d, "events").select("event_id", *[rnd(c).alias(k) for k, c in parts.items()], rnd(safe, 9).alias("safe"))


@query("array_functions", "F12", """SELECT vec_id, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90, CAST(arg_max(i, (x, -i)) AS INT) AS argmax, round(max(d), 6) AS max_step, round(max(x), 6) AS top
  FROM (SELECT vec_id, i, x, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) GROUP BY vec_id""")
def _(spark, d):
    a = F.col("a")

    def pct(q):
        s = F.array_sort(a)
        pos = (F.size(a) - 1) * F.lit(q)
        lo, hi = F.get(s, F.floor(pos).cast("int")), F.get(s, F.ceil(pos).cast("int"))
        return lo + (hi - lo) * (pos - F.floor(pos))
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    step = F.zip_with(F.slice(a, 2, 10000), F.slice(a, 1, F.size(a) - 1), lambda p, q: p - q)
    return rounded(x.select("vec_id", pct(0.1).alias("p10"), pct(0.9).alias("p90"), (F.array_position(a, F.array_max(a)) - 1).cast("int").alias("argmax"), F.array_max(step).alias("max_step"), F.array_max(a).alias("top")))


@query("barrier_levels", "P10", """SELECT o_orderkey AS id, round(o_totalprice * (1 + s * m * 1.5 / 100), 6) AS tp1, round(o_totalprice * (1 + s * m * 3.0 / 100), 6) AS tp2, round(o_totalprice * (1 + s * m * 4.5 / 100), 6) AS tp3, round(o_totalprice * (1 - s * m * 1.5 / 100), 6) AS sl
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END AS s, (o_custkey % 10)::DOUBLE AS m FROM orders)""")
def _(spark, d):
    o = table(spark, d, "orders")
    lv = X.barrier_levels(F.col("o_totalprice"), (F.col("o_custkey") % 10).cast("double"), F.when(F.col("o_orderstatus") == "F", "BULLISH").otherwise("BEARISH"), {"tp1": 1.5, "tp2": 3.0, "tp3": 4.5, "sl": 1.5})
    return rounded(o.select(F.col("o_orderkey").alias("id"), *[c.alias(k) for k, c in lv.items()]), 6)


@query("expected_magnitude", "P11", """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice / 1e3 END AS a4, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 2e3 END AS a1, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 4e3 END AS a15, o_totalprice / 7e3 AS a5, (o_custkey % 3) * 1000.0::DOUBLE AS price, 50 + o_custkey % 50 AS conf FROM orders),
b AS (SELECT *, coalesce(nullif(a4, 0), nullif(a1, 0) * 2, nullif(a15, 0) * 4, nullif(a5, 0) * 6.92) AS atr FROM a) SELECT id, round(coalesce(least(20.0, 2 * CASE WHEN price > 0 THEN atr / price * 100 ELSE 0 END * greatest(0.5, least(2.0, 0.5 + (conf - 50) / 50 * 1.5))), 0), 8) AS magnitude FROM b""")
def _(spark, d):
    o = table(spark, d, "orders")
    p = F.col("o_totalprice")
    atr = {"4h": F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(p / 1e3), "1h": F.when(F.col("o_orderkey") % 3 != 0, p / 2e3), "15m": F.when(F.col("o_orderkey") % 5 != 0, p / 4e3), "5m": p / 7e3}
    return rounded(o.select(F.col("o_orderkey").alias("id"), X.expected_magnitude(atr, (F.col("o_custkey") % 3) * 1000.0, 50 + F.col("o_custkey") % 50).alias("magnitude")), 8)


@query("liquidation_cascade", "P17", f"""WITH {BARS_SQL}, x AS (SELECT symbol, bar_idx, (taker_buy_base / nullif(volume, 0) - 0.5) / 10 AS fund, (quote_volume / nullif(first_value(quote_volume) OVER {last(4)}, 0) - 1) * 100 AS surge, volume / nullif(avg(volume) OVER {last(20)}, 0) AS ov, (high - low) / (close + 1e-8) AS ap FROM bars),
m AS (SELECT *, coalesce(CAST(fund <= -0.025 AS INT), 0) + coalesce(CAST(surge >= 12 AS INT), 0) + coalesce(CAST(ov >= 1.5 AS INT), 0) AS n FROM x WHERE fund IS NOT NULL AND surge IS NOT NULL AND ov IS NOT NULL)
SELECT symbol, bar_idx, CAST(n >= 2 AS INT) AS cascade, CASE WHEN n >= 2 THEN round(least(least(3 * ap, 7.5) * (1 + greatest(0, (abs(fund) - 0.025) / 0.025) * 0.5), 15.0), 2) ELSE 0.0 END AS target_dist_pct, CASE WHEN n >= 2 THEN round(least(1.25, 1 + (n - 1) * 0.15), 3) ELSE 1.0 END::DOUBLE AS size_boost,
  concat_ws('+', CASE WHEN fund <= -0.025 THEN 'funding' END, CASE WHEN surge >= 12 THEN 'oi_surge' END, CASE WHEN ov >= 1.5 THEN 'oi_vol_ratio' END) AS reason FROM m""")
def _(spark, d):
    def build(x, f):
        return x.select("symbol", "bar_idx", "_chunk", ((F.try_divide(F.col("taker_buy_base"), F.col("volume")) - 0.5) / 10).alias("fund"), ((F.try_divide(F.col("quote_volume"), F.first("quote_volume").over(f.last(4))) - 1) * 100).alias("surge"),
                        F.try_divide(F.col("volume"), F.avg("volume").over(f.last(20))).alias("ov"), ((F.col("high") - F.col("low")) / (F.col("close") + R.EPS)).alias("ap")).dropna()
    x = over_chunks(bars(spark, d), build, back=19)
    return x.select("symbol", "bar_idx", *[c.alias(k) for k, c in X.cascade_signal(F.col("fund"), F.col("surge"), F.col("ov"), F.col("ap")).items()])


BOOK_N = 10
BOOK_SQL = """q AS (SELECT l_orderkey AS id, l_extendedprice / l_quantity AS px, l_quantity AS qty FROM lineitem), g AS (SELECT id, list(struct_pack(px := px, qty := qty) ORDER BY px DESC, qty DESC) AS al, count(*) AS n FROM q GROUP BY id HAVING count(*) >= 2),
bk AS (SELECT id, al[1:10] AS b, list_reverse(list_transform(al, lambda x: struct_pack(px := x.px + al[1].px, qty := 51 - x.qty)))[1:10] AS a FROM g),
v AS (SELECT *, list_sum(list_transform(b[1:5], lambda x: x.qty)) AS bq, list_sum(list_transform(a[1:5], lambda x: x.qty)) AS aq, list_sum(list_transform(b[1:5], lambda x: x.px * x.qty)) AS bc, list_sum(list_transform(a[1:5], lambda x: x.px * x.qty)) AS ac,
  list_sum(list_transform(b, lambda x: x.qty)) AS tb, list_sum(list_transform(a, lambda x: x.qty)) AS ta, (b[1].px + a[1].px) / 2 AS mid, list_sum(list_transform(list_zip(b[1:least(5, len(a), len(b))], a[1:least(5, len(a), len(b))]), lambda z: z[1].px * z[2].qty + z[2].px * z[1].qty)) AS cr FROM bk)"""


@query("order_book_features", "E24", f"""WITH {BOOK_SQL} SELECT id, round((bq - aq) / (bq + aq), 6) AS imbalance, round((bc - ac) / (bc + ac), 6) AS cash_imbalance, round((a[1].px - b[1].px) / b[1].px * 100, 5) AS spread_pct, round(bq / aq, 6) AS depth_ratio, round((ac / aq - bc / bq) / (bc / bq) * 100, 5) AS vwap_spread_pct,
  round(b[1].qty / tb, 6) AS bid_top_share, round(a[1].qty / ta, 6) AS ask_top_share, {', '.join(f'round(coalesce((coalesce(b[{i}].qty, 0) - coalesce(a[{i}].qty, 0)) / nullif(coalesce(b[{i}].qty, 0) + coalesce(a[{i}].qty, 0), 0), 0), 6) AS flow_l{i}' for i in range(1, 6))},
  round(CASE WHEN len(b) >= 5 THEN list_sum(list_transform([2, 3, 4, 5], lambda i: abs(b[i].px - b[i - 1].px) / b[1].px * 100)) / 4 ELSE 0 END, 5) AS bid_gap_pct, round(CASE WHEN len(a) >= 5 THEN list_sum(list_transform([2, 3, 4, 5], lambda i: abs(a[i].px - a[i - 1].px) / a[1].px * 100)) / 4 ELSE 0 END, 5) AS ask_gap_pct,
  round(CASE WHEN len(b) > 2 THEN b[3].qty / b[1].qty ELSE 1 END, 6) AS queue_ratio, round((cr / (bq + aq) - mid) / mid * 100, 5) AS micro_delta_pct, round((id % 7 - 3) / 100.0::DOUBLE, 6) AS funding_pct FROM v""")
def _(spark, d):
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"))
    # an order has few lines: one book per order
    g = q.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("px", "qty")), asc=False).alias("b")).filter(F.size("b") >= 2)
    asks = F.reverse(F.transform("b", lambda x: F.struct((x["px"] + F.col("b")[0]["px"]).alias("px"), (51 - x["qty"]).alias("qty"))))
    g = g.withColumn("a", asks)
    f = X.book_features(F.col("b"), F.col("a"), (F.col("id") % 7 - 3) / 10000.0)
    five = {"spread_pct", "vwap_spread_pct", "bid_gap_pct", "ask_gap_pct", "micro_delta_pct"}
    return g.select("id", *[rnd(c, 5 if k in five else 6).alias(k) for k, c in f.items()])


@query("order_book_proxies", "E25", f"""WITH {BARS_SQL}, x AS (SELECT *, greatest(-1, least(1, taker_buy_base / greatest(volume, 1e-8) * 2 - 1)) AS push, close + 1e-8 AS c, avg(high - low) OVER {last(5)} AS r5 FROM bars)
SELECT symbol, bar_idx, round(push, 6) AS imbalance, round(push, 6) AS cash_imbalance, round((high - low) / c * 100, 4) AS spread_pct, round(taker_buy_base / greatest(greatest(volume, 1e-8) - taker_buy_base, 1e-8), 3) AS depth_ratio, round((close - (high + low) / 2) / c * 100, 4) AS vwap_spread_pct, 0.5::DOUBLE AS bid_top_share, 0.5::DOUBLE AS ask_top_share,
  {', '.join(f'round(push * {k}, 6) AS flow_l{i}' for i, k in enumerate((1.0, 0.85, 0.70, 0.55, 0.40), 1))}, round(r5 / c * 20, 4) AS bid_gap_pct, round(r5 / c * 20, 4) AS ask_gap_pct, 1.0::DOUBLE AS queue_ratio, round((close - (high + low) / 2) / c * 100, 4) AS micro_delta_pct FROM x""")
def _(spark, d):
    four = {"spread_pct", "vwap_spread_pct", "bid_gap_pct", "ask_gap_pct", "micro_delta_pct"}

    def build(x, f):
        p = X.book_proxies(F.avg(F.col("high") - F.col("low")).over(f.last(5)))
        return x.select("symbol", "bar_idx", "_chunk", *[rnd(c, 4 if k in four else 3 if k == "depth_ratio" else 6).alias(k) for k, c in p.items()])
    return over_chunks(bars(spark, d), build, back=4)


@query("futures_positioning", "E26", f"WITH {BARS_SQL} SELECT symbol, bar_idx, round(least(10.0, quote_volume * close / (volume + 1e-8) / 1000), 5) AS oi_intensity, round(least(5.0, volume / (quote_volume / 1000 + 1e-8)), 5) AS speculation FROM bars")
def _(spark, d):
    p = X.positioning(F.col("quote_volume") / 1000, F.col("close"), F.col("volume"))
    return bars(spark, d).select("symbol", "bar_idx", *[rnd(c, 5).alias(k) for k, c in p.items()])


@query("volume_profile_weights", "F15", """WITH pr AS (SELECT CAST(hour(ts) AS INT) AS h, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events GROUP BY 1), s AS (SELECT event_id, event_type AS plan, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(hour(ts) AS INT) AS h FROM events)
SELECT event_id, round(v / sum(v) OVER (PARTITION BY plan, day), 6) AS weight FROM s JOIN pr USING (h)""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("plan"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day"), F.hour("ts").alias("h"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    s = e.join(F.broadcast(e.groupBy("h").agg(F.sum("k").alias("v"))), "h")     # 24 rows
    tot = s.groupBy("plan", "day").agg(F.sum("v").alias("_t"))
    return s.join(tot, ["plan", "day"]).select("event_id", rnd(F.col("v") / F.col("_t")).alias("weight"))


@query("hazard_limits", "R11", f"""WITH RECURSIVE {SIGNALS_SQL}, p AS (SELECT s.symbol, s.bar_idx AS start_bar, b.bar_idx - s.bar_idx AS off, s.close AS e, b.close AS c, s.atr / s.close AS ap FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx + 1 AND s.bar_idx + 24 WHERE s.atr > 0 AND s.close > 0),
n AS (SELECT *, CASE WHEN off >= 3 AND c > e THEN least(1.0, off / 24) * ln(c / e) / (off / 288) + (1 - least(1.0, off / 24)) * 0.7 ELSE 0.7 END AS n FROM p),
t AS (SELECT *, CASE WHEN n <= 0.517 THEN 0 ELSE ln(n / 0.517) / 2.92 END AS t1, CASE WHEN 1.5 * n <= 0.517 THEN 0 ELSE ln(1.5 * n / 0.517) / 2.92 END AS t2, CASE WHEN 2.5 * n <= 0.517 THEN 0 ELSE ln(2.5 * n / 0.517) / 2.92 END AS t3 FROM n)
SELECT symbol, start_bar, off, round(n, 5) AS velocity, round(CASE WHEN n <= 0.517 THEN greatest(2.0, 4.2 * sqrt(greatest(n / 0.517, 0.1))) ELSE greatest(2.0, least(10.0, (exp(least(n * t1, 500)) - 1) / ap)) END, 5) AS bank_atr, CAST(greatest(12, least(144, floor(t2 * 288))) AS INT) AS pre_limit, CAST(greatest(12, least(576, floor(greatest(0, t3 - off / 288) * 288))) AS INT) AS post_limit FROM t""")
def _(spark, d):
    from barloom.operators.labels import forward_bars
    from barloom.plans.events import signals
    b = bars(spark, d)
    ev = signals(spark, d, b).filter((F.col("atr") > 0) & (F.col("close") > 0)).select("symbol", F.col("bar_idx").alias("start_bar"), "close", "atr")
    p = forward_bars(ev, b, 24, ["close"], at="start_bar").withColumn("n", X.velocity(F.col("close"), F.col("f_close"), F.col("off")))
    n = F.col("n")
    return p.select("symbol", "start_bar", "off", rnd(n, 5).alias("velocity"), rnd(X.bank_distance(n, F.col("atr") / F.col("close")), 5).alias("bank_atr"), X.pre_bank_limit(n).alias("pre_limit"), X.post_bank_limit(n, F.col("off")).alias("post_limit"))


@query("fallback_score", "E21", f"""WITH RECURSIVE {SIGNALS_SQL}, w AS (SELECT s.symbol, s.bar_idx, s.score, s.body_eff, s.vol_ratio, s.body_ratio, list(b.close ORDER BY b.bar_idx) AS cs, arg_max(b.high, b.bar_idx) AS h, arg_max(b.low, b.bar_idx) AS l, arg_max(b.volume, b.bar_idx) AS v, list(b.volume ORDER BY b.bar_idx) AS vs
   FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx - 24 AND s.bar_idx WHERE s.bar_idx >= 24 GROUP BY ALL),
e AS (SELECT *, cs[25] AS c, list_reduce(cs, lambda a, x: a * (1 - 2.0::DOUBLE / 11) + x * (2.0::DOUBLE / 11)) AS ema, list_avg(vs[22:24]) AS v3 FROM w),
z AS (SELECT *, greatest(0, least(1, (greatest(-1, least(1, (c - ema) / greatest(ema * 0.001, 1e-12))) + 0.1) / 0.7)) AS trend, greatest(0, least(1, body_ratio / 100 / greatest((h - l) / greatest(c, 1e-8), 1e-8) - 0.5)) AS edge, greatest(0, least(1, v / greatest(vs[24], 1e-8) - 0.3)) AS pers, greatest(0, least(1, (v3 - v) / greatest(v3, 1e-8))) AS fade FROM e)
SELECT symbol, bar_idx, round(greatest(0, least(100, 100 * (0.30 * score / 100 + 0.24 * greatest(0, least(1, (vol_ratio - 1) / 4)) + 0.16 * trend + 0.16 * edge + 0.14 * greatest(0, least(1, 0.6 * body_eff + 0.4 * pers))) - 15 * fade)), 4) AS score FROM z""")
def _(spark, d):
    from barloom.plans.events import signals
    b = bars(spark, d)

    def build(x, f):
        seen = F.collect_list("close").over(f.last(25))
        mean10 = F.aggregate(F.slice(seen, 2, 24), seen[0], lambda acc, v: acc * (1 - 2.0 / 11) + v * (2.0 / 11))
        return x.select("symbol", "bar_idx", "_chunk", "high", "low", "close", "volume", mean10.alias("ema"), f.lag("volume").alias("volume_before"), F.avg("volume").over(f.prior(3)).alias("volume_mean3"))
    x = over_chunks(b, build, back=24)
    s = signals(spark, d, b).filter(F.col("bar_idx") >= 24).select("symbol", "bar_idx", "score", "body_eff", "vol_ratio", F.col("body_ratio").alias("body_pct"))
    j = s.join(x, ["symbol", "bar_idx"])
    return j.select("symbol", "bar_idx", rnd(X.fallback_score({c: F.col(c) for c in j.columns}), 4).alias("score"))


@query("complexity_measures", "F08 F09 F10 F11")
def _(spark, d):
    b = over_chunks(bars(spark, d), lambda x, f: x.select("symbol", "bar_idx", "_chunk", F.collect_list("close").over(f.last(50)).alias("v")).filter(f.full(50)), back=49)
    x = b.select("symbol", "bar_idx", C.hurst(F.col("v")).alias("hurst"), C.sample_entropy(F.col("v")).alias("entropy"), C.fluctuation_width(F.col("v")).alias("width"))
    return rounded(x.withColumn("regime_entropy", X.regime_entropy(F.col("entropy"), F.col("hurst"), F.lit(0.5), F.col("width"))))


NEUTRAL = {1: 0.5, 3: 1.0, 5: -1.0}


@query("neutral_vectors", "P09", """SELECT vec_id, CAST(i AS INT) AS slot, round(CASE WHEN x > 0.2 THEN CASE i WHEN 1 THEN 0.5 WHEN 3 THEN 1.0 WHEN 5 THEN -1.0 ELSE 0 END ELSE x END, 6)::DOUBLE AS v
FROM (SELECT vec_id, i, coalesce(embedding[i + 1]::DOUBLE, 0) AS x FROM embeddings, range(70) r(i))""")
def _(spark, d):
    # large entries stand in for readings that are not numbers
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v > 0.2, float("nan")).otherwise(v)).alias("a"))
    return e.select("vec_id", F.posexplode(X.neutral_vector(F.col("a"), 70, NEUTRAL)).alias("slot", "v")).withColumn("v", rnd("v"))


# -- timeframes ---------------------------------------------------------------------------------

IV = {"1h": 3600, "2h": 7200, "4h": 14400}
# bars of every interval as series of their own: symbol|interval
MI_SQL = f"""{BARS_SQL.replace('bars AS MATERIALIZED', 'base AS MATERIALIZED')},
bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_idx FROM (SELECT symbol || '|' || iv AS symbol, (t // w) * w AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume, sum(taker_buy_base) AS taker_buy_base
  FROM base, (VALUES {', '.join(f"('{k}', {v})" for k, v in IV.items())}) g(iv, w) GROUP BY symbol, iv, w, t // w))"""
AN_SQL = f"""{MI_SQL}, tr AS MATERIALIZED (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn, greatest(close - lag(close) OVER ({W}), 0) AS gain, greatest(lag(close) OVER ({W}) - close, 0) AS loss FROM bars),
dm AS MATERIALIZED (SELECT symbol, bar_idx, tr AS tra, CASE WHEN bar_idx = 0 THEN 0.0::DOUBLE ELSE tr END AS tr0, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0::DOUBLE END AS mdm, gain, loss, avg(gain) OVER {last(14)} AS g0, avg(loss) OVER {last(14)} AS l0 FROM tr),
{sql_ema('e12', 'bars', 'close', 12)}, {sql_ema('e26', 'bars', 'close', 26)}, mc AS MATERIALIZED (SELECT symbol, bar_idx, e12.y - e26.y AS macd FROM e12 JOIN e26 USING (symbol, bar_idx)), {sql_ema('sg', 'mc', 'macd', 9)},
{sql_ema('ta', 'dm', 'tr0', 14)}, {sql_ema('pe', 'dm', 'pdm', 14)}, {sql_ema('me', 'dm', 'mdm', 14)}, {sql_ema('atx', 'dm', 'tra', 14)},
dx AS MATERIALIZED (SELECT symbol, bar_idx, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) AS dx FROM (SELECT ta.symbol, ta.bar_idx, coalesce(100 * pe.y / nullif(ta.y, 0), 0) AS p, coalesce(100 * me.y / nullif(ta.y, 0), 0) AS m FROM ta JOIN pe USING (symbol, bar_idx) JOIN me USING (symbol, bar_idx))), {sql_ema('ad', 'dx', 'dx', 14)},
{sql_recur('ru', 'dm', 'g0', '(p.y * 13 + b.gain) / 14', 'bar_idx = 14')}, {sql_recur('rd', 'dm', 'l0', '(p.y * 13 + b.loss) / 14', 'bar_idx = 14')},
k0 AS (SELECT b.*, coalesce(close - lag(close) OVER ({W}), 0) AS dc, coalesce((2 * sum(taker_buy_base) OVER {last(10)} - sum(volume) OVER {last(10)}) / (sum(volume) OVER {last(10)} + 1e-8), 0) AS tim, avg(close) OVER {last(20)} AS m20, avg(close) OVER {last(50)} AS m50, stddev_pop(close) OVER {last(20)} AS s20, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret,
  CASE WHEN bar_idx >= 13 THEN coalesce(100.0 * (close - min(low) OVER {last(14)}) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0), 50.0) ELSE 50.0 END AS k FROM bars b),
k1 AS (SELECT *, CASE WHEN bar_idx >= 15 THEN avg(k) OVER {last(3)} ELSE k END AS d, CASE WHEN bar_idx >= 19 AND s20 > 0 THEN (close - m20 + 2 * s20) / (4 * s20) ELSE 0.5 END AS bb, CASE WHEN bar_idx >= 20 THEN stddev_pop(coalesce(ret, 0)) OVER {last(20)} ELSE 0 END AS vola,
  coalesce(volume / nullif(avg(volume) OVER {last(20)}, 0), 1) AS vr, {', '.join(f'coalesce(close / nullif(lag(close, {n}) OVER ({W}), 0) - 1, 0) AS mo{n}' for n in (5, 10, 20, 50))}, list(dc) OVER {last(13)} AS ds, list(volume) OVER {last(13)} AS vs FROM k0),
an0 AS (SELECT k1.*, CASE WHEN k1.bar_idx >= 13 AND list_stddev_pop(list_append(ds, 0.0)) > 0 AND list_sum(vs) > 0 THEN abs(list_sum(list_transform(list_zip(ds, vs), lambda z: z[2] * tanh(z[1] / list_stddev_pop(list_append(ds, 0.0)) * 0.79788456)))) / list_sum(vs) ELSE 0.5 END AS vpin, mc.macd AS ml, sg.y AS sgl, atx.y AS atr, ad.y AS adx, CASE WHEN ru.y IS NULL THEN 50.0 WHEN rd.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + ru.y / rd.y) END AS rsi FROM k1 JOIN mc USING (symbol, bar_idx) JOIN sg USING (symbol, bar_idx) JOIN atx USING (symbol, bar_idx) JOIN ad USING (symbol, bar_idx) LEFT JOIN ru USING (symbol, bar_idx) LEFT JOIN rd USING (symbol, bar_idx)),
an1 AS (SELECT *, CASE WHEN rsi > 70 THEN 20 WHEN rsi < 30 THEN -20 WHEN rsi > 50 THEN 10 ELSE -10 END + CASE WHEN ml > sgl AND ml - sgl > 0 THEN 20 WHEN ml < sgl AND ml - sgl < 0 THEN -20 ELSE 0 END + CASE WHEN close > m20 AND m20 > m50 THEN 20 WHEN close < m20 AND m20 < m50 THEN -20 ELSE 0 END
  + CASE WHEN bb > 0.8 THEN 10 WHEN bb < 0.2 THEN -10 ELSE 0 END + CASE WHEN k > 80 AND d > 80 THEN 10 WHEN k < 20 AND d < 20 THEN -10 ELSE 0 END AS trend_score FROM an0),
an AS MATERIALIZED (SELECT *, split_part(symbol, '|', 1) AS sym, split_part(symbol, '|', 2) AS interval, CASE WHEN trend_score > 30 THEN 'BULLISH' WHEN trend_score < -30 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend, CAST(floor(round(least(100.0, abs(trend_score) * adx / 25), 9)) AS INT) AS strength FROM an1)"""


def analysis(spark, d):
    return TF.analyse(TF.interval_bars(raw_bars(spark, d), list(IV)))


@query("timeframe_analysis", "E23", f"""WITH RECURSIVE {AN_SQL} SELECT sym AS symbol, interval, bar_idx, trend_score, trend, strength, round(rsi, 5) AS rsi, round(ml - sgl, 5) AS macd, round(bb, 5) AS bb_position, round(adx, 5) AS adx, round(atr, 5) AS atr, round(k, 5) AS k, round(d, 5) AS d, round(vola, 5) AS volatility, round(vr, 5) AS volume_ratio,
  round(m20 - m50, 8) AS mean_shift, {', '.join(f'round(mo{n}, 5) AS momentum_{n}' for n in (5, 10, 20, 50))}, round(close, 5) AS price, round(volume, 5) AS volume,
  round(coalesce((atr - lag(atr, 9) OVER ({W})) / nullif(atr, 0), 0), 5) AS volatility_accel, round(coalesce(abs(m20 - m50) / nullif(atr, 0), 0), 4) AS trend_strength, round(vpin, 5) AS vpin, round(tim, 5) AS taker_imbalance FROM an""")
def _(spark, d):
    # means over 8, 16, 32 or 40 prices have up to seven decimals: at eight no value lies between two roundings
    shown = ["rsi", "macd", "bb_position", "adx", "atr", "k", "d", "volatility", "volume_ratio", "momentum_5", "momentum_10", "momentum_20", "momentum_50", "price", "volume", "volatility_accel", "vpin",
             "taker_imbalance"]
    return analysis(spark, d).select("symbol", "interval", "bar_idx", "trend_score", "trend", "strength", rnd("mean_shift", 8).alias("mean_shift"), rnd("trend_strength", 4).alias("trend_strength"), *[rnd(c, 5).alias(c) for c in shown])


TFW = {"1h": 0.2, "2h": 0.3, "4h": 0.5}


@query("timeframe_consensus", "A44", f"""WITH RECURSIVE {AN_SQL}, l AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) = 1), x AS (SELECT *, ml - sgl AS hist, atr / greatest(close, 1e-8) * 100 AS ap, CASE interval WHEN '1h' THEN 1 WHEN '2h' THEN 2 ELSE 4 END AS w, CASE interval WHEN '1h' THEN 0.2 WHEN '2h' THEN 0.3 ELSE 0.5 END::DOUBLE AS wt FROM l)
SELECT sym AS symbol, round(avg(CAST(trend = 'BULLISH' AS INT)), 5) AS bull_share, round(avg(CAST(trend = 'BEARISH' AS INT)), 5) AS bear_share, round(sum(CASE trend WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END * wt * strength / 100), 5) AS weighted, round(max(rsi) - min(rsi), 4) AS rsi_spread, round(stddev_pop(rsi), 4) AS rsi_std, round(arg_max(rsi, w) - arg_min(rsi, w), 4) AS rsi_slope,
  round(avg(rsi), 4) AS rsi_mean, round(max(hist) - min(hist), 5) AS macd_spread, round(avg(CAST(hist > 0 AS INT)), 5) AS macd_up, round(ln(1 + max(volume)), 5) AS volume_log_max, round(stddev_pop(ln(1 + volume)), 5) AS volume_log_std, round(max(ap), 4) AS atr_max, round(avg(ap), 4) AS atr_mean, round(max(adx), 4) AS adx_max, round(avg(bb), 5) AS bb_mean, round(stddev_pop(bb), 5) AS bb_std,
  round(avg(strength), 5) AS strength_mean, round(avg(CAST(rsi > 50 AND hist > 0 AS INT)), 5) AS bull_momentum FROM x GROUP BY sym""")
def _(spark, d):
    c = TF.as_array(TF.latest_by_interval(analysis(spark, d)))
    out = X.consensus(F.col("tfs"), TFW)
    four = {"rsi_spread", "rsi_std", "rsi_slope", "rsi_mean", "atr_max", "atr_mean", "adx_max"}
    names = ["bull_share", "bear_share", "weighted", "rsi_spread", "rsi_std", "rsi_slope", "rsi_mean", "macd_spread", "macd_up", "volume_log_max", "volume_log_std", "atr_max", "atr_mean", "adx_max", "bb_mean", "bb_std", "strength_mean", "bull_momentum"]
    return c.select("symbol", *[rnd(out[k], 4 if k in four else 5).alias(k) for k in names])


def tf_columns(spark, d):
    return TF.as_columns(TF.latest_by_interval(analysis(spark, d)), {"1h": "a", "2h": "b", "4h": "c"})


PIV = f"""{AN_SQL}, l AS (SELECT *, ml - sgl AS hist FROM an QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) = 1), p AS (SELECT x.sym AS symbol, x.rsi AS ar, y.rsi AS br, z.rsi AS cr, x.hist AS ah, y.hist AS bh, z.hist AS ch, x.bb AS ab, y.bb AS bb, x.adx AS aa, y.adx AS ba, x.atr AS ata, y.atr AS bt, z.atr AS ct, x.strength AS asx, y.strength AS bs,
  x.volume AS av, y.volume AS bv, z.volume AS cv, x.close AS ap, y.close AS bp, z.close AS cp, x.trend AS atd, x.vpin AS avp, y.vpin AS bvp FROM l x JOIN l y ON y.sym = x.sym AND y.interval = '2h' JOIN l z ON z.sym = x.sym AND z.interval = '4h' WHERE x.interval = '1h')"""


@query("cross_timeframe_deltas", "F14", f"""WITH RECURSIVE {PIV} SELECT symbol, round(ar - br, 5) AS rsi_delta, round(ah - bh, 5) AS macd_delta, round(ab - bb, 5) AS bb_position_delta, round(aa - ba, 5) AS adx_delta, round(ata - bt, 5) AS atr_delta, (asx - bs)::INT AS strength_delta, round(av / greatest(bv, 1e-8) - 1, 5) AS volume_delta, round(br - cr, 5) AS rsi_accel, round(bh - ch, 5) AS macd_accel, round(avp - bvp, 5) AS vpin_delta FROM p""")
def _(spark, d):
    c = X.cross_deltas({"5m": F.col("a"), "15m": F.col("b"), "1h": F.col("c")})
    return rounded(tf_columns(spark, d).select("symbol", *[v.alias(k) for k, v in c.items()]), 5)


@query("spike_reversal_block", "E22", f"""WITH RECURSIVE {PIV}, q AS (SELECT *, CASE WHEN cp > 0 THEN (ap / cp - 1) * 100 ELSE 0 END AS mv, least(10, asx // 10) AS run FROM p),
q2 AS (SELECT *, CAST(CASE WHEN atd = 'BULLISH' THEN run ELSE 0 END AS INT) AS gr, CAST(CASE WHEN atd = 'BEARISH' THEN run ELSE 0 END AS INT) AS rr, CASE WHEN ar < 30 THEN (30 - ar) / 30 ELSE 0.0 END AS un, list_filter([CASE WHEN bp > 0 THEN (ap - bp) / bp * 100 END, CASE WHEN cp > 0 THEN (bp - cp) / cp * 100 END], lambda v: v < 0) AS fl FROM q)
SELECT symbol, round(ab, 5) AS band_top, round(coalesce(least(1.0, greatest(0, (cv - av) / nullif(av, 0))), 0), 5) AS exhaustion, round(least(10.0, coalesce(-list_avg(fl), 0)), 5) AS dump_speed, round(un, 5) AS oversold, round(least(1.0, least(50, mv) / 50 * 0.3 + least(50, abs(least(0, mv))) / 20 * 0.3 + un * 0.4), 4) AS pattern,
  round(CASE WHEN rr >= 5 THEN 1.0 ELSE rr / 5 END, 5)::DOUBLE AS red_share, round(CASE WHEN gr >= 3 THEN 1.0 ELSE gr / 3 END, 5)::DOUBLE AS green_share, round(least(50, mv), 4) AS spike, round(CASE WHEN av / nullif(cv, 0) > 1.5 THEN least(10.0, av / cv) ELSE 0 END, 5) AS volume_spike, round(CASE WHEN ar > 70 THEN (ar - 70) / 30 ELSE 0 END, 5) AS overbought, round(least(5.0, ata / ((bt + ct) / 2)), 5) AS atr_spike, round(least(50, abs(least(0, mv))), 4) AS dump, round(abs(least(0, cr - ar)) / 50, 5) AS rsi_fall,
  CASE WHEN ah < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS macd_bearish, CAST((ap - cp) / nullif(cp, 0) < -0.01 AND ar - cr > 0.02 AS INT) AS divergence, CAST(ah > bh AND bh < 0 AS INT) AS macd_turn, round(CASE WHEN ab < 0.2 THEN greatest(0, (0.2 - ab) / 0.2) ELSE 0 END, 5) AS band_bounce, gr AS green_run, rr AS red_run FROM q2""")
def _(spark, d):
    t = tf_columns(spark, d)
    c = X.spike_block({"5m": F.col("a"), "15m": F.col("b"), "1h": F.col("c"), "4h": F.col("c")})
    whole = ("divergence", "macd_turn", "green_run", "red_run")
    return t.select("symbol", *[v.cast("int").alias(k) if k in whole else rnd(v, 4 if k in ("spike", "dump", "pattern") else 5).alias(k) for k, v in c.items()])


ADJ_SQL = f"""{sql_bars(86400, True)}, rk AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS rank FROM bars GROUP BY symbol), ret AS MATERIALIZED (SELECT * FROM (SELECT symbol, t, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS r FROM bars) WHERE r IS NOT NULL),
ok AS (SELECT symbol FROM ret GROUP BY symbol HAVING count(*) >= 15), cr AS MATERIALIZED (SELECT a.symbol AS sa, b.symbol AS sb, covar_pop(a.r, b.r) / nullif(sqrt(var_pop(a.r) * var_pop(b.r)), 0) AS c FROM ret a JOIN ret b ON a.t = b.t AND a.symbol < b.symbol WHERE a.symbol IN (FROM ok) AND b.symbol IN (FROM ok) GROUP BY ALL HAVING count(*) >= 15 AND abs(covar_pop(a.r, b.r) / nullif(sqrt(var_pop(a.r) * var_pop(b.r)), 0)) > 0.5),
ed AS MATERIALIZED (SELECT sa, sb, abs(c) AS w FROM cr UNION ALL SELECT sb, sa, abs(c) FROM cr UNION ALL SELECT symbol, symbol, 1.0 FROM ok), dg AS (SELECT sa, sum(w) AS dg FROM ed GROUP BY sa), mr AS (SELECT symbol, avg(r) AS m FROM ret GROUP BY symbol)"""


@query("correlation_graph", "A35 A36", f"WITH {ADJ_SQL} SELECT ed.sa AS sym_a, ed.sb AS sym_b, round(w, 5) AS weight, round(w / sqrt(a.dg * b.dg), 5) AS normalised, round(m, 5) AS mean_return FROM ed JOIN dg a ON a.sa = ed.sa JOIN dg b ON b.sa = ed.sb JOIN mr ON mr.symbol = ed.sa")
def _(spark, d):
    from barloom.operators.series import index_series, seconds
    day = raw_bars(spark, d, 86400, by_user=True).withColumn("t", seconds("open_time"))
    # names that begin alike are numbered together
    names = index_series(day.select("symbol").distinct(), [], ["symbol"], [F.substring("symbol", 1, 3)], out="rank").withColumn("rank", F.col("rank") + 1)
    v = U.aligned_returns(day, names).join(names, "symbol")
    p = settle(U.correlated_pairs(v, threshold=0.5).select("sym_a", "sym_b", F.abs("corr").alias("w")), "pairs")
    loops = v.select(F.col("symbol").alias("sym_a"), F.col("symbol").alias("sym_b"), F.lit(1.0).alias("w"))
    edges = p.unionByName(p.select(F.col("sym_b").alias("sym_a"), F.col("sym_a").alias("sym_b"), "w")).unionByName(loops)
    deg = edges.groupBy("sym_a").agg(F.sum("w").alias("dg"))
    mean = v.select(F.col("symbol").alias("sym_a"), (F.aggregate(F.map_values("rets"), F.lit(0.0), lambda a, x: a + x) / F.size("rets")).alias("m"))
    return (edges.join(deg, "sym_a").join(deg.select(F.col("sym_a").alias("sym_b"), F.col("dg").alias("dh")), "sym_b").join(mean, "sym_a")
            .select("sym_a", "sym_b", rnd("w", 5).alias("weight"), rnd(F.col("w") / F.sqrt(F.col("dg") * F.col("dh")), 5).alias("normalised"), rnd("m", 5).alias("mean_return")))
