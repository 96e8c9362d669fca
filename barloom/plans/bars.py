"""Bar ingest, resampling and landed-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators.series import over_chunks, seconds
from barloom.plans.inputs import BARS_SQL, bars, raw_bars, rnd, sql_bars, table, ticks
from barloom.plans.registry import query
from barloom.plans.windows import W
from barloom.session import scratch
from barloom.sources import landing as S
from barloom.sources.snapshots import read_table

OHLCV = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote"]


def out(df, *keys):
    return df.select(*keys, *[rnd(c, 4).alias(c) for c in OHLCV], "trades")


ROLL = """first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, round(sum(volume), 4) AS volume, round(sum(quote_volume), 4) AS quote_volume,
  round(sum(taker_buy_base), 4) AS taker_buy_base, round(sum(taker_buy_quote), 4) AS taker_buy_quote, CAST(sum(trades) AS BIGINT) AS trades"""


@query("resample_4h", "A01", f"WITH {BARS_SQL} SELECT symbol, (t // 14400) * 14400 AS t, (t // 14400) * 14400000 + 14399999 AS close_ms, {ROLL} FROM bars GROUP BY symbol, t // 14400")
def _(spark, d):
    r = B.resample(raw_bars(spark, d), "4h").withColumn("t", seconds("open_time")).withColumn("close_ms", F.unix_millis("close_time"))
    return out(r, "symbol", "t", "close_ms")


@query("resample_many", "A02 J18", f"""WITH {BARS_SQL}, g AS (SELECT * FROM (VALUES ('1h', 3600), ('2h', 7200), ('4h', 14400), ('1d', 86400)) x(interval, w))
SELECT symbol, interval, CAST((t // w) * w AS BIGINT) AS t, {ROLL} FROM bars, g GROUP BY symbol, interval, w, t // w""")
def _(spark, d):
    r = B.resample_many(raw_bars(spark, d), ["1h", "2h", "4h", "1d"]).withColumn("t", seconds("open_time"))
    return out(r, "symbol", "interval", "t")


@query("count_blocks", "A03", f"""WITH {BARS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, CAST((bar_idx - n % 12) // 12 AS BIGINT) AS block, min(t) AS block_start, {ROLL} FROM n WHERE bar_idx >= n % 12 GROUP BY ALL""")
def _(spark, d):
    r = B.count_resample(bars(spark, d), 12).withColumn("block_start", seconds("block_start"))
    return out(r, "symbol", "block", "block_start")


@query("normalized_rows", "S01 S11", """WITH r AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS t, event_id AS seq, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)
SELECT symbol, t, arg_max(close, seq) AS close, arg_max(volume, seq) AS volume, max(seq) AS ingest_seq FROM r GROUP BY symbol, t""")
def _(spark, d):
    x = ticks(spark, d).select("symbol", B.floor_time("ts", 900).alias("open_time"), F.col("seq").alias("ingest_seq"), F.col("price").alias("close"), "volume")
    n = B.normalize_bars(x.withColumn("_s", F.col("ingest_seq")), ["symbol", "open_time"], "_s")
    return n.select("symbol", seconds("open_time").alias("t"), "close", "volume", "ingest_seq")


@query("tail_bars", "S02", f"WITH {BARS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, bar_idx, t, round(close, 4) AS close FROM n WHERE bar_idx >= n - 150")
def _(spark, d):
    return B.tail_bars(bars(spark, d), 150).select("symbol", "bar_idx", "t", rnd("close", 4).alias("close"))


@query("bar_counts", "S03", f"WITH {BARS_SQL} SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol")
def _(spark, d):
    return B.count_bars(raw_bars(spark, d))


@query("upserted_bars", "S04 S08", """WITH r AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, event_id AS seq, value AS close, CASE WHEN user_id < 100 THEN 0 ELSE 1 END AS gen FROM events)
SELECT symbol, t, arg_max(close, gen * 100000000000 + seq) AS close, count(*) AS versions FROM r GROUP BY symbol, t""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), B.floor_time(F.col("ts").cast("timestamp"), 3600).alias("open_time"), F.col("event_id").alias("ingest_seq"), F.col("value").alias("close"), "user_id")
    old, new = (e.filter(c).drop("user_id") for c in (F.col("user_id") < 100, F.col("user_id") >= 100))
    m = B.merge_bars(old, new, ["symbol", "open_time"])
    n = e.groupBy("symbol", "open_time").agg(F.count(F.lit(1)).alias("versions"))
    return m.join(n, ["symbol", "open_time"]).select("symbol", seconds("open_time").alias("t"), "close", "versions")


@query("archive_months", "S07", """WITH o AS (SELECT o_custkey AS k, CAST(max(o_orderdate) AS DATE) AS d FROM orders GROUP BY o_custkey), s AS (SELECT k, d, unnest(generate_series(CAST(date_trunc('month', d - INTERVAL 200 DAY) AS TIMESTAMP), CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM o)
SELECT k, strftime(m, '%Y-%m') AS month, CAST(row_number() OVER (PARTITION BY k ORDER BY m DESC) - 1 AS INT) AS age FROM s""")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").cast("date").alias("d"))
    return S.archive_months(o, F.col("d"), F.lit(200)).select("k", "month", "age")


@query("recent_window", "S09", f"""WITH {BARS_SQL}, r AS (SELECT * FROM bars WHERE t >= (SELECT max(t) FROM bars) - 10 * 86400) SELECT symbol, t, round(close, 4) AS close FROM r""")
def _(spark, d):
    return B.load_window(raw_bars(spark, d), 10).select("symbol", seconds("open_time").alias("t"), rnd("close", 4).alias("close"))


@query("cached_universe", "S10", f"""WITH {sql_bars(3600, True)} SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol HAVING count(*) >= 100 ORDER BY n_bars DESC, symbol LIMIT 30""")
def _(spark, d):
    return B.cached_universe(raw_bars(spark, d, by_user=True), 100, 30)


@query("cleaned_rows", "S12", """WITH r AS (SELECT user_id AS symbol, ts, event_id, try_cast(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS close FROM events)
SELECT symbol, count(*) AS n, round(sum(close), 4) AS total FROM (SELECT symbol, ts, arg_max(close, event_id) AS close FROM r WHERE close IS NOT NULL GROUP BY symbol, ts) GROUP BY symbol""")
def _(spark, d):
    raw = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("open_time"), F.col("event_id").alias("ingest_seq"), F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("close"))
    return B.clean_bars(raw, ["close"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("close"), 4).alias("total"))


@query("trading_symbols", "S13", """SELECT DISTINCT p_brand || '_' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN 'BUSD' ELSE 'USDT' END AS symbol FROM part WHERE p_size <= 40 AND p_type <> 'SMALL' AND p_partkey % 3 <> 0""")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", F.struct(
        F.concat(F.col("p_brand"), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "BUSD").otherwise("USDT")).alias("symbol"),
        F.when(F.col("p_size") <= 40, "TRADING").otherwise("BREAK").alias("status"), F.when(F.col("p_type") == "SMALL", "CURRENT_QUARTER").otherwise("PERPETUAL").alias("contractType")).alias("s"))
    # one listing document per part, as the exchange would send it
    doc = p.select(F.to_json(F.struct(F.array("s").alias("symbols"))).alias("doc"))
    return S.parse_exchange_info(doc, "doc").distinct()


@query("ticker_snapshot", "S14 F13", """SELECT l_orderkey AS batch, 'P' || CAST(l_partkey AS VARCHAR) AS symbol, try_cast(CASE WHEN l_linenumber = 3 THEN 'bad' ELSE CAST(l_extendedprice AS VARCHAR) END AS DOUBLE) AS volume_24h, l_discount AS pct_24h, l_quantity AS last_price, l_tax AS low_price FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    doc = li.select("l_orderkey", F.to_json(F.array(F.struct(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.when(F.col("l_linenumber") == 3, "bad").otherwise(F.col("l_extendedprice").cast("string")).alias("quoteVolume"),
        F.col("l_discount").cast("string").alias("priceChangePercent"), F.col("l_quantity").cast("string").alias("lastPrice"), F.col("l_tax").cast("string").alias("lowPrice")))).alias("doc"))
    return S.parse_tickers(doc.withColumnRenamed("l_orderkey", "batch"), "doc").select("batch", "symbol", "volume_24h", "pct_24h", "last_price", "low_price")


def messages(spark, d):
    """Each print as the bar message a venue would push for its open bar."""
    e = table(spark, d, "events")
    def s(c):
        return c.cast("string")
    k = F.struct((F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp")) % 3600000).alias("t"), F.col("event_type").alias("s"), F.lit("1h").alias("i"), s(F.col("value")).alias("o"),
                 s(F.col("value") * 2).alias("h"), s(F.col("value") / 2).alias("l"), s(F.col("value")).alias("c"), F.get_json_object("props", "$.k").alias("v"), (F.col("user_id") % 4 == 0).alias("x"))
    return e.select("event_id", "ts", F.to_json(F.struct(F.struct(F.when(F.col("user_id") % 10 == 9, "trade").otherwise("kline").alias("e"), k.alias("k")).alias("data"))).alias("raw"))


@query("parsed_bar_messages", "S15 T02", """SELECT event_id, event_type AS symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, value AS open, round(value * 2, 4) AS high, round(value / 2, 4) AS low, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events WHERE user_id % 10 <> 9 AND user_id % 4 = 0""")
def _(spark, d):
    b = S.parse_bar_messages(messages(spark, d).select("event_id", "raw"), "raw").filter("closed")
    return b.select("event_id", "symbol", seconds("open_time").alias("t"), "open", rnd("high", 4).alias("high"), rnd("low", 4).alias("low"), "volume")


@query("feed_titles", "S16", r"""SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages WHERE regexp_matches(html, '(?s)<title>.+?</title>')""")
def _(spark, d):
    t = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.trim(S.unescape(t)).alias("title")).filter(F.length("title") > 0)


VAL = """ex AS (SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS symbol, count(*) AS n_bars, CAST(max(epoch(ts) // 1) AS BIGINT) AS max_time FROM events GROUP BY 1),
ac AS (SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS symbol, 1 + CAST(user_id % 17 = 3 AS INT) AS version, CASE WHEN user_id % 19 = 4 THEN 'x' ELSE 'ok' END AS token, count(*) AS n_bars, CAST(max(epoch(ts) // 1) AS BIGINT) AS max_time, count(*) - CAST(user_id % 23 = 5 AS INT) AS n_values, user_id % 29 <> 6 AS keys_ok FROM events WHERE user_id % 7 <> 2 AND event_id % 50 <> 0 GROUP BY user_id, event_type)"""


def expected(spark, d):
    e = table(spark, d, "events").withColumn("symbol", F.concat_ws("_", "event_type", F.col("user_id").cast("string")))
    return e, e.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("max_time"))


def actual(e):
    a = e.filter((F.col("user_id") % 7 != 2) & (F.col("event_id") % 50 != 0)).groupBy("symbol", "user_id").agg(F.count(F.lit(1)).alias("n_bars"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("max_time"))
    u = F.col("user_id")
    return a.select("symbol", (1 + (u % 17 == 3).cast("int")).alias("version"), F.when(u % 19 == 4, "x").otherwise("ok").alias("token"), "n_bars", "max_time", (F.col("n_bars") - (u % 23 == 5).cast("int")).alias("n_values"), (u % 29 != 6).alias("keys_ok"))


@query("dataset_validation", "S17", f"""WITH {VAL}, v AS (SELECT CASE WHEN a.symbol IS NULL THEN 'missing' WHEN NOT keys_ok THEN 'missing keys' WHEN version <> 1 THEN 'schema' WHEN token <> 'ok' THEN 'token' WHEN a.n_bars <> e.n_bars THEN 'n_bars' WHEN a.max_time < e.max_time THEN 'stale' WHEN n_values <> a.n_bars THEN 'shape' ELSE 'ok' END AS reason FROM ex e LEFT JOIN ac a ON a.symbol = e.symbol)
SELECT reason, count(*) AS symbols FROM v GROUP BY reason""")
def _(spark, d):
    e, ex = expected(spark, d)
    return S.validation_counts(S.validate_dataset(ex, actual(e), 1, "ok"))


@query("stale_symbols", "S18", f"WITH {VAL} SELECT e.symbol FROM ex e LEFT JOIN (SELECT * FROM ac WHERE version = 1 AND token = 'ok') a ON a.symbol = e.symbol WHERE a.symbol IS NULL OR a.max_time < e.max_time")
def _(spark, d):
    e, ex = expected(spark, d)
    return S.stale_symbols(ex, actual(e), 1, "ok")


@query("first_copy_of_log", "S22", """WITH c AS (SELECT event_id AS id, 0 AS k, value AS v FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT event_id, 1, value + 1 FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, 2, value + 2 FROM events)
SELECT id, arg_min(v, k) AS v FROM c GROUP BY id""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("value").alias("v"))
    copies = [e.filter(F.col("user_id") % 3 != 0), e.filter(F.col("user_id") % 2 == 0).withColumn("v", F.col("v") + 1), e.withColumn("v", F.col("v") + 2)]
    return S.first_copy([c.select("id", "v") for c in copies], "id")


@query("audit_log_rows", "S23", """SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS pk, round(l_extendedprice / l_quantity * l_quantity, 4) AS notional,
  round(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END * ((l_extendedprice / l_quantity) * (1 + l_tax) - l_extendedprice / l_quantity) / (l_extendedprice / l_quantity) * 100, 5) AS pnl_pct, round(epoch(l_shipdate - o_orderdate) / 60.0, 4) AS hold_minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    log = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("pk"), F.when(F.col("l_linestatus") == "O", "BULLISH").otherwise("BEARISH").alias("direction"), px.alias("entry_price"),
        (px * (1 + F.col("l_tax"))).alias("exit_price"), F.col("l_quantity").alias("size"), F.col("o_orderdate").cast("timestamp").alias("entry_time"), F.col("l_shipdate").cast("timestamp").alias("exit_time"))
    return S.audit_columns(log).select("id", "pk", rnd("notional", 4).alias("notional"), rnd("pnl_pct", 5).alias("pnl_pct"), rnd("hold_minutes", 4).alias("hold_minutes"))


@query("daily_picks", "S24", """SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS pick_id, o_orderpriority AS symbol, CASE o_orderstatus WHEN 'F' THEN 'BULLISH' ELSE 'BEARISH' END AS direction, o_totalprice AS entry_price FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    doc = o.select(F.to_json(F.create_map(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.struct(
        F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderstatus") == "F", "BULLISH").otherwise("BEARISH").alias("direction"), F.col("o_totalprice").alias("entry_price")))).alias("doc"))
    return S.parse_picks(doc, "doc").select("pick_id", "symbol", "direction", "entry_price")


@query("anomaly_follow_through", "A24 P13", f"""WITH {BARS_SQL}, g AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) a(thr), (VALUES (1), (3), (6), (12)) b(k)),
m AS (SELECT *, (close - lag(close) OVER ({W})) / nullif(lag(close) OVER ({W}), 0) AS chg, {', '.join(f'lead(close, {k}) OVER ({W}) AS f{k}' for k in (1, 3, 6, 12))} FROM bars),
e AS (SELECT thr, k, chg > 0 AS bull, close, CASE k WHEN 1 THEN f1 WHEN 3 THEN f3 WHEN 6 THEN f6 ELSE f12 END AS fut FROM m, g WHERE abs(chg) >= thr),
c AS (SELECT *, CASE WHEN bull THEN CAST(fut > close AS INT) ELSE CAST(fut < close AS INT) END AS cont FROM e WHERE fut IS NOT NULL)
SELECT thr AS threshold, k AS lookahead, count(*) AS events, count(*) FILTER (WHERE bull) AS bull_events, round(avg(cont) * 100, 5) AS cont_pct, round(avg(cont) FILTER (WHERE bull) * 100, 5) AS bull_cont_pct, round(avg(1 - cont) FILTER (WHERE NOT bull) * 100, 5) AS bear_reversal_pct FROM c GROUP BY thr, k""")
def _(spark, d):
    steps = (1, 3, 6, 12)

    def build(x, f):
        prev = f.lag("close")
        return x.select("symbol", "bar_idx", "_chunk", "close", F.try_divide(F.col("close") - prev, prev).alias("chg"), F.array(*[
            F.struct(F.lit(k).alias("k"), f.lead("close", k).alias("fut")) for k in steps]).alias("ahead"))
    m = over_chunks(bars(spark, d), build, back=1, ahead=12).filter(F.abs(F.col("chg")) >= 0.5)
    grid = F.filter(F.array(*[F.lit(t) for t in (0.5, 1.0, 2.0)]), lambda t: t <= F.abs(F.col("chg")))
    e = m.withColumn("thr", F.explode(grid)).withColumn("a", F.explode("ahead")).filter(F.col("a.fut").isNotNull())
    bull = F.col("chg") > 0
    cont = F.when(bull, F.col("a.fut") > F.col("close")).otherwise(F.col("a.fut") < F.col("close")).cast("int")
    e = e.select("thr", F.col("a.k").alias("k"), bull.alias("bull"), cont.alias("cont"))
    return e.groupBy(F.col("thr").alias("threshold"), F.col("k").alias("lookahead")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("bull").alias("bull_events"), rnd(F.avg("cont") * 100, 5).alias("cont_pct"),
        rnd(F.avg(F.when(F.col("bull"), F.col("cont"))) * 100, 5).alias("bull_cont_pct"), rnd(F.avg(F.when(~F.col("bull"), 1 - F.col("cont"))) * 100, 5).alias("bear_reversal_pct"))


TABLES = "benchmark conversations customer documents embeddings labels lineitem nation orders pages part region supplier"


@query("audited_files", "S05", f"""SELECT unnest(string_split('{TABLES}', ' ')) || '.parquet' AS file, FALSE AS unreadable, 'event_id,ts,value' AS missing, FALSE AS too_large
UNION ALL SELECT 'events.parquet', FALSE, '', FALSE""")
def _(spark, d):
    return S.audit_tables(spark, d, required=("event_id", "ts", "value"))


@query("event_dataset_manifest", "S19", f"WITH {BARS_SQL} SELECT symbol, count(*) AS n_bars, CAST(max(t) AS BIGINT) AS max_time, 1 AS version, 'v1' AS token FROM bars GROUP BY symbol")
def _(spark, d):
    path = scratch(spark, "dataset")
    b = bars(spark, d).select("symbol", "bar_idx", "t", "close", "volume")
    S.write_event_dataset(b, b.filter(F.col("volume") > 500).select("symbol", "bar_idx"), path, 1, "v1")
    return read_table(spark, path, "manifest").select("symbol", "n_bars", "max_time", "version", "token")


@query("run_folder_tables", "S20 S21", """WITH t AS (SELECT CAST(year(l_shipdate) AS INT) AS w, l_extendedprice * (0.05 - l_discount) AS pnl, 50 + l_quantity AS score FROM lineitem)
SELECT 'trades' AS part, count(*) AS n FROM t UNION ALL SELECT 'wins', count(*) FROM t WHERE pnl > 0 UNION ALL SELECT 'losses', count(*) FROM t WHERE pnl <= 0 UNION ALL SELECT 'windows', count(DISTINCT w) FROM t
UNION ALL SELECT 'score_buckets', count(DISTINCT CASE WHEN score < 72 THEN 1 WHEN score < 80 THEN 2 ELSE 3 END) FROM t WHERE score >= 60 AND score < 100 UNION ALL SELECT 'summary', 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    t = li.select(F.year("l_shipdate").alias("window_id"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("pnl"), ((0.05 - F.col("l_discount")) * 100).alias("pnl_pct"), (50 + F.col("l_quantity")).alias("score"))
    path = scratch(spark, "run")
    parts = S.run_folder_tables(t, [60, 72, 80, 100])
    S.write_tables(parts, path)
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in parts]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
