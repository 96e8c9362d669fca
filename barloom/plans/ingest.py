"""Ingest entry points on landed files that are derived from the given tables: archives, feeds, odd columns, logs and sinks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators.series import seconds
from barloom.plans.inputs import BARS_SQL, raw_bars, rnd, table
from barloom.plans.registry import query
from barloom.session import scratch
from barloom.sources import landing as S


FEED_ENTRIES = 500


def zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One month of one symbol as the archive a venue would publish; every second one has a header."""
    symbol, month = rows["symbol"].iloc[0], rows["month"].iloc[0]
    text = rows.sort_values("open_time")[list(S.ARCHIVE_COLUMNS)].to_csv(index=False, header=len(symbol) % 2 == 0)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{symbol}-1h-{month}.csv", text)
    return pd.DataFrame({"path": [f"archive/{symbol}-1h-{month}.zip"], "content": [held.getvalue()]})


@query("archive_bars", "S06 S08", f"WITH {BARS_SQL} SELECT symbol, '1h' AS interval, t, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, CAST(trades AS INT) AS trades FROM bars")
def _(spark, d):
    ms = F.unix_millis("open_time")
    b = raw_bars(spark, d).select(
        "symbol", F.date_format("open_time", "yyyy-MM").alias("month"), ms.alias("open_time"), "open", "high", "low", "close", "volume", (ms + 3599999).alias("close_time"), "quote_volume", "trades",
        "taker_buy_base", "taker_buy_quote", F.lit(0).alias("ignore"))
    files = b.groupBy("symbol", "month").applyInPandas(zipped, "path string, content binary")
    m = S.merge_archive(S.parse_archives(files))
    return m.select("symbol", "interval", seconds("open_time").alias("t"), *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume")], "trades")


def ticket(spark, d):
    """Prints of users as rows of a bar table, the newer half as a second delivery."""
    e = table(spark, d, "events")
    at = B.floor_time(F.col("ts").cast("timestamp"), 3600)
    known = {"symbol": F.col("event_type"), "interval": F.lit("1h"), "open_time": at, "close": F.col("value"), "ingest_seq": F.col("event_id")}
    return e.select("user_id", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.BAR_SCHEMA.fields])


@query("upserted_table", "S04", """WITH r AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, event_id AS seq, value AS close, CASE WHEN user_id < 100 THEN 0 ELSE 1 END AS gen FROM events)
SELECT symbol, t, arg_max(close, gen * 100000000000 + seq) AS close FROM r GROUP BY symbol, t""")
def _(spark, d):
    rows, path = ticket(spark, d), scratch(spark, "bars")
    S.write_bars(B.normalize_bars(rows.filter("user_id < 100").drop("user_id").withColumn("_s", F.col("ingest_seq")), seq="_s"), path)
    S.upsert_bars(spark, path, rows.filter("user_id >= 100").drop("user_id"), scratch(spark, "stage"))
    return S.read_bars(spark, path).select("symbol", seconds("open_time").alias("t"), "close")


@query("standard_bars", "S11", """SELECT event_type AS symbol, event_id, value AS open, value * 2 AS high, value / 2 AS low, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events WHERE user_id % 11 <> 4""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    odd = table(spark, d, "events").select(
        F.col("event_type").alias("Symbol"), F.col("event_id").alias("Event_Id"), F.col("value").alias("O"), (F.col("value") * 2).alias("High_Price"), (F.col("value") / 2).alias("l"), F.col("value").alias("Close"),
        F.when(F.col("user_id") % 11 != 4, k).alias("VOL"))
    return B.standard_columns(odd).select("symbol", "event_id", "open", "high", "low", "close", "volume")


@query("feed_items", "S16", """WITH r AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS x FROM documents),
u AS (SELECT doc_id, trim(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title FROM r)
SELECT title, 'day ' || CAST(doc_id AS VARCHAR) AS published, CASE WHEN doc_id % 2 = 0 THEN 'rss' ELSE 'atom' END AS kind FROM u WHERE length(title) > 0""")
def _(spark, d):
    title = F.split("text", "\n")[0]
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(plain), F.lit(escaped))
    docs = table(spark, d, "documents").select("doc_id", title.alias("title"), F.concat(F.lit("day "), F.col("doc_id").cast("string")).alias("day"))
    out = None
    for n, (kind, item, root) in enumerate((("rss", "<item><title>%s</title><pubDate>%s</pubDate></item>", "<rss><channel>%s</channel></rss>"),
                                            ("atom", "<entry><title>%s</title><updated>%s</updated></entry>", "<feed>%s</feed>"))):
        path = scratch(spark, kind)
        # a feed is a file of its own with a bounded number of entries
        feeds = docs.filter(F.col("doc_id") % 2 == n).groupBy(F.floor(F.col("doc_id") / FEED_ENTRIES).alias("feed")).agg(
            F.format_string(root, F.array_join(F.collect_list(F.format_string(item, "title", "day")), "")).alias("value"))
        feeds.repartition("feed").write.partitionBy("feed").text(path)
        got = S.read_feed(spark, path, atom=kind == "atom").select("title", "published", F.lit(kind).alias("kind"))
        out = got if out is None else out.unionByName(got)
    return out


@query("log_from_copies", "S22", """WITH c AS (SELECT event_id AS id, 0 AS k, value AS v FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT event_id, 2, value + 2 FROM events) SELECT id, arg_min(v, k) AS v FROM c GROUP BY id""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("value").alias("v"))
    root = scratch(spark, "log")
    e.filter(F.col("user_id") % 3 != 0).select("id", "v").write.parquet(f"{root}/a")
    # the second copy is no parquet file
    e.select(F.col("id").cast("string")).write.text(f"{root}/b")
    e.select("id", (F.col("v") + 2).alias("v")).write.parquet(f"{root}/c")
    return S.read_log(spark, [f"{root}/{x}" for x in "abc"], "id", "id long, v double")


@query("appended_audit_log", "S23", """SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n, round(sum(l_extendedprice), 2) AS notional FROM lineitem GROUP BY 1""")
def _(spark, d):
    li, path = table(spark, d, "lineitem"), scratch(spark, "audit")
    at = F.col("l_shipdate").cast("timestamp")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    log = li.select(F.lit("BULLISH").alias("direction"), price.alias("entry_price"), (price * 1.01).alias("exit_price"), F.col("l_quantity").alias("size"), at.alias("entry_time"), at.alias("exit_time"), "l_linenumber")
    for part in (F.col("l_linenumber") <= 3, F.col("l_linenumber") > 3):
        S.append_audit_log(log.filter(part).drop("l_linenumber"), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("notional"), 2).alias("notional"))


@query("report_files", "S20", """SELECT l_returnflag AS agent, count(*) AS n, round(sum(l_extendedprice), 2) AS total, '| ' || l_returnflag || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("agent")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total"))
    path = scratch(spark, "report")
    S.write_tables({"by_agent": g}, path, kind="csv")
    back = spark.read.option("header", "true").schema("agent string, n long, total double").csv(f"{path}/by_agent")
    lines = S.markdown_table(back.select("agent", "n").orderBy("agent")).split("\n")[2:]
    text = spark.createDataFrame([(x.split(" ")[1], x) for x in lines], "agent string, line string")
    return back.join(text, "agent")
