"""Readers and parsers for landed market data, and the table writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.bars import merge_bars, normalize_bars
from barloom.sources.snapshots import publish

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType()), T.StructField("open_time", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")], T.StructField("close_time", T.TimestampType()),
    T.StructField("quote_volume", T.DoubleType()), T.StructField("trades", T.IntegerType()), T.StructField("taker_buy_base", T.DoubleType()),
    T.StructField("taker_buy_quote", T.DoubleType()), T.StructField("ingest_seq", T.LongType())])
# Position of the twelve archive columns.
ARCHIVE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bar table partitioned by interval and month; filters on both prune whole folders."""
    return spark.read.schema(T.StructType([*BAR_SCHEMA.fields, T.StructField("month", T.StringType())])).parquet(path)


def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("open_time", "yyyy-MM"))


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Write by (interval, month); rows of a month are spread by symbol and day, so a hot symbol takes many files."""
    out = with_month(bars)
    (out.repartition("interval", "month", F.col("symbol"), F.to_date("open_time")).sortWithinPartitions("symbol", "open_time")
     .write.mode(mode).partitionBy("interval", "month").parquet(path))


def upsert_bars(spark: SparkSession, path: str, new: DataFrame, staging: str) -> None:
    """Merge new bars into the months they touch and replace only those partitions.

    The merge is staged first: a table is never overwritten while it is being read.
    """
    touched = with_month(new).select("interval", "month").distinct()
    old = read_bars(spark, path).join(F.broadcast(touched), ["interval", "month"], "left_semi").drop("month")
    write_bars(merge_bars(old, new), staging, mode="overwrite")
    read_bars(spark, staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "month").parquet(path)


def audit_files(spark: SparkSession, path: str, required: Sequence[str] = ("open_time", "open", "high", "low", "close", "volume"), limit: int = 50 << 20) -> DataFrame:
    """Per parquet file: size flag, unreadable flag, missing columns. Reports only.

    The listing carries paths and lengths; tasks read the file footers, never the data. In a store that only
    Spark's readers can open, Spark reads the footers, a file at a time.
    """
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, length in zip(b.path, b.length):
                try:
                    fs, inner = pafs.FileSystem.from_uri(path_)
                    names = set(pq.read_schema(inner, filesystem=fs).names)
                    rows.append((path_, int(length), False, ",".join(c for c in required if c not in names)))
                except Exception:  # noqa: BLE001 - any failure to parse is the finding
                    rows.append((path_, int(length), True, ""))
            yield pd.DataFrame(rows, columns=["path", "length", "unreadable", "missing"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    schema = "path string, length long, unreadable boolean, missing string"
    some = files.first()
    try:
        pafs.FileSystem.from_uri(some.path if some else "file:/")
        found = files.mapInPandas(look, schema)
    except Exception:  # noqa: BLE001 - whatever it is, this store is not open to tasks
        def read(file: Row) -> tuple:
            try:
                names = set(spark.read.parquet(file.path).columns)
                return file.path, file.length, False, ",".join(c for c in required if c not in names)
            except Exception:  # noqa: BLE001 - any failure to parse is the finding
                return file.path, file.length, True, ""

        with ThreadPoolExecutor(8) as pool:
            found = spark.createDataFrame(list(pool.map(read, files.toLocalIterator())), schema)
    return found.select("*", (F.col("length") > limit).alias("too_large"))


def audit_tables(spark: SparkSession, path: str, required: Sequence[str], limit: int = 50 << 20) -> DataFrame:
    """The audit by table: file, unreadable, missing, too_large.

    A table is a file NAME.parquet or a folder of that name, which has whatever fault one of its files has.
    """
    below = F.split("path", f"/\\Q{path.rstrip('/').rsplit('/', 1)[-1]}\\E/")
    name = F.regexp_extract(F.element_at(below, -1), r"^(?:[^/]+/)*?([^/]+\.parquet)(?:/|$)", 1)
    lacks = F.flatten(F.collect_set(F.split("missing", ",")))
    return audit_files(spark, path, required, limit).groupBy(name.alias("file")).agg(
        F.bool_or("unreadable").alias("unreadable"), F.array_join(F.array_intersect(F.array(*[F.lit(c) for c in required]), lacks), ",").alias("missing"),
        F.bool_or("too_large").alias("too_large"))


def archive_months(frame: DataFrame, end: Column, days: Column) -> DataFrame:
    """Full months covering a look-back, newest first: one row per month."""
    first = F.trunc(F.date_sub(end, days), "MM")
    last = F.add_months(F.trunc(end, "MM"), -1)
    months = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).otherwise(F.array().cast("array<date>"))
    return frame.select("*", F.posexplode(F.reverse(months)).alias("age", "month")).withColumn("month", F.date_format("month", "yyyy-MM"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Monthly zip files named SYMBOL-interval-YYYY-MM.zip below ``path``."""
    return parse_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def parse_archives(files: DataFrame) -> DataFrame:
    """Bars of zip files (path, content), each holding one CSV with or without header.

    A file is one bounded month of one symbol, so it fits a task.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content):
                symbol, interval = p.rsplit("/", 1)[-1].split("-")[:2]
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        raw = pd.read_csv(z.open(name), header=None, names=list(ARCHIVE_COLUMNS), dtype=str)
                        yield raw.assign(symbol=symbol, interval=interval, source=f"{p}!{name}")

    text = files.select("path", "content").mapInPandas(unpack, ", ".join(f"`{c}` string" for c in ARCHIVE_COLUMNS) + ", symbol string, interval string, source string")
    num = {c: F.expr(f"try_cast(`{c}` AS double)") for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote")}
    ms = {c: F.timestamp_millis(F.expr(f"try_cast(`{c}` AS bigint)")) for c in ("open_time", "close_time")}
    # the header row is the one whose time is no number
    return (text.filter(F.expr("try_cast(open_time AS bigint) IS NOT NULL")).withColumns({**num, **ms, "trades": F.expr("try_cast(trades AS int)")})
            .drop("ignore").withColumn("ingest_seq", F.xxhash64("source")))


def merge_archive(parts: DataFrame) -> DataFrame:
    """Months laid together; of equal bars the one read last stays."""
    return normalize_bars(parts.drop("source"))


# -- parsers ------------------------------------------------------------------------------------

EXCHANGE = "struct<symbols:array<struct<symbol:string,status:string,contractType:string>>>"
TICKER = "array<struct<symbol:string,quoteVolume:string,priceChangePercent:string,lastPrice:string,highPrice:string,lowPrice:string>>"
PICK = ("map<string,struct<symbol:string,direction:string,confidence:double,entry_price:double,tp1:double,tp2:double,tp3:double,sl:double,"
        "timestamp:double,status:string,max_favorable:double>>")


def parse_exchange_info(rows: DataFrame, json_col: str) -> DataFrame:
    """Trading perpetual contracts with the quote suffix."""
    s = rows.select(F.explode(F.from_json(json_col, EXCHANGE)["symbols"]).alias("s")).select("s.*")
    return s.filter((F.col("status") == "TRADING") & (F.col("contractType") == "PERPETUAL") & F.col("symbol").endswith("USDT")).select("symbol")


def parse_tickers(rows: DataFrame, json_col: str) -> DataFrame:
    """24 h statistics; numbers arrive as text, bad ones become NULL."""
    rest = [c for c in rows.columns if c != json_col]
    s = rows.select(*rest, F.explode(F.from_json(json_col, TICKER)).alias("s")).select(*rest, "s.*")
    num = {"quoteVolume": "volume_24h", "priceChangePercent": "pct_24h", "lastPrice": "last_price", "highPrice": "high_price", "lowPrice": "low_price"}
    return s.select(*rest, "symbol", *[F.expr(f"try_cast({k} AS double)").alias(v) for k, v in num.items()])


def bar_field(json_col: str, name: str, kind: str = "double") -> Column:
    """One field of the bar message by its exact, case-bound path."""
    text = F.get_json_object(json_col, f"$.data.k.{name}")
    return text.cast(kind) if kind != "double" else F.expr(f"try_cast(get_json_object({json_col}, '$.data.k.{name}') AS double)")


def parse_bar_messages(rows: DataFrame, json_col: str) -> DataFrame:
    """Streamed bar messages to bar rows with their closed flag; batch and streaming alike."""
    f = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "quote_volume": "q", "taker_buy_base": "V", "taker_buy_quote": "Q"}
    return rows.filter(F.get_json_object(json_col, "$.data.e") == "kline").select(
        *[c for c in rows.columns if c != json_col], bar_field(json_col, "s", "string").alias("symbol"), bar_field(json_col, "i", "string").alias("interval"),
        F.timestamp_millis(bar_field(json_col, "t", "bigint")).alias("open_time"), *[bar_field(json_col, k).alias(c) for c, k in f.items()],
        F.timestamp_millis(bar_field(json_col, "T", "bigint")).alias("close_time"), bar_field(json_col, "n", "bigint").alias("trades"),
        bar_field(json_col, "x", "boolean").alias("closed"))


def read_feed(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """RSS items, or Atom entries, with entities resolved in the title."""
    tag = "entry" if atom else "item"
    schema = "title string, published string, pubDate string, link string" if not atom else "title string, published string, updated string"
    x = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    when = F.coalesce("published", "updated") if atom else F.coalesce("pubDate", "published")
    return x.select(unescape(F.trim("title")).alias("title"), when.alias("published")).filter(F.length("title") > 0)


# HTML entities resolved in titles.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def parse_picks(rows: DataFrame, json_col: str) -> DataFrame:
    """Map of pick id to pick, one row each."""
    return rows.select(F.explode(F.from_json(json_col, PICK)).alias("pick_id", "p")).select("pick_id", "p.*")


# -- dataset checks -------------------------------------------------------------------------------

def validate_dataset(expected: DataFrame, actual: DataFrame, version: int, token: str) -> DataFrame:
    """First failing check per expected symbol, NULL when it passes.

    ``expected``: symbol, n_bars, max_time. ``actual``: symbol, version, token, n_bars, max_time, n_values, keys_ok.
    """
    a = actual.select("symbol", *[F.col(c).alias(f"a_{c}") for c in ("version", "token", "n_bars", "max_time", "n_values", "keys_ok")], F.lit(True).alias("_found"))
    reason = (F.when(F.col("_found").isNull(), "missing").when(~F.coalesce("a_keys_ok", F.lit(False)), "missing keys").when(F.col("a_version") != version, "schema")
              .when(F.col("a_token") != token, "token").when(F.col("a_n_bars") != F.col("n_bars"), "n_bars").when(F.col("a_max_time") < F.col("max_time"), "stale")
              .when(F.col("a_n_values") != F.col("a_n_bars"), "shape"))
    return expected.join(a, "symbol", "left").select("symbol", reason.alias("reason"))


def validation_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("symbols"))


def stale_symbols(expected: DataFrame, actual: DataFrame, version: int, token: str) -> DataFrame:
    """Symbols to rebuild: absent, older version, other token, or behind in time."""
    current = actual.filter((F.col("version") == version) & (F.col("token") == token)).select("symbol", F.col("max_time").alias("have"))
    j = expected.join(current, "symbol", "left")
    return j.filter(F.col("have").isNull() | (F.col("have") < F.col("max_time"))).select("symbol")


def first_copy(copies: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several copies of a log, the earliest copy winning per key."""
    tagged = [c.withColumn("_copy", F.lit(i)) for i, c in enumerate(copies)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (key, "_copy")]
    return u.groupBy(key).agg(F.min_by(F.struct(*rest), "_copy").alias("r")).select(key, "r.*")


def read_log(spark: SparkSession, paths: Sequence[str], key: str, schema: str) -> DataFrame:
    """Prediction log from its copies; broken and missing files are skipped. The schema is given, as a broken copy tells none."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return first_copy([reader.parquet(p) for p in paths], key)


def append_audit_log(log: DataFrame, path: str) -> None:
    """Append trade rows with their derived columns, by day of entry; earlier rows are never touched."""
    audit_columns(log).withColumn("day", F.to_date("entry_time")).write.mode("append").parquet(path)


def audit_columns(log: DataFrame) -> DataFrame:
    """Derived columns of the trade log: notional, percent result, minutes held."""
    sign = F.when(F.col("direction") == "BULLISH", 1.0).otherwise(-1.0)
    notional = F.col("entry_price") * F.col("size")
    return log.select("*", notional.alias("notional"), F.coalesce(F.try_divide(sign * (F.col("exit_price") - F.col("entry_price")), F.col("entry_price")) * 100, F.lit(0.0)).alias("pnl_pct"),
                      ((F.unix_seconds("exit_time") - F.unix_seconds("entry_time")) / 60.0).alias("hold_minutes"))


def write_event_dataset(values: DataFrame, events: DataFrame, path: str, version: int, token: str) -> str:
    """Publish bar values, events and a manifest row per symbol as one snapshot: all or nothing.

    The manifest counts the values that were written.
    """
    spark = values.sparkSession

    def manifest(folder: str) -> DataFrame:
        written = spark.read.schema(values.schema).parquet(f"{folder}/values").groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_bars"), F.count(F.lit(1)).alias("n_values"), F.max("t").alias("max_time"))
        return written.select("*", F.lit(version).alias("version"), F.lit(token).alias("token"), F.lit(True).alias("keys_ok"))

    spread = values.repartition("symbol", F.floor(F.col("bar_idx") / 65536))
    return publish(spark, {"values": spread, "events": events, "manifest": manifest}, path, version, token)


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Several result tables under one folder."""
    for name, t in tables.items():
        w = t.write.mode("overwrite")
        (w.option("header", "true").csv if kind == "csv" else w.parquet)(f"{path}/{name}")


def markdown_table(report: DataFrame, limit: int = 50) -> str:
    """Text table of an already aggregated report; never more than ``limit`` rows reach the driver."""
    rows = report.limit(limit).collect()
    def cell(v) -> str:
        return "n/a" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(report.columns) + " |\n| " + " | ".join("---" for _ in report.columns) + " |"
    return "\n".join([head, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def run_folder_tables(trades: DataFrame, edges: Sequence[float]) -> dict[str, DataFrame]:
    """Tables of one run: all trades, wins, losses, windows, score buckets and the summary."""
    from barloom.operators.trades import score_histogram, window_kpis, window_stability
    windows = window_kpis(trades, ["window_id"])
    return {"trades": trades, "wins": trades.filter(F.col("pnl") > 0), "losses": trades.filter(F.col("pnl") <= 0), "windows": windows,
            "score_buckets": score_histogram(trades, edges), "summary": window_stability(windows)}
