"""How the given tables stand in for ticks, bars, trades, quotes and predictions.

Each Spark builder has a SQL twin (a WITH list) used by the DuckDB checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators.series import index_series, seconds
from barloom.session import settle

HOUR = 3600
# bars per time bucket when a series is numbered
INDEX_SPAN = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """One row per trade print: symbol, ts, seq, price, volume, taker_buy."""
    e = table(spark, sf_dir, "events")
    volume = F.get_json_object("props", "$.k").cast("double")
    symbol = F.concat_ws("_", F.col("event_type"), (F.col("user_id") % 10).cast("string")) if by_user \
        else F.col("event_type")
    return e.select(
        symbol.alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        volume.alias("volume"),
        F.when(F.col("user_id") % 2 == 0, volume).otherwise(0.0).alias("taker_buy"),
    )


def raw_bars(spark: SparkSession, sf_dir: str, seconds_per_bar: int = HOUR, by_user: bool = False) -> DataFrame:
    return B.bars_from_ticks(ticks(spark, sf_dir, by_user), seconds_per_bar)


def index_bars(bars: DataFrame, seconds_per_bar: int = HOUR) -> DataFrame:
    """Number the bars of each symbol; a numbering bucket holds at most INDEX_SPAN bars."""
    span = seconds_per_bar * INDEX_SPAN
    return index_series(bars, ["symbol"], ["open_time"], [F.floor(seconds("open_time") / span)])


def bars(spark: SparkSession, sf_dir: str, seconds_per_bar: int = HOUR, by_user: bool = False) -> DataFrame:
    """Bars with ``bar_idx`` and ``t`` (epoch seconds of the open)."""
    return index_bars(raw_bars(spark, sf_dir, seconds_per_bar, by_user), seconds_per_bar).withColumn(
        "t", seconds("open_time"))


def bars_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars as a written table, for plans in which many branches read them."""
    return settle(bars(spark, sf_dir), "bars")


def rnd(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def sql_ticks(by_user: bool = False) -> str:
    symbol = "event_type || '_' || CAST(user_id % 10 AS VARCHAR)" if by_user else "event_type"
    return f"""ticks AS (
  SELECT {symbol} AS symbol, ts, event_id AS seq, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CASE WHEN user_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0.0 END AS taker_buy
  FROM events)"""


def sql_bars(seconds_per_bar: int = HOUR, by_user: bool = False) -> str:
    n = seconds_per_bar
    return sql_ticks(by_user) + f""",
bars AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_idx FROM (
    SELECT symbol, CAST(floor(epoch(ts) / {n}) * {n} AS BIGINT) AS t,
           first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY ts, seq) AS close, sum(volume) AS volume,
           sum(price * volume) AS quote_volume, count(*) AS trades,
           sum(taker_buy) AS taker_buy_base, sum(taker_buy * price) AS taker_buy_quote
    FROM ticks GROUP BY ALL))"""


BARS_SQL = sql_bars()
