"""Data sets of several tables that are published together or not at all.

A snapshot is a folder of its own with one Parquet folder a table. It counts once its line stands in the catalog, which is written
last, as one file: readers take the newest catalogued snapshot, so they see the old tables until all new ones are there.
A writer that dies in between leaves a folder that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CATALOG = "snapshot string, seq long, name string, rows long, version int, token string, at timestamp"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each table of each published snapshot; empty where none is."""
    try:
        return spark.read.schema(CATALOG).parquet(f"{path}/catalog")
    except AnalysisException:  # nothing has been published yet
        return spark.createDataFrame([], CATALOG)


def newest(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """Name and number of the newest snapshot; of equal numbers (two writers at once) the larger name."""
    r = catalog(spark, path).agg(F.max(F.struct("seq", "snapshot")).alias("s")).first()["s"]
    return None if r is None else (r["snapshot"], r["seq"])


def publish(spark: SparkSession, tables: dict[str, DataFrame | Callable[[str], DataFrame]], path: str, version: int = 1, token: str = "") -> str:
    """Write all tables as one new snapshot, in their order, and return its name.

    A function gets the snapshot's folder and makes its table of those written before. Rows are counted in what was written, not in what was to be.
    """
    last, name = newest(spark, path), uuid.uuid4().hex
    folder = f"{path}/snapshots/{name}"
    for table, rows in tables.items():
        (rows(folder) if callable(rows) else rows).write.parquet(f"{folder}/{table}")
    counts = [(name, (last[1] if last else 0) + 1, table, spark.read.parquet(f"{folder}/{table}").count(), version, token) for table in tables]
    lines = spark.createDataFrame(counts, "snapshot string, seq long, name string, rows long, version int, token string").withColumn("at", F.current_timestamp())
    lines.coalesce(1).write.mode("append").parquet(f"{path}/catalog")
    return name


def read_table(spark: SparkSession, path: str, table: str, snapshot: str | None = None) -> DataFrame:
    """A table of the newest snapshot, or of the one named."""
    if snapshot is None:
        found = newest(spark, path)
        if found is None:
            raise FileNotFoundError(f"no snapshot in {path}")
        snapshot = found[0]
    return spark.read.parquet(f"{path}/snapshots/{snapshot}/{table}")
