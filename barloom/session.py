"""Session settings the library relies on."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "barloom", **extra: str) -> SparkSession:
    """A session with the library defaults; on a cluster the submitter's own settings win."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str | None = None, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom-local")
        .config(map={
            **SETTINGS,
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        })
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Calendar fields are defined in UTC; pin the running session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@functools.cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="barloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared folder that ``spark.checkpoint.dir`` names.

    Executors must see it, so there is no fallback to a folder of one machine; only a session in
    a single process (tests, local runs) gets one of its own where the setting is missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = own_folder()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Used where several branches of a plan start from one costly frame: they then read the
    table, and the loss of an executor never recomputes what lies before it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
