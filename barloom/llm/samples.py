"""Bounded samples for fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest(rows: DataFrame, key: Column, most: int, total: int | None = None) -> DataFrame:
    """At most ``most`` rows, those with the smallest 64-bit hashes of ``key``.

    A cut of the hash range by the number of rows comes first, so that the ordered limit, which
    takes up to ``most`` rows of every task to the driver, only sees about as many rows in all.
    """
    total = rows.count() if total is None else total
    hashed = rows.withColumn("__hash__", F.xxhash64(F.lit(11), key))
    if total > most:
        hashed = hashed.filter(F.col("__hash__") <= min(2**63 - 1, int(2**64 * 1.1 * most / total) - 2**63))
    return hashed.orderBy("__hash__", key).limit(most).drop("__hash__")
