"""Top rows per key without sorting a key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64, spread: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each key: each of ``salts`` shares keeps n, then n of what is left.

    ``order`` must be total. At most salts x n rows of a key meet in the last step.
    """
    salt = F.pmod(F.xxhash64(*(spread or [c for c in df.columns if c not in keys])), F.lit(salts))
    share = Window.partitionBy(*keys, "_salt").orderBy(*order)
    near = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(share)).filter(F.col("_r") <= n)
    final = Window.partitionBy(*keys).orderBy(*order)
    return near.withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n).drop("_salt", "_r")
