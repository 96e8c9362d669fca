"""Folds over array columns whose result grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements folded before their results are joined to the earlier ones.
BLOCK = 256


def folded(x: Column, state: dict[str, Column], out: str, step: Callable[[Column, Column], Column]) -> Column:
    """``aggregate`` whose state has a growing array ``out`` of that type: it grows in blocks, so little is copied.

    ``step(acc, v)`` returns a struct of the names of ``state``, then ``out``; the result has ``out`` flattened.
    """
    def block(acc: Column, i: Column) -> Column:
        start = F.struct(*[acc[n].alias(n) for n in state], F.array().cast(out).alias("out"))
        inner = F.aggregate(F.slice(x, i * BLOCK + 1, F.lit(BLOCK)), start, step)
        return F.transform(F.array(inner), lambda r: F.struct(*[r[n].alias(n) for n in state], F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    start = F.struct(*[c.alias(n) for n, c in state.items()], F.array().cast(f"array<{out}>").alias("out"))
    # the block after the last is empty, so an empty array has one too
    blocks = F.sequence(F.lit(0), F.floor(F.size(x) / BLOCK).cast("int"))
    return F.transform(F.array(F.aggregate(blocks, start, block)), lambda r: F.struct(*[r[n].alias(n) for n in state], F.flatten(r["out"]).alias("out")))[0]


def running(x: Column) -> Column:
    """Sums of the elements before each element."""
    def step(acc: Column, v: Column) -> Column:
        return F.struct((acc["t"] + v).alias("t"), F.concat(acc["out"], F.array(acc["t"])).alias("out"))

    return F.when(F.size(x) == 0, F.array().cast("array<long>")).otherwise(folded(x, {"t": F.lit(0).cast("long")}, "array<long>", step)["out"])
