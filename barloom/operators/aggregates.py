"""Outcome statistics: profit factor, exact quantiles and report shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profit_factor(c: Column | str, when_no_loss: float = float("inf")) -> Column:
    """Sum of gains over the size of the sum of losses; 0 without any gain or loss."""
    c = F.col(c) if isinstance(c, str) else c
    wins = F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0))
    losses = F.coalesce(F.sum(F.when(c < 0, -c)), F.lit(0.0))
    return F.when(losses == 0, F.when(wins > 0, F.lit(when_no_loss)).otherwise(0.0)).otherwise(F.try_divide(wins, losses))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], bins: int = 64) -> DataFrame:
    """Exact linear-interpolation quantiles without gathering a group in one task.

    The built-in exact ``percentile`` keeps every distinct value of a group in one buffer.
    Here the rows are counted once per distinct value (map-side combined); all that follows
    starts from these counts. They are cut into bins by approximate edges, and only the bins
    that hold a wanted rank are ranked. Output: keys, q, value_at_q.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    share = [(i + 1) / bins for i in range(bins - 1)]
    edges = counted.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(s) for s in share]), 10 * bins)).alias("_edges"))
    cut = counted.join(edges, keys) if keys else counted.withColumn("_edges", edges.scalar())
    binned = cut.withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # at most one row for each bin of a key
    held = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc")).withColumns(
        {"_off": F.coalesce(F.sum("_bc").over(before), F.lit(0)), "_n": F.sum("_bc").over(whole)})
    wanted = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("_n") - 1) * float(q)).alias("pos")) for q in qs]))

    def holds(rank: Column, first: str, rows: str) -> Column:
        return (rank >= F.col(first)) & (rank < F.col(first) + F.col(rows))

    below, above = F.floor("_w.pos"), F.ceil("_w.pos")
    asked = held.withColumn("_w", wanted).filter(holds(below, "_off", "_bc") | holds(above, "_off", "_bc")).groupBy(*keys, "_bin", "_off").agg(
        F.collect_list("_w").alias("_ws"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(asked, [*keys, "_bin"]).withColumn("_lo", F.col("_off") + F.sum("_c").over(inside) - F.col("_c"))
    hit = ranked.withColumn("_w", F.explode("_ws")).filter(holds(below, "_lo", "_c") | holds(above, "_lo", "_c"))
    picked = hit.groupBy(*keys, F.col("_w.q").alias("q"), F.col("_w.pos").alias("_pos")).agg(
        F.max(F.when(holds(below, "_lo", "_c"), F.col("_v"))).alias("_va"), F.max(F.when(holds(above, "_lo", "_c"), F.col("_v"))).alias("_vb"))
    part = F.col("_pos") - F.floor("_pos")
    return picked.select(*keys, "q", (F.col("_va") + (F.col("_vb") - F.col("_va")) * part).alias("value_at_q"))
