"""Ordered-series processing that does not put one series into one task.

A series is the set of rows that share ``keys`` (usually the symbol), ordered by time.
A plain ``Window.partitionBy("symbol")`` would sort a whole series in a single task, so a
symbol that holds a third of the table would hold up the job. Here every series is cut:

* ``index_series``   gives each row its ordinal in two levels (rows in a time bucket, then
                     a prefix sum over the much smaller bucket counts);
* ``over_chunks``    evaluates bounded frames per fixed-length chunk, with the rows the
                     frames reach back to (or ahead to) copied from the neighbour chunk;
* ``running``        evaluates unbounded running aggregates as local running value plus
                     the carry of all earlier chunks;
* ``cusum``          is the two-level form of the reset-at-zero cumulative sum;
* ``carry_last``     is a two-level forward fill, the base of the as-of join;
* ``thin``           is greedy min-gap selection through composable chunk maps.

All results equal those of the single-window form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"
IDX = "bar_idx"
MIN_CHUNK = 256
# carry below this share of the seed cannot change a double
FORGET = 1e-17
# exp() argument up to which the rescaled running sum of an exponential mean stays finite
MAX_EXPONENT = 600.0


def seconds(col: Column | str) -> Column:
    """Whole seconds since the epoch."""
    return F.unix_seconds(F.col(col) if isinstance(col, str) else col)


def index_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Sequence[Column],
    out: str = IDX,
) -> DataFrame:
    """Add the 0-based ordinal of each row in its series.

    ``bucket`` columns must never decrease along ``order``; each bucket is sorted by one
    task, so a bucket should hold a bounded number of rows (for bars: a time span).
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    local = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(local))
        .join(offsets, [*keys, *names])
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_rn", "_off", *names)
    )


@dataclass(frozen=True)
class Frames:
    """Window frames over one chunk of a series, ordered by the row ordinal."""

    keys: tuple[str, ...]
    idx: str = IDX

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(self.idx)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.w.rowsBetween(-n, -1)

    def ahead(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1, n)

    @property
    def so_far(self) -> WindowSpec:
        """From the first row of the chunk (with its halo) to the current one."""
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, col: Column | str, k: int = 1) -> Column:
        return F.lag(col, k).over(self.w)

    def lead(self, col: Column | str, k: int = 1) -> Column:
        return F.lead(col, k).over(self.w)

    def full(self, n: int) -> Column:
        """True where n rows of the series exist up to and including this one."""
        return F.col(self.idx) >= n - 1


def over_chunks(
    df: DataFrame,
    build: Callable[[DataFrame, Frames], DataFrame],
    keys: Sequence[str] = ("symbol",),
    back: int = 0,
    ahead: int = 0,
    chunk: int | None = None,
    idx: str = IDX,
) -> DataFrame:
    """Run ``build`` on chunks of each series, one shuffle on (keys, chunk).

    ``back`` and ``ahead`` are the rows that the frames in ``build`` may reach; nested
    frames add up. Rows copied from a neighbour serve as frame input only and are dropped
    at the end.
    """
    size = chunk or max(MIN_CHUNK, 4 * max(back, ahead))
    if max(back, ahead) > size:
        raise ValueError(f"frames reach {max(back, ahead)} rows but a chunk has only {size}")
    own = F.floor(F.col(idx) / size)
    offset = F.col(idx) % size
    homes = [own]
    if back:
        homes.append(F.when(offset >= size - back, own + 1))
    if ahead:
        homes.append(F.when((offset < ahead) & (own > 0), own - 1))
    spread = df.select("*", F.explode(F.array_compact(F.array(*homes))).alias(CHUNK))
    built = build(spread, Frames(tuple(keys), idx))
    return built.filter(F.floor(F.col(idx) / size) == F.col(CHUNK)).drop(CHUNK)


def running(
    df: DataFrame,
    values: dict[str, tuple[str, Column]],
    keys: Sequence[str] = ("symbol",),
    order: Sequence[Column | str] = (IDX,),
    bucket: Sequence[Column] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates from the first row of the series: local value combined with the carry.

    ``values`` maps an output name to (``sum`` | ``min`` | ``max`` | ``count``, input).
    ``exclusive`` leaves the current row out.
    """
    bucket = bucket or [F.floor(F.col(IDX) / 4096)]
    names = [f"_b{i}" for i in range(len(bucket))]
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    tagged = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)],
                       *[c.alias(f"_in_{o}") for o, (_, c) in values.items()])
    upto = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, *names).agg(
        *[fns[fn](f"_in_{o}").alias(f"_t_{o}") for o, (fn, _) in values.items()])
    carry = totals.select(
        *keys, *names,
        *[(F.sum if fn == "count" else fns[fn])(f"_t_{o}").over(before).alias(f"_c_{o}")
          for o, (fn, _) in values.items()])
    local = tagged.select(
        *[c for c in df.columns], *names,
        *[fns[fn](f"_in_{o}").over(upto).alias(f"_l_{o}") for o, (fn, _) in values.items()])
    joined = local.join(carry, [*keys, *names])

    def combine(o: str, fn: str) -> Column:
        here, past = F.col(f"_l_{o}"), F.col(f"_c_{o}")
        if fn in ("sum", "count"):
            return F.when(here.isNull() & past.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)))
        return F.least(here, past) if fn == "min" else F.greatest(here, past)

    return joined.select(*df.columns, *[combine(o, fn).alias(o) for o, (fn, _) in values.items()])


def cusum(df: DataFrame, step: Column, keys: Sequence[str] = ("symbol",), idx: str = IDX,
          size: int = 1024, up: str = "cusum_pos", down: str = "cusum_neg") -> DataFrame:
    """One-sided cumulative sums that restart at zero.

    max(0, s + r) taken along a series equals S - min(0, running min of S) with S the plain
    running sum, and min(0, s + r) equals S - max(0, running max of S). Both extremes
    compose over chunks, so only one row per chunk takes part in the carry.
    """
    local = Window.partitionBy(*keys, CHUNK).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    chunked = (
        df.select("*", F.floor(F.col(idx) / size).alias(CHUNK), F.coalesce(step, F.lit(0.0)).alias("_r"))
        .withColumn("_s", F.sum("_r").over(local))
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.max_by("_s", idx).alias("_tot"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
        .withColumn("_s0", F.coalesce(F.sum("_tot").over(before), F.lit(0.0)))
        .select(*keys, CHUNK, "_s0",
                F.coalesce(F.min(F.col("_s0") + F.col("_lo")).over(before), F.lit(0.0)).alias("_lo0"),
                F.coalesce(F.max(F.col("_s0") + F.col("_hi")).over(before), F.lit(0.0)).alias("_hi0"))
    )
    total = F.col("_s0") + F.col("_s")
    low = F.least(F.lit(0.0), F.col("_lo0"), F.col("_s0") + F.min("_s").over(local))
    high = F.greatest(F.lit(0.0), F.col("_hi0"), F.col("_s0") + F.max("_s").over(local))
    return (
        chunked.join(carry, [*keys, CHUNK])
        .select(*df.columns, (total - low).alias(up), (total - high).alias(down))
    )


def ema_halo(*alphas: float) -> int:
    """Rows after which stacked exponential means have forgotten what came before."""
    return sum(math.ceil(math.log(FORGET) / math.log(1.0 - a)) for a in alphas)


def ema_chunk(halo: int, *alphas: float) -> int:
    """Chunk length for exponential means: a small multiple of the halo that stays in range."""
    steepest = max(-math.log(1.0 - a) for a in alphas)
    size = int(min(4 * halo, MAX_EXPONENT / steepest - halo))
    if size < halo:
        raise ValueError("smoothing factors lie too far apart for one chunk length")
    return size


def ema(x: Column, alpha: float, frames: Frames, start: int = 0, from_zero: bool = False) -> Column:
    """Exponential mean y = a*x + (1-a)*y' seeded with the value at row ``start`` (or with 0).

    Written as a rescaled running sum, so it stays a built-in window aggregate:
    y_t = (1-a)^t * sum(a * x_i * (1-a)^-i). Use inside ``over_chunks`` with ``ema_halo``.
    """
    keep = 1.0 - alpha
    idx = F.col(frames.idx)
    pos = (idx - F.min(idx).over(Window.partitionBy(*frames.keys, CHUNK))).cast("double")
    share = F.when((idx == start) & F.lit(not from_zero), F.lit(1.0)).otherwise(F.lit(alpha))
    term = F.when(idx >= start, x * share * F.pow(F.lit(keep), -pos))
    return F.sum(term).over(frames.so_far) * F.pow(F.lit(keep), pos)


def wilder_seeded(x: Column, period: int, frames: Frames) -> Column:
    """Input of a Wilder mean: the plain mean of rows 1..period at row ``period``, then x."""
    idx = F.col(frames.idx)
    return F.when(idx == period, F.avg(x).over(frames.last(period))).when(idx > period, x)


def wilder(x: Column, period: int, frames: Frames) -> Column:
    """Wilder mean of x, NULL before row ``period``."""
    return ema(wilder_seeded(x, period, frames), 1.0 / period, frames, start=period)


def carry_last(df: DataFrame, col: str, keys: Sequence[str], order: Sequence[str],
               bucket: Column, out: str, inclusive: bool = True, forward: bool = True) -> DataFrame:
    """Latest (or, with ``forward=False``, next) non-null ``col`` along the series, in two levels."""
    asc = [F.col(o).asc() if forward else F.col(o).desc() for o in order]
    bdir = F.col("_b").asc() if forward else F.col("_b").desc()
    tagged = df.withColumn("_b", bucket)
    local = Window.partitionBy(*keys, "_b").orderBy(*asc).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    pick = F.max_by if forward else F.min_by
    ends = (
        tagged.groupBy(*keys, "_b")
        .agg(pick(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order))).alias("_end"))
        .select(*keys, "_b", F.last("_end", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(bdir).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    )
    return (
        tagged.withColumn("_here", F.last(col, ignorenulls=True).over(local))
        .join(ends, [*keys, "_b"])
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_here", "_carry", "_b")
    )


def thin(df: DataFrame, gap: int, keys: Sequence[str] = ("symbol",), idx: str = IDX,
         size: int | None = None) -> DataFrame:
    """Greedy min-gap selection: keep a row when it lies >= ``gap`` rows after the last kept one.

    Each chunk is reduced to a map from "first free row on entry" to "first free row on
    exit", which has at most ``gap`` + 1 entries whatever the chunk holds. The maps are
    folded per series, giving each chunk its entry state; then chunks are thinned on their own.
    """
    size = size or max(1024, 8 * gap)
    rows = (
        df.groupBy(*keys, F.floor(F.col(idx) / size).alias(CHUNK))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(idx).cast("long").alias("_i"), F.struct(*df.columns).alias("_row")))).alias("_rows"))
        .withColumn("_base", F.col(CHUNK) * size)
    )
    free_after = F.transform(
        F.sequence(F.lit(0), F.lit(gap)),
        lambda s: F.aggregate("_rows", F.col("_base") + s.cast("long"),
                              lambda free, r: F.when(r["_i"] >= free, r["_i"] + F.lit(gap)).otherwise(free)))
    maps = rows.select(*keys, CHUNK, "_base", free_after.alias("_exit"))
    ordered = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(CHUNK, "_base", "_exit"))).alias("_m"))
    start = F.struct(F.lit(0).cast("long").alias("free"),
                     F.array().cast(f"array<struct<{CHUNK}:bigint,entry:bigint>>").alias("seen"))

    def step(acc: Column, m: Column) -> Column:
        # what an earlier chunk blocks reaches less than ``gap`` rows into this one
        entry = F.greatest(acc["free"], m["_base"])
        slot = (entry - m["_base"]).cast("int")
        return F.struct(F.element_at(m["_exit"], slot + 1).alias("free"),
                        F.array_append(acc["seen"], F.struct(m[CHUNK].alias(CHUNK), entry.alias("entry"))).alias("seen"))

    entries = ordered.select(
        *keys, F.explode(F.aggregate("_m", start, step, lambda acc: acc["seen"])).alias("_e")
    ).select(*keys, F.col(f"_e.{CHUNK}").alias(CHUNK), F.col("_e.entry").alias("_entry"))

    def keep(acc: Column, r: Column) -> Column:
        hit = r["_i"] >= acc["free"]
        return F.struct(F.when(hit, r["_i"] + F.lit(gap)).otherwise(acc["free"]).alias("free"),
                        F.when(hit, F.array_append(acc["kept"], r["_i"])).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate(
        "_rows", F.struct(F.col("_entry").alias("free"), F.array().cast("array<bigint>").alias("kept")),
        keep, lambda acc: acc["kept"])
    return (
        rows.join(entries, [*keys, CHUNK])
        .select("_rows", kept.alias("_kept"))
        .select(F.explode(F.filter("_rows", lambda r: F.array_contains("_kept", r["_i"]))).alias("_r"))
        .select("_r._row.*")
    )
