"""As-of, nearest and interval joins that stay equi joins or two-level carries."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import carry_last


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
              payload: str, span: int, strict: bool = False, forward: bool = False) -> DataFrame:
    """Latest row of ``right`` at or before each left row (strictly before, or next, on request).

    Both sides are laid on one time line cut into buckets of ``span`` units; the newest right
    row of each bucket is carried across buckets. The match arrives as struct ``payload``.
    """
    side = (1 if not strict else 0) if not forward else (0 if not strict else 1)
    fields = F.struct(*right.columns)
    lines = left.select(*keys, F.col(left_at).alias("_at"), F.lit(side).alias("_side"),
                        F.struct(*left.columns).alias("_row")).unionByName(
        right.select(*keys, F.col(right_at).alias("_at"), F.lit(1 - side).alias("_side"), fields.alias("_hit")),
        allowMissingColumns=True)
    carried = carry_last(lines, "_hit", keys, ["_at", "_side"], F.floor(F.col("_at") / span), payload, forward=not forward)
    return carried.filter(F.col("_row").isNotNull()).select("_row.*", payload)


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
                 payload: str, span: int) -> DataFrame:
    """Right row nearest in time on either side; the later one wins a tie."""
    both = asof_join(left, right, keys, left_at, right_at, "_prev", span)
    both = asof_join(both, right, keys, left_at, right_at, "_next", span, strict=True, forward=True)
    back = F.col(left_at) - F.col(f"_prev.{right_at}")
    ahead = F.col(f"_next.{right_at}") - F.col(left_at)
    pick = F.when(F.col("_prev").isNull() | (ahead <= back), F.coalesce("_next", "_prev")).otherwise(F.col("_prev"))
    return both.withColumn(payload, pick).drop("_prev", "_next")


def band_semi(child: DataFrame, parent: DataFrame, reach: int, at: str = "bar_idx", on: str = "symbol") -> DataFrame:
    """Child rows that lie within ``reach`` rows of any parent row of the series."""
    width = max(reach, 1)
    spots = parent.select(on, F.col(at).alias("_p"), F.explode(F.sequence(
        F.floor((F.col(at) - reach) / width), F.floor((F.col(at) + reach) / width))).alias("_blk"))
    c = child.withColumn("_blk", F.floor(F.col(at) / width))
    near = (c[on] == spots[on]) & (c["_blk"] == spots["_blk"]) & (F.abs(c[at] - spots["_p"]) <= reach)
    return c.join(spots, near, "left_semi").drop("_blk")


def within_parent(child: DataFrame, parent: DataFrame, reach: int, cols: Sequence[str], child_cols: Sequence[str],
                  at: str = "bar_idx", start: str = "start_bar", end: str = "exit_bar", on: str = "symbol") -> DataFrame:
    """Child rows strictly inside (start, end) of a parent; parents last ``reach`` rows at most."""
    p = parent.select(on, *[F.col(c) for c in cols], F.explode(F.sequence(
        F.floor(F.col(start) / reach), F.floor(F.col(end) / reach))).alias("_blk"))
    c = child.select(on, F.floor(F.col(at) / reach).alias("_blk"), *[F.col(x).alias(f"c_{x}") for x in child_cols])
    return p.join(c, [on, "_blk"]).filter((F.col(f"c_{at}") > F.col(start)) & (F.col(f"c_{at}") < F.col(end))).drop("_blk")


def assign_windows(rows: DataFrame, windows: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Rows with the windows [lo, hi) they fall into, through a block key of ``width`` units."""
    w = windows.withColumn("_blk", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return (rows.withColumn("_blk", F.floor(F.col(at) / width)).join(w, "_blk")
            .filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_blk"))


#: Characters of all words of a contains join that one automaton in each task may hold.
AUTOMATON_CHARS = 2_000_000


@functools.lru_cache(maxsize=4)
def automaton(words: tuple[str, ...]):
    """One automaton of all words, built once in a worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def words_in(text: Column, words: tuple[str, ...]) -> Column:
    """The different ``words`` that a text contains, in one pass over it."""
    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        scan = automaton(words).iter
        return pa.array([None if (t := v.as_py()) is None else sorted({w for _, w in scan(t)}) for v in texts], pa.list_(pa.string()))

    return found(text)


def contains_join(texts: DataFrame, words: DataFrame, text: str, word: str, most: int = AUTOMATON_CHARS) -> DataFrame:
    """Pairs of a text and a word that it contains, whatever the case. Empty words match nothing.

    Words of at most ``most`` characters in all go to every task as one automaton, so only matches leave it. Beyond that, every
    distinct stretch of a text that is as long as some word is the key of an equi join; words have few lengths, so a text
    gives at most its length times that number of keys.
    """
    table = words.filter(F.length(word) > 0).withColumn("_w", F.lower(word))
    size = table.agg(F.sum(F.length("_w"))).first()[0] or 0
    if size == 0:
        return texts.withColumn("_w", F.lit(None).cast("string")).join(table, "_w").drop("_w")
    if size <= most:
        every = tuple(sorted(r["_w"] for r in table.select("_w").distinct().collect()))
        return texts.withColumn("_w", F.explode(words_in(F.lower(text), every))).join(F.broadcast(table), "_w").drop("_w")
    sizes = table.agg(F.collect_set(F.length("_w")).alias("n"))
    low = texts.withColumn("_t", F.lower(text)).withColumn("_n", F.explode(sizes.scalar())).filter(F.length("_t") >= F.col("_n"))
    starts = F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1)
    keys = F.array_distinct(F.transform(starts, lambda i: F.substr("_t", i, F.col("_n"))))
    return low.withColumn("_w", F.explode(keys)).drop("_t", "_n").join(table, "_w").drop("_w")
