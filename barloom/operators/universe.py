"""Symbol universe: eligibility, scores, slot selection, de-duplication, venues."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators.graphs import components
from barloom.operators.series import ema, index_series, over_chunks
from barloom.session import scratch, settle

# Quote suffix, stable-coin parts, excluded bases and anchors.
SUFFIX = "USDT"
STABLE = ("BUSD", "USDC", "TUSD", "DAI", "FDUSD")
STABLE_AND_WRAPPED = ("BUSD", "USDC", "TUSD", "DAI", "FDUSD", "WBTC", "STETH")
GARBAGE_BASES = (
    "BUSD", "USDC", "TUSD", "DAI", "USDP", "USDD", "FDUSD", "PYUSD", "EUR", "GBP", "USD", "USD1", "TRY", "BRL", "ZAR", "RUB",
    "IDR", "UAH", "NGN", "PAXG", "WBTC", "WETH", "STETH", "AEUR", "VAI", "FRAX")
ANCHORS = ("BTCUSDT", "ETHUSDT", "BNBUSDT")
REGIME_WEIGHTS = {
    "bull": {"volume": 0.20, "momentum": 0.30, "atr": 0.20, "adx": 0.15, "consistency": 0.05, "funding": 0.10},
    "bear": {"volume": 0.30, "momentum": 0.15, "atr": 0.15, "adx": 0.20, "consistency": 0.05, "funding": 0.15},
    "range": {"volume": 0.20, "momentum": 0.20, "atr": 0.25, "adx": 0.10, "consistency": 0.10, "funding": 0.15},
}


# -- predicates ---------------------------------------------------------------------------------

def eligible(volume: Column, symbol: Column, floor: float = 10e6, excluded: Sequence[str] = STABLE, suffix: str = SUFFIX) -> Column:
    """Quote suffix, volume floor and none of the excluded parts inside the symbol."""
    return symbol.endswith(suffix) & (volume >= floor) & ~symbol.rlike("|".join(excluded))


def gated(tickers: DataFrame, floor: float = 5e6, gate: float = 1.0, least: int | None = None, suffix: str = SUFFIX) -> DataFrame:
    """Movers of at least ``gate`` percent; with ``least``, the gate falls when fewer rows would stay."""
    base = tickers.filter(eligible(F.col("volume_24h"), F.col("symbol"), floor, STABLE_AND_WRAPPED, suffix))
    moving = F.abs(F.col("pct_24h")) >= gate
    if least is not None:
        moving = moving | ~base.agg((F.count_if(moving) >= least).alias("enough")).scalar()
    return base.filter(moving).withColumn(
        "score", F.abs(F.col("pct_24h")) * F.log10(F.greatest(F.col("volume_24h"), F.lit(1.0))))


def clean_base(volume: Column, symbol: Column, floor: float = 5e5, suffix: str = SUFFIX) -> Column:
    return symbol.endswith(suffix) & (volume >= floor) & ~F.regexp_replace(symbol, f"{suffix}$", "").isin(*GARBAGE_BASES)


def spike_candidates(tickers: DataFrame, limit: int, move: float = 5.0, floor: float = 2e6) -> DataFrame:
    """Strong movers on volume, ranked by move times millions traded."""
    rank = F.abs(F.col("pct_24h")) * F.col("volume_24h") / 1e6
    return (tickers.filter((F.abs(F.col("pct_24h")) > move) & (F.col("volume_24h") > floor))
            .withColumn("rank_score", rank).orderBy(F.desc("rank_score"), "symbol").limit(limit))


def number_list(text: Column) -> Column:
    """'13,14-16' to [13, 14, 15, 16]."""
    def part(p: Column) -> Column:
        ends = F.split(F.trim(p), "-")
        return F.sequence(ends[0].cast("int"), F.element_at(ends, -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), part))))


def name_list(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(F.upper(text), ","), lambda x: F.trim(x)))


# -- scores -------------------------------------------------------------------------------------

def month_stats(daily: DataFrame, rows: int = 30, least: int = 20) -> DataFrame:
    """Change, ATR percent, ADX and volume steadiness over the last ``rows`` daily bars (by ``t``) of each symbol.

    The tail is numbered, so the recurrences start at its first bar.
    """
    by = Window.partitionBy("symbol")     # a row per day: bounded by the calendar
    tail = (daily.withColumns({"_n": F.count(F.lit(1)).over(by), "_i": F.row_number().over(by.orderBy("t")).cast("long") - 1})
            .filter((F.col("_n") >= least) & (F.col("_i") >= F.col("_n") - rows))
            .withColumn("bar_idx", F.col("_i") - F.greatest(F.col("_n") - rows, F.lit(0))).withColumn("_rows", F.least(F.col("_n"), F.lit(rows))).drop("_i"))
    a = R.ema_alpha(14)

    def build(x: DataFrame, f) -> DataFrame:
        plus, minus = R.directional_moves(f)
        x = x.select("*", F.when(F.col("bar_idx") == 0, 0.0).otherwise(R.true_range(f)).alias("tr"), plus.alias("pdm"), minus.alias("mdm"))
        x = x.select("*", ema(F.col("tr"), a, f).alias("ta"), ema(F.col("pdm"), a, f).alias("pe"), ema(F.col("mdm"), a, f).alias("me"))
        x = x.select("*", F.coalesce(F.try_divide(100.0 * F.col("pe"), F.col("ta")), F.lit(0.0)).alias("pdi"),
                     F.coalesce(F.try_divide(100.0 * F.col("me"), F.col("ta")), F.lit(0.0)).alias("mdi"))
        x = x.withColumn("dx", F.coalesce(F.try_divide(100.0 * F.abs(F.col("pdi") - F.col("mdi")), F.col("pdi") + F.col("mdi")), F.lit(0.0)))
        return x.withColumn("adx", ema(F.col("dx"), a, f)).withColumn("range14", F.avg("tr").over(f.last(14)))

    s = over_chunks(tail, build, back=0, chunk=256)
    last = F.max_by(F.struct("close", "adx", "pdi", "mdi", "range14", "volume"), "bar_idx")
    g = s.groupBy("symbol").agg(last.alias("_l"), F.min_by("close", "bar_idx").alias("_c0"), F.avg("volume").alias("avg_volume"),
                                F.stddev_pop("volume").alias("_sv"), F.first("_rows").alias("days"))
    close = F.col("_l.close")
    return g.select(
        "symbol", "days", "avg_volume", close.alias("close"), ((F.try_divide(close, F.col("_c0")) - 1) * 100).alias("pct_30d"),
        F.when(close > 0, F.col("_l.range14") / close * 100).otherwise(0.0).alias("atr_pct"), F.col("_l.adx").alias("adx"),
        (1 / (1 + F.coalesce(F.try_divide(F.col("_sv"), F.col("avg_volume")), F.lit(999.0)))).alias("consistency"))


def five_factor_score() -> Column:
    """Liquidity, momentum either way, capped volatility, trend clarity, steadiness."""
    return (F.log10(F.col("volume_24h")) * 0.30 + F.abs(F.col("pct_30d")) * 0.25 + F.least(F.col("atr_pct"), F.lit(10.0)) * 0.20
            + F.col("adx") * 0.15 + F.col("consistency") * 10 * 0.10)


def regime_score(regime: Column) -> Column:
    """The same with regime-dependent weights, relative volume, funding and open interest."""
    def w(name: str) -> Column:
        return (F.when(regime == "bull", REGIME_WEIGHTS["bull"][name]).when(regime == "bear", REGIME_WEIGHTS["bear"][name])
                .otherwise(REGIME_WEIGHTS["range"][name]))
    rel = F.least(F.log10(F.greatest(F.col("vol_ratio"), F.lit(1.0)) + 1) * 5, F.lit(10.0))
    fund = F.least(F.abs(F.coalesce("funding", F.lit(0.0))) * 10000, F.lit(10.0))
    oi = F.when(F.col("oi") > 0, F.least(F.log10(F.greatest(F.col("oi"), F.lit(1.0))) * 0.5, F.lit(5.0))).otherwise(0.0)
    return ((F.log10(F.col("volume_24h")) + rel) * w("volume") + F.abs(F.col("pct_30d")) * w("momentum")
            + F.least(F.col("atr_pct"), F.lit(10.0)) * w("atr") + F.col("adx") * w("adx") + F.col("consistency") * 10 * w("consistency") + (fund + oi) * w("funding"))


# -- selection ----------------------------------------------------------------------------------

def fill_slots(scored: DataFrame, slots: Sequence[tuple[str, Column | None, Column, int]], limit: int) -> DataFrame:
    """Greedy slots without repeats: (name, condition, descending order, size).

    A slot of size k needs no more than its best k rows plus one per row earlier slots may
    have taken. So each slot contributes a bounded top list and one row holds them all.
    """
    seen, tops = 0, []
    for pos, (name, cond, order, size) in enumerate(slots):
        reach = min(size, limit) + seen
        part = scored if cond is None else scored.filter(cond)
        tops.append(part.select("symbol", order.alias("_o")).orderBy(F.desc("_o"), "symbol").limit(reach)
                    .select(F.lit(pos).alias("slot"), (-F.col("_o")).alias("_o"), "symbol"))
        seen += min(size, limit)
    union = tops[0]
    for t in tops[1:]:
        union = union.unionByName(t)
    lists = union.groupBy().agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == p, F.struct("_o", "symbol")))), lambda x: x["symbol"]).alias(f"_l{p}")
        for p in range(len(slots))])
    row = lists.withColumn("_used", F.array().cast("array<string>")).withColumn(
        "_chosen", F.array().cast("array<struct<slot:string,symbol:string>>"))
    for p, (name, _, _, size) in enumerate(slots):
        take = F.slice(F.filter(F.col(f"_l{p}"), lambda s: ~F.array_contains("_used", s)), 1, size)
        row = row.withColumn("_take", take)
        row = row.withColumn("_chosen", F.concat("_chosen", _label(F.col("_take"), name))).withColumn("_used", F.concat("_used", "_take"))
    return (row.select(F.posexplode(F.slice("_chosen", 1, limit)).alias("pos", "c"))
            .select((F.col("pos") + 1).alias("position"), "c.slot", "c.symbol"))


def _label(symbols: Column, name: str) -> Column:
    return F.transform(symbols, lambda s: F.struct(F.lit(name).alias("slot"), s.alias("symbol")))


def diversity_slots(discovery: bool = True, fill: int = 50) -> list[tuple[str, Column | None, Column, int]]:
    """Gainers, losers, ranging, volatile, anchors, discovery and the rest by score."""
    score = F.col("score")
    slots = [("gainer", F.col("pct_30d") > 15, score, 5), ("loser", F.col("pct_30d") < -15, score, 5), ("ranging", F.col("adx") < 20, score, 5),
             ("volatile", None, F.col("atr_pct"), 5), ("anchor", F.col("symbol").isin(*ANCHORS), score, 3)]
    if discovery:
        slots.append(("discovery", (F.col("vol_ratio") >= 3.0) & (F.col("volume_24h") < 5e8), F.col("vol_ratio"), 3))
    return [*slots, ("fill", None, score, fill)]


def top_both_sides(rows: DataFrame, value: str, n: int, anchors: Sequence[str] = ()) -> DataFrame:
    """Top n gainers then top n losers in order, repeats removed, missing anchors last."""
    up = rows.filter(F.col(value) > 0).orderBy(F.desc(value), "symbol").limit(n).select("symbol", F.lit(0).alias("side"), (-F.col(value)).alias("o"))
    down = rows.filter(F.col(value) < 0).orderBy(value, "symbol").limit(n).select("symbol", F.lit(1).alias("side"), F.col(value).alias("o"))
    both = up.unionByName(down)
    if anchors:
        extra = rows.sparkSession.createDataFrame([(a, 2, float(i)) for i, a in enumerate(anchors)], "symbol string, side int, o double")
        both = both.unionByName(extra)
    # at most 2n + anchors rows are left here
    first = both.groupBy("symbol").agg(F.min(F.struct("side", "o")).alias("k"))
    return first.select("symbol", F.row_number().over(Window.orderBy("k.side", "k.o", "symbol")).alias("position"))


def interleaved_extremes(rows: DataFrame, value: str, limit: int, high: float = 100.0, low: float = -40.0) -> DataFrame:
    """Strong gainers and strong losers taken in turn, padded with the next largest moves."""
    def ranked(part: DataFrame, order: Column, side: int) -> DataFrame:
        top = part.select("symbol", order.alias("o")).orderBy("o", "symbol").limit(limit)
        return top.select("symbol", F.row_number().over(Window.orderBy("o", "symbol")).alias("r"), F.lit(side).alias("side"))
    up = ranked(rows.filter(F.col(value) >= high), -F.col(value), 0)
    down = ranked(rows.filter(F.col(value) <= low), F.col(value), 1)
    rest = ranked(rows.filter((F.col(value) < high) & (F.col(value) > low)), -F.abs(F.col(value)), 2)
    merged = up.unionByName(down).unionByName(rest)
    order = Window.orderBy((F.col("side") == 2).cast("int"), "r", "side")
    return (merged.select("symbol", "side", F.row_number().over(order).alias("position")).filter(F.col("position") <= limit))


def best_per_symbol(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Highest score of each symbol, then the overall top."""
    rest = [c for c in rows.columns if c != "symbol"]
    best = rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("score", F.struct(*rest))).alias("b")).select("symbol", "b.*")
    return best.orderBy(F.desc("score"), "symbol").limit(limit)


def category_split(rows: DataFrame, anchors: Sequence[str], share: float = 0.4, least: int = 10) -> DataFrame:
    """anchor / quality / volatile: the rest splits by volume at max(least, share)."""
    rest = rows.filter(~F.col("symbol").isin(*anchors))
    cut = F.greatest(F.lit(least), F.floor(rest.agg(F.count(F.lit(1)).alias("n")).scalar() * share))
    split = volume_rank(rest).select("symbol", F.when(F.col("rank") <= cut, "quality").otherwise("volatile").alias("category"))
    anchor = rows.filter(F.col("symbol").isin(*anchors)).select("symbol", F.lit("anchor").alias("category"))
    return split.unionByName(anchor)


def volume_rank(rows: DataFrame, volume: str = "volume_24h") -> DataFrame:
    """Symbols with their rank by volume (from 1); volumes of one sixteenth of an octave are sorted in one task."""
    octave = F.coalesce(F.floor(F.log2(F.col(volume)) * -16), F.lit(2**31))
    n = index_series(rows.select("symbol", volume), [], [F.desc(volume), F.col("symbol")], [octave], out="rank")
    return n.withColumn("rank", (F.col("rank") + 1).cast("int"))


# -- correlation ----------------------------------------------------------------------------------

def aligned_returns(daily: DataFrame, candidates: DataFrame, least: int = 15, days: int | None = None, step: int = 86400) -> DataFrame:
    """The returns of each candidate by day number: symbol, rets (map). ``days`` keeps only the newest ones; all by default."""
    rows = daily.join(candidates.select("symbol"), "symbol", "left_semi").withColumn("_d", F.floor(F.col("t") / step).cast("int"))
    if days is not None:
        newest = daily.agg(F.floor(F.max("t") / step).alias("m"))
        rows = rows.filter(newest.scalar() - F.col("_d") < days)
    by = Window.partitionBy("symbol").orderBy("t")     # a row per day: bounded by the calendar
    r = rows.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(by)) - 1).filter(F.col("r").isNotNull())
    return r.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("_d", "r"))).alias("rets")).filter(F.size("rets") >= least)


def pair_sums(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, most: int = 2_000_000) -> list[np.ndarray]:
    """For every row of x with every row of y, over the columns both have: how many, sums of x, y, xx, yy and xy.

    ``x`` and ``y`` are zero where the masks ``mx`` and ``my`` are. Well-filled tiles are six matrix products. In sparse ones the
    rows that share a column meet there, at most ``most`` meetings at a time.
    """
    meetings = mx.sum(axis=0) * my.sum(axis=0)
    size = len(x) * len(y)
    if 16 * int(meetings.sum()) > size * x.shape[1]:
        fx, fy = mx.astype(np.float64), my.astype(np.float64)
        return [fx @ fy.T, x @ fy.T, fx @ y.T, (x * x) @ fy.T, fx @ (y * y).T, x @ y.T]
    sums = [np.zeros(size) for _ in range(6)]
    (day_x, row_x), (day_y, row_y) = np.nonzero(mx.T), np.nonzero(my.T)
    first, each = np.searchsorted(day_y, day_x), my.sum(axis=0)[day_x]
    ends = np.cumsum(each)
    lo = 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        n = each[lo:hi]
        left = np.repeat(np.arange(lo, hi), n)
        right = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(len(left))
        code = row_x[left] * len(y) + row_y[right]
        u, v = x[row_x[left], day_x[left]], y[row_y[right], day_y[right]]
        for total, weight in zip(sums, (None, u, v, u * u, v * v, u * v)):
            total += np.bincount(code, weight, size)
        lo = hi
    return [total.reshape(len(x), len(y)) for total in sums]


def correlation(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, syy: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Correlations from sums over the common days; NaN where a side does not vary on them."""
    with np.errstate(all="ignore"):
        vx, vy = sxx / n - (sx / n)**2, syy / n - (sy / n)**2
        flat = (vx <= 1e-13 * sxx / n) | (vy <= 1e-13 * syy / n)
        return np.where(flat, np.nan, (sxy / n - sx * sy / n**2) / np.sqrt(vx * vy))


def tile_correlations(x: np.ndarray, y: np.ndarray, least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, correlation) of the ``wanted`` pairs that have ``least`` columns in common (NaN where a row has none).

    A pair of which one side does not vary on the common columns has no correlation.
    """
    def centred(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = ~np.isnan(rows)
        mean = np.where(mask, rows, 0).sum(axis=1, keepdims=True) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
        return np.where(mask, rows - mean, 0.0), mask

    (x, mx), (y, my) = centred(x), centred(y)
    sums = pair_sums(x, y, mx, my)
    a, b = np.nonzero(wanted & (sums[0] >= least))
    return a, b, correlation(*(s[a, b] for s in sums))


def sparse_correlations(x: pd.DataFrame, y: pd.DataFrame, least: int, same: bool, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, correlation) of the pairs of vectors (days, r) with ``least`` days in common, about ``most`` of these days at a time.

    For one row of x after the other, the days that each row of y shares with it are counted; only of the rows that share enough are values
    read. With ``same`` y is x, and each pair is given once.
    """
    def flat(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
        row, day, r = (np.repeat(np.arange(len(part)), part["days"].str.len()), *(np.concatenate(part[c].to_list()) for c in ("days", "r")))
        row, day, r = (v[~np.isnan(r)] for v in (row, day, r))
        mean = np.bincount(row, r, len(part)) / np.maximum(np.bincount(row, minlength=len(part)), 1)
        return row, day, r - mean[row]

    (xrow, xday, xr), (yrow, yday, yr) = flat(x), flat(y)
    days = np.unique(yday)
    known = np.isin(xday, days)
    xrow, xday, xr = xrow[known], np.searchsorted(days, xday[known]), xr[known]
    by_day = np.argsort(yday, kind="stable")
    starts = np.append(np.searchsorted(yday[by_day], days), len(by_day))
    yrow, yr = yrow[by_day], yr[by_day]
    rows = np.searchsorted(xrow, np.arange(len(x) + 1))
    held, size = [], 0
    for a in range(len(x)):
        at = np.arange(rows[a], rows[a + 1])
        low, high = starts[xday[at]], starts[xday[at] + 1]
        if len(at):
            others = np.concatenate([yrow[i:j] for i, j in zip(low.tolist(), high.tolist())])
            enough = np.bincount(others, minlength=len(y)) >= least
            if same:
                enough[:a] = False
            pick = np.flatnonzero(enough[others])
            ends = np.cumsum(high - low)
            day = np.searchsorted(ends, pick, side="right")
            held.append((np.full(len(pick), a), others[pick], xr[at][day], yr[high[day] - ends[day] + pick]))
            size += len(pick)
        if size and (size >= most or a == len(x) - 1):
            left, right, u, v = (np.concatenate(c) for c in zip(*held))
            held, size = [], 0
            order = np.lexsort((right, left))
            left, right, u, v = left[order], right[order], u[order], v[order]
            first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
            n, sx, sy, sxx, syy, sxy = (np.add.reduceat(c, first) for c in (np.ones(len(u)), u, v, u * u, v * v, u * v))
            yield left[first], right[first], correlation(n, sx, sy, sxx, syy, sxy)


def strong_pairs(left: pd.DataFrame, right: pd.DataFrame, threshold: float, least: int, tile: int, same: bool) -> Iterator[pd.DataFrame]:
    """lead_a, lead_b and corr of the pairs of vectors (lead, days, r) of both sides above the threshold; of one side with itself if they are the ``same``.

    Well-filled vectors go ``tile`` by ``tile`` into matrices, sparse ones through the days they share.
    """
    if not len(left) or not len(right):
        return
    both = [np.unique(np.concatenate(part["days"].to_list()), return_counts=True) for part in (left, right)]
    _, x, y = np.intersect1d(both[0][0], both[1][0], return_indices=True)
    meetings = (both[0][1][x].astype(float) * both[1][1][y]).sum()
    if 16 * meetings <= float(len(left)) * len(right) * len(np.union1d(both[0][0], both[1][0])):
        for a, b, corr in sparse_correlations(left, right, least, same):
            over = np.abs(corr) > threshold
            yield pd.DataFrame({"lead_a": left["lead"].to_numpy()[a[over]], "lead_b": right["lead"].to_numpy()[b[over]], "corr": corr[over]})
        return
    for lo in range(0, len(left), tile):
        x = left.iloc[lo:lo + tile]
        for at in range(lo if same else 0, len(right), tile):
            y = right.iloc[at:at + tile]
            days = np.unique(np.concatenate([*x["days"], *y["days"]]))

            def dense(part: pd.DataFrame) -> np.ndarray:
                out = np.full((len(part), len(days)), np.nan)
                sizes = part["days"].str.len().to_numpy()
                out[np.repeat(np.arange(len(part)), sizes), np.searchsorted(days, np.concatenate(part["days"].to_list()))] = np.concatenate(part["r"].to_list())
                return out

            wanted = np.ones((len(x), len(y)), dtype=bool)
            a, b, corr = tile_correlations(dense(x), dense(y), least, np.triu(wanted) if same and at == lo else wanted)
            over = np.abs(corr) > threshold
            yield pd.DataFrame({"lead_a": x["lead"].to_numpy()[a[over]], "lead_b": y["lead"].to_numpy()[b[over]], "corr": corr[over]})


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of vectors (symbol, rank, rets) by equality: classes hold the best rank ``lead`` of those with equal
    ``days`` and ``r``, members every symbol with its rank and lead. Equal vectors have equal correlations with all others."""
    entries = F.array_sort(F.map_entries("rets"))
    v = settle(vectors.select("symbol", F.col("rank").cast("int").alias("rank"), entries["key"].alias("days"), entries["value"].alias("r")), "vectors")
    classes = settle(v.groupBy("days", "r").agg(F.min("rank").alias("lead")), "classes")
    return classes, settle(v.join(classes, ["days", "r"]).select("symbol", "rank", "lead"), "members")


def class_pairs(classes: DataFrame, threshold: float, least: int, tile: int = 1000, copies: int = 16, most: int = 100_000) -> DataFrame:
    """(lead_a, lead_b, corr) of the classes that correlate above the threshold, each with itself included.

    Classes are dealt to blocks; each pair of blocks is one task that correlates them (``strong_pairs``) and returns
    the strong pairs. A class is sent to as many tasks as there are blocks: ``copies``, until a block would hold over ``most`` classes.
    """
    n = classes.count()
    blocks = max(1, min(-(-n // tile), max(copies, -(-n // most))))
    # few bytes but much work a tile: tasks are counted by tiles, not by bytes
    tasks = min(blocks * (blocks + 1) // 2, max(4 * classes.sparkSession.sparkContext.defaultParallelism, blocks * blocks // 128))
    own, other = F.pmod(F.xxhash64("lead"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = classes.select("lead", "days", "r", own.alias("own"), other.alias("other")).select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def strong(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        yield from strong_pairs(rows[rows["own"] == rows["i"]], rows[rows["own"] == rows["j"]], threshold, least, tile, same)

    return tiles.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(strong, "lead_a int, lead_b int, corr double")


def correlated_pairs(vectors: DataFrame, threshold: float = 0.85, least: int = 15, tile: int = 1000) -> DataFrame:
    """Pairs with an absolute correlation above the threshold, of all ranked vectors (symbol, rank, rets).

    Equal vectors are correlated once; the pairs of their symbols come from joins with the members of the classes.
    """
    classes, members = vector_classes(vectors)
    a, b = (members.select(F.col("lead").alias(f"lead_{e}"), F.col("symbol").alias(f"sym_{e}"), F.col("rank").alias(f"rank_{e}")) for e in "ab")
    both = class_pairs(classes, threshold, least, tile).join(a, "lead_a").join(b, "lead_b").filter("lead_a <> lead_b OR rank_a < rank_b")
    swap = F.col("rank_a") > F.col("rank_b")
    ends = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("sym", "rank")]
    return both.select(*ends, "corr")


def reached(kept: DataFrame, rest: DataFrame, threshold: float, least: int, tile: int = 1000, block: int = 20_000) -> DataFrame:
    """(lead) of the classes of ``rest`` that correlate above the threshold with one of ``kept``."""
    cores = rest.sparkSession.sparkContext.defaultParallelism
    n, m = kept.count(), rest.count()
    across, down = max(1, -(-n // block)), max(1, -(-m // block), min(cores, m // tile))
    deal = [F.pmod(F.xxhash64("lead"), F.lit(k)).cast("int") for k in (across, down)]
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (across, down)]
    both = kept.select("lead", "days", "r", F.lit(True).alias("kept"), deal[0].alias("i"), every[1].alias("j")).unionByName(
        rest.select("lead", "days", "r", F.lit(False).alias("kept"), every[0].alias("i"), deal[1].alias("j")))

    def hit(rows: pd.DataFrame) -> pd.DataFrame:
        found = [p["lead_b"].unique() for p in strong_pairs(rows[rows["kept"]], rows[~rows["kept"]], threshold, least, tile, False)]
        return pd.DataFrame({"lead": np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)})

    # few bytes but much work a block: tasks are counted by blocks
    return both.repartition(min(across * down, 4 * cores), "i", "j").groupBy("i", "j").applyInPandas(hit, "lead int").distinct()


def drop_correlated_vectors(ranked: DataFrame, vectors: DataFrame, threshold: float = 0.85, least: int = 15, head: int = 20_000) -> DataFrame:
    """``drop_correlated`` over the pairs of ``correlated_pairs``, of which only those that decide are made.

    A round walks about the ``head`` best classes that are left (all, if they are no more than two heads), and drops of the others what those it keeps reach; ``head`` doubles
    from round to round. Most symbols go in the first rounds, and the pairs among them are never made.

    Symbols of equal vectors that vary are linked and have the same neighbours: whether the best of them stays or is
    dropped, the others are dropped. So the walk takes the best of each class only.
    """
    spark = ranked.sparkSession
    classes, members = vector_classes(vectors)
    left, folder = classes, scratch(spark, "kept")
    while n := left.count():
        cut = left.agg(F.percentile_approx("lead", head / n, 10_000)).first()[0] if n > 2 * head else None
        best = left if cut is None else settle(left.filter(F.col("lead") <= cut), "best")
        edges = class_pairs(best, threshold, least).filter("lead_a <> lead_b").select(F.least("lead_a", "lead_b").alias("rank_a"), F.greatest("lead_a", "lead_b").alias("rank_b"))
        kept = settle(drop_correlated(best.withColumnRenamed("lead", "rank"), edges).withColumnRenamed("rank", "lead").select("lead", "days", "r"), "kept")
        kept.select("lead").write.mode("append").parquet(folder)
        if cut is None:
            break
        rest = left.filter(F.col("lead") > cut)
        left, head = settle(rest.join(reached(kept, rest, threshold, least), "lead", "left_anti"), "left"), 2 * head

    def varying(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            us = [v - v.mean() for v in (np.asarray(v)[~np.isnan(v)] for v in rows["r"])]
            linked = [len(u) >= least and threshold < 1 and (u @ u) / len(u) - (u.sum() / len(u))**2 > 1e-13 * (u @ u) / len(u) for u in us]
            yield pd.DataFrame({"lead": rows["lead"][np.array(linked, dtype=bool)]})

    twins = members.filter("rank <> lead")
    same = classes.join(twins.select("lead"), "lead", "left_semi").select("lead", "days", "r").mapInPandas(varying, "lead int")
    lost = members.filter("rank = lead").join(spark.read.schema("lead int").parquet(folder), "lead", "left_anti").unionByName(twins.join(same, "lead", "left_semi"))
    return ranked.join(lost.select("rank"), "rank", "left_anti").select(*ranked.columns)


def walked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks that a walk by rank drops, for edges from ``a`` to the larger ``b``: those with a smaller neighbour that it keeps."""
    order = np.lexsort((b, a))
    lost: set[int] = set()
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if x not in lost:
            lost.add(y)
    return np.array(sorted(lost), dtype=np.int64)


def drop_correlated(ranked: DataFrame, pairs: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Walk the ranking and drop every symbol that correlates with a kept better one.

    Symbols of different connected parts do not touch one another, so each part is walked in a task of its own. Of a part of
    more than ``most`` edges a round walks the best ranks, with about that many edges among them, and then drops
    what their kept symbols reach; so the rounds are counted by the edges of the largest part, not by the length of its chains.
    """
    spark = ranked.sparkSession
    edges = settle(pairs.select(F.col("rank_a").cast("long").alias("a"), F.col("rank_b").cast("long").alias("b")), "edges")
    folder, found = scratch(spark, "gone"), False
    while n := edges.count():
        if n <= most:
            now = edges.select("a", "b", F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("cut"))
        else:
            parts = edges.join(components(edges).select(F.col("node").alias("a"), F.col("root").alias("part")), "a")
            cuts = parts.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("b", most / n, 10_000).cast("long").alias("cut"))
            now = settle(parts.join(cuts.withColumn("cut", F.when(F.col("n") > most, F.col("cut"))).drop("n"), "part"), "parts")

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"rank": walked(rows["a"].to_numpy(), rows["b"].to_numpy())})

        first = now.filter("cut IS NULL OR b <= cut")
        lost = settle(first.groupBy("part").applyInPandas(walk, "rank long"), "lost")
        # a better symbol that was walked and kept drops what lies beyond the cut
        beyond = now.filter("b > cut AND a <= cut").join(lost.select(F.col("rank").alias("a")), "a", "left_anti").select(F.col("b").alias("rank"))
        gone = settle(lost.unionByName(beyond).distinct(), "gone")
        gone.write.mode("append").parquet(folder)
        found = True
        left = now.filter("a > cut").select("a", "b")
        for end in ("a", "b"):
            left = left.join(gone.select(F.col("rank").alias(end)), end, "left_anti")
        edges = settle(left.select("a", "b"), "edges")
    if not found:
        return ranked
    gone = spark.read.schema("rank long").parquet(folder)
    return ranked.join(gone.select(F.col("rank").alias("_lost")), ranked["rank"] == F.col("_lost"), "left_anti")


def survivorship(history: DataFrame, today: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """First and last sighting per symbol; unseen for ``days`` days counts as delisted."""
    h = history.select("symbol", "first_seen", "last_seen", F.col("delisted").alias("_gone"))
    j = h.join(today.select("symbol", F.lit(True).alias("_here")), "symbol", "full")
    here = F.coalesce("_here", F.lit(False))
    last = F.when(here, now).otherwise(F.col("last_seen"))
    return j.select("symbol", F.coalesce("first_seen", now).alias("first_seen"), last.alias("last_seen"),
                    F.when(here, False).otherwise(F.coalesce("_gone", F.lit(False)) | (F.datediff(now, F.col("last_seen")) >= days)).alias("delisted"))


# -- venues ---------------------------------------------------------------------------------------

def funding_spread(rates: DataFrame, min_bps: float = 5.0) -> DataFrame:
    """Widest funding gap between two venues per symbol; zero rates are no quotes."""
    g = rates.filter(F.col("rate") != 0).groupBy("symbol").agg(
        F.min(F.struct("rate", "venue")).alias("lo"), F.max(F.struct(F.col("rate"), (-F.col("venue")).alias("v"))).alias("hi"), F.count(F.lit(1)).alias("venues"))
    spread = (F.col("hi.rate") - F.col("lo.rate")) * 10000
    return g.filter((F.col("venues") >= 2) & (spread >= min_bps)).select(
        "symbol", F.col("lo.venue").alias("long_venue"), (-F.col("hi.v")).alias("short_venue"), F.col("lo.rate").alias("long_rate"),
        F.col("hi.rate").alias("short_rate"), spread.alias("spread_bps"))


def best_price(quotes: DataFrame, side: str) -> DataFrame:
    """Lowest ask to buy, highest bid to sell; the last price stands in for a missing quote."""
    buy = side.upper() == "BUY"
    px = F.when(F.col("ask" if buy else "bid") > 0, F.col("ask" if buy else "bid")).otherwise(F.col("last"))
    q = quotes.withColumn("_p", px if buy else -px)
    return q.groupBy("symbol").agg(F.min(F.struct("_p", "venue")).alias("b")).select(
        "symbol", F.col("b.venue").alias("venue"), (F.col("b._p") if buy else -F.col("b._p")).alias("price"))
