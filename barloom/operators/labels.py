"""Labels over the forward price path of sparse events.

Events are joined to the bars after them through a block key, so the join stays an equi
join whose work spreads over a long series; each path holds at most ``horizon`` bars.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample weights of hit targets and stops.
TARGET_WEIGHT = 1.0
STOP_WEIGHT = 1.5


def forward_bars(events: DataFrame, bars: DataFrame, horizon: int, cols: Sequence[str],
                 first: int = 1, at: str = "bar_idx", on: str = "symbol") -> DataFrame:
    """Event rows times the bars ``first`` .. ``horizon`` after them, with ``off`` = bars since the event.

    Block length equals the horizon, so an event meets two blocks at most.
    """
    blocks = F.sequence(F.floor((F.col(at) + first) / horizon), F.floor((F.col(at) + horizon) / horizon))
    left = events.withColumn("_blk", F.explode(blocks))
    right = bars.select(F.col(on), F.floor(F.col("bar_idx") / horizon).alias("_blk"),
                        F.col("bar_idx").alias("_j"), *[F.col(c).alias(f"f_{c}") for c in cols])
    return (
        left.join(right, [on, "_blk"])
        .withColumn("off", F.col("_j") - F.col(at))
        .filter((F.col("off") >= first) & (F.col("off") <= horizon))
        .drop("_blk", "_j")
    )


def path_arrays(events: DataFrame, bars: DataFrame, horizon: int, cols: Sequence[str],
                keys: Sequence[str], first: int = 1) -> DataFrame:
    """One row per event with its forward path as an array of structs in bar order (at most ``horizon``)."""
    rest = [c for c in events.columns if c not in keys]
    return (
        forward_bars(events, bars, horizon, cols, first)
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in rest],
             F.array_sort(F.collect_list(F.struct("off", *[f"f_{c}" for c in cols]))).alias("path"))
    )


#: Bars of a chunk in a sweep, and numbers of the paths that a task holds at once.
SWEEP_BARS, SWEEP_CELLS = 2048, 4_000_000


def sweep(events: DataFrame, bars: DataFrame, horizon: int, cols: Sequence[str], walk: Callable[[pd.DataFrame, dict[str, np.ndarray]], pd.DataFrame], schema: str,
          first: int = 1, chunk: int = SWEEP_BARS) -> DataFrame:
    """``walk(events, paths)`` over all events (symbol, bar_idx, ...) of a chunk of a series, with a matrix (events x bars ``first`` .. ``horizon``) of each column.

    Bars move once for their own chunk, and once more for an earlier chunk if events there reach them; events move once. Paths are cut
    from the chunk's arrays inside the task, a bounded number at a time, NaN beyond the end of the series.
    """
    chunk = max(chunk, 1)
    ev = events.withColumn("_blk", F.floor(F.col("bar_idx") / chunk))
    reach = F.sequence(F.floor((F.col("bar_idx") - horizon) / chunk), F.floor((F.col("bar_idx") - first) / chunk))
    wanted = ev.select("symbol", "_blk").distinct()
    halo = bars.select("symbol", "bar_idx", *[F.col(c).cast("double").alias(f"_{c}") for c in cols]).withColumn("_blk", F.explode(reach)).join(wanted, ["symbol", "_blk"], "left_semi")
    most = max(1, SWEEP_CELLS // ((horizon - first + 1) * len(cols)))
    steps = np.arange(first, horizon + 1)

    def run(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("bar_idx")
        at = near["bar_idx"].to_numpy()
        values = {c: np.append(near[f"_{c}"].to_numpy(), np.nan) for c in cols}
        mine = mine.sort_values("bar_idx", kind="stable").drop(columns="_blk")
        out = []
        for lo in range(0, len(mine), most):
            some = mine.iloc[lo:lo + most]
            want = some["bar_idx"].to_numpy()[:, None] + steps[None, :]
            place = np.searchsorted(at, want)
            place = np.where((place < len(at)) & (np.append(at, -1)[place] == want), place, len(at))
            # events without a bar ahead have no path
            some, place = some[(place < len(at)).any(axis=1)], place[(place < len(at)).any(axis=1)]
            if len(some):
                out.append(walk(some, {c: v[place] for c, v in values.items()}))
        return pd.concat(out) if out else pd.DataFrame({c.strip().split(" ")[0]: [] for c in schema.split(",")})

    return ev.groupBy("symbol", "_blk").cogroup(halo.groupBy("symbol", "_blk")).applyInPandas(run, schema)


def barrier_label(events: DataFrame, bars: DataFrame, tp_atr: float, sl_atr: float, max_bars: int,
                  keys: Sequence[str] = ("symbol", "bar_idx", "direction")) -> DataFrame:
    """First of target and stop to be touched within ``max_bars``.

    Events carry close, atr and direction (1 or -1). Label 1 means the price went up, 0 down.
    A bar that touches both sides counts by its close. Events without a touch, without the
    full horizon ahead or without a positive ATR and price are dropped.
    """
    up = F.col("direction") == 1
    sign = F.when(up, 1.0).otherwise(-1.0)
    target = F.col("close") + sign * F.col("atr") * tp_atr
    stop = F.col("close") - sign * F.col("atr") * sl_atr
    tp = F.when(up, F.col("f_high") >= target).otherwise(F.col("f_low") <= target)
    sl = F.when(up, F.col("f_low") <= stop).otherwise(F.col("f_high") >= stop)
    good_close = (F.col("f_close") - F.col("close")) * sign >= 0
    won = F.when(tp & sl, good_close).otherwise(tp)
    rest = [c for c in events.columns if c not in keys]
    touched = (
        forward_bars(events.filter((F.col("atr") > 0) & (F.col("close") > 0)), bars, max_bars, ["high", "low", "close"])
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in rest],
             F.count(F.lit(1)).alias("_n"),
             F.min(F.when(tp | sl, F.struct("off", won.alias("won")))).alias("_hit"))
        .filter((F.col("_n") == max_bars) & F.col("_hit").isNotNull())
    )
    return touched.select(
        *keys, *rest,
        (F.col("_hit.won") == up).cast("int").alias("label"),
        F.when(F.col("_hit.won"), TARGET_WEIGHT).otherwise(STOP_WEIGHT).alias("weight"),
        F.col("_hit.off").alias("bars_to_hit"),
    )


def directional_exit(events: DataFrame, bars: DataFrame, tp_atr: float, sl_atr: float, max_bars: int,
                     keys: Sequence[str] = ("symbol", "bar_idx", "direction"),
                     penetration: float | None = None, slip_cap: float = 0.25) -> DataFrame:
    """TP / SL / TIMEOUT with the stop looked at first; a time-out exits at the last close.

    With ``penetration`` the stop is a market order: it fills at the open when the bar opens
    beyond it, else a share of the penetration below it, at most ``slip_cap`` ATR.
    """
    up = F.col("direction") == 1
    sign = F.when(up, 1.0).otherwise(-1.0)
    target = F.col("close") + sign * F.col("atr") * tp_atr
    stop = F.col("close") - sign * F.col("atr") * sl_atr
    sl = F.when(up, F.col("f_low") <= stop).otherwise(F.col("f_high") >= stop)
    tp = F.when(up, F.col("f_high") >= target).otherwise(F.col("f_low") <= target)
    if penetration is None:
        fill = stop
    else:
        beyond = F.when(up, F.col("f_open") <= stop).otherwise(F.col("f_open") >= stop)
        depth = F.when(up, stop - F.col("f_low")).otherwise(F.col("f_high") - stop)
        fill = F.when(beyond, F.col("f_open")).otherwise(
            stop - sign * F.least(depth * penetration, F.col("atr") * slip_cap))
    rest = [c for c in events.columns if c not in keys]
    hit = F.struct("off", F.when(sl, "SL").otherwise("TP").alias("label"), F.when(sl, fill).otherwise(target).alias("px"))
    end = F.struct("off", F.lit("TIMEOUT").alias("label"), F.col("f_close").alias("px"))
    out = (
        forward_bars(events.filter(F.col("atr") > 0), bars, max_bars, ["open", "high", "low", "close"])
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in rest],
             F.coalesce(F.min(F.when(sl | tp, hit)), F.max(end)).alias("_x"))
    )
    stop_px = F.col("close") - sign * F.col("atr") * sl_atr
    slip = F.when(F.col("_x.label") == "SL",
                  F.greatest(F.lit(0.0), sign * (stop_px - F.col("_x.px")) / F.col("atr"))).otherwise(0.0)
    return out.select(*keys, *rest, F.col("_x.label").alias("outcome"),
                      (sign * (F.col("_x.px") - F.col("close")) / F.col("atr")).alias("realized_atr"),
                      (F.col("bar_idx") + F.col("_x.off")).alias("exit_bar"), F.col("_x.px").alias("exit_price"),
                      slip.alias("stop_slip_atr"))


def drop_touch(events: DataFrame, bars: DataFrame, target_atr: float = 1.0, max_bars: int = 12,
               keys: Sequence[str] = ("symbol", "bar_idx")) -> DataFrame:
    """Does the low fall by ``target_atr`` ATR within ``max_bars``, and after how many bars."""
    hit = F.col("f_low") <= F.col("close") - target_atr * F.col("atr")
    rest = [c for c in events.columns if c not in keys]
    touched = (forward_bars(events, bars, max_bars, ["low"]).groupBy(*keys)
               .agg(*[F.first(c).alias(c) for c in rest], F.min(F.when(hit & (F.col("atr") > 0), F.col("off"))).alias("delay_bars")))
    return touched.withColumn("success", F.col("delay_bars").isNotNull())


def tier_label(preds: DataFrame, bars: DataFrame, horizon: int, ratios: dict[str, float], weights: dict[str, float],
               keys: Sequence[str] = ("symbol", "bar_idx"), max_magnitude: float = 10.0) -> DataFrame:
    """Three target tiers and a stop, decided once the whole monitoring window has passed.

    Distances are ``magnitude`` percent times the tier's ratio. Within a window the order of
    the first touches decides; a stop at the same bar as a target counts first. Beyond the
    third target the weight grows with the run, to 20 at most.
    """
    up = F.col("direction") == 1
    sign = F.when(up, 1.0).otherwise(-1.0)
    base = F.least(F.col("magnitude"), F.lit(max_magnitude)) / 100.0

    def level(name: str) -> Column:
        way = -1.0 if name == "sl" else 1.0
        return F.col("close") * (1 + sign * base * (way * ratios[name]))

    def touch(name: str) -> Column:
        favour = F.when(up, F.col("f_high") >= level(name)).otherwise(F.col("f_low") <= level(name))
        against = F.when(up, F.col("f_low") <= level(name)).otherwise(F.col("f_high") >= level(name))
        return F.min(F.when(against if name == "sl" else favour, F.col("off")))

    rest = [c for c in preds.columns if c not in keys]
    reach = F.when(up, F.col("f_high")).otherwise(-F.col("f_low"))
    paths = forward_bars(preds, bars, horizon, ["high", "low"])
    hits = paths.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest], *[touch(n).alias(f"_{n}") for n in ("tp1", "tp2", "tp3", "sl")],
        F.array_sort(F.collect_list(F.struct("off", reach.alias("r")))).alias("_reach"))
    # the favourable run counts up to and including the stop bar's predecessor
    before_stop = F.filter("_reach", lambda x: F.col("_sl").isNull() | (x["off"] <= F.col("_sl")))
    best = F.greatest(F.array_max(F.transform(before_stop, lambda x: x["r"])), sign * F.col("close")) * sign
    none = F.lit(1 << 30)
    t1, t2, t3, ts = (F.coalesce(F.col(c), none) for c in ("_tp1", "_tp2", "_tp3", "_sl"))
    beyond = (best - F.col("close")) / (level("tp3") - F.col("close"))
    tier = (F.when((ts < none) & (ts <= F.least(t1, t2, t3)), "SL")
            .when((ts < none) & (t1 < ts), "TP1").when((t3 < none) & (t3 < ts), "TP3")
            .when((t2 < none) & (t2 < ts), "TP2").when((t1 < none) & (t1 < ts), "TP1").otherwise("NONE"))
    weight = (F.when(F.col("tier") == "SL", weights["sl"]).when(F.col("tier") == "TP1", weights["tp1"])
              .when(F.col("tier") == "TP2", weights["tp2"])
              .when(F.col("tier") == "TP3", F.least(F.lit(20.0), weights["tp3"] * F.greatest(F.lit(1.0), beyond)))
              .otherwise(0.0))
    return (hits.withColumn("tier", tier).withColumn("weight", weight)
            .withColumn("outcome", F.when(F.col("tier") == "SL", "wrong").when(F.col("tier") == "NONE", "neutral").otherwise("correct"))
            .select(*keys, *rest, "tier", "weight", "outcome"))


# -- folds over one event's path --------------------------------------------------------------

def fold_path(path: Column | str, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """Fold an array of bar structs with a struct state; stops changing once ``done`` is set."""
    init = F.struct(*[v.alias(k) for k, v in start.items()])

    def merge(state: Column, bar: Column) -> Column:
        nxt = step(state, bar)
        return F.when(state["done"], state).otherwise(
            F.struct(*[nxt.get(k, state[k]).cast(_type(v)).alias(k) for k, v in start.items()]))

    return F.aggregate(path, init, merge)


def _type(c: Column) -> str:
    text = str(c)
    for kind in ("boolean", "double", "int", "string"):
        if f"AS {kind.upper()}" in text:
            return kind
    raise ValueError(f"state fields must be typed by cast: {text}")


def staged_exit(path: Column | str, entry: Column, atr: Column, bank_atr: Column, sl_atr: Column,
                bank_fraction: float, trail_atr: float, max_pre: int, max_post: int) -> Column:
    """Stop, bank a fraction at a first target, trail the rest; struct(label, realized, off, banked).

    ``path`` holds at most ``max_post`` bars with f_high, f_low, f_close and off.
    """
    bank, stop = entry + bank_atr * atr, entry - sl_atr * atr
    gain = bank_atr * bank_fraction

    def dbl(c) -> Column:
        return (F.lit(c) if not isinstance(c, Column) else c).cast("double")

    start = {"done": F.lit(False).cast("boolean"), "banked": F.lit(False).cast("boolean"),
             "peak": dbl(entry), "rstop": dbl(entry), "realized": dbl(0.0), "off": F.lit(0).cast("int"),
             "label": F.lit("OPEN").cast("string"), "last": dbl(entry)}

    def step(s: Column, b: Column) -> dict[str, Column]:
        late = b["off"] >= max_post
        peak = F.greatest(s["peak"], b["f_high"])
        rstop = F.greatest(s["rstop"], peak - trail_atr * atr)
        runner = gain + (1.0 - bank_fraction) * (b["f_close"] - entry) / atr
        stopped = ~s["banked"] & (b["f_low"] <= stop)
        banks = ~s["banked"] & ~stopped & (b["f_high"] >= bank)
        idle = ~s["banked"] & ~stopped & ~banks & (b["off"] >= max_pre)
        trailed = s["banked"] & (b["f_low"] <= rstop)
        expired = (s["banked"] | banks) & ~trailed & late
        return {
            "done": stopped | idle | trailed | expired,
            "banked": s["banked"] | banks,
            "peak": F.when(s["banked"], peak).when(banks, F.greatest(bank, b["f_high"])).otherwise(s["peak"]),
            "rstop": F.when(s["banked"], rstop).otherwise(s["rstop"]),
            "realized": F.when(stopped, -sl_atr).when(idle, (b["f_close"] - entry) / atr)
                         .when(trailed, gain + (1.0 - bank_fraction) * (rstop - entry) / atr)
                         .otherwise(runner),
            "off": b["off"],
            "label": F.when(stopped, "SL").when(idle, "TIMEOUT").when(trailed | expired, "TP").otherwise("OPEN"),
            "last": b["f_close"],
        }

    s = fold_path(path, start, step)
    return F.transform(F.array(s), lambda x: F.struct(
        F.when(x["label"] != "OPEN", x["label"]).when(x["banked"], "TP").otherwise("TIMEOUT").alias("label"),
        F.when(x["label"] != "OPEN", x["realized"]).when(x["banked"], gain + (1.0 - bank_fraction) * (x["last"] - entry) / atr)
         .otherwise((x["last"] - entry) / atr).alias("realized"),
        x["off"].alias("off"), x["banked"].alias("banked")))[0]
