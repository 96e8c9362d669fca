"""Walk-forward logistic filters of many targets: one pass over the rows serves a Newton step of all folds and targets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from barloom.session import settle

# Inverse penalty, fewest rows a model is fitted on, and the AUC below which a filter adds little.
C, LEAST_ROWS, LOW_AUC = 0.5, 50, 0.55


def sound(features: Sequence[str]) -> Column:
    """All features are there and finite."""
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf"))
    return out


def before_fold(values: np.ndarray) -> np.ndarray:
    """Sums over the folds before each one; the first row is what comes before fold 0."""
    return np.cumsum(values, axis=0)[:-1]


def newton_sums(z: np.ndarray, y: np.ndarray, n: np.ndarray, coef: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(targets, d + d * d) gradients and Hessians of all targets over the columns of ``z`` (d x rows), which count ``n`` times; three products for all targets."""
    i, j = np.triu_indices(len(z))
    out = np.zeros((len(y), len(z) + len(i)))
    wide = max(1, 2**17 // len(i))
    for at in range(0, z.shape[1], wide):
        own = slice(at, at + wide)
        x, hit = z[:, own], y[:, own]
        p = 1 / (1 + np.exp(-np.clip(coef @ x, -500, 500)))
        w = np.where(hit > 0, weights[:, 1:], weights[:, :1]) * n[own]
        out[:, :len(z)] += (w * (p - hit)) @ x.T
        out[:, len(z):] += (w * p * (1 - p)) @ (x[i] * x[j]).T
    bend = np.zeros((len(y), len(z), len(z)))
    bend[:, i, j] = bend[:, j, i] = out[:, len(z):]
    return np.concatenate([out[:, :len(z)], bend.reshape(len(y), -1)], axis=1)


def fit_filters(rows: DataFrame, features: Sequence[str], targets: Sequence[str], folds: int, c: float = C, least: int = LEAST_ROWS, rounds: int = 30) -> dict:
    """Models of every fold and target on the sound rows before the fold: ``coef`` (folds x targets x features + 1, intercept last) of scaled features, ``mean``, ``scale``, ``usable``.

    L2-penalised with balanced classes. ``rows`` carry ``fold`` (null or below 0 before the first one). Means and class
    counts are prefix sums over folds of one aggregate. Equal rows of a fold are one row with their number. A Newton step is one pass
    in which every task sums gradients and Hessians of all models over its rows; the driver solves systems of the size of the features.
    """
    d, s = len(features), len(targets)
    xs, ys = [f"x{i}" for i in range(d)], [f"y{i}" for i in range(s)]
    slim = rows.filter(sound(features)).select(F.greatest(F.coalesce("fold", F.lit(-1)), F.lit(-1)).cast("int").alias("fold"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)],
                                               *[F.col(t).cast("double").alias(y) for t, y in zip(targets, ys)]).filter(F.col("fold") < folds - 1)
    equal, times = slim.groupBy("fold", *xs, *ys).agg(F.count("*").cast("double").alias("n")), F.col("n")
    # small on disk but read in every round, so it is dealt to all cores
    good = settle(equal.repartition(rows.sparkSession.sparkContext.defaultParallelism, *xs), "filter-rows")
    agg = good.groupBy("fold").agg(F.sum(times).alias("n"), *[F.sum(times * F.col(x)).alias(f"s_{x}") for x in xs], *[F.sum(times * F.col(x) ** 2).alias(f"q_{x}") for x in xs], *[F.sum(times * F.col(y)).alias(f"p_{y}") for y in ys])
    table = np.zeros((folds + 1, 1 + 2 * d + s))
    for r in agg.collect():  # one row a fold
        table[r["fold"] + 1] = [r["n"], *[r[f"s_{x}"] for x in xs], *[r[f"q_{x}"] for x in xs], *[r[f"p_{y}"] for y in ys]]
    total = before_fold(table)
    n = total[:, :1]
    mean = total[:, 1:d + 1] / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(total[:, d + 1:2 * d + 1] / np.maximum(n, 1) - mean**2, 0))
    scale = np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1), spread, 1.0)
    ones = total[:, 2 * d + 1:]
    usable = (ones > 0) & (ones < n) & (n >= least)
    weights = np.stack([n / (2 * np.maximum(n - ones, 1)), n / (2 * np.maximum(ones, 1))], axis=-1)
    coef = np.zeros((folds, s, d + 1))
    size = (d + 1) * (d + 2)

    def step_of(now: np.ndarray):
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((folds, s, size))
            for b in batches:
                order = np.argsort(b["fold"].to_numpy(), kind="stable")
                fold, n_of, x, y = (np.stack([b[c].to_numpy()[order] for c in names]) for names in (["fold"], ["n"], xs, ys))
                for k in range(folds):
                    past = int(np.searchsorted(fold[0], k))
                    if past and usable[k].any():
                        z = np.append((x[:, :past] - mean[k][:, None]) / scale[k][:, None], np.ones((1, past)), axis=0)
                        out[k] += newton_sums(z, y[:, :past], n_of[0, :past], now[k], weights[k])
            k, t, i = np.indices(out.shape)
            yield pd.DataFrame({"k": k.ravel(), "t": t.ravel(), "i": i.ravel(), "v": out.ravel()})
        return sums

    penalty = np.diag([1.0] * d + [0.0])
    for _ in range(rounds):
        got = np.zeros((folds, s, size))
        for r in good.mapInPandas(step_of(coef.copy()), "k int, t int, i int, v double").groupBy("k", "t", "i").agg(F.sum("v").alias("v")).collect():  # folds * targets * size rows
            got[r["k"], r["t"], r["i"]] = r["v"]
        move = np.zeros_like(coef)
        for k, t in np.argwhere(usable):
            gradient = c * got[k, t, :d + 1] + penalty @ coef[k, t]
            move[k, t] = np.linalg.solve(c * got[k, t, d + 1:].reshape(d + 1, d + 1) + penalty + 1e-12 * np.eye(d + 1), gradient)
        # far from the optimum a full step may overshoot
        coef -= move * np.minimum(1, 5 / np.maximum(np.abs(move).max(axis=2, keepdims=True), 1e-300))
        if np.abs(move).max(initial=0) < 1e-9:
            break
    return {"coef": coef, "mean": mean, "scale": scale, "usable": usable}


def scored_by_filters(rows: DataFrame, model: dict, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """``rows`` of each fold with ``proba``: an array with the chance of each target, null where the fold or target has no model or a feature is missing."""
    slope = model["coef"][:, :, :-1] / model["scale"][:, None, :]
    start = model["coef"][:, :, -1] - (slope * model["mean"][:, None, :]).sum(axis=2)
    usable = model["usable"]
    used, kept = [f"_x{i}" for i in range(len(features))], rows.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy(zero_copy_only=False).astype(int)
            x = [b.column(u).to_numpy(zero_copy_only=False) for u in used]
            known = np.isfinite(x).all(axis=0)
            line = start[fold]
            for i, v in enumerate(x):
                line += np.where(known, v, 0.0)[:, None] * slope[fold, :, i]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-line))
            missing = ~(known[:, None] & usable[fold])
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(targets))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.ListArray.from_arrays(ends, pa.array(p.ravel(), mask=missing.ravel()))], [*kept, "proba"])

    slim = rows.filter(F.col("fold") >= 0).select("*", *[F.col(f).cast("double").alias(u) for f, u in zip(features, used)])
    return slim.mapInArrow(score, StructType([*rows.schema.fields, StructField("proba", ArrayType(DoubleType()))]))


def filter_quality(scored: DataFrame, targets: Sequence[str]) -> DataFrame:
    """target, fold, rows, positives, auc and ``weak`` (mean AUC of the target's folds below LOW_AUC); scores are ranked in ten-thousandths.

    Without both classes the AUC is null and does not count.
    """
    long = scored.select("fold", F.posexplode(F.arrays_zip("proba", F.array(*[F.col(t).cast("int").alias(t) for t in targets]).alias("y"))).alias("t", "z"))
    by = long.filter("z.proba IS NOT NULL").groupBy("t", "fold", F.round("z.proba", 4).alias("p")).agg(F.sum(F.col("z.y")).alias("pos"), F.sum(1 - F.col("z.y")).alias("neg"))
    # at most ten thousand scores of a target and fold
    g = by.groupBy("t", "fold").agg(F.sum("pos").alias("positives"), F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sort_array(F.collect_list(F.struct("p", "pos", "neg"))).alias("s"))
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("wins"))
    walked = F.aggregate("s", start, lambda a, x: F.struct((a["below"] + x["neg"]).alias("below"), (a["wins"] + x["pos"] * (a["below"] + x["neg"] / 2.0)).alias("wins")))
    names = F.array(*[F.lit(t) for t in targets])
    auc = F.try_divide(walked["wins"], (F.col("positives") * (F.col("rows") - F.col("positives"))).cast("double"))
    one = g.select(F.element_at(names, F.col("t") + 1).alias("target"), "fold", "rows", "positives", auc.alias("auc"))
    mean = one.groupBy("target").agg((F.avg("auc") < LOW_AUC).alias("weak"))
    return one.join(mean, "target")
