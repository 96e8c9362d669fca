"""Boosted trees of many specialists at once: histograms of gradients summed over cells of equal bins, one pass for a level of all trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import settle


@dataclass(frozen=True)
class Tree:
    """A full tree: the feature and the last bin to the left of each inner node, breadth first, and the value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Specialists:
    """Bin edges of the features, and a start value and trees for each group."""

    edges: list[np.ndarray]
    groups: list[str]
    start: np.ndarray
    trees: list[list[Tree]]
    losses: list[list[float]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin of each feature; a missing value lies in the last one."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(v), np.inf, v), side="left") for e, v in zip(self.edges, x.T)], axis=1)

    def margin(self, group: int, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start[group])
        for t in self.trees[group]:
            out += t.value[leaves(t.feature, t.cut, bins) - len(t.feature)]
        return out


def leaves(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Node that each row ends in, numbered breadth first."""
    node = np.zeros(len(bins), dtype=np.int64)
    while len(feature) and node[:1].size and node.min() < len(feature):
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return node


def gradient_sums(group: np.ndarray, node: np.ndarray, bins: np.ndarray, slope: np.ndarray, bend: np.ndarray, groups: int, nodes: int, width: int) -> np.ndarray:
    """(groups, nodes, features, bins, 2) sums of gradients and Hessians."""
    d = bins.shape[1]
    code = ((group * nodes + node)[:, None] * d + np.arange(d)[None, :]) * width + bins
    return np.stack([np.bincount(code.ravel(), np.repeat(v, d), groups * nodes * d * width) for v in (slope, bend)], axis=-1).reshape(groups, nodes, d, width, 2)


def splits(sums: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best feature and cut of every node, and the values (groups, nodes, 2) of its two sides; a node that gains nothing sends all rows left."""
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :, -1:, :]
    score = lambda s: s[..., 0]**2 / (s[..., 1] + penalty)
    gain = score(left) + score(whole - left) - score(whole)
    g, n, d, b = gain.shape
    best = gain.reshape(g, n, -1).argmax(axis=2)
    feature, cut = best // b, best % b
    cut = np.where(np.take_along_axis(gain.reshape(g, n, -1), best[:, :, None], 2)[:, :, 0] > 1e-9, cut, b - 1)
    i, j = np.indices((g, n))
    sides = np.stack([left[i, j, feature, cut], (whole - left)[i, j, feature, cut]], axis=2)
    return feature, cut, -sides[..., 0] / (sides[..., 1] + penalty)


def cells_of(slim: DataFrame, model: Specialists, features: Sequence[str], number: dict) -> DataFrame:
    """The number of the group, the bin of each feature, ``y``, ``valid`` and the summed weight of each cell; groups without a number are left out."""
    def bin_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = model.binned(b[list(features)].to_numpy(dtype=float))
            yield pd.DataFrame({"g": b["g"].map(number).fillna(-1).astype("int64"), **dict(zip(features, bins.T)), "y": b["y"], "valid": b["valid"], "w": b["w"]})

    schema = "g long, " + "".join(f"{f} long, " for f in features) + "y double, valid boolean, w double"
    return slim.mapInPandas(bin_rows, schema).filter("g >= 0").groupBy("g", *features, "y", "valid").agg(F.sum("w").alias("w"))


def fit_specialists(rows: DataFrame, features: Sequence[str], label: str, weight: str, group: str, valid: str, trees: int = 40, depth: int = 3, bins: int = 32,
                    rate: float = 0.3, penalty: float = 1.0, patience: int = 5) -> Specialists:
    """A boosted classifier for each value of ``group`` (few), fitted on the rows that are not ``valid``.

    Trees see bins only, so rows of the same group, bins, label and side are one cell that holds the sum of their weights. A pass
    over the cells serves one level of the next tree of all groups: each task sums its gradient histograms, the driver picks
    splits. Log losses of the valid cells come with the first level; a group whose loss has not fallen for ``patience`` trees
    stops, and keeps the trees up to its least loss.
    """
    x = [f"x{i}" for i in range(len(features))]
    slim = settle(rows.select(F.col(group).alias("g"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, x)], F.col(label).cast("double").alias("y"),
                              F.col(weight).cast("double").alias("w"), F.col(valid).alias("valid")).filter("g IS NOT NULL AND y IS NOT NULL"), "specialist-rows")
    marks = [i / bins for i in range(1, bins)]
    cuts = slim.filter("NOT valid").agg(*[F.percentile_approx(n, marks, 10_000).alias(n) for n in x]).first()
    edges = [np.unique(np.array(cuts[n] or [], dtype=float)) for n in x]
    totals = {r["g"]: (r["p"], r["n"]) for r in slim.filter("NOT valid").groupBy("g").agg(F.sum(F.col("y") * F.col("w")).alias("p"), F.sum((1 - F.col("y")) * F.col("w")).alias("n")).collect()}
    groups = sorted(totals)
    number = {g: i for i, g in enumerate(groups)}
    start = np.array([np.log((totals[g][0] + 1) / (totals[g][1] + 1)) for g in groups])
    model = Specialists(edges, groups, start, [[] for _ in groups], [[] for _ in groups])
    stopped = [False] * len(groups)
    cells = settle(cells_of(slim, model, x, number), "specialist-cells")

    def passed(feature: np.ndarray, cut: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        size = len(groups) * 2**level * len(x) * bins * 2

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(size + 2 * len(groups))
            for b in batches:
                g, at, y, w, held = b["g"].to_numpy(), b[x].to_numpy(), b["y"].to_numpy(), b["w"].to_numpy(), b["valid"].to_numpy(dtype=bool)
                for k in range(len(groups)):
                    own = g == k
                    if stopped[k] or not own.any():
                        continue
                    p = 1 / (1 + np.exp(-model.margin(k, at[own])))
                    fit, yk, wk = ~held[own], y[own], w[own]
                    loss = -wk * np.log(np.clip(np.where(yk > 0, p, 1 - p), 1e-15, 1))
                    out[size + 2 * k] += loss[~fit].sum()
                    out[size + 2 * k + 1] += wk[~fit].sum()
                    node = leaves(feature[k], cut[k], at[own][fit]) - (2**level - 1)
                    out[:size] += gradient_sums(np.full(int(fit.sum()), k), node, at[own][fit], (wk * (p - yk))[fit], (wk * p * (1 - p))[fit], len(groups), 2**level, bins).ravel()
            full = np.flatnonzero(out)
            yield pd.DataFrame({"i": full, "v": out[full]})

        out = np.zeros(size + 2 * len(groups))
        for r in cells.mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # groups * nodes * features * bins rows
            out[r["i"]] = r["v"]
        return out[:size].reshape(len(groups), 2**level, len(x), bins, 2), out[size:].reshape(-1, 2)

    for _ in range(trees + 1):
        feature, cut = (np.zeros((len(groups), 0), dtype=np.int64) for _ in range(2))
        for level in range(depth):
            found, held = passed(feature, cut, level)
            if level == 0:
                for k in range(len(groups)):
                    if not stopped[k]:
                        model.losses[k].append(float(held[k, 0] / held[k, 1]) if held[k, 1] else 0.0)
                        stopped[k] = len(model.losses[k]) - 1 - int(np.argmin(model.losses[k])) >= patience or len(model.trees[k]) == trees
                if all(stopped):
                    break
            f, c, sides = splits(found, penalty)
            feature, cut = np.append(feature, f, axis=1), np.append(cut, c, axis=1)
        if all(stopped):
            break
        for k in range(len(groups)):
            if not stopped[k]:
                model.trees[k].append(Tree(feature[k], cut[k], rate * sides[k].reshape(-1)))
    for k, own in enumerate(model.losses):
        del model.trees[k][int(np.argmin(own)):]
    return model


def scored_by_specialists(rows: DataFrame, model: Specialists, features: Sequence[str], group: str) -> DataFrame:
    """``rows`` with ``prob``, null where the group has no model."""
    number = {g: i for i, g in enumerate(model.groups)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = b[group].map(number).fillna(-1).to_numpy(dtype=np.int64)
            cells, out = model.binned(b[list(features)].to_numpy(dtype=float)), np.full(len(b), np.nan)
            for k in np.unique(g[g >= 0]):
                out[g == k] = 1 / (1 + np.exp(-model.margin(int(k), cells[g == k])))
            yield b.assign(prob=out)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + ["prob double"])
    return rows.mapInPandas(score, schema).withColumn("prob", F.when(~F.isnan("prob"), F.col("prob")))
