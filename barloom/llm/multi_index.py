"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the (unit) vectors are quantised separately, so ``K`` centroids a half give
``K * K`` cells. A query walks the pairs of centroids by their summed distance with a heap, until the
cells it has opened hold a share of all entries; the opened entries are reranked by the exact
cosine. The share is calibrated: it is the one at which ``recall`` of the true neighbours of
sample queries are in opened cells. The index is fitted on a bounded sample and holds every vector.

Equal vectors are one entry with its smallest ids: as ties go to the smaller id, the others can
never be among the nearest of any query, so a vector that a third of the rows share is no hot spot. Cosines
that agree to twelve decimals are ties, since the scale of a vector alone moves the digits after these.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.samples import smallest
from barloom.session import settle

#: Bounds of the fit: vectors, queries for the calibration, vectors of the sample for each centroid of a half, and the recall aimed at.
FIT_ROWS, FIT_QUERIES, FIT_EACH, RECALL = 20_000, 200, 40, 0.97
#: Entries and queries that meet in one task, queries multiplied at once, entries opened at least.
CHUNK, ASKED, SLAB, LEAST_OPEN = 4000, 4000, 512, 1000
#: Decimals that decide between cosines, and how far a matrix product may be from the cosine.
DECIMALS, NEARLY = 12, 1e-9


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of each half, entries of each cell, and the number of entries a query opens."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    share: float

    def open_cells(self, unit: np.ndarray) -> list[tuple[int, int]]:
        half = self.first.shape[1]
        return walk(distances(unit[None, :half], self.first)[0], distances(unit[None, half:], self.second)[0], self.counts,
                    max(LEAST_OPEN, self.share * self.counts.sum()))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.square(x).sum(axis=1)[:, None] - 2 * x @ c.T + np.square(c).sum(axis=1)[None, :]


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of non-empty cells by ``one[i] + two[j]``, until they hold ``enough`` entries."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, pushed, cells, held = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            held += n
            cells.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (one[a[x]] + two[b[y]], x, y))
    return cells


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the (hash-ordered) sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        for i in range(k):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return c


def needed_share(units: np.ndarray, first: np.ndarray, second: np.ndarray, near: int, recall: float) -> float:
    """Share of the entries a query must open so that ``recall`` of the true nearest are among them."""
    half, picked = first.shape[1], units[:FIT_QUERIES]
    like = picked @ units.T
    like[np.arange(len(picked)), np.arange(len(picked))] = -np.inf
    top = np.argsort(-like, axis=1, kind="stable")[:, :near]
    cell = distances(units[:, :half], first).argmin(axis=1) * len(second) + distances(units[:, half:], second).argmin(axis=1)
    counts = np.bincount(cell, minlength=len(first) * len(second))
    if len(units) <= near:
        return 1.0
    one, two = distances(picked[:, :half], first), distances(picked[:, half:], second)
    held = []
    for x, y, own in zip(one, two, top):
        order = np.argsort((x[:, None] + y[None, :]).ravel(), kind="stable")
        until = np.empty(len(order))
        until[order] = np.cumsum(counts[order]) / len(units)
        held.append(until[cell[own]])
    return float(np.quantile(np.array(held), recall))


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def stacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    for row, x in zip(out, column):
        x = x.values.to_numpy(zero_copy_only=False)
        row[:len(x)] = x
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def fitted(entries: DataFrame, width: int, near: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids of both halves and the share to open, from at most FIT_ROWS entries with the smallest hashes."""
    total = entries.count()
    sample = smallest(entries.select("key", "vector"), F.col("key"), FIT_ROWS, total).select("vector").toArrow()
    units = unit(stacked(sample["vector"], width))
    half = max(1, width // 2)
    k = int(min(max(4, min((total / 200) ** 0.5, FIT_ROWS / FIT_EACH)), len(units)))
    first, second = centroids(units[:, :half], k), centroids(units[:, half:], k)
    return first, second, needed_share(units, first, second, near, RECALL)


def assigned(entries: DataFrame, first: np.ndarray, second: np.ndarray, width: int) -> DataFrame:
    half = first.shape[1]

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(stacked(b.column(2), width))
                found = [pa.array(distances(x, c).argmin(axis=1), pa.int32()) for x, c in ((u[:, :half], first), (u[:, half:], second))]
                yield pa.RecordBatch.from_arrays([*b.columns, *found], names=["key", "ids", "vector", "one", "two"])

    return entries.select("key", "ids", "vector").mapInArrow(cells, "key string, ids array<long>, vector array<double>, one int, two int")


def visits(queries: DataFrame, index: MultiIndex, width: int, chunks: list[int]) -> DataFrame:
    """(one, chunk, key, vector, twos): for each first-half centroid that a query opens, the second-half ones, once for each chunk of its entries."""

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, vector, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unit(stacked(b.column(1), width)) if b.num_rows else []):
                by: dict[int, list[int]] = {}
                for i, j in index.open_cells(u):
                    by.setdefault(i, []).append(j)
                rows += [(i, c, key, vector, twos) for i, twos in by.items() for c in range(chunks[i])]
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["one", "chunk", "key", "vector", "twos"])

    return queries.select("key", "vector").mapInArrow(opened, "one int, chunk int, key string, vector array<double>, twos array<int>")


def nearest(vectors: DataFrame, is_query: Column, near: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine in double precision) of the ``near`` nearest found.

    Candidates are all rows but the query's own id; ties (cosines equal to DECIMALS decimals) go to the smaller id; fewer
    candidates than ``near`` are all returned. Rows with a null id, or with a vector that is null, empty, zero, or holds null
    or non-finite components, take no part. Vectors of different lengths are filled up
    with zeros. An id that occurs more than once with one vector counts once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("key", F.md5(F.concat_ws(",", F.col("vector").cast("array<string>"))))
    few = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    # the filter on the rank is applied before the shuffle too, so no task gets all ids of one vector
    entries = rows.withColumn("n", few).filter(F.col("n") <= near + 1).groupBy("key").agg(
        F.sort_array(F.collect_set("id")).alias("ids"), F.first("vector").alias("vector"))
    entries = settle(entries, "entries")
    width = entries.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first, second, share = fitted(entries, width, near)
    cells = settle(assigned(entries, first, second, width), "cells")
    counts = np.zeros((len(first), len(second)), dtype=np.int64)
    for r in cells.groupBy("one", "two").count().collect():  # at most (FIT_ROWS / FIT_EACH) ** 2 rows
        counts[r["one"], r["two"]] = r["count"]
    chunks = [max(1, -(-int(n) // CHUNK)) for n in counts.sum(axis=1)]
    table = F.array(*[F.lit(c) for c in chunks])
    parts = cells.withColumn("chunk", F.expr("pmod(xxhash64(key), 2147483647)") % F.element_at(table, F.col("one") + 1)).select(
        "one", F.col("chunk").cast("int").alias("chunk"), "two", "ids", "vector")
    asked = settle(rows.filter("asks").select("key", "vector").groupBy("key").agg(F.first("vector").alias("vector")), "asked")
    shares = max(1, -(-asked.count() // ASKED))
    share_of = F.expr(f"pmod(xxhash64(key, 1), {shares})").cast("int")
    visit = visits(asked, MultiIndex(first, second, counts, share), width, chunks).withColumn("asks", share_of)
    parts = parts.withColumn("asks", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    keep = near + 1

    def rerank(mine: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [], "id": [], "score": []}
        if len(mine) and len(asks):
            two = mine["two"].to_numpy()
            base = unit(stacked(pa.array(mine["vector"]), width))
            places = {int(j): np.flatnonzero(two == j) for j in np.unique(two)}
            for lo in range(0, len(asks), SLAB):
                slab = asks.iloc[lo:lo + SLAB]
                q = unit(stacked(pa.array(slab["vector"]), width))
                like = np.full((len(slab), len(mine)), -np.inf)
                opens = np.zeros((len(slab), max(places) + 1), dtype=bool)
                for n, twos in enumerate(slab["twos"]):
                    opens[n, [t for t in twos if t in places]] = True
                for j, at in places.items():
                    who = np.flatnonzero(opens[:, j])
                    if len(who):
                        like[np.ix_(who, at)] = q[who] @ base[at].T
                last = min(keep, like.shape[1])
                least = -np.partition(-like, last - 1, axis=1)[:, last - 1] - NEARLY
                for n, key in enumerate(slab["key"]):
                    # whatever may tie with the last place is scored exactly before the smaller ids are taken
                    found = []
                    for e in np.flatnonzero((like[n] >= least[n]) & (like[n] > -np.inf)):
                        score = float((q[n] * base[e]).sum())
                        found += [(-round(score, DECIMALS), int(i), score) for i in mine["ids"].iloc[e]]
                    for _, i, score in sorted(found)[:keep]:
                        out["key"].append(key)
                        out["id"].append(i)
                        out["score"].append(score)
        return pd.DataFrame(out).astype({"key": str, "id": np.int64, "score": np.float64})

    found = parts.groupBy("one", "chunk", "asks").cogroup(visit.groupBy("one", "chunk", "asks")).applyInPandas(rerank, "key string, id long, score double")
    best = Window.partitionBy("key").orderBy(F.round("score", DECIMALS).desc(), "id")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep).select("key", F.col("id").alias("vec_id"), "score")
    ranked = rows.filter("asks").select("key", F.col("id").alias("query_id")).distinct().join(top, "key").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= near).select("query_id", "rank", "vec_id", "score")
