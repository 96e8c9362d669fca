"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text, shared by all
grades, and ordered thresholds. It gives the expected grade and the tail probability P(grade >= k) by which documents are
selected. x holds hashed words (log counts), and hashed shapes of words (letters as ``a``/``A``,
digits as ``0``, other characters kept), so that unseen words still tell prose from junk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.samples import smallest
from barloom.llm.text import words_of

DIMS = 1 << 16
#: Bound of the labelled rows that the model is fitted on, and words a worker remembers.
FIT_ROWS = 4000
REMEMBERED = 300_000
#: Share of the held-out documents of the top grade that the decision on the top grade lets stay.
STAY = 0.98
MARKS = b".,;:!?\"'()*#$%&|"
SHAPES = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Shape with runs of one character held to two."""
    out = bytearray()
    for b in word.translate(SHAPES):
        if len(out) < 2 or out[-1] != b or out[-2] != b:
            out.append(b)
    return bytes(out[:12])


def slot(kind: bytes, value: bytes) -> int:
    return xxhash.xxh64_intdigest(kind + value) % DIMS


class Features:
    """Sparse features of whole texts; remembers the slots of words and shapes it has met."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}

    def slots(self, word: bytes) -> int:
        """Slot of the word and slot of its shape in one number."""
        form = word.translate(SHAPES)
        second = self.shapes.get(form)
        if second is None:
            if len(self.shapes) > REMEMBERED:
                self.shapes.clear()
            second = self.shapes[form] = slot(b"s", shape(word))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        got = self.known[word] = slot(b"w", word.lower().strip(MARKS)) * DIMS + second
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values); a text without words has none."""
        words = words_of(text)
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
        counts = Counter(words)
        known, slots = self.known, self.slots
        pairs = np.array([known.get(w) or slots(w) for w in counts], dtype=np.int64)
        each = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        names, back = np.unique(pairs // DIMS, return_inverse=True)
        worth = np.log1p(np.bincount(back, weights=each))
        shapes, sback = np.unique(pairs % DIMS, return_inverse=True)
        share = np.bincount(sback, weights=each) / len(words)
        again = sum(map(eq, words, words[1:])) / len(words)
        rare = len(counts) / len(words)
        keys = np.concatenate([names, shapes, [slot(b"f", b"again"), slot(b"f", b"distinct"), slot(b"f", b"one")]])
        values = np.concatenate([worth / np.sqrt(np.square(worth).sum()), 2 * np.sqrt(share), [2 * again, rare, 1.0]])
        return keys.astype(np.int32), values.astype(np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    """``thresholds`` ascend; there are ``len(thresholds) + 1`` grades from 0 on. ``least_top`` is the least P(top grade) of a kept document."""

    weights: np.ndarray
    thresholds: np.ndarray
    least_top: float = 0.0

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each k from 1 on."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = 150, rate: float = 0.1, ridge: float = 2e-4) -> OrdinalModel:
    """Adam on the mean negative log likelihood; grades weigh alike whatever their numbers.

    Thresholds are the first one plus positive steps, so they stay ordered. With fewer than two
    grades among the rows nothing can be told apart: every document then has the top grade.
    """
    if len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(DIMS), np.full(levels - 1, -40.0))
    row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    col, val = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    seen = np.bincount(grades, minlength=levels)
    weigh = (1 / np.maximum(seen, 1))[grades]
    weigh /= weigh.sum()
    p = np.zeros(DIMS + levels - 1)
    p[DIMS] = -1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        steps = np.exp(p[DIMS + 1:])
        cut = p[DIMS] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(row, weights=p[col] * val, minlength=len(rows))
        edges = np.concatenate([np.full((len(rows), 1), -np.inf), cut[None, :] - score[:, None], np.full((len(rows), 1), np.inf)], axis=1)
        f = sigmoid(edges)
        n = np.arange(len(rows))
        top, low = f[n, grades + 1], f[n, grades]
        chance = np.maximum(top - low, 1e-9)
        dtop, dlow = top * (1 - top) / chance, low * (1 - low) / chance
        grad = np.zeros_like(p)
        grad[:DIMS] = np.bincount(col, weights=((dtop - dlow) * weigh)[row] * val, minlength=DIMS) + ridge * p[:DIMS]
        dcut = np.zeros(levels + 1)
        np.add.at(dcut, grades + 1, -dtop * weigh)
        np.add.at(dcut, grades, dlow * weigh)
        dcut = dcut[1:levels]
        grad[DIMS] = dcut.sum()
        grad[DIMS + 1:] = np.cumsum(dcut[::-1])[::-1][1:] * steps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(p[:DIMS].copy(), p[DIMS] + np.concatenate([[0.0], np.cumsum(np.exp(p[DIMS + 1:]))]))


def scores_of(rows: Iterable[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """w.x of each row; minus infinity without words."""
    return np.array([(weights[k] * v).sum() if len(k) else -np.inf for k, v in rows], dtype=np.float64)


def least_top(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, stay: float = STAY) -> float:
    """Least P(top grade) by which ``stay`` of the top-graded rows of every fourth row stay, by a model of the others; 0 if nothing can be told apart."""
    held = np.arange(len(rows)) % 4 == 3
    if not {levels - 2, levels - 1} <= set(grades[held]) & set(grades[~held]):
        return 0.0
    model = fit([r for r, h in zip(rows, held) if not h], grades[~held], levels)
    clean = scores_of([r for r, h, g in zip(rows, held, grades) if h and g == levels - 1], model.weights)
    return float(np.quantile(model.at_least(clean)[:, -1], 1 - stay, method="lower"))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 poor, 1 good but toxic, 2 good and clean; rows with nulls are left out."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def trained(docs: DataFrame, ratings: DataFrame, levels: int = 3, fit_rows: int = FIT_ROWS, text: str = "text") -> OrdinalModel:
    """Model of at most ``fit_rows`` labelled rows, those with the smallest hashes of the id, an even share for each grade."""
    counts = {r["grade"]: r["count"] for r in ratings.groupBy("grade").count().collect()}
    some = None
    for g in range(levels):
        part = smallest(ratings.filter(F.col("grade") == g), F.col("doc_id"), fit_rows // levels, counts.get(g, 0))
        some = part if some is None else some.unionByName(part)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = Features()
        for b in batches:
            got = [known.of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.tobytes() for k, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["grade", "slots", "worth"])

    # at most fit_rows ids are sent to the scan of the texts, and as many feature rows come back
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(some), "doc_id").select("grade", "text")
    rows = sample.mapInArrow(features, "grade int, slots binary, worth binary").collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["slots"]), bytes(r["worth"])))
    sparse, grades = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["worth"], np.float32)) for r in rows], np.array([r["grade"] for r in rows], dtype=np.int64)
    return replace(fit(sparse, grades, levels), least_top=least_top(sparse, grades, levels))


def rating(text: Column, model: OrdinalModel) -> Column:
    """Struct of ``score``, ``expected_grade`` and ``tail`` (P(grade >= k) for k = 1, 2, ...).

    Whole texts; null and empty texts have no words and get the least grade.
    """

    @F.arrow_udf("struct<score:double,expected_grade:double,tail:array<double>>")
    def ordinal_rating(texts: pa.Array) -> pa.Array:
        known = Features()
        score = scores_of((known.of(t.as_py()) for t in texts), model.weights)
        tail = np.where(np.isneginf(score)[:, None], 0.0, model.at_least(score))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1) * tail.shape[1], pa.int32()), pa.array(tail.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.where(np.isneginf(score), -40.0, score)), pa.array(tail.sum(axis=1)), flat], names=["score", "expected_grade", "tail"])

    return ordinal_rating(text)


def rated(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the struct ``rating``."""
    return docs.withColumn("rating", rating(F.col(text), model)).drop(text)


def kept(tail: Column, model: OrdinalModel, level: int = 1, least: float = 0.5) -> Column:
    """Whether P(grade >= level) is ``least`` or more and P(top grade) that of the held-out rows or more."""
    return (F.element_at(tail, level) >= least) & (F.element_at(tail, -1) >= model.least_top)


def selected(docs: DataFrame, model: OrdinalModel, level: int = 1, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that are ``kept``, unchanged."""
    mark = "__rating__"
    return docs.withColumn(mark, rating(F.col(text), model)).filter(kept(F.col(f"{mark}.tail"), model, level, least)).drop(mark)
