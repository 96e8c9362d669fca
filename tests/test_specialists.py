"""Boosted specialists: bin sums and splits against loops, held-out loss against Spark's own boosted trees."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barloom.operators import monitor as M
from barloom.operators import specialists as SP


def test_gradient_sums_and_splits_equal_loops():
    rng = np.random.default_rng(1)
    group, node, bins, slope, bend = rng.integers(0, 2, 400), rng.integers(0, 3, 400), rng.integers(0, 5, (400, 3)), rng.normal(size=400), rng.random(400)
    sums = SP.gradient_sums(group, node, bins, slope, bend, 2, 3, 5)
    feature, cut, value = SP.splits(sums, 1.0)
    for g in range(2):
        for n in range(3):
            own = (group == g) & (node == n)
            best = -1.0
            for f in range(3):
                for b in range(5):
                    at = own & (bins[:, f] == b)
                    assert sums[g, n, f, b] == pytest.approx([slope[at].sum(), bend[at].sum()])
                    left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                    gain = sum(slope[s].sum()**2 / (bend[s].sum() + 1) for s in (left, right)) - slope[own].sum()**2 / (bend[own].sum() + 1)
                    if gain > best + 1e-12:
                        best, want = gain, (f, b)
            assert (feature[g, n], cut[g, n]) == want
            left = own & (bins[:, want[0]] <= want[1])
            assert value[g, n] == pytest.approx([-slope[s].sum() / (bend[s].sum() + 1) for s in (left, own & ~left)])


def test_specialists_lose_no_more_than_boosted_trees_of_spark_and_cover(spark):
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(size=(n, 3))
    group = rng.choice(["a", "b"], n)
    z = np.where(group == "a", 2 * x[:, 0] * x[:, 1], 1.5 * np.sign(x[:, 2]) + x[:, 0])
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    part = np.where(np.arange(n) < 3600, "fit", np.where(np.arange(n) < 4800, "valid", "test"))
    rows = spark.createDataFrame([(i, str(g), *map(float, v), int(t), 1.0, str(p)) for i, (g, v, t, p) in enumerate(zip(group, x, y, part))],
                                 "id int, g string, x0 double, x1 double, x2 double, y int, w double, part string").repartition(4)
    features = ["x0", "x1", "x2"]
    seen = rows.filter("part <> 'test'").withColumn("valid", F.col("part") == "valid")
    model = SP.fit_specialists(seen, features, "y", "w", "g", "valid", trees=40)
    assert model.groups == ["a", "b"] and all(len(t) == int(np.argmin(l)) for t, l in zip(model.trees, model.losses))
    scored = SP.scored_by_specialists(rows, model, features, "g")
    p = F.greatest(F.when(F.col("y") == 1, F.col("prob")).otherwise(1 - F.col("prob")), F.lit(1e-15))
    ours = {r["g"]: r["loss"] for r in scored.filter("part = 'test'").groupBy("g").agg(F.avg(-F.log(p)).alias("loss")).collect()}
    for g in ("a", "b"):
        gbt = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="v"), GBTClassifier(featuresCol="v", labelCol="y", maxIter=10, maxDepth=3, seed=1)])
        plain = gbt.fit(rows.filter(f"g = '{g}' AND part = 'fit'")).transform(rows.filter(f"g = '{g}' AND part = 'test'")).withColumn("prob", vector_to_array("probability")[1])
        assert ours[g] <= plain.agg(F.avg(-F.log(p))).first()[0] + 0.005
    limits = M.conformal_threshold(scored.filter("part = 'valid'"), ["g"], 0.1)
    covered = M.conformal_sets(scored.filter("part = 'test'"), limits, ["g"]).agg(F.avg("covered")).first()[0]
    assert 0.87 <= covered <= 0.94
    other = SP.scored_by_specialists(rows.limit(1).withColumn("g", F.lit("new")), model, features, "g").first()
    assert other["prob"] is None


def test_passes_read_cells_whose_number_does_not_grow_with_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, group, y = rng.integers(0, 6, (900, 2)), rng.choice(["a", "b"], 900), rng.integers(0, 2, 900)
    rows = spark.createDataFrame([(str(g), *map(float, v), int(t), float(w), i >= 600) for i, (g, v, t, w) in enumerate(zip(group, x, y, rng.integers(1, 4, 900)))],
                                 "g string, x0 double, x1 double, y int, w double, valid boolean")
    tables = []
    real = SP.settle
    monkeypatch.setattr(SP, "settle", lambda df, name="table": tables.append(real(df, name)) or tables[-1])
    once = SP.fit_specialists(rows, ["x0", "x1"], "y", "w", "g", "valid", trees=6)
    often = SP.fit_specialists(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("w", F.col("w") / 8), ["x0", "x1"], "y", "w", "g", "valid", trees=6)
    n = [t.count() for t in tables]
    assert n[0] == 900 and n[2] == 7200 and n[1] == n[3] <= 2 * 36 * 2 * 2
    # a cell holds the weights of its rows, none is left out
    assert tables[1].agg(F.sum("w")).first()[0] == rows.agg(F.sum("w")).first()[0]
    assert once.start == pytest.approx(often.start, rel=1e-9)
    for a, b in zip(once.losses, often.losses):
        assert a == pytest.approx(b, rel=1e-9)
    rows = rows.select("g", "x0", "x1")
    for a, b in zip(SP.scored_by_specialists(rows, once, ["x0", "x1"], "g").collect(), SP.scored_by_specialists(rows, often, ["x0", "x1"], "g").collect()):
        assert a["prob"] == pytest.approx(b["prob"], rel=1e-9)
