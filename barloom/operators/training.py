"""Training-set preparation: splits, weights, sampling, sequences and models."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ranking import top_per_key
from barloom.operators.series import Frames, index_series, over_chunks


def number_rows(rows: DataFrame, order: Sequence[str], bucket: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Time position ``pos`` and total ``n`` of the rows (per key), in two levels."""
    k = list(keys)
    idx = index_series(rows, k, order, bucket, out="pos")
    size = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    return idx.join(size, k) if k else idx.withColumn("n", size.scalar())


def chronological_split(rows: DataFrame, purge: int, share: float = 0.2) -> DataFrame:
    """train / purged / val by position; the purge lies before the cut."""
    cut = F.floor(F.col("n") * (1 - share))
    return rows.withColumn("role", F.when(F.col("pos") < F.greatest(F.lit(0), cut - purge), "train").when(F.col("pos") >= cut, "val").otherwise("purged"))


def purged_paths(rows: DataFrame, groups: int = 6, k: int = 2, purge: int = 48, embargo: float = 0.01) -> DataFrame:
    """Combinatorial purged splits in long form: (row, path, role) with train and test rows.

    Each row is paired with the fixed list of paths; whether it lies in a purge or embargo
    zone is arithmetic on its position.
    """
    size = F.floor(F.col("n") / groups)
    paths = F.array(*[F.struct(F.lit(i).alias("path"), F.array(*[F.lit(g) for g in c]).alias("tests")) for i, c in enumerate(combinations(range(groups), k))])
    x = rows.withColumn("_g", F.least(F.floor(F.col("pos") / size), F.lit(groups - 1)).cast("int")).withColumn("_p", F.explode(paths))
    gap = purge + F.floor(size * embargo)

    def zone(g: Column) -> Column:
        start, end = g * size, F.when(g == groups - 1, F.col("n")).otherwise((g + 1) * size)
        return ((F.col("pos") >= start - purge) & (F.col("pos") < start)) | ((F.col("pos") >= end) & (F.col("pos") < end + gap))
    test = F.array_contains("_p.tests", F.col("_g"))
    role = F.when(test, "test").when(~F.exists("_p.tests", zone), "train")
    return x.select(*rows.columns, F.col("_p.path").alias("path"), role.alias("role")).filter(F.col("role").isNotNull())


def walk_forward_windows(sizes: DataFrame, train: int, test: int, step: int, purge: int = 48) -> DataFrame:
    """Windows per series from its length ``n``: train range ends ``purge`` rows before the test range."""
    last = F.col("n") - test
    starts = F.when(last >= train, F.sequence(F.lit(train).cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return sizes.select("*", F.posexplode(starts).alias("window_id", "test_start")).select(
        *sizes.columns, "window_id", F.greatest(F.lit(0), F.col("test_start") - train).alias("train_start"), F.greatest(F.lit(0), F.col("test_start") - purge).alias("train_end"),
        "test_start", (F.col("test_start") + test).alias("test_end"))


def assign_folds(rows: DataFrame, folds: int, burn_in: float) -> DataFrame:
    """Fold of each position after the burn-in; the last fold takes the remainder."""
    start = F.floor(F.col("n") * burn_in)
    size = F.floor((F.col("n") - start) / folds)
    f = F.least(F.floor((F.col("pos") - start) / size), F.lit(folds - 1)).cast("int")
    return rows.withColumn("fold", F.when(F.col("pos") >= start, f))


def recency_weight(low: float = 1.0, high: float = 3.0) -> Column:
    """Linear in position from ``low`` to ``high``."""
    return low + (high - low) * F.col("pos") / F.greatest(F.col("n"), F.lit(1))


def recent_boost(weight: Column, boost: float, cutoff: float = 0.7) -> Column:
    return F.when(F.col("pos") >= F.floor(F.col("n") * cutoff), weight * boost).otherwise(weight)


def class_weights(rows: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """The minority class weighs as much more as it is rarer; the majority weighs 1."""
    c = rows.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    w = F.when((F.col(label) == 1) & (F.col("_p") < F.col("_n")), F.col("_n") / F.col("_p")).when((F.col(label) == 0) & (F.col("_n") <= F.col("_p")), F.col("_p") / F.col("_n")).otherwise(1.0)
    if keys:
        x = rows.join(c, list(keys))
    else:
        one = c.select(F.struct("_p", "_n").alias("c"))
        x = rows.withColumn("_c", one.scalar()).select(*rows.columns, F.col("_c._p").alias("_p"), F.col("_c._n").alias("_n"))
    return x.withColumn("class_weight", w).drop("_p", "_n")


def temporal_undersample(rows: DataFrame, id_col: str, label: str = "label", ratio: float = 10.0, buckets: int = 10) -> DataFrame:
    """Thin the majority class to ``ratio`` times the minority, evenly over time buckets.

    Rows need pos and n. Within a bucket the rows with the smallest id hash stay; the hash
    order is ranked in two levels (hash prefix, then inside it).
    """
    tot = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    minor = F.least("p", "q")
    facts = tot.select(F.struct(F.when(F.col("p") < F.col("q"), 0).otherwise(1).alias("major"), minor.alias("m"), F.greatest("p", "q").alias("mm"), (F.greatest("p", "q") > minor * ratio).alias("act")))
    x = rows.withColumn("_f", facts.scalar())
    keep = x.filter(~F.col("_f.act") | (F.col(label) != F.col("_f.major"))).drop("_f")
    major = x.filter(F.col("_f.act") & (F.col(label) == F.col("_f.major"))).withColumn("_h", F.md5(F.col(id_col).cast("string")))
    at = index_series(major, [], ["pos"], [F.floor(F.col("pos") / 65536)], out="_i")
    at = at.withColumn("_b", F.least(F.floor(F.col("_i") * buckets / F.col("_f.mm")), F.lit(buckets - 1)).cast("int"))
    size = at.groupBy("_b").agg(F.count(F.lit(1)).alias("_bn"))
    quota = F.greatest(F.lit(1), F.floor(F.floor(F.col("_f.m") * ratio) * F.col("_bn") / F.col("_f.mm")))
    ranked = index_series(at.join(size, "_b"), ["_b"], ["_h", id_col], [F.substring("_h", 1, 3)], out="_rank")
    return keep.unionByName(ranked.filter(F.col("_rank") < quota).select(*keep.columns))


def hard_negative_weights(rows: DataFrame, boost: float = 2.0, cap: float = 0.5) -> DataFrame:
    """Boost misclassified rows; scale them back when they would hold more than ``cap`` of the weight."""
    x = rows.withColumn("_w", F.when(F.col("pred") != F.col("label"), F.col("weight") * boost).otherwise(F.col("weight")))
    t = x.agg(F.struct(F.sum(F.when(F.col("pred") != F.col("label"), F.col("_w"))).alias("hard"), F.sum("_w").alias("all")))
    x = x.withColumn("_t", t.scalar())
    scale = F.when(F.col("_t.hard") > cap * F.col("_t.all"), cap * F.col("_t.all") / F.col("_t.hard")).otherwise(1.0)
    return x.withColumn("new_weight", F.when(F.col("pred") != F.col("label"), F.col("_w") * scale).otherwise(F.col("_w"))).drop("_w", "_t")


def cap_events(events: DataFrame, per_key: Sequence[str], n: int, pool: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """The heaviest ``n`` events per key, then the heaviest ``pool`` overall."""
    order = [F.col("weight").desc(), *[F.col(c) for c in tie]]
    kept = top_per_key(events, per_key, order, n, spread=list(tie) or None)
    return kept if pool is None else kept.orderBy(*order).limit(pool)


def sequences(bars: DataFrame, features: Sequence[str], length: int, stride: int = 10, warmup: int = 50) -> DataFrame:
    """Feature windows of ``length`` bars that end before every ``stride``-th bar."""

    def build(x: DataFrame, f: Frames) -> DataFrame:
        seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(f.prior(length))
        due = (F.col("bar_idx") >= warmup + length) & ((F.col("bar_idx") - warmup - length) % stride == 0)
        return x.select("symbol", "bar_idx", "_chunk", "close", "atr", F.when(due, seq).alias("sequence")).filter(F.col("sequence").isNotNull())

    return over_chunks(bars, build, back=length)


# -- columns and models ---------------------------------------------------------------------------

def slot_variances(rows: DataFrame, features: str) -> DataFrame:
    """Variance of every slot of an array column: one row per slot."""
    return rows.select(F.posexplode(features).alias("slot", "v")).groupBy("slot").agg(F.var_pop(F.col("v").cast("double")).alias("variance"))


def keep_slots(variances: DataFrame, share: float = 0.7, seed: int | None = None) -> DataFrame:
    """The most varying share of the slots, or a seeded random share. Slots are few (one row each)."""
    order = [F.desc("variance"), F.col("slot")] if seed is None else [F.md5(F.concat_ws(":", F.lit(seed), F.col("slot")))]
    n = variances.count()
    return variances.orderBy(*order).limit(int(n * share))


def learned_filter(rows: DataFrame, features: Sequence[str], label: str, weight: str, folds: Sequence[int], regularisation: float = 1.0) -> DataFrame:
    """Walk-forward logistic filter: each fold is scored by a model fitted on the rows before it.

    ``rows`` carry fold numbers; folds without both classes before them stay unscored.
    """
    scored = None
    for k in folds:
        past = rows.filter(F.coalesce("fold", F.lit(-1)) < k)
        classes, n = past.agg(F.count_distinct(label), F.count(F.lit(1))).first()
        here = rows.filter(F.col("fold") == k)
        if classes < 2:
            part = here.withColumn("proba", F.lit(None).cast("double"))
        else:
            stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
                      LogisticRegression(featuresCol="_z", labelCol=label, weightCol=weight, regParam=1.0 / (regularisation * n), maxIter=50)]
            part = Pipeline(stages=stages).fit(past).transform(here).withColumn("proba", vector_to_array("probability")[1]).select(*rows.columns, "proba")
        scored = part if scored is None else scored.unionByName(part)
    return scored


def top_coefficients(rows: DataFrame, features: Sequence[str], label: str, weight: str, n: int) -> DataFrame:
    """Features with the largest absolute coefficient of the logistic filter."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
              LogisticRegression(featuresCol="_z", labelCol=label, weightCol=weight, maxIter=50)]
    coef = Pipeline(stages=stages).fit(rows).stages[-1].coefficients.toArray()
    table = rows.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, coef)], "feature string, coefficient double")
    return table.orderBy(F.desc(F.abs("coefficient")), "feature").limit(n)


def boosted_classifier(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, weight: str, trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Gradient-boosted event classifier; returns the scored test rows."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(train).transform(test).withColumn("proba", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability")
