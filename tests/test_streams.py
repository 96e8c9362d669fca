"""Streaming folds: ADWIN buckets against whole windows, and expiry by the watermark."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from barloom.streaming import live
from barloom.streaming import steps as S
from barloom.streaming.fold import use_rocksdb


def slow_adwin(values, delta):
    """Drift and window size after each value: all values are kept, and cut where buckets of the same rule meet."""
    window, sizes, out = [], [], []
    for x in values:
        window.append(x)
        sizes.append(1)
        size = 1
        while sizes.count(size) > S.PER_SIZE:
            at = sizes.index(size)
            sizes[at:at + 2] = [2 * size]
            size *= 2
        n, best, cut = len(window), 0.0, None
        edges = np.cumsum(sizes)[:-1]
        for c in edges if n >= 10 else []:
            if c >= 5 and n - c >= 5:
                gap = abs(np.mean(window[:c]) - np.mean(window[c:]))
                if gap >= math.sqrt((1 / c + 1 / (n - c)) / 2 * math.log(4 * math.log(n) / delta)) and gap > best:
                    best, cut = gap, int(c)
        if cut is not None:
            window, sizes = window[cut:], sizes[list(edges).index(cut) + 1:]
        out.append((cut is not None, len(window)))
    return out


def test_adwin_buckets_equal_the_whole_window():
    rng = np.random.default_rng(1)
    for shift in (0.0, 0.3, -0.5):
        values = [*(rng.random(700) < 0.6).astype(float), *(rng.random(700) < 0.6 + min(shift, 0.39)).astype(float)]
        state, got = {}, []
        step = S.adwin(0.002)
        for i, x in enumerate(values):
            state, ((_, _, hit, _, held),) = step(state, {"t": i, "id": i, "x": x})
            got.append((hit, held))
        assert got == slow_adwin(values, 0.002) and any(h for h, _ in got[700:]) == (shift != 0)


def test_adwin_state_stays_small():
    state, step = {}, S.adwin(1e-9)
    for i in range(20000):
        state, _ = step(state, {"t": i, "id": i, "x": float(i % 2)})
    assert sum(n for n, _ in state["w"]) == 20000 and len(json.dumps(state)) < 2000


ROW = "symbol string, t long, seq long, id long, kind string, direction string, price double, tp1 double, tp2 double, tp3 double, sl double"


def fed(spark, folder, batches, run):
    """Files that arrive one after the other in one stream; the rows it has given by then."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(ROW).parquet(f"{folder}/in")
        q = run(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_quiet_symbols_expire_by_the_watermark(spark, tmp_path):
    use_rocksdb(spark)
    pick = ("quiet", 1000, 1, 1, "pick", "BULLISH", 10.0, 11.0, 12.0, 13.0, 9.0)
    price = ("quiet", 2000, 2, 2, "price", "BULLISH", 11.5, 0.0, 0.0, 0.0, 0.0)
    late = ("late", 100_000, 3, 3, "pick", "BEARISH", 10.0, 9.0, 8.0, 7.0, 11.0)
    clock = [("other", t, t, t, "price", "BULLISH", 5.0, 0.0, 0.0, 0.0, 0.0) for t in (3000, 90_000, 100_000, 150_000)]
    got = fed(spark, str(tmp_path / "picks"), [[pick, price, clock[0]], [late, clock[1], clock[2]], [clock[3]]], lambda s: live.picks(s, "1 hour"))
    rows = sorted((r["id"], r["t"], r["status"], r["best"], r["final"]) for r in got.collect())
    assert rows == [(1, 1000, "PENDING", 10.0, False), (1, 2000, "TP1", 11.5, False), (1, 87_400, "TP1", 11.5, True), (3, 100_000, "PENDING", 10.0, False)]
    day = 86_400
    clock = [("other", t, t, t, "price", "BULLISH", 5.0, 0.0, 0.0, 0.0, 0.0) for t in (3000, 31 * day, 32 * day)]
    got = fed(spark, str(tmp_path / "decisions"), [[pick, clock[0]], [clock[1]], [clock[2]]], lambda s: live.decisions(s, "1 hour"))
    assert [(r["symbol"], r["id"], r["t"], r["outcome"]) for r in got.collect()] == [("quiet", 1, 1000 + 30 * day, "EXPIRED")]


def test_order_of_batches_does_not_matter_for_rows_in_order(spark, tmp_path):
    use_rocksdb(spark)
    rng = np.random.default_rng(2)
    rows = [("a", int(t), int(t), int(t), "pick" if t % 9 == 0 else "price", "BULLISH" if t % 2 else "BEARISH", float(p), p * 1.1, p * 1.2, p * 1.3, p * 0.9)
            for t, p in zip(np.arange(0, 400_000, 4000), rng.uniform(8, 12, 100).tolist())]
    rows = [(*r[:7], *(x if r[5] == "BULLISH" else 2 * r[6] - x for x in r[7:])) for r in rows]
    whole = fed(spark, str(tmp_path / "whole"), [rows], live.picks)
    parts = fed(spark, str(tmp_path / "parts"), [rows[:37], rows[37:60], rows[60:]], live.picks)
    key = [F.col(c) for c in ("id", "t", "status", "final")]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, parts.select(*key).collect())) and whole.count() > 10


def test_adaptive_level_follows_its_recursion():
    rng = np.random.default_rng(3)
    scores = rng.random(500)
    state, step, alpha = {}, S.adaptive_alpha(scores.tolist(), 0.1, 0.005), 0.1
    limit = np.quantile(scores, min(1.0, math.ceil(0.9 * 501) / 500))
    for i in range(3000):
        p, y = rng.random(), 1
        state, ((_, _, covered, level, threshold),) = step(state, {"t": i, "id": i, "prob": p, "y": y})
        hit = 1 - p > limit
        alpha = min(0.5, max(0.001, alpha + 0.005 * (float(hit) - 0.1)))
        limit = np.quantile(scores, min(1.0, math.ceil((1 - alpha) * 501) / 500))
        assert covered is not hit and abs(level - alpha) < 1e-12 and abs(threshold - limit) < 1e-12
    assert 0.001 < alpha <= 0.5


def test_a_table_streams_in_order_and_in_bounded_batches(spark):
    use_rocksdb(spark)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(str(i % 3), int(t), i, float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 400, 1000), rng.normal(size=1000)))] + [("0", None, 1000, 1.0)],
                                 "symbol string, t long, seq long, value double").coalesce(2)
    batches = []
    live.in_order(rows, F.col("t"), "feed", 400).writeStream.foreachBatch(lambda b, _: batches.append(b.collect())).trigger(availableNow=True).start().awaitTermination()
    times = [[r.t for r in b if r.t is not None] for b in batches]
    assert sum(map(len, batches)) == 1001 and len(batches) == 3 and max(map(len, batches)) < 420 and len(times[0]) == len(batches[0]) - 1
    assert all(max(a) < min(b) for a, b in zip(times, times[1:]))
    whole, cut = (sorted(map(tuple, live.replay(live.rate_history(live.in_order(rows.filter("t IS NOT NULL"), F.col("t"), "feed", n)), "rates").collect())) for n in (10_000, 400))
    assert whole == cut and len(whole) == 1000


def test_long_batches_are_given_out_in_slices(spark, monkeypatch):
    from barloom.streaming import fold
    frames = []
    monkeypatch.setattr(fold, "SLICE", 10)
    f = fold.Fold(S.ring(3), {}, ["t"], ["t", "held", "mean"], ["symbol"])
    f.state = type("V", (), {"exists": lambda s: False, "update": lambda s, v: frames.append(v)})()
    import pandas as pd
    got = list(f.handleInputRows(("a",), iter([pd.DataFrame({"t": range(24, -1, -1), "value": 1.0})]), None))
    assert [len(g) for g in got] == [10, 10, 5] and got[0]["t"].tolist() == list(range(10)) and len(frames) == 1


def test_values_foreseen_to_cut_nothing_are_not_judged(monkeypatch):
    """The cuts of every value were tried one value at a time."""
    rng = np.random.default_rng(3)
    values = [*rng.random(3000).round(4), *(rng.random(600) * 0.4).round(4), *rng.normal(100, 1, 500)]
    judged, real = [], np.flatnonzero
    monkeypatch.setattr(S.np, "flatnonzero", lambda v: judged.append(1) or real(v))
    rows, step, state, got = [{"t": i, "id": i, "x": float(x)} for i, x in enumerate(values)], S.adwin(0.002), {}, []
    for i, r in enumerate(rows):
        if i % 64 == 0:
            state = step.ahead(json.loads(json.dumps(state)), rows[i:i + 64])
        state, ((_, _, hit, _, held),) = step(state, r)
        got.append((hit, held))
    assert got == slow_adwin(values, 0.002) and 0 < sum(h for h, _ in got) and len(judged) < len(values) / 4
