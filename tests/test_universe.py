"""Correlations of tiles and the walk over correlated symbols against plain loops."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import universe as U


@pytest.mark.parametrize("fill, most", [(0.04, 2_000_000), (0.04, 7), (0.9, 2_000_000)])
def test_tile_correlations_equal_pairwise_ones(fill, most, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = (np.where(rng.random((n, 80)) < fill, rng.normal(size=(n, 80)), np.nan) for n in (60, 50))
    x[3], y[4] = np.nan, 0.5
    monkeypatch.setattr(U.pair_sums, "__defaults__", (most,))
    wanted = rng.random((60, 50)) < 0.8
    a, b, corr = U.tile_correlations(x, y, 3, wanted)
    got = dict(zip(zip(a.tolist(), b.tolist()), corr))
    for i in range(60):
        for j in range(50):
            both = ~np.isnan(x[i]) & ~np.isnan(y[j])
            if wanted[i, j] and both.sum() >= 3:
                with np.errstate(all="ignore"):
                    want = np.corrcoef(x[i][both], y[j][both])[0, 1] if np.ptp(y[j][both]) else np.nan
                assert got.pop((i, j)) == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert not got


def walk(edges):
    lost = set()
    for a, b in sorted(edges):
        if a not in lost:
            lost.add(b)
    return lost


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_dedup_equals_the_walk(spark, most):
    rng = np.random.default_rng(2)
    edges = {(min(a, b), max(a, b)) for a, b in rng.integers(1, 120, (150, 2)).tolist() if a != b} | {(200 + i, 201 + i) for i in range(60)}
    pairs = spark.createDataFrame([(f"s{a}", a, f"s{b}", b) for a, b in edges], "sym_a string, rank_a int, sym_b string, rank_b int")
    ranked = spark.createDataFrame([(f"s{i}", i) for i in range(1, 300)], "symbol string, rank int")
    got = {r["rank"] for r in U.drop_correlated(ranked, pairs, most).collect()}
    assert got == set(range(1, 300)) - walk(edges)
    assert U.drop_correlated(ranked, pairs.limit(0)).count() == 299


def test_long_chains_end_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = U.walked
    monkeypatch.setattr(U, "components", lambda e: rounds.append(1) or real_components(e))
    pairs = spark.range(1, 10_000).selectExpr("concat('s', id) AS sym_a", "int(id) AS rank_a", "concat('s', id + 1) AS sym_b", "int(id + 1) AS rank_b")
    ranked = spark.range(1, 10_001).selectExpr("concat('s', id) AS symbol", "int(id) AS rank")
    for most in (2_000_000, 4000):
        kept = U.drop_correlated(ranked, pairs, most).selectExpr("count(*) AS n", "sum(rank % 2) AS odd").first()
        assert (kept["n"], kept["odd"]) == (5000, 5000)
    assert len(rounds) <= 4 and real is U.walked


real_components = U.components


def test_equal_vectors_are_sent_and_correlated_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [sorted(rng.choice(30, 12, replace=False).tolist()) for _ in range(9)]
    vectors = [dict(zip(days, rng.normal(size=12).tolist())) for days in base] + [dict(zip(base[0], [0.25] * 12))]
    rows = [(f"s{r}", r, vectors[int(v)]) for r, v in enumerate(rng.permutation(np.repeat(range(10), 4)), 1)]
    df = spark.createDataFrame(rows, "symbol string, rank int, rets map<int,double>")
    want = set()
    for sa, ra, a in rows:
        for sb, rb, b in rows:
            x = np.array([(a[d], b[d]) for d in a if d in b])
            if ra < rb and len(x) >= 3 and np.ptp(x[:, 0]) and np.ptp(x[:, 1]) and abs(np.corrcoef(x.T)[0, 1]) > 0.5:
                want.add((sa, ra, sb, rb))
    sent = []
    real = U.class_pairs
    monkeypatch.setattr(U, "class_pairs", lambda classes, *a: sent.append(classes.count()) or real(classes, *a))
    got = [(r.sym_a, r.rank_a, r.sym_b, r.rank_b) for r in U.correlated_pairs(df, 0.5, 3, tile=3).collect()]
    assert len(got) == len(want) and set(got) == want and sent == [10]
    kept = {r["rank"] for r in U.drop_correlated_vectors(df.select("symbol", "rank"), df, 0.5, 3).collect()}
    assert kept == set(range(1, 41)) - walk({(a, b) for _, a, _, b in want}) and sent == [10, 10]


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("most", [1_000_000, 50])
def test_sparse_correlations_equal_pairwise_ones(same, most):
    rng = np.random.default_rng(7)
    def vectors(n):
        days = [np.sort(rng.choice(300, int(k), replace=False)) for k in rng.integers(1, 40, n)]
        return pd.DataFrame({"lead": np.arange(n), "days": days, "r": [rng.normal(size=len(d)) if len(d) % 9 else np.full(len(d), 0.5) for d in days]})
    x = vectors(70)
    y = x if same else vectors(50)
    got = {(a, b): c for part in U.sparse_correlations(x, y, 3, same, most) for a, b, c in zip(*(p.tolist() for p in part))}
    dense = [np.full((len(p), 300), np.nan) for p in (x, y)]
    for out, part in zip(dense, (x, y)):
        for i, (d, r) in enumerate(zip(part["days"], part["r"])):
            out[i, d] = r
    wanted = np.ones((len(x), len(y)), dtype=bool)
    want = {(a, b): c for a, b, c in zip(*(p.tolist() for p in U.tile_correlations(*dense, 3, np.triu(wanted) if same else wanted)))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True) for k in want)


def test_dedup_makes_only_the_pairs_that_decide(spark, monkeypatch):
    """All pairs of all classes were made before the walk."""
    rng = np.random.default_rng(5)
    rows = [(f"s{r}", r, dict(zip(rng.choice(40, 9, replace=False).tolist(), rng.normal(size=9).tolist()))) for r in range(1, 301)] + [("f1", 301, {1: 0.5, 2: 0.5, 3: 0.5}), ("f2", 302, {1: 0.5, 2: 0.5, 3: 0.5})]
    rows += [("t1", 303, rows[40][2]), ("t2", 304, rows[299][2])]
    df = spark.createDataFrame(rows, "symbol string, rank int, rets map<int,double>")
    edges = {(r.rank_a, r.rank_b) for r in U.correlated_pairs(df, 0.8, 3).collect()}
    sent, real = [], U.class_pairs
    monkeypatch.setattr(U, "class_pairs", lambda classes, *a: sent.append(classes.count()) or real(classes, *a))
    got = {r["rank"] for r in U.drop_correlated_vectors(df.select("symbol", "rank"), df, 0.8, 3, head=40).collect()}
    assert got == set(range(1, 305)) - walk(edges) and {301, 302} <= got
    assert len(sent) > 1 and sum(sent) < 240


def test_a_vector_goes_to_few_blocks(spark):
    classes = spark.range(1, 401).selectExpr("int(id) AS lead", "array(1, 2, 3) AS days", "array(id, 1D, id * id) AS r")
    plan = U.class_pairs(classes, 0.5, 3, tile=10, copies=4)
    assert "sequence(0, 3" in plan._jdf.queryExecution().analyzed().toString() and plan.count() > 0


def test_month_statistics_read_the_bars_once(spark):
    bars = [(s, 86400 * i * k, 1.0 + i, 3.0 + i, 0.5 + i, 2.0 + i % 7, 10.0) for s, n, k in (("a", 45, 2), ("b", 20, 1), ("c", 19, 1)) for i in range(n)]
    df = spark.createDataFrame(bars, "symbol string, t long, open double, high double, low double, close double, volume double")
    stats = U.month_stats(df.repartition(3))
    got = {r.symbol: (r.days, r.close, r.pct_30d) for r in stats.collect()}
    assert got == {"a": (30, 2.0 + 44 % 7, pytest.approx(((2.0 + 44 % 7) / (2.0 + 15 % 7) - 1) * 100)), "b": (20, 7.0, pytest.approx(250.0))}
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
