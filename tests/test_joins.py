"""The contains join against a loop, on both sides of its size check."""

import random

import pytest

from barloom.operators.joins import contains_join


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_contains_join_equals_a_loop(spark, most):
    rng = random.Random(1)
    texts = [(i, None if i % 17 == 0 else "".join(rng.choice("abAB é1") for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(200, "ab ab"), (200, "ab ab")]
    words = ["a", "AB", "ba", "abab", "é1", "", None, "zz", "Ab"]
    got = contains_join(spark.createDataFrame(texts, "id int, title string"), spark.createDataFrame([(w, n) for n, w in enumerate(words)], "ticker string, n int"), "title", "ticker", most)
    want = [(i, t, w, n) for i, t in texts if t is not None for n, w in enumerate(words) if w and w.lower() in t.lower()]
    key = lambda r: (r[0], r[1], r[3])
    assert sorted(((r["id"], r["title"], r["ticker"], r["n"]) for r in got.collect()), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], "ticker string, n int")
    assert contains_join(spark.createDataFrame(texts, "id int, title string"), none, "title", "ticker", most).count() == 0
