"""Registered queries against their SQL twins on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
import check

DIR = "/root/testdata/sf0.001"
QUICK = ["rolling_mean_std", "cusum_filter", "rsi_series", "up_break_events", "tiered_breakouts", "directional_exits", "episode_summary", "trade_kpis",
         "conformal_sets", "lexicon_scores", "temporal_undersample", "resample_many", "loss_streaks"]


def test_every_query_has_a_plan_and_no_orphan_sql():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    verdict = check.compare(entry.queries()[name](spark, DIR), check.connect(DIR), entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
