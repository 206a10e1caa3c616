"""A sample of registered queries against DuckDB at the smallest scale, and the contract."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SAMPLE = ["s02_bar_builder", "w02_ema", "w14_volume_lines", "w19_parabolic_sar", "w21_supertrend", "p11_gap_fill", "p18_trend_state", "j01_asof", "j03_first_touch", "a16_conditional_matrix",
          "a24_cycles", "r01_risk_metrics", "r07_covariance", "r15_signal_ledger", "r30_average_cost", "f01_sax", "f06_cwt", "m14_walk_forward_splits", "k01_top_k"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, root, name):
    got = entry.queries()[name](spark, root).toPandas()
    assert len(got)
    assert compare(got, connect(root).execute(entry.oracle_sql()[name]).df()) == "ok"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_fills_are_read_not_joined_again(spark, root):
    """Both book queries read stored fills: every reader of them would else join and number all line items once more."""
    from tapeline.plans.r_reports import fills

    f = fills(spark, root)
    assert "Exchange" not in f._jdf.queryExecution().executedPlan().toString()
    name = "r30_mark_to_market"
    assert compare(entry.queries()[name](spark, root).toPandas(), connect(root).execute(entry.oracle_sql()[name]).df()) == "ok"
