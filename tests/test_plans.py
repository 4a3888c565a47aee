"""Physical-plan properties that matter at scale."""

import pytest

from panelcast.plans.queries import QUERIES
from tests.conftest import SF001

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert not any(b in plan for b in BAD), name


def test_year_bounds_reach_the_scan(spark):
    from panelcast.sources.panel import demand_panel
    plan = demand_panel(spark, SF001, max_year=2000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in plan or "o_orderdate <" in plan


def test_fit_and_forecast_add_no_shuffle_on_partitioned_panel(spark):
    from panelcast.operators import horizon as H
    from panelcast.operators import models as M
    from panelcast.sources.panel import synthetic_panel
    p = synthetic_panel(spark, 200, n_years=10).repartition(4, "series_id")
    fc = H.predict_logistic_price(M.fit_logistic_price(p), 5)
    plan = _plan(fc)
    assert plan.count("Exchange") == 1, plan   # the explicit repartition only


@pytest.mark.parametrize("name", ["best_model_forecast", "backtest_leaderboard", "comparison_rows"])
def test_comparisons_do_not_derive_the_panel_again(spark, name):
    """The panel is checkpointed once; what follows reads no source table."""
    assert "FileScan" not in _plan(QUERIES[name](spark, SF001))


def test_the_resampling_stage_runs_once(spark):
    """Its result is written, so the fit's own plan holds no Python stage."""
    from panelcast.operators import bootstrap as B
    from panelcast.sources.panel import synthetic_panel
    fits = B.fit_bootstrap_logistic(synthetic_panel(spark, 3, n_years=8), {"optimize_parameters": True, "n_simulations": 10})
    assert "InPandas" not in _plan(fits)
