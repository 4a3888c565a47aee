"""Rolling back-tests read off running sums equal fits made anew for every fold."""

import math

import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate as E
from tests.fixtures import INPUT

SCHEMA = "series_id bigint, year int, actual double, population double, gdp double, price double"


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(1, *r) for r in INPUT]
    rows += [(2, y, a * 1.1, p, g, None if y == 2011 else c) for y, a, p, g, c in INPUT]
    rows += [(3, y, None if y == 2012 else a, p, g * (1 + y % 3 / 50), c) for y, a, p, g, c in INPUT if y % 4]
    rows += [(4, y, max(1.0, 4e6 - 4.2e5 * (y - 2005)), p, g * 1.2 ** (y - 2005), c) for y, a, p, g, c in INPUT]
    rows += [(5, *INPUT[3]), (5, *INPUT[3]), (5, *INPUT[4]), (6, *INPUT[0]), (7, *INPUT[0]), (7, *INPUT[2]), (None, *INPUT[5]), (8, None, *INPUT[0][1:])]
    return spark.createDataFrame([tuple(None if x is None else float(x) if i > 1 else x for i, x in enumerate(r)) for r in rows], SCHEMA)


def rounded(df):
    return sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in df.collect()), key=str)


CASES = [("linear_price", {}), ("linear_price", {"optimize_parameters": True}), ("linear_price", {"C1": -3.0, "gdp_growth_rate": 0.1}),
         ("linear_income_index", {}), ("linear_income_index", {"optimize_parameters": True}),
         ("trend_elasticity_blend", {}), ("trend_elasticity_blend", {"trend_weight": 1.0}),
         ("logistic_price", {}), ("logistic_price", {"apply_continuity_adjustment": False}),
         ("implied_price_logistic", {}), ("implied_price_logistic", {"ref_gdp_per_capita": 9000.0})]


@pytest.mark.parametrize("model, params", CASES)
def test_running_sums_equal_fits_made_anew(spark, panel, model, params):
    cutoffs = [2004, 2006, 2007, 2008, 2011, 2014, 2016, 2040]
    got = E.rolling_backtest(panel, model, cutoffs, 3, params)
    want = E._refitted_folds(panel, model, cutoffs, 3, params, ["series_id"])
    assert got.columns == want.columns
    assert rounded(got) == rounded(want)
    assert got.count() > 5


def test_cutoffs_counted_back(spark, panel):
    back = E.cutoffs_back([4, 2])
    got = E.rolling_backtest(panel, "linear_price", back, 2)
    assert rounded(got) == rounded(E._refitted_folds(panel, "linear_price", back, 2, None, ["series_id"]))


def test_models_that_are_no_running_sums_are_fitted_anew(spark, panel):
    assert not E.is_running("logistic_price", {"optimize_parameters": True})
    assert not E.is_running("implied_price_logistic", {"ref_year": 2007})
    assert not E.is_running("bootstrap_logistic", {})
    assert not E.is_running("linear_price", {"C1": F.col("x")})
    assert E.rolling_backtest(panel, "implied_price_logistic", [2010], 2, {"ref_year": 2007}).count() > 0


def test_one_shuffle_and_no_join(spark, panel):
    plan = E.rolling_backtest(panel.repartition(4), "trend_elasticity_blend", E.cutoffs_back([3, 2]), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_leaderboard_mixes_both_kinds(spark, panel):
    params = {"implied_price_logistic": {"ref_year": 2007}}
    got = E.backtest_leaderboard(panel.where("series_id < 3"), ["linear_price", "implied_price_logistic"], [2010, 2012], 2, params)
    ranks = {(r["series_id"], r["model"]): r["rank"] for r in got.collect()}
    assert set(ranks) == {(s, m) for s in (1, 2) for m in ("linear_price", "implied_price_logistic")} and set(ranks.values()) == {1, 2}
