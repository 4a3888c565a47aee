"""Golden values: the five closed-form models reproduce the stored
spreadsheet-validation predictions (relative tolerance 1e-9)."""

import pytest
from pyspark.sql import functions as F

from panelcast.operators import horizon as H
from panelcast.operators import models as M
from tests.fixtures import EXPECTED_PATH, FULL, FULL_INPUT, GOLDEN, INDEXED, INPUT, LINEAR, panel

HORIZON = 32


def _forecast(spark, model):
    if model == "logistic_price":
        fits = M.fit_logistic_price(panel(spark, FULL_INPUT), dict(FULL))
        return H.predict_logistic_price(fits, HORIZON, apply_continuity_adjustment=False)
    if model == "linear_price":
        return H.predict_linear_price(M.fit_linear_price(panel(spark, INPUT), dict(LINEAR)), HORIZON)
    if model == "linear_income_index":
        return H.predict_linear_income_index(M.fit_linear_income_index(panel(spark, INPUT), dict(LINEAR)), HORIZON)
    if model == "trend_elasticity_blend":
        fits = M.fit_trend_elasticity_blend(panel(spark, INPUT), {"trend_weight": 0.5})
        return H.predict_trend_elasticity_blend(fits, HORIZON)
    fits = M.fit_implied_price_logistic(panel(spark, INPUT), dict(INDEXED))
    return H.predict_implied_price_logistic(fits, HORIZON)


@pytest.mark.parametrize("model", sorted(GOLDEN))
def test_golden_every_year(spark, model):
    got = {r["year"]: r["pred"] for r in _forecast(spark, model).select("year", "pred").collect()}
    for year, value in enumerate(GOLDEN[model], start=2018):
        assert got[year] == pytest.approx(value, rel=1e-9), (model, year)


def test_implied_price_threshold_constants(spark):
    fits = M.fit_implied_price_logistic(panel(spark, INPUT), dict(INDEXED)).first()
    assert fits["calib_k2"] == pytest.approx(0.6636252853715, rel=1e-10)
    assert fits["calib_k1"] == pytest.approx(0.30541962998204, rel=1e-10)
    assert fits["last_t"] == pytest.approx(1.00020305536163, rel=1e-10)


def test_blend_and_recent_factors(spark):
    blend = M.fit_trend_elasticity_blend(panel(spark, INPUT), {"trend_weight": 0.5}).first()
    assert blend["continuity"] == pytest.approx(1.00464075565425, rel=1e-10)
    assert blend["trend_slope"] == pytest.approx(0.00153757, rel=1e-5)
    assert blend["elast_slope"] == pytest.approx(-0.03415326, rel=1e-5)
    full = M.fit_logistic_price(panel(spark, FULL_INPUT), dict(FULL)).first()
    assert full["continuity"] == pytest.approx(0.99885221521363, rel=1e-10)


def test_implied_price_on_expected_path_shift_zero(spark):
    """With the expected file's own population and GDP path (X5) and no year
    shift, the implied-price model reproduces the spreadsheet column."""
    paths = spark.createDataFrame([(1, y, p, g) for y, p, g, _ in EXPECTED_PATH],
                                  "series_id BIGINT, year INT, population DOUBLE, gdp DOUBLE")
    fits = M.fit_implied_price_logistic(panel(spark, INPUT), dict(INDEXED))
    fc = H.predict_implied_price_logistic(fits, HORIZON, paths=paths)
    got = {r["year"]: r["pred"] for r in fc.collect()}
    errs = [abs(got[y] - v) for y, _, _, v in EXPECTED_PATH]
    assert sum(errs) / len(errs) < 5e-5
    assert max(errs) < 5e-5 * 10
