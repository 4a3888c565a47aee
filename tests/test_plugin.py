"""Models given as Python functions: in the registry, comparisons and back-tests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate as E
from panelcast.operators import models as M
from panelcast.operators import plugin as PL
from panelcast.plans import forecast as R
from panelcast.sources.panel import synthetic_panel


def level_functions():
    """A fit and a prediction that are sent to the workers by value."""
    def fit_level(years, params):
        return {"level": params["times"] * float((years["actual"] / years["population"]).mean())}

    def predict_level(rows):
        if (rows["gdp"] < 0).any():
            raise ValueError("negative")
        return rows["level"] * rows["population"]

    return fit_level, predict_level


def level_model():
    return PL.plugin_model("level_per_head", *level_functions(), ["level"], {"times": 1.0}, drivers=("population",))


def test_a_plugin_runs_beside_built_in_models(spark):
    panel = synthetic_panel(spark, 6, 8)
    with R.registered(level_model()):
        fits, fc = R.compare_models(panel, ["linear_price", "level_per_head"], horizon=2)
        assert "level_per_head" in R.list_models()
    assert "level_per_head" not in R.list_models()
    data = panel.toPandas()
    rows = {r["series_id"]: r for r in fits.where("model = 'level_per_head'").collect()}
    assert len(rows) == 6 and fits.count() == 12
    for k, own in data.groupby("series_id"):
        own = own.sort_values("year")
        level = (own.actual / own.population).mean()
        pred, w = level * own.population.to_numpy(), np.arange(1, len(own) + 1)
        factor = (w * own.actual).sum() / (w * pred).sum()
        assert math.isclose(rows[k]["level"], level, rel_tol=1e-12) and math.isclose(rows[k]["continuity"], factor, rel_tol=1e-12)
        rmse = np.sqrt(np.mean((own.actual - pred * factor) ** 2))
        assert math.isclose(rows[k]["metrics"]["rmse"], rmse, rel_tol=1e-9, abs_tol=1e-9)
    ahead = fc.where("model = 'level_per_head'").collect()
    assert len(ahead) == 12
    for r in ahead:
        f = rows[r["series_id"]]
        assert math.isclose(r["pred"], f["level"] * r["population"] * f["continuity"], rel_tol=1e-12)


def test_two_shuffles_fit_a_plugin(spark):
    fits = level_model().fit(synthetic_panel(spark, 6, 8).repartition(4), {"times": 2.0})
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    own = level_model().fit(synthetic_panel(spark, 6, 8))
    one, two = ({r["series_id"]: r["level"] for r in x.collect()} for x in (own, fits))
    assert all(math.isclose(2 * one[k], two[k], rel_tol=1e-12) for k in one)


def test_failing_and_invalid_series_leave_the_others_alone(spark):
    def fit(years, params):
        if years["actual"].iloc[0] > 100:
            raise RuntimeError("too big")
        return {"level": 1.0}

    rows = [(1, y, 10.0, 5.0, 1.0, 1.0) for y in (2000, 2001, 2002)] + [(2, y, 500.0, 5.0, 1.0, 1.0) for y in (2000, 2001)]
    rows += [(3, 2000, 10.0, None, 1.0, 1.0), (4, 2000, 10.0, 5.0, -1.0, 1.0), (None, 2000, 10.0, 5.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id int, year int, actual double, population double, gdp double, price double")
    model = PL.plugin_model("own", fit, level_functions()[1], ["level"], drivers=("population",))
    with R.registered(model):
        fits, fc = R.forecast(df, "own", horizon=1)
        found = {r["series_id"]: r for r in fits.collect()}
        ahead = {r["series_id"]: r["pred"] for r in fc.collect()}
    assert {k: r["status"] for k, r in found.items()} == {1: "ok", 2: "error", 3: "invalid", 4: "ok", None: "ok"}
    assert found[2]["error"] == "RuntimeError: too big" and found[2]["metrics"] is None and found[1]["error"] is None
    # Series 4's prediction raises: its rows are null, the rows beside it are not.
    assert ahead.keys() == {1, 4, None} and ahead[4] is None and ahead[1] is not None and ahead[None] is not None


def test_a_plugin_is_back_tested(spark):
    panel = synthetic_panel(spark, 3, 10)
    with R.registered(level_model()):
        folds = E.rolling_backtest(panel, "level_per_head", E.cutoffs_back([3, 2]), 2).collect()
        ranked = E.backtest_leaderboard(panel, ["linear_price", "level_per_head"], E.cutoffs_back([3, 2]), 2).collect()
    data = panel.toPandas()
    assert len(folds) == 3 * 4 and len(ranked) == 6 and {r["rank"] for r in ranked} == {1, 2}
    for r in folds:
        own = data[(data.series_id == r["series_id"]) & (data.year <= r["cutoff"])].sort_values("year")
        level = (own.actual / own.population).mean()
        w = np.arange(1, len(own) + 1)
        factor = (w * own.actual).sum() / (w * level * own.population).sum()
        pop = own.population.iloc[-1] * 1.01 ** (r["year"] - r["cutoff"])
        assert math.isclose(r["pred"], level * factor * pop, rel_tol=1e-9)


def test_empty_panel_names_and_unknown_parameters(spark):
    empty = synthetic_panel(spark, 2, 5).where(F.lit(False))
    assert level_model().fit(empty).count() == 0
    with pytest.raises(ValueError):
        PL.plugin_model("own", *level_functions(), ["level", "gdp"])
    with pytest.raises(ValueError):
        level_model().fit(empty, {"nothing": 1.0})
    spec = R.ModelSpec("linear_price", M.fit_linear_price, None, {})
    before = R.get_model("linear_price")
    with R.registered(spec):
        assert R.get_model("linear_price") is spec
    assert R.get_model("linear_price") is before
