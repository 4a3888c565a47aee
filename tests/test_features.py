"""Quantiles of hot groups, bounded least squares, parameter and window relations,
sensitivity cells, nested documents, metric display."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import constants as K
from panelcast.functions import curve as C
from panelcast.functions import format as FM
from panelcast.operators import documents as D
from panelcast.operators import least_squares as L
from panelcast.operators import parameters as PR
from panelcast.operators import prepare as P
from panelcast.operators import quantiles as Q
from panelcast.operators import scenarios as X
from panelcast.operators.calibration import calibrate_saturation
from panelcast.plans.forecast import forecast
from panelcast.sources.panel import synthetic_panel, training_window_bounds
from tests.fixtures import INPUT, panel


@pytest.fixture(scope="module")
def skewed(spark):
    """One series holds most rows, some with many ties; one has nulls only."""
    rng = random.Random(3)
    rows = [(1, y, float(rng.choice([rng.randrange(6), rng.gauss(0, 1)])), None if rng.random() < 0.1 else rng.paretovariate(1.2), rng.choice("abc") if rng.random() < 0.9 else None)
            for y in range(6000)]
    rows += [(s, y, float(rng.randrange(9)), rng.random(), rng.choice(["x", None])) for s in (2, 3, None) for y in range(rng.randrange(3, 30))]
    rows += [(4, y, None, None, None) for y in range(2000)]
    return spark.createDataFrame(rows, "series_id bigint, year int, actual double, price double, label string").repartition(5)


def rows_of(df):
    return sorted((tuple(repr(x) for x in r) for r in df.collect()))


@pytest.mark.parametrize("probs", [(0.25, 0.75), (0.5,), (0.0, 0.999, 1.0)])
def test_split_quantiles_equal_the_plain_ones(skewed, probs):
    got = Q.group_quantiles(skewed, ["actual", "price"], probs, ["series_id"], hot_rows=500, accuracy=200)
    assert rows_of(got) == rows_of(Q._whole(skewed, ["actual", "price"], probs, ["series_id"]))


def test_cleaning_does_not_depend_on_the_split(skewed):
    for step in (P.impute, P.winsorize, P.iqr_outliers, P.validate_panel, P.clean_panel):
        assert rows_of(step(skewed, hot_rows=500)) == rows_of(step(skewed))


def test_cleaning_by_hand(skewed):
    table = skewed.toPandas()
    hot = table[table.series_id == 1]
    got = P.impute(skewed, hot_rows=500).where("series_id = 1").toPandas().set_index("year").sort_index()
    want = hot.price.fillna(hot.price.median())
    assert np.array_equal(got.price.to_numpy(), want.set_axis(hot.year).sort_index().to_numpy())
    assert set(got.label[hot.label.isna().set_axis(hot.year)]) == {sorted(hot.label.dropna().value_counts().items(), key=lambda x: (-x[1], x[0]))[0][0]}
    years = P.validate_panel(skewed.unionAll(skewed.where("series_id = 2")), hot_rows=500).where("rule = 'duplicate_years' AND n > 0").collect()
    assert [(r["series_id"], r["n"]) for r in years] == [(2, skewed.where("series_id = 2").count())]


def test_least_squares_beats_the_grid(spark):
    p = synthetic_panel(spark, 30, n_years=20).unionByName(panel(spark, INPUT).withColumn("series_id", F.lit(1000).cast("bigint")))
    grid = {r["series_id"]: r for r in calibrate_saturation(p, rounds=1).collect()}
    fine = {r["series_id"]: r for r in calibrate_saturation(p, rounds=4).collect()}
    found = {r["series_id"]: r for r in L.calibrate_bounded(p.repartition(3)).collect()}
    assert set(found) == set(grid)
    for s, r in found.items():
        assert K.CALIB_K1_LO <= r["k1"] <= K.CALIB_K1_HI and K.CALIB_K2_LO <= r["k2"] <= K.CALIB_K2_HI
        assert r["sse"] <= grid[s]["sse"] * (1 + 1e-12) + 1e-6 and r["sse"] <= r["sse_start"] * (1 + 1e-12)
        assert r["sse"] <= fine[s]["sse"] * (1 + 1e-6) + 1e-6
        assert math.isclose(r["sse_start"], grid[s]["sse_start"], rel_tol=1e-9)


def test_least_squares_finds_a_known_curve(spark):
    true = (-3.0, 0.8)
    rows = []
    for i in range(25):
        r = 0.1 + 0.08 * i
        f = float(C.saturation_np(np.array([r]), 2.0, 0.0, *true)[0])
        rows.append((1, 2000 + i, 1000.0 * f, 1000.0, 1000.0, 1000.0 * r))
    rows += [(2, 2000, None, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "series_id bigint, year int, actual double, population double, gdp double, price double")
    found = {r["series_id"]: r for r in L.calibrate_bounded(p, {"distribution_a": 2.0, "distribution_b": 0.0, "full_price_scale": 1.0}).collect()}
    assert found[1]["k1"] == pytest.approx(true[0], rel=1e-5) and found[1]["k2"] == pytest.approx(true[1], rel=1e-5)
    assert found[2]["sse"] is None and found[2]["k1"] == K.LOGISTIC_PRICE_DEFAULTS["k1"]


def test_parameters_by_precedence(spark):
    series = spark.createDataFrame([(1, "North"), (2, "North  East"), (3, None), (4, "West")], "series_id bigint, source string")
    rows = [(None, " North ", "C1", "-1", 3), (None, "North", "C1", "-2", 1), (None, "North East", "C1", "abc", 1), (None, "Nowhere", "C1", "5", 1),
            (1, None, "C2", "0.9", 1), (1, None, "C2", "0.1", 0), (4, "West", "C1", " 7 ", 2), (None, "West", "C1", "8", 0), (3, None, "other", "1", 0)]
    params = spark.createDataFrame(rows, "series_id bigint, source string, name string, value string, ord bigint")
    got = {r["series_id"]: (r["p_C1"], r["p_C2"]) for r in PR.resolve_params(series, params, {"C1": -0.5, "C2": 0.5}).collect()}
    assert math.isnan(got[2][0]) and got[2][1] == 0.5
    assert {k: v for k, v in got.items() if k != 2} == {1: (-2.0, 0.1), 3: (-0.5, 0.5), 4: (7.0, 0.5)}


def test_series_fit_with_their_own_parameters(spark):
    both = panel(spark, INPUT).unionAll(panel(spark, INPUT).withColumn("series_id", F.col("series_id") + 1))
    first = both.first()["series_id"]
    resolved = spark.createDataFrame([(first, -0.4, 0.5), (first + 1, -0.2, 0.6)], "series_id bigint, p_C1 double, p_C2 double")
    rows, named = PR.with_params(both, resolved)
    _, fc = forecast(rows, "linear_price", named, 3)
    for k, (c1, c2) in ((first, (-0.4, 0.5)), (first + 1, (-0.2, 0.6))):
        _, alone = forecast(both.where(F.col("series_id") == k), "linear_price", {"C1": c1, "C2": c2}, 3)
        assert [r["pred"] for r in fc.where(F.col("series_id") == k).orderBy("year").collect()] == [r["pred"] for r in alone.orderBy("year").collect()]


def test_windows_by_series(spark):
    rows = [(s, y) for s in (1, 2, 3, 4, None) for y in range(2000, 2004)] + [(5, None)]
    p = spark.createDataFrame(rows, "series_id bigint, year int")
    bounds = spark.createDataFrame([(1, 2001, 2002), (2, None, 2000), (3, 2005, None), (None, 2003, None), (6, 2000, 2001), (4, 2003, 2001)], "series_id bigint, first_year int, last_year int")
    got = sorted(map(tuple, training_window_bounds(p, bounds).collect()), key=str)
    want = [(1, 2001, "ok"), (1, 2002, "ok"), (2, 2000, "ok"), (3, None, "empty_window"), (None, 2003, "ok"), (6, None, "empty_window"), (4, None, "bad_bounds"), (5, None, "empty_window")]
    assert got == sorted(want, key=str)


def test_cells_and_failed_cells(spark):
    p = panel(spark, INPUT).unionAll(panel(spark, INPUT[:1]).withColumn("series_id", F.lit(99).cast("bigint")))
    cells = X.sensitivity_cells(p, "logistic_price", ("k2", [0.5, 1.0]), ("gdp_growth_rate", [0.01, 0.02, 0.03]), horizon=4)
    rows = {(r["series_id"], r["i"], r["j"]): r for r in cells.collect()}
    assert len(rows) == 12
    for (s, i, j), r in rows.items():
        if s == 99:
            assert r["error"] == "too_short" and r["final_prediction"] is None and r["impact_pct"] is None
            continue
        _, fc = forecast(p.where(F.col("series_id") == s), "logistic_price", {"k2": [0.5, 1.0][i], "gdp_growth_rate": [0.01, 0.02, 0.03][j]}, 4)
        assert r["final_prediction"] == pytest.approx(fc.orderBy(F.desc("year")).first()["pred"], rel=1e-12)
        base = rows[s, 0, 0]["final_prediction"]
        assert r["error"] is None and r["impact_pct"] == pytest.approx(100 * (r["final_prediction"] - base) / base)
    assert len({r["impact_pct"] for r in rows.values()}) > 1
    with pytest.raises(ValueError, match="switch"):
        X.sensitivity_cells(p, "logistic_price", ("apply_continuity_adjustment", [0, 1]), ("k2", [1]))


def docs_of(spark, *documents):
    return spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "series_id bigint, document string")


def test_comparison_documents_of_unlike_shapes(spark):
    full = {"model": "a", "metrics": {"rmse": 1, "RMSE": 9, "mae": 2.5, "mape": None, "R2": 0.5},
            "diagnostics": {"scores": {"global": 80, "stability": 70.25}, "continuity": {"gapPct": -3}, "risk": "low"}}
    docs = docs_of(spark, {"comparison": [full, {"model": "b", "error": "failed"}, 7, "x"], "results": [{"model": "no"}]}, {"results": [{"metrics": []}]},
                   {"comparison": "none"}, "no json", None, [1], {"comparison": [{"model": "c", "diagnostics": {"scores": 1, "risk": 3}}]})
    got = sorted((tuple(r) for r in D.comparison_records(docs).collect()), key=str)
    assert got == sorted([(0, "a", 1.0, 2.5, None, 0.5, 80.0, None, 70.25, -3.0, "low", None), (0, "b", *[None] * 9, "failed"),
                          (1, "", *[None] * 10), (6, "c", *[None] * 8, "3", None)], key=str)


def test_backtest_documents_of_unlike_shapes(spark):
    model = {"model": "a", "mode": "rolling", "cutoffYear": 2010, "testStart": 2011, "folds": [{"cutoff": 2010, "rmse": 1.5}, {"cutoff": 2011, "mode": "own"}, 3], "summary": {"RMSE": 4}}
    docs = docs_of(spark, {"models": [model, {"model": "b"}, None]}, {"folds": [{"cutoff": 1, "model": "z"}, []]}, {"models": []}, None)
    assert sorted(map(tuple, D.backtest_summaries(docs).collect()), key=str) == [
        (0, "a", "rolling", 2010, 2011, None, 3, 4.0, None, None, None, None), (0, "b", "", None, None, None, 0, *[None] * 5)]
    folds = D.backtest_folds(docs, {"cutoff": "int", "rmse": "double"})
    assert sorted(map(tuple, folds.collect()), key=str) == [(0, "a", "own", 2011, None), (0, "a", "rolling", 2010, 1.5), (1, "z", None, 1, None)]


def test_metric_display(spark):
    df = spark.createDataFrame([(1.23456, None), (float("nan"), 2.0), (float("inf"), None), (-0.0005, None)], "rmse double, MAE double")
    shown = df.select(FM.display_metric(FM.metric_value(df, ["rmse"])).alias("a"), FM.display_metric(FM.metric_value(df, ["mae_", "MAE"])).alias("b"), FM.display_metric(FM.metric_value(df, ["x"])).alias("c"))
    assert [tuple(r) for r in shown.collect()] == [("1.235", "n/a", "n/a"), ("n/a", "2.000", "n/a"), ("n/a", "n/a", "n/a"), ("-0.001", "n/a", "n/a")]


def test_models_fitted_together_equal_their_own_fits(spark):
    from panelcast.operators import models as M
    panel = synthetic_panel(spark, 12, 9)
    bad = panel.withColumn("actual", F.when((F.col("series_id") == 3) & (F.col("year") % 4 == 0), F.lit(None)).otherwise(F.col("actual")))
    bad = bad.where((F.col("series_id") != 5) | (F.col("year") == 2000)).repartition(4)
    asked = {"logistic_price": None, "linear_price": {"optimize_parameters": True}, "linear_income_index": {"C1": 0.3}, "trend_elasticity_blend": None,
             "implied_price_logistic": {"ref_elasticity": -0.7}}
    together = M.fit_together(bad, asked)
    # One shuffle for all five: neither a model's windows nor its aggregate add one.
    assert together._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for model, params in asked.items():
        own, read = M.FITTERS[model](bad, params), M.fits_of(together, model)
        assert own.columns == read.columns
        a, b = ({r["series_id"]: r.asDict(True) for r in x.collect()} for x in (own, read))
        assert a.keys() == b.keys()
        for k in a:
            for c in own.columns:
                x, y = a[k][c], b[k][c]
                xs, ys = (x.values(), y.values()) if isinstance(x, dict) else ([x], [y])
                for u, v in zip(xs, ys, strict=True):
                    assert u == v or u != u or abs(u - v) <= 1e-9 * max(1.0, abs(u)), (model, k, c)
    assert not M.fits_together("implied_price_logistic", {"ref_elasticity": F.lit(-1.0)})
    assert not M.fits_together("logistic_price", {"optimize_parameters": True})


def test_sketched_quantiles_of_a_million_simulations_keep_their_rank_error(spark):
    n, probs = 1_000_000, [0.05, 0.25, 0.5, 0.75, 0.95]
    value = F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double")
    sims = spark.range(n, numPartitions=8).select(F.lit(1).alias("series_id"), (F.col("id") % 2).alias("run"), (value * value).alias("pred"))
    one = Q.sketches(sims, ["series_id"], "pred")
    two = Q.merge_sketches(Q.sketches(sims, ["series_id", "run"], "pred"), ["series_id"])
    exact = np.sort(sims.select("pred").toPandas()["pred"].to_numpy())
    for found in (one, two):
        row = found.select("n", "mean", F.octet_length("sketch").alias("size"), Q.sketch_quantiles(probs).alias("q")).first()
        assert row["n"] == n and math.isclose(row["mean"], exact.mean(), rel_tol=1e-9)
        assert row["size"] < 32_000  # bounded whatever the number of simulations
        for p, q in zip(probs, row["q"], strict=True):
            assert abs(np.searchsorted(exact, q) / n - p) <= 2 * Q.rank_error()


def test_sketched_quantiles_of_few_values_are_exact(spark):
    rows = [(1, float(v)) for v in range(1, 101)] + [(2, 5.0), (2, 5.0), (2, None), (3, None), (None, 7.0), (4, float("nan"))]
    found = Q.sketches(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").select("k", "n", Q.sketch_quantiles([0.05, 0.5, 1.0]).alias("q"))
    assert {r["k"]: (r["n"], r["q"]) for r in found.collect()} == {1: (100, [5.0, 50.0, 100.0]), 2: (2, [5.0, 5.0, 5.0]), None: (1, [7.0, 7.0, 7.0])}


def test_bootstrap_bands_from_sketches(spark):
    params = {"n_simulations": 60}
    exact = forecast(synthetic_panel(spark, 1, 12), "bootstrap_logistic", params, 2)[1]
    sketched = forecast(synthetic_panel(spark, 1, 12), "bootstrap_logistic", {**params, "sketch": True}, 2)[1]
    assert exact.columns == sketched.columns
    for a, b in zip(exact.orderBy("year").collect(), sketched.orderBy("year").collect(), strict=True):
        assert math.isclose(a["pred"], b["pred"], rel_tol=1e-12) and a["population"] == b["population"]
        width = a["upper"] - a["lower"]
        for c in ("lower", "q25", "q75", "upper"):  # an order statistic beside an interpolated one
            assert abs(a[c] - b[c]) <= 0.25 * width
