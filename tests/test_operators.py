"""Unit, edge and property tests of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from panelcast.functions import curve as C
from panelcast.operators import bootstrap as B
from panelcast.operators import evaluate as E
from panelcast.operators import horizon as H
from panelcast.operators import models as M
from panelcast.operators import prepare as P
from panelcast.operators.calibration import calibrate_saturation
from panelcast.operators.prepare import load_panel
from panelcast.plans.forecast import compare_models, forecast, list_models
from tests.fixtures import INPUT, LINEAR, PANEL_SCHEMA, panel

A, Bc, Cc, D = 1.1572, 4.3517429, -6.59917386, 0.39546328


def _rows(spark, rows):
    return spark.createDataFrame(rows, PANEL_SCHEMA)


def test_inverse_roundtrip(spark):
    df = spark.range(1, 300).select((F.col("id") / F.lit(100.0)).alias("r"))
    df = df.select("r", C.saturation(F.col("r"), A, Bc, Cc, D).alias("f"))
    # only where the curve is not clamped at 0 or 1
    out = df.where("f > 1e-9 AND f < 1 - 1e-9").select(
        "r", C.inverse_saturation(F.col("f"), A, Bc, Cc, D).alias("back")).collect()
    assert len(out) > 100
    for row in out:
        assert row["back"] == pytest.approx(row["r"], rel=1e-7)


def test_threshold_roundtrip(spark):
    df = spark.createDataFrame([(-0.3,), (-0.8,), (-1.728566864526717,), (-2.5,)], "t double")
    out = df.select("t", C.elasticity_threshold(F.col("t"), A, Bc, Cc, D).alias("r"))
    out = out.select("t", C.elasticity(F.col("r"), A, Bc, Cc, D).alias("e")).collect()
    for row in out:
        assert row["e"] == pytest.approx(row["t"], abs=1e-9)


def test_threshold_unreachable_is_null_and_status(spark):
    df = spark.createDataFrame([(5.0,)], "t double")
    assert df.select(C.elasticity_threshold(F.col("t"), A, Bc, Cc, D).alias("r")).first()["r"] is None
    fits = M.fit_implied_price_logistic(panel(spark, INPUT), {"ref_elasticity": 5.0}).first()
    assert fits["status"] == "no_threshold"


def test_partition_count_does_not_change_results(spark):
    p = panel(spark, INPUT)
    many = p.unionByName(p.withColumn("series_id", F.lit(2).cast("bigint")))
    a = {r["series_id"]: r["continuity"] for r in M.fit_trend_elasticity_blend(many.repartition(1)).collect()}
    b = {r["series_id"]: r["continuity"] for r in M.fit_trend_elasticity_blend(many.repartition(7, "year")).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_copies_of_one_series_give_equal_results(spark):
    base = panel(spark, INPUT)
    copies = base.select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("series_id"),
                         *[c for c in base.columns if c != "series_id"])
    fc = H.predict_linear_price(M.fit_linear_price(copies, dict(LINEAR)), 3)
    per_year = fc.groupBy("year").agg(F.countDistinct(F.round("pred", 9)).alias("k"), F.count("*").alias("n")).collect()
    assert all(r["k"] == 1 and r["n"] == 5 for r in per_year)


def test_too_short_series_has_status_and_no_forecast(spark):
    """Only the recent-window factor needs three years; the other models fit two."""
    p = _rows(spark, [(1, *INPUT[i]) for i in range(13)] + [(9, *INPUT[i]) for i in range(2)])
    for model, short in (("logistic_price", "too_short"), ("linear_price", "ok"), ("linear_income_index", "ok"),
                         ("trend_elasticity_blend", "ok"), ("implied_price_logistic", "ok")):
        fits, fc = forecast(p, model, horizon=3)
        assert {r["series_id"]: r["status"] for r in fits.collect()} == {1: "ok", 9: short}, model
        assert fc.where("series_id = 9").count() == (0 if short == "too_short" else 3), model


@pytest.mark.parametrize("column, value, spared", [("year", None, ()), ("actual", None, ()), ("actual", -1.0, ()),
                                                   ("gdp", None, ()), ("population", None, ()),
                                                   ("price", None, ("linear_income_index", "trend_elasticity_blend",
                                                                    "implied_price_logistic"))])
def test_missing_values_make_a_fit_invalid_not_invented(spark, column, value, spared):
    at = ["year", "actual", "population", "gdp", "price"].index(column)
    rows = [list(r) for r in INPUT]
    rows[-1][at] = value
    p = _rows(spark, [(1, *r) for r in rows] + [(2, *r) for r in INPUT])
    for model in ("logistic_price", "linear_price", "linear_income_index", "trend_elasticity_blend", "implied_price_logistic",
                  "bootstrap_logistic"):
        fits, fc = forecast(p, model, {"n_simulations": 5} if model == "bootstrap_logistic" else None, horizon=2)
        got = {r["series_id"]: (r["status"], r["metrics"]) for r in fits.collect()}
        assert got[2][0] == "ok"
        assert got[1][0] == ("ok" if model in spared else "invalid"), model
        assert (got[1][1] is None) == (model not in spared)
        assert fc.where("series_id = 1").count() == (2 if model in spared else 0)


def test_curve_functions_keep_nulls(spark):
    row = spark.range(1).select(F.lit(None).cast("double").alias("x")).select(
        C.clamp(F.col("x"), 0.0, 1.0), C.saturation(F.col("x"), 1.1, 4.3, -6.5, 0.4), C.elasticity(F.col("x"), 1.1, 4.3, -6.5, 0.4),
        C.inverse_saturation(F.col("x"), 1.1, 4.3, -6.5, 0.4), C.clipped_index(F.col("x"))).first()
    assert list(row) == [None] * 5


def test_parameters_reach_the_prediction(spark):
    p = _rows(spark, [(1, *r) for r in INPUT])
    value = lambda params: [r["pred"] for r in forecast(p, "logistic_price", params, 3)[1].orderBy("year").collect()]
    assert value({"apply_continuity_adjustment": False}) != value({})
    assert value({"gdp_growth_rate": 0.0}) != value({"gdp_growth_rate": 0.05})
    bands = {r["band_type"] for r in forecast(p, "logistic_price", {"monte_carlo_simulations": 500}, 2)[1].collect()}
    assert bands == {"residual_sigma_95"}
    with pytest.raises(ValueError, match="unknown parameter"):
        forecast(p, "linear_price", {"no_such": 1})
    with pytest.raises(ValueError, match="optimise"):
        forecast(p, "trend_elasticity_blend", {"optimize_parameters": True})


def test_comparison_of_all_models_with_another_key(spark):
    p = _rows(spark, [(1, *r) for r in INPUT]).withColumnRenamed("series_id", "route")
    fits, fc = compare_models(p, params={"bootstrap_logistic": {"n_simulations": 5}}, horizon=2, keys=("route",))
    assert {r["model"] for r in fits.collect()} == set(list_models()) == {r["model"] for r in fc.collect()}
    assert fc.where("route IS NULL OR fit_rmse IS NULL").count() == 0
    board = E.leaderboard(fits, fc, keys=("route",)).collect()
    assert sorted(r["rank"] for r in board) == list(range(1, 7)) and all(r["interval_width"] is not None for r in board)


def test_backtest_of_the_bootstrap(spark):
    p = _rows(spark, [(1, *r) for r in INPUT])
    rows = E.rolling_backtest(p, "bootstrap_logistic", E.cutoffs_back([3, 2]), 2, {"n_simulations": 5}).collect()
    last = max(r[0] for r in INPUT)
    assert {(r["cutoff"], r["year"]) for r in rows} == {(last - 3, last - 2), (last - 3, last - 1), (last - 2, last - 1), (last - 2, last)}


def test_diagnostics_of_lists_and_scalars(spark):
    df = spark.createDataFrame([(1, '{"a":{"x":1,"y":["p","q"]},"warnings":["w1","w2"],"risk":"high","none":null}')], "series_id bigint, diagnostics string")
    rows = {(r["section"], r["metric"]): r["value"] for r in E.diagnostics_rows(df).collect()}
    assert rows == {("a", "x"): "1", ("a", "y"): "p; q", ("warnings", "value"): "w1; w2", ("risk", "value"): "high", ("none", "value"): None}


def test_repeated_headers_and_missing_columns(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("year;year;y\n2001;1;5\n2002;2;6\n")
    panel, checks, _ = load_panel(spark, str(f))
    assert "year_2" in panel.columns and panel.select("actual").first()[0] == 5.0
    g = tmp_path / "b.csv"
    g.write_text("year;prix\n2001;1\n")
    _, checks, _ = load_panel(spark, str(g))
    assert [(r["rule"], r["severity"]) for r in checks.collect()] == [("missing_actual_passengers", "error")]


def test_constant_index_is_degenerate(spark):
    rows = [(1, y, 10.0 + i, 100.0, 500.0, 50.0) for i, y in enumerate(range(2000, 2008))]
    fits = M.fit_linear_income_index(_rows(spark, rows), {"optimize_parameters": True}).first()
    assert fits["status"] == "degenerate"


def test_null_price_uses_reference_price(spark):
    rows = [(1, *r) for r in INPUT]
    rows[5] = (1, rows[5][1], rows[5][2], rows[5][3], rows[5][4], None)
    fits = M.fit_trend_elasticity_blend(_rows(spark, rows)).first()
    assert fits["status"] == "ok" and math.isfinite(fits["continuity"])


def test_zero_population_is_guarded(spark):
    rows = [(1, *r) for r in INPUT]
    rows[3] = (1, rows[3][1], rows[3][2], 0.0, rows[3][4], rows[3][5])
    for fit in (M.fit_linear_price, M.fit_linear_income_index, M.fit_implied_price_logistic, M.fit_logistic_price):
        assert fit(_rows(spark, rows)).count() == 1


def test_duplicate_year_is_invalid_and_reported(spark):
    rows = [(1, *r) for r in INPUT] + [(1, *INPUT[4])]
    p = _rows(spark, rows)
    assert M.fit_linear_price(p).first()["status"] == "invalid"
    checks = {r["rule"]: r["n"] for r in P.validate_panel(p).collect()}
    assert checks["duplicate_years"] == 1


def test_non_integer_year_is_reported(spark):
    df = spark.createDataFrame([(1, 2004.0, 1.0), (1, 2004.5, 2.0), (1, 2006.0, 3.0)],
                               "series_id bigint, year double, actual double")
    checks = {r["rule"]: r["n"] for r in P.validate_panel(df).collect()}
    assert checks["year_not_integer"] == 1 and checks["year_converted"] == 3


def test_negative_count_ignores_nulls(spark):
    df = spark.createDataFrame([(1, 2000, -1.0), (1, 2001, None), (1, 2002, 3.0)],
                               "series_id bigint, year int, actual double")
    checks = {r["rule"]: r["n"] for r in P.validate_panel(df).collect()}
    assert checks["negative_actual"] == 1 and checks["null_actual"] == 1


def test_delimited_source_locale_and_types(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("Annee;Passagers;Prix;Note\n2001;1234,5;10;a\n2002;;12,5;b\n2003;1500;x;\n")
    df = P.normalize_column_names(__import__("panelcast.sources.delimited", fromlist=["x"]).read_delimited(spark, str(f)))
    assert df.columns == ["year", "actual_passengers", "ticket_price", "note"]
    types = dict(df.dtypes)
    assert types["year"] == "double" and types["actual_passengers"] == "double"
    assert types["ticket_price"] == "string"          # one text cell keeps the column textual
    vals = [r["actual_passengers"] for r in df.orderBy("year").collect()]
    assert vals == [1234.5, None, 1500.0]             # nulls keep the column numeric


def test_name_normalisation_suffixes_repeats():
    assert P.normalise_names([" Year", "date", "PIB", "fare", "y", "pop"]) == [
        "year", "year_2", "gdp_per_capita", "ticket_price", "actual_passengers", "population"]


def test_impute_median_and_winsorize_bounds(spark):
    rows = [(1, 2000 + i, float(v), 1.0, 1.0, 1.0) for i, v in enumerate([1, 2, 3, 4, 100])]
    rows.append((1, 2005, None, 1.0, 1.0, 1.0))
    p = _rows(spark, rows)
    imp = {r["year"]: r["actual"] for r in P.impute(p).collect()}
    assert imp[2005] == 3.0
    win = {r["year"]: r["actual"] for r in P.winsorize(p).collect()}
    assert win[2004] == pytest.approx(4 + 1.5 * 2) and win[2005] is None


def test_unknown_parameter_rejected(spark):
    with pytest.raises(ValueError):
        M.fit_linear_price(panel(spark, INPUT), {"trend_weight": 0.5})


def test_pct_error_null_when_expected_zero(spark):
    fc = spark.createDataFrame([(1, "m", 2001, 5.0)], "series_id bigint, model string, year int, pred double")
    ex = spark.createDataFrame([(1, 2001, 0.0)], "series_id bigint, year int, expected double")
    row = E.compare_forecast(fc, ex).first()
    assert row["pct_error"] is None and row["abs_error"] == 5.0


def test_calibration_never_worse_than_start(spark):
    best = calibrate_saturation(panel(spark, INPUT), rounds=3).first()
    assert best["sse"] <= best["sse_start"] + 1e-6


def test_bootstrap_quantiles_ordered(spark):
    fits = B.fit_bootstrap_logistic(panel(spark, INPUT), {"optimize_parameters": True, "n_simulations": 40})
    fc = B.predict_bootstrap_logistic(fits, 4).collect()
    assert len(fc) == 4
    for r in fc:
        assert r["lower"] <= r["q25"] <= r["q75"] <= r["upper"]


def test_bootstrap_repeatable(spark):
    p = panel(spark, INPUT)
    a = B.fit_bootstrap_logistic(p, {"optimize_parameters": True, "n_simulations": 30}).first()
    b = B.fit_bootstrap_logistic(p.repartition(3), {"optimize_parameters": True, "n_simulations": 30}).first()
    assert a["k1"] == b["k1"] and a["k2"] == b["k2"]


def test_model_compatibility_per_series(spark):
    rows = [(1, 2000 + i, 1.0, 1.0, 1.0, 1.0) for i in range(3)] + [(2, 2000 + i, 1.0, 1.0, 1.0, None) for i in range(3)]
    out = {(r["series_id"], r["model"]): r for r in P.model_compatibility(_rows(spark, rows)).collect()}
    assert out[(1, "linear_price")]["is_compatible"]
    assert out[(2, "linear_price")]["missing_columns"] == "ticket_price"
    assert out[(2, "linear_price")]["compatibility_score"] == 75.0
    assert out[(2, "linear_income_index")]["is_compatible"]


def test_numpy_curve_equals_spark_curve(spark):
    import numpy as np
    df = spark.range(0, 400).select((F.col("id") / F.lit(97.0)).alias("r"))
    got = df.select("r", C.saturation(F.col("r"), A, Bc, Cc, D).alias("f")).toPandas()
    want = C.saturation_np(got["r"].to_numpy(), A, Bc, Cc, D)
    assert np.allclose(got["f"].to_numpy(), want, rtol=1e-12, atol=1e-13)


def test_bootstrap_engines_agree(spark):
    p = panel(spark, INPUT)
    params = {"optimize_parameters": True, "n_simulations": 70}
    a = B.fit_bootstrap_logistic(p, params, engine="numpy").first()
    b = B.fit_bootstrap_logistic(p, params, engine="jvm").first()
    assert a["k1"] == pytest.approx(b["k1"], rel=1e-12) and a["k2"] == pytest.approx(b["k2"], rel=1e-12)
    assert [s["k1"] for s in a["samples"]] == [s["k1"] for s in b["samples"]]


def test_logistic_with_calibration_not_worse_than_defaults(spark):
    p = panel(spark, INPUT)
    opt = M.fit_logistic_price(p, {"optimize_parameters": True}).first()
    assert opt["status"] == "ok" and -20 <= opt["k1"] <= 20 and 0.01 <= opt["k2"] <= 5


def test_long_zoom_chain_checkpoints(spark):
    best = calibrate_saturation(panel(spark, INPUT), rounds=6, checkpoint_every=2).first()
    assert best["sse"] <= best["sse_start"] + 1e-6


def test_portable_draw_matches_sql_engine(spark):
    import duckdb
    import random
    from panelcast.functions.draws import uniform
    rnd = random.Random(7)
    keys = [(rnd.randrange(10**6), rnd.randrange(1000), rnd.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame(keys, "s bigint, sim int, slot int")
    got = {(r["s"], r["sim"], r["slot"]): r["u"] for r in
           df.select("s", "sim", "slot", uniform(F.col("s"), F.col("sim"), F.col("slot"), 42).alias("u")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE k(s BIGINT, sim INTEGER, slot INTEGER)")
    con.executemany("INSERT INTO k VALUES (?, ?, ?)", keys)
    rows = con.execute("SELECT s, sim, slot, CAST(('0x' || substr(md5(concat_ws('|', s, sim, slot, 42)), 1, 8)) AS BIGINT)"
                       " / 4294967296.0 FROM k").fetchall()
    for s, sim, slot, u in rows:
        assert got[(s, sim, slot)] == u
    vals = list(got.values())
    assert all(0.0 <= v < 1.0 for v in vals) and 0.4 < sum(vals) / len(vals) < 0.6
