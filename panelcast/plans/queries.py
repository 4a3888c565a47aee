"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
whose columns and rounding match the DuckDB oracle of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import horizon as H
from ..operators import models as M
from .common import HOLDOUT_YEARS, HORIZON, flat_metrics, rounded, train_panel
from ..sources.panel import demand_panel

FIT_OUT = ["series_id", "model", "status", "n_years", "last_year", "continuity", "mae", "mse", "rmse", "mape", "r2"]
FC_OUT = ["series_id", "model", "scenario_id", "year", "population", "gdp", "price", "pred", "lower", "upper",
          "growth_rate", "band_type"]


def q_demand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand_panel(spark, sf_dir))


def q_fit_linear_price(spark, sf_dir):
    fits = M.fit_linear_price(train_panel(spark, sf_dir))
    return rounded(flat_metrics(fits).select(*FIT_OUT[:5], "c1", "c2", *FIT_OUT[5:]))


def q_forecast_linear_price(spark, sf_dir):
    fits = M.fit_linear_price(train_panel(spark, sf_dir))
    return rounded(H.predict_linear_price(fits, HORIZON).select(*FC_OUT))


def _fit_out(fits, *middle):
    return rounded(flat_metrics(fits).select(*FIT_OUT[:5], *middle, *FIT_OUT[5:]))


def q_fit_logistic_price(spark, sf_dir):
    return _fit_out(M.fit_logistic_price(train_panel(spark, sf_dir)), "k1", "k2")


def q_forecast_logistic_price(spark, sf_dir):
    fits = M.fit_logistic_price(train_panel(spark, sf_dir))
    return rounded(H.predict_logistic_price(fits, HORIZON).select(*FC_OUT))


def q_residual_band(spark, sf_dir):
    """B2: the residual-sigma band of the saturation model."""
    fits = M.fit_logistic_price(train_panel(spark, sf_dir))
    return rounded(H.predict_logistic_price(fits, HORIZON, monte_carlo_simulations=1).select(*FC_OUT))


def q_anchor_columns(spark, sf_dir):
    """A3: continuity anchor columns of the saturation model's forecast."""
    fits = M.fit_logistic_price(train_panel(spark, sf_dir))
    fc = H.predict_logistic_price(fits, HORIZON, with_anchor=True)
    return rounded(fc.select("series_id", "model", "scenario_id", "year", "pred", "pred_raw", "pred_adjusted",
                             "lower_adjusted", "upper_adjusted", "anchor_factor", "anchor_reference",
                             "anchor_gap", "anchor_gap_pct", "anchor_applied"))


def q_fit_income_index(spark, sf_dir):
    return _fit_out(M.fit_linear_income_index(train_panel(spark, sf_dir)), "c1", "c2")


def q_fit_income_index_ols(spark, sf_dir):
    """M4 + M5: C1, C2 by least squares per series."""
    fits = M.fit_linear_income_index(train_panel(spark, sf_dir), {"optimize_parameters": True})
    return _fit_out(fits, "c1", "c2")


def q_forecast_income_index(spark, sf_dir):
    fits = M.fit_linear_income_index(train_panel(spark, sf_dir))
    return rounded(H.predict_linear_income_index(fits, HORIZON).select(*FC_OUT))


def q_fit_blend(spark, sf_dir):
    fits = M.fit_trend_elasticity_blend(train_panel(spark, sf_dir))
    return _fit_out(fits, "trend_slope", "trend_intercept", "elast_slope", "elast_intercept")


def q_forecast_blend(spark, sf_dir):
    fits = M.fit_trend_elasticity_blend(train_panel(spark, sf_dir))
    return rounded(H.predict_trend_elasticity_blend(fits, HORIZON).select(*FC_OUT))


def q_fit_implied_price(spark, sf_dir):
    fits = M.fit_implied_price_logistic(train_panel(spark, sf_dir))
    return _fit_out(fits, "calib_k1", "calib_k2", "last_t")


def q_forecast_implied_price(spark, sf_dir):
    fits = M.fit_implied_price_logistic(train_panel(spark, sf_dir))
    return rounded(H.predict_implied_price_logistic(fits, HORIZON).select(*FC_OUT))


def _curve_rows(spark, sf_dir):
    from ..constants import LOGISTIC_PRICE_DEFAULTS as LP
    from ..functions import curve as C
    p = demand_panel(spark, sf_dir)
    a, b, c, d = LP["distribution_a"], LP["distribution_b"], LP["k1"], LP["k2"]
    rr = C.relative_price_index(F.col("price"), F.col("gdp"), LP["full_price_scale"])
    rows = p.select("series_id", "year", rr.alias("r"))
    return rows.select("*", C.saturation(F.col("r"), a, b, c, d).alias("f"),
                       C.elasticity(F.col("r"), a, b, c, d).alias("elasticity")), (a, b, c, d)


def q_curve_values(spark, sf_dir):
    rows, _ = _curve_rows(spark, sf_dir)
    return rounded(rows.select("series_id", "year", "r", "f"))


def q_curve_elasticity(spark, sf_dir):
    rows, _ = _curve_rows(spark, sf_dir)
    return rounded(rows.select("series_id", "year", "r", "elasticity"))


def q_curve_inverse(spark, sf_dir):
    from ..functions import curve as C
    rows, (a, b, c, d) = _curve_rows(spark, sf_dir)
    return rounded(rows.select("series_id", "year", "r", "f",
                               C.inverse_saturation(F.col("f"), a, b, c, d).alias("r_back")))


def q_elasticity_threshold(spark, sf_dir):
    """C4: per series, the index at which the curve reaches the series' mean
    observed elasticity (solved by the bisection fold, once per series)."""
    from ..functions import curve as C
    rows, (a, b, c, d) = _curve_rows(spark, sf_dir)
    tg = rows.groupBy("series_id").agg(F.avg("elasticity").alias("target"))
    th = tg.select("series_id", "target", C.elasticity_threshold(F.col("target"), a, b, c, d).alias("threshold"))
    return rounded(th.select("*", C.elasticity(F.col("threshold"), a, b, c, d).alias("elasticity_at_threshold")))


QUERIES = {
    "demand_panel": q_demand_panel,
    "fit_linear_price": q_fit_linear_price,
    "forecast_linear_price": q_forecast_linear_price,
    "fit_logistic_price": q_fit_logistic_price,
    "forecast_logistic_price": q_forecast_logistic_price,
    "residual_band": q_residual_band,
    "anchor_columns": q_anchor_columns,
    "fit_income_index": q_fit_income_index,
    "fit_income_index_ols": q_fit_income_index_ols,
    "forecast_income_index": q_forecast_income_index,
    "fit_blend": q_fit_blend,
    "forecast_blend": q_forecast_blend,
    "fit_implied_price": q_fit_implied_price,
    "forecast_implied_price": q_forecast_implied_price,
    "curve_values": q_curve_values,
    "curve_elasticity": q_curve_elasticity,
    "curve_inverse": q_curve_inverse,
    "elasticity_threshold": q_elasticity_threshold,
}


# --- table preparation (D3–D14) ---------------------------------------------------

def q_panel_validation(spark, sf_dir):
    from ..operators import prepare as P
    return P.validate_panel(demand_panel(spark, sf_dir))


def q_panel_profile(spark, sf_dir):
    from ..operators import prepare as P
    prof = P.profile(demand_panel(spark, sf_dir))
    return rounded(prof.select("series_id", "column", "type", "n_rows", "n_missing", "min", "max", "mean", "std"),
                   overrides={"min": 4, "max": 4, "mean": 4, "std": 4})


def q_validation_summary(spark, sf_dir):
    from ..operators import prepare as P
    p = demand_panel(spark, sf_dir)
    return rounded(P.validation_summary(p, P.validate_panel(p)), overrides={"min": 4, "max": 4, "mean": 4, "std": 4})


def q_panel_iqr_outliers(spark, sf_dir):
    from ..operators import prepare as P
    from ..sources.panel import customer_panel
    return rounded(P.iqr_outliers(customer_panel(spark, sf_dir), ["actual", "population", "gdp", "price"], k=3.0),
                   digits=8)


def q_panel_impute(spark, sf_dir):
    from ..operators import prepare as P
    from ..sources.panel import customer_panel
    return rounded(P.impute(P.complete_years(customer_panel(spark, sf_dir))), digits=4)


def q_panel_winsorize(spark, sf_dir):
    from ..operators import prepare as P
    from ..sources.panel import customer_panel
    return rounded(P.winsorize(customer_panel(spark, sf_dir)), digits=8)


def q_panel_clean(spark, sf_dir):
    from ..operators import prepare as P
    from ..sources.panel import customer_panel
    return rounded(P.clean_panel(P.complete_years(customer_panel(spark, sf_dir))), digits=8)


def q_panel_dedup(spark, sf_dir):
    """Distinct (customer, year, order status) rows of the order table."""
    from ..operators import prepare as P
    from ..sources.panel import read_table
    o = read_table(spark, sf_dir, "orders")
    return P.dedup(o.select(F.col("o_custkey").alias("series_id"), F.year("o_orderdate").cast("int").alias("year"),
                            F.col("o_orderstatus").alias("status")))


def q_model_compatibility(spark, sf_dir):
    from ..operators import prepare as P
    return rounded(P.model_compatibility(demand_panel(spark, sf_dir)))


def q_year_range(spark, sf_dir):
    from ..operators import prepare as P
    return P.year_range(demand_panel(spark, sf_dir))


QUERIES.update({
    "panel_validation": q_panel_validation,
    "panel_profile": q_panel_profile,
    "validation_summary": q_validation_summary,
    "panel_iqr_outliers": q_panel_iqr_outliers,
    "panel_impute": q_panel_impute,
    "panel_winsorize": q_panel_winsorize,
    "panel_clean": q_panel_clean,
    "panel_dedup": q_panel_dedup,
    "model_compatibility": q_model_compatibility,
    "year_range": q_year_range,
})


# --- evaluation (E1–E13) -------------------------------------------------------------

def _holdout_panel(spark, sf_dir):
    """The panel, derived once for training rows and held-out rows."""
    from ..session import cut_lineage
    return cut_lineage(demand_panel(spark, sf_dir))


def _holdout_fc(panel, model, h):
    """Forecast of each series from all but its last ``HOLDOUT_YEARS`` years."""
    from ..operators.evaluate import without_last_years
    from .forecast import forecast
    return forecast(without_last_years(panel, HOLDOUT_YEARS), model, horizon=h)[1]


def q_holdout_accuracy(spark, sf_dir):
    """E2 + E1: linear price model without the last years, scored on the first two of them."""
    from ..operators import evaluate as E
    panel = _holdout_panel(spark, sf_dir)
    pairs = E.holdout_pairs(_holdout_fc(panel, "linear_price", 2), panel)
    return rounded(E.accuracy_metrics(pairs))


def _compare(spark, sf_dir):
    from ..operators import evaluate as E
    panel = _holdout_panel(spark, sf_dir)
    expected = panel.select("series_id", "year", F.col("actual").alias("expected"))
    return E.compare_forecast(_holdout_fc(panel, "logistic_price", 2), expected)


def q_forecast_vs_expected(spark, sf_dir):
    """Forecast ⋈ expected on (series, year), shift 0."""
    return rounded(_compare(spark, sf_dir))


def q_comparison_summary(spark, sf_dir):
    from ..operators import evaluate as E
    return rounded(E.comparison_summary(_compare(spark, sf_dir)))


def _report(spark, sf_dir):
    from ..operators import evaluate as E
    panel = _holdout_panel(spark, sf_dir)
    return E.left_join_report(panel, _holdout_fc(panel, "linear_price", 3))


def q_left_join_report(spark, sf_dir):
    """E5: expected ⟕ forecast by (series, year)."""
    return rounded(_report(spark, sf_dir))


def q_report_summary(spark, sf_dir):
    from ..operators import evaluate as E
    return rounded(E.report_summary(_report(spark, sf_dir)))


def _five(spark, sf_dir):
    """The closed-form models."""
    from .forecast import compare_models
    from .oracle import FIVE
    return compare_models(train_panel(spark, sf_dir), FIVE, horizon=HORIZON)


def _six(spark, sf_dir):
    from .forecast import compare_models
    return compare_models(train_panel(spark, sf_dir), params={"bootstrap_logistic": dict(BOOT_PARAMS)}, horizon=HORIZON)


def q_leaderboard(spark, sf_dir):
    """All six models per series, ranked by (rmse, model)."""
    from ..operators import evaluate as E
    fits, fc = _six(spark, sf_dir)
    lb = E.leaderboard(fits, fc)
    return rounded(lb.select("series_id", "model", "status", "rmse", "mae", "r2", "mape", "interval_width", "rank"))


def q_interval_width(spark, sf_dir):
    from ..operators import evaluate as E
    _, fc = _six(spark, sf_dir)
    return rounded(E.interval_width(fc.where(F.col("scenario_id") == "base")))


def q_best_model_per_series(spark, sf_dir):
    from ..operators import evaluate as E
    fits, _ = _six(spark, sf_dir)
    return rounded(E.best_model_per_series(fits))


BT_BACK = [4, 3, 2]      # the folds end so many years before each series' last


def q_rolling_backtest(spark, sf_dir):
    """Rolling-origin backtest, all folds in one grouped job."""
    from ..operators import evaluate as E
    return rounded(E.rolling_backtest(train_panel(spark, sf_dir), "linear_price", E.cutoffs_back(BT_BACK), 2))


def q_backtest_summary(spark, sf_dir):
    from ..operators import evaluate as E
    folds = E.rolling_backtest(train_panel(spark, sf_dir), "linear_price", E.cutoffs_back(BT_BACK), 2)
    return rounded(E.backtest_summary(folds))


QUERIES.update({
    "holdout_accuracy": q_holdout_accuracy,
    "forecast_vs_expected": q_forecast_vs_expected,
    "comparison_summary": q_comparison_summary,
    "left_join_report": q_left_join_report,
    "report_summary": q_report_summary,
    "leaderboard": q_leaderboard,
    "interval_width": q_interval_width,
    "best_model_per_series": q_best_model_per_series,
    "rolling_backtest": q_rolling_backtest,
    "backtest_summary": q_backtest_summary,
})


# --- prediction helpers, scenarios, sweeps (P1/P2, X1–X6, G1/G2) -----------------------

SCENARIOS_3 = [
    {"scenario_id": "base"},
    {"scenario_id": "high", "gdp_growth": 0.04, "pop_growth": 0.015, "price_inflation": 0.01},
    {"scenario_id": "low", "gdp_growth": 0.01, "pop_growth": 0.005, "price_inflation": 0.03},
]
DRIVERS = ["series_id", "scenario_id", "year", "population", "gdp", "price"]


def q_future_drivers(spark, sf_dir):
    """P1 + P2: horizon years and drivers grown at the base rates."""
    fits = M.fit_linear_price(train_panel(spark, sf_dir))
    return rounded(H.expand_horizon(fits, HORIZON).select(*DRIVERS))


def q_scenario_drivers(spark, sf_dir):
    """The same for three growth scenarios."""
    fits = M.fit_linear_price(train_panel(spark, sf_dir))
    return rounded(H.expand_horizon(fits, HORIZON, SCENARIOS_3).select(*DRIVERS))


def q_driver_path_override(spark, sf_dir):
    """Implied-price forecast whose first two years repeat the population and
    GDP observed three years before instead of the growth assumption."""
    panel = train_panel(spark, sf_dir)
    last = panel.groupBy("series_id").agg(F.max("year").alias("last_year"))
    path = (panel.join(last, "series_id").where(F.col("year") < F.col("last_year"))
            .select("series_id", (F.col("year") + F.lit(3)).cast("int").alias("year"), "population", "gdp"))
    fits = M.fit_implied_price_logistic(panel)
    return rounded(H.predict_implied_price_logistic(fits, HORIZON, paths=path).select(*FC_OUT))


def q_growth_rates(spark, sf_dir):
    """G1 in both forms: plain division (linear price) and max(p, 1) (blend)."""
    p = train_panel(spark, sf_dir)
    a = H.predict_linear_price(M.fit_linear_price(p), HORIZON)
    b = H.predict_trend_elasticity_blend(M.fit_trend_elasticity_blend(p), HORIZON)
    cols = ["series_id", "model", "year", "pred", "growth_rate"]
    return rounded(a.select(*cols).unionByName(b.select(*cols)))


def q_total_growth(spark, sf_dir):
    """G2 per (series, model, scenario)."""
    fc = H.predict_linear_price(M.fit_linear_price(train_panel(spark, sf_dir)), HORIZON, SCENARIOS_3)
    return rounded(H.total_growth(fc))


def q_scenario_summary(spark, sf_dir):
    from ..operators import scenarios as X
    fc = H.predict_linear_price(M.fit_linear_price(train_panel(spark, sf_dir)), HORIZON, SCENARIOS_3)
    return rounded(X.scenario_summary(fc))


SWEEP_VALUES = [-0.6, -0.5, -0.4, -0.3]


def q_sensitivity_sweep(spark, sf_dir):
    """X1 + X2: the linear price slope C1 over four values, horizon 10."""
    from ..operators import scenarios as X
    fits, fc = X.sensitivity_sweep(train_panel(spark, sf_dir), "linear_price", "C1", SWEEP_VALUES, horizon=10)
    rows = X.sensitivity_rows(fits, fc, "linear_price", "C1")
    return rounded(rows.select("series_id", "model", "parameter", "value", "final_prediction", "impact_pct", "rmse"))


def q_grid_calibration(spark, sf_dir):
    """M2, first round: 41 x 30 grid over the box plus the start point."""
    from ..operators.calibration import calibrate_saturation
    return rounded(calibrate_saturation(train_panel(spark, sf_dir), rounds=1))


def q_grid_calibration_zoom(spark, sf_dir):
    """M2 with three zoom rounds (iterative; checked by SSE monotonicity in tests)."""
    from ..operators.calibration import calibrate_saturation
    return rounded(calibrate_saturation(train_panel(spark, sf_dir), rounds=4))


BOOT_PARAMS = {"optimize_parameters": True, "n_simulations": 200, "seed": 42}


def q_bootstrap_fit(spark, sf_dir):
    """M8: 200 resamples per series, grid winner per resample."""
    from ..operators import bootstrap as B
    fits = B.fit_bootstrap_logistic(train_panel(spark, sf_dir), dict(BOOT_PARAMS))
    return _fit_out(fits, "k1", "k2", "k1_std", "k2_std")


def q_bootstrap_forecast(spark, sf_dir):
    """P8 + B3: mean and q05/q25/q75/q95 over the simulated paths."""
    from ..operators import bootstrap as B
    fits = B.fit_bootstrap_logistic(train_panel(spark, sf_dir), dict(BOOT_PARAMS))
    fc = B.predict_bootstrap_logistic(fits, HORIZON)
    return rounded(fc.select(*FC_OUT[:10], "q25", "q75", "growth_rate", "band_type"))


NOISE_SIMS = 100


def q_param_noise_mc(spark, sf_dir):
    """Saturation-model parameters with ±10 % noise, 100 simulations per series."""
    from ..operators import scenarios as X
    fits, _ = X.param_noise_mc(train_panel(spark, sf_dir), "logistic_price", {}, n_sims=NOISE_SIMS, horizon=HORIZON)
    return rounded(X.noise_stats(fits))


def q_param_noise_forecast(spark, sf_dir):
    from ..operators import scenarios as X
    _, fc = X.param_noise_mc(train_panel(spark, sf_dir), "logistic_price", {}, n_sims=NOISE_SIMS, horizon=HORIZON)
    return rounded(X.noise_forecast_quantiles(fc))


def q_param_noise_sketch(spark, sf_dir):
    """Order statistics of the simulated forecasts from mergeable sketches; two halves of
    the simulations are sketched apart and merged."""
    from ..operators import quantiles as Q
    from ..operators import scenarios as X
    _, fc = X.param_noise_mc(train_panel(spark, sf_dir), "logistic_price", {}, n_sims=NOISE_SIMS, horizon=HORIZON)
    by = ["series_id", "model", "scenario_id", "year"]
    halves = Q.sketches(fc.withColumn("half", F.col("sim") % 2), [*by, "half"], "pred")
    both = Q.merge_sketches(halves, by).withColumn("q", Q.sketch_quantiles((0.05, 0.5, 0.95)))
    return rounded(both.select(*by, F.col("n").alias("n_sims"), F.col("mean").alias("mean_pred"), *[F.col("q")[i].alias(c) for i, c in enumerate(("q05", "q50", "q95"))]))


def q_format_report(spark, sf_dir):
    """The linear price forecast formatted for a report."""
    from ..functions import format as FM
    fc = H.predict_linear_price(M.fit_linear_price(train_panel(spark, sf_dir)), HORIZON)
    fc = fc.select("series_id", "year", "pred", (F.col("growth_rate") / F.lit(100.0)).alias("growth"), "price",
                   F.make_date(F.col("year"), F.lit(12), F.lit(31)).alias("period_end"))
    return FM.format_columns(fc, {"pred": {"type": "number", "decimals": 2},
                                  "growth": {"type": "percentage", "decimals": 2},
                                  "price": {"type": "currency", "currency": "EUR", "decimals": 2},
                                  "period_end": {"type": "date"}})


def q_comparison_rows(spark, sf_dir):
    """E12 + E10: nested per-series results flattened back to rows."""
    from ..operators import evaluate as E
    fits, _ = _six(spark, sf_dir)
    return rounded(E.comparison_rows(E.nest_results(fits)))


def q_diagnostics_rows(spark, sf_dir):
    """Per-series diagnostics JSON (validation results) flattened to
    (section, metric, value) rows."""
    from ..operators import evaluate as E
    from ..operators import prepare as P
    checks = P.validate_panel(demand_panel(spark, sf_dir))
    per = checks.groupBy("series_id").agg(
        F.to_json(F.struct(
            F.map_from_entries(F.collect_list(F.struct("rule", F.col("n").cast("string")))).alias("counts"),
            F.create_map(F.lit("failed_rules"), F.to_json(F.sort_array(F.collect_list(
                F.when(F.col("n") > 0, F.col("rule")))))).alias("summary"))).alias("diagnostics"))
    return E.diagnostics_rows(per)


QUERIES.update({
    "future_drivers": q_future_drivers,
    "scenario_drivers": q_scenario_drivers,
    "driver_path_override": q_driver_path_override,
    "growth_rates": q_growth_rates,
    "total_growth": q_total_growth,
    "scenario_summary": q_scenario_summary,
    "sensitivity_sweep": q_sensitivity_sweep,
    "grid_calibration": q_grid_calibration,
    "grid_calibration_zoom": q_grid_calibration_zoom,
    "bootstrap_fit": q_bootstrap_fit,
    "bootstrap_forecast": q_bootstrap_forecast,
    "param_noise_mc": q_param_noise_mc,
    "param_noise_forecast": q_param_noise_forecast,
    "param_noise_sketch": q_param_noise_sketch,
    "format_report": q_format_report,
    "comparison_rows": q_comparison_rows,
    "diagnostics_rows": q_diagnostics_rows,
})


def q_accuracy_metrics(spark, sf_dir):
    """E1 on hold-out pairs of the saturation model."""
    from ..operators import evaluate as E
    panel = demand_panel(spark, sf_dir)
    pairs = E.holdout_pairs(_holdout_fc(panel, "logistic_price", 2), panel)
    return rounded(E.accuracy_metrics(pairs))


def q_bootstrap_samples(spark, sf_dir):
    """The long table of simulated paths before aggregation."""
    from ..operators import bootstrap as B
    fits = B.fit_bootstrap_logistic(train_panel(spark, sf_dir), dict(BOOT_PARAMS))
    sims = B.simulate_bootstrap(fits, HORIZON)
    return rounded(sims.select("series_id", "model", "scenario_id", "sim", "year", "pred"))


QUERIES.update({
    "accuracy_metrics": q_accuracy_metrics,
    "bootstrap_samples": q_bootstrap_samples,
})


def q_best_model_forecast(spark, sf_dir):
    """Flagship: every nation's demand five years out, from the model that
    fits that nation best, of all six models."""
    from ..operators import evaluate as E
    _, fc = _six(spark, sf_dir)
    out = E.best_model_forecast(fc)
    return rounded(out.select("series_id", "model", "scenario_id", "year", "population", "gdp", "price", "pred",
                              "lower", "upper", "growth_rate", "band_type"))


QUERIES["best_model_forecast"] = q_best_model_forecast


def q_backtest_leaderboard(spark, sf_dir):
    """Five models ranked per series by out-of-sample back-test RMSE."""
    from ..operators import evaluate as E
    from .oracle import FIVE
    lb = E.backtest_leaderboard(train_panel(spark, sf_dir), FIVE, E.cutoffs_back(BT_BACK), 2)
    return rounded(lb.select("series_id", "model", "n", "mae", "rmse", "mape", "rank"))


QUERIES["backtest_leaderboard"] = q_backtest_leaderboard


def _dirty_panel(spark, sf_dir):
    """One series per customer with every year from its first to its last order:
    years without an order have no values, and many series are a year or two long."""
    from ..operators import prepare as P
    from ..sources.panel import customer_panel
    return P.complete_years(customer_panel(spark, sf_dir))


def _each_model(panel, columns, fitted: bool):
    from .oracle import FIVE
    from .forecast import compare_models
    fits, fc = compare_models(panel, FIVE, horizon=2)
    return (flat_metrics(fits) if fitted else fc).select(*columns)


def q_fit_status_dirty_panel(spark, sf_dir):
    """M9: the status of every fit on series with missing and too few years."""
    cols = ["series_id", "model", "status", "n_years", "last_year", "continuity"]
    return rounded(_each_model(_dirty_panel(spark, sf_dir), cols, True), digits=4)


def q_forecast_dirty_panel(spark, sf_dir):
    """M9 + P1-P7: forecasts exist for the series that could be fitted, and for no other."""
    cols = ["series_id", "model", "year", "pred"]
    return rounded(_each_model(_dirty_panel(spark, sf_dir), cols, False), digits=4)


def q_training_window(spark, sf_dir):
    """The rows of the training window, here the middle three order years."""
    from ..sources.panel import training_window
    return rounded(training_window(demand_panel(spark, sf_dir), 1997, 1999))


def q_relabelled_years(spark, sf_dir):
    """A hold-out forecast relabelled to follow each series' last input year."""
    panel = _holdout_panel(spark, sf_dir)
    last = panel.groupBy("series_id").agg(F.max("year").alias("last_input_year"))
    fc = _holdout_fc(panel, "linear_price", 2)
    return rounded(H.relabel_years(fc, last).select("series_id", "model", "scenario_id", "year", "pred"))


def q_future_rows(spark, sf_dir):
    """Rows marked as future, here the held-out years, up to the first of them."""
    from ..operators import evaluate as E
    panel = demand_panel(spark, sf_dir)
    from pyspark.sql import Window
    marked = panel.withColumn("is_future", F.col("year") > F.max("year").over(Window.partitionBy("series_id")) - HOLDOUT_YEARS)
    return rounded(E.future_rows(marked, 2000).select("series_id", "year", "actual"))


def q_diagnostics_sections(spark, sf_dir):
    """Sections that are objects, lists and scalars, built from the panel checks."""
    from ..operators import evaluate as E
    from ..operators import prepare as P
    checks = P.validate_panel(demand_panel(spark, sf_dir))
    per = checks.groupBy("series_id").agg(
        F.to_json(F.struct(
            F.map_from_entries(F.collect_list(F.struct("rule", F.col("n").cast("string")))).alias("counts"),
            F.sort_array(F.collect_list("rule")).alias("rules"),
            F.sum("n").cast("string").alias("findings"))).alias("diagnostics"))
    return E.diagnostics_rows(per)


QUERIES.update({
    "fit_status_dirty_panel": q_fit_status_dirty_panel,
    "forecast_dirty_panel": q_forecast_dirty_panel,
    "training_window": q_training_window,
    "relabelled_years": q_relabelled_years,
    "future_rows": q_future_rows,
    "diagnostics_sections": q_diagnostics_sections,
})


def q_forecast_logistic_unadjusted(spark, sf_dir):
    """R1 + P3: the saturation forecast without its continuity factor, by parameter."""
    from .forecast import forecast
    _, fc = forecast(train_panel(spark, sf_dir), "logistic_price", {"apply_continuity_adjustment": False}, HORIZON)
    return rounded(fc.select(*FC_OUT))


def q_forecast_growth_params(spark, sf_dir):
    """R1 + P2: growth rates given as parameters."""
    from .forecast import forecast
    rates = {"gdp_growth_rate": 0.02, "population_growth_rate": 0.005, "ticket_price_inflation": 0.04}
    _, fc = forecast(train_panel(spark, sf_dir), "linear_price", rates, HORIZON)
    return rounded(fc.select(*FC_OUT))


GROWTH_VALUES = [0.01, 0.03, 0.05]


def q_sensitivity_growth(spark, sf_dir):
    """X1 over the GDP growth rate, horizon 10."""
    from ..operators import scenarios as X
    fits, fc = X.sensitivity_sweep(train_panel(spark, sf_dir), "linear_price", "gdp_growth_rate", GROWTH_VALUES)
    rows = X.sensitivity_rows(fits, fc, "linear_price", "gdp_growth_rate")
    return rounded(rows.select("series_id", "model", "parameter", "value", "final_prediction", "impact_pct"))


def q_catalog_fit(spark, sf_dir):
    """R3 + R4: the catalogue beside how many series each model is compatible with."""
    from ..operators import prepare as P
    from .forecast import model_catalog
    ok = P.model_compatibility(demand_panel(spark, sf_dir)).groupBy("model").agg(F.count_if("is_compatible").alias("n_compatible"))
    cat = model_catalog(spark).select("model", "category", F.map_values("default_params").alias("v"))
    return cat.join(ok, "model").select("model", "category", F.size("v").cast("bigint").alias("n_defaults"), "n_compatible")


QUERIES.update({
    "forecast_logistic_unadjusted": q_forecast_logistic_unadjusted,
    "forecast_growth_params": q_forecast_growth_params,
    "sensitivity_growth": q_sensitivity_growth,
    "catalog_fit": q_catalog_fit,
})


def q_many_files_by_name(spark, sf_dir):
    """S1 + S2 + S4 + S5: the panel written as delimited files of three layouts (delimiter,
    decimal mark, order and set of columns) and read back by column name."""
    from ..session import shared_path
    from ..sources import delimited as D
    panel = demand_panel(spark, sf_dir)
    at = shared_path(spark, "delimited")
    third = lambda k: panel.where(F.col("series_id") % 3 == k)
    third(0).write.option("header", True).csv(f"{at}/a")
    D.write_locale_csv(third(1).select("price", "gdp", "population", "actual", "year", "series_id"), f"{at}/b")
    noted = third(2).withColumn("note", F.concat(F.lit("n, "), F.col("year")))
    noted.select("year", "note", "actual", "gdp", "price", "population", "series_id").write.option("header", True).option("quoteAll", True).csv(f"{at}/c")
    df = D.read_delimited_many(spark, [f"{at}/{x}" for x in "abc"])
    numbers = {"series_id": F.col("series_id").cast("bigint"), "year": F.col("year").cast("int")}
    return rounded(df.withColumns(numbers).select("series_id", "year", "actual", "population", "gdp", "price", "note"))


QUERIES["many_files_by_name"] = q_many_files_by_name


def q_calibration_bounded(spark, sf_dir):
    """M2 by bounded least squares; the error sums to six significant digits."""
    from ..operators.least_squares import calibrate_bounded
    found = calibrate_bounded(train_panel(spark, sf_dir))
    return rounded(found.select("series_id", F.log10("sse").alias("log_sse"), F.log10("sse_start").alias("log_sse_start")), digits=4)


def q_forecast_series_params(spark, sf_dir):
    """S8 + R5: the linear price model with each nation's own parameters, else its region's,
    else the defaults; the parameter rows are derived from the two tables."""
    from ..operators.parameters import resolve_params, with_params
    from ..sources.panel import read_table
    from .forecast import forecast
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    key, area = F.col("n_nationkey").cast("bigint"), F.col("r_regionkey").cast("bigint")
    nobody, decimal = F.lit(None).cast("bigint"), lambda c: c.cast("decimal(9,3)").cast("string")
    shared = region.where(area > 0).select(nobody.alias("series_id"), F.concat(F.lit(" "), F.regexp_replace("r_name", " ", "  ")).alias("source"),
                                           F.lit("C1").alias("name"), decimal(F.lit(-0.5) - area * 0.02).alias("value"), (area + 100).alias("ord"))
    own = lambda rows, name, value, ord_: nation.where(rows).select(key.alias("series_id"), F.lit(None).cast("string").alias("source"),
                                                                   F.lit(name).alias("name"), decimal(value).alias("value"), F.lit(ord_).cast("bigint").alias("ord"))
    params = (shared.unionByName(own(key % 4 == 1, "C2", F.lit(0.5) + key * 0.01, 5)).unionByName(own(key % 6 == 0, "C1", F.lit(-0.3), 7))
              .unionByName(own(key % 6 == 0, "C1", F.lit(-9.0), 8)))
    series = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("series_id"), F.col("r_name").alias("source"))
    panel, named = with_params(train_panel(spark, sf_dir), resolve_params(series, params, {"C1": -0.5, "C2": 0.5}))
    _, fc = forecast(panel, "linear_price", named, HORIZON)
    return rounded(fc.select(*FC_OUT))


def q_training_window_bounds(spark, sf_dir):
    """A training window for each nation, some open at an end, some of them empty;
    the row that says so has year 0."""
    from ..sources.panel import read_table, training_window_bounds
    key = F.col("n_nationkey").cast("bigint")
    first = F.when(key == 3, 2050).when(key == 4, 2001).when(key % 5 != 0, 1995 + key % 4)
    bounds = read_table(spark, sf_dir, "nation").where(key != 6).select(key.alias("series_id"), first.cast("int").alias("first_year"),
                                                                     F.when(key % 7 != 0, 1998).cast("int").alias("last_year"))
    found = training_window_bounds(demand_panel(spark, sf_dir), bounds)
    return rounded(found.withColumn("year", F.coalesce("year", F.lit(0))))


CELLS = ([-0.6, -0.5, -0.4], [0.5, 0.7])


def q_sensitivity_cells(spark, sf_dir):
    """Cells of slope and intercept of the linear price model."""
    from ..operators import scenarios as X
    return rounded(X.sensitivity_cells(train_panel(spark, sf_dir), "linear_price", ("C1", CELLS[0]), ("C2", CELLS[1])))


def q_metric_display(spark, sf_dir):
    """The models' metrics for display, one of them under a name that no fit has."""
    from ..functions import format as FM
    fits, _ = _five(spark, sf_dir)
    flat = flat_metrics(fits).withColumnRenamed("mape", "MAPE")
    shown = {"rmse": ["rmse", "RMSE"], "mape": ["mape_pct", "MAPE"], "wape": ["wape", "WAPE"]}
    return flat.select("series_id", "model", *[FM.display_metric(FM.metric_value(flat, n)).alias(a) for a, n in shown.items()])


def q_model_info(spark, sf_dir):
    """The catalogue's categories, the fitted flag and a metric of every fit."""
    from .forecast import model_info
    fits, _ = _five(spark, sf_dir)
    return rounded(model_info(spark, fits).select("series_id", "model", "category", "capability_category", "is_fitted", F.col("metrics.rmse").alias("rmse")))


def _comparison_documents(spark, sf_dir):
    """JSON documents of unlike shapes: metrics in two spellings, diagnostics with some,
    and the list under one of two names."""
    fits, _ = _five(spark, sf_dir)
    flat = rounded(flat_metrics(fits).select("series_id", "model", "status", "rmse", "mae", "mape", "r2"))
    lower = F.struct("rmse", "mae", "mape", "r2")
    upper = F.struct(*[F.col(m).alias(m.upper()) for m in ("rmse", "mae", "mape", "r2")])
    scores = F.struct((F.col("r2") * 100).alias("global"), (100 - F.col("mape")).alias("continuity"), F.col("mae").alias("stability"))
    diagnostics = F.struct(scores.alias("scores"), F.struct(F.col("mape").alias("gapPct")).alias("continuity"), F.when(F.col("mape") > 20, "high").otherwise("low").alias("risk"))
    text = (F.when(F.col("status") != "ok", F.to_json(F.struct("model", F.col("status").alias("error"))))
            .when(F.col("model").startswith("linear"), F.to_json(F.struct("model", lower.alias("metrics"), diagnostics.alias("diagnostics"))))
            .otherwise(F.to_json(F.struct("model", upper.alias("metrics")))))
    listed = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(text)), ","), F.lit(', "no object"]'))
    name = F.when(F.col("series_id") % 2 == 0, "comparison").otherwise("results")
    return flat.groupBy("series_id").agg(F.concat(F.lit('{"'), F.first(name), F.lit('": '), listed, F.lit("}")).alias("document"))


def q_comparison_documents(spark, sf_dir):
    """E10 + E12: comparison rows out of nested documents."""
    from ..operators.documents import comparison_records
    return rounded(comparison_records(_comparison_documents(spark, sf_dir)))


def _backtest_documents(spark, sf_dir):
    from ..operators import evaluate as E
    from ..session import cut_lineage
    folds = cut_lineage(E.rolling_backtest(train_panel(spark, sf_dir), "linear_price", E.cutoffs_back(BT_BACK), 2))
    listed = rounded(folds).groupBy("series_id", "model").agg(
        F.sort_array(F.collect_list(F.struct("cutoff", "year", "actual", "pred"))).alias("folds"),
        F.max("cutoff").alias("cutoffYear"), F.min("year").alias("testStart"), F.max("year").alias("testEnd"))
    summary = rounded(E.backtest_summary(folds)).select("series_id", "model", "stability", F.struct(F.col("rmse").alias("RMSE"), F.col("mae"), F.col("mape").alias("MAPE"), F.col("r2")).alias("summary"))
    model = F.struct("model", F.lit("rolling").alias("mode"), "cutoffYear", "testStart", "testEnd", "folds", "summary", "stability")
    return listed.join(summary, ["series_id", "model"]).groupBy("series_id").agg(F.to_json(F.struct(F.collect_list(model).alias("models"))).alias("document"))


def q_backtest_documents(spark, sf_dir):
    """Summaries out of nested back-test documents."""
    from ..operators.documents import backtest_summaries
    return rounded(backtest_summaries(_backtest_documents(spark, sf_dir)))


def q_backtest_document_folds(spark, sf_dir):
    """Fold rows out of nested back-test documents."""
    from ..operators.documents import backtest_folds
    return rounded(backtest_folds(_backtest_documents(spark, sf_dir), {"cutoff": "int", "year": "int", "actual": "double", "pred": "double"}))


QUERIES.update({
    "calibration_bounded": q_calibration_bounded,
    "forecast_series_params": q_forecast_series_params,
    "training_window_bounds": q_training_window_bounds,
    "sensitivity_cells": q_sensitivity_cells,
    "metric_display": q_metric_display,
    "model_info": q_model_info,
    "comparison_documents": q_comparison_documents,
    "backtest_documents": q_backtest_documents,
    "backtest_document_folds": q_backtest_document_folds,
})


def q_plugin_comparison(spark, sf_dir):
    """R2 + E6: a model given as two Python functions beside a built-in one; series that
    it refuses carry its message."""
    from ..operators import plugin as PL
    from .forecast import compare_models, registered
    with registered(PL.rising_share()):
        fits, fc = compare_models(train_panel(spark, sf_dir), ["linear_price", "rising_share"], horizon=HORIZON)
    ends = fc.groupBy("series_id", "model").agg(F.max_by("pred", "year").alias("last_pred"))
    rows = flat_metrics(fits).join(ends, ["series_id", "model"], "left")
    return rounded(rows.select("series_id", "model", "status", "error", "n_years", "level", "rise", "continuity", "mae", "rmse", "mape", "r2", "last_pred"))


def q_plugin_backtest(spark, sf_dir):
    """R2 + E13: the back-test of a model given as two Python functions."""
    from ..operators import evaluate as E
    from ..operators import plugin as PL
    from .forecast import registered
    with registered(PL.rising_share()):
        return rounded(E.rolling_backtest(train_panel(spark, sf_dir), "rising_share", E.cutoffs_back(BT_BACK), 2))


QUERIES.update({"plugin_comparison": q_plugin_comparison, "plugin_backtest": q_plugin_backtest})
