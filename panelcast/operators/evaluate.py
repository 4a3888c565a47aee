"""Evaluation and comparison.

Every operator is a join on ``(series_id, year)`` and/or a grouped aggregate
keyed by ``(series_id, model, ...)``; nothing is collected.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage
from .backtest import cutoffs_back, fits_of, fold_fits, fold_pairs, is_running


def metric_aggs(actual: str = "actual", pred: str = "pred") -> list[Column]:
    """E1 aggregates: n, MAE, MSE, RMSE, MAPE (|e/(a+1e-10)|, %), R² (0 without variance)."""
    a, p = F.col(actual), F.col(pred)
    e = a - p
    n = F.count(F.lit(1))
    mse = F.avg(e * e)
    sst = F.var_pop(a) * n
    return [
        n.alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(F.abs(F.try_divide(e, a + F.lit(K.MAPE_EPS)))) * F.lit(100.0)).alias("mape"),
        F.when(sst == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.sum(e * e) / sst).alias("r2"),
    ]


def accuracy_metrics(df: DataFrame, keys=("series_id", "model"), actual="actual", pred="pred") -> DataFrame:
    """E1 per group over paired rows (pairs without an actual are dropped)."""
    return df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(*metric_aggs(actual, pred))


def holdout_pairs(forecast: DataFrame, actuals: DataFrame, keys=("series_id",)) -> DataFrame:
    """Forecast rows joined to held-out actual rows by (series, year) —
    by year, not by position."""
    keys = list(keys)
    a = actuals.select(*keys, "year", F.col("actual"))
    return forecast.join(a, keys + ["year"], "inner")


def without_last_years(panel: DataFrame, years: int, keys=("series_id",)) -> DataFrame:
    """Each series without its own last ``years`` years. A window over the
    series, so training rows and held-out rows come from one derivation."""
    w = Window.partitionBy(*keys)
    return (panel.withColumn("_last", F.max("year").over(w))
            .where(F.col("year") <= F.col("_last") - F.lit(int(years))).drop("_last"))


def compare_forecast(forecast: DataFrame, expected: DataFrame, expected_col: str = "expected",
                     year_shift: int = 0, keys=("series_id",)) -> DataFrame:
    """Inner join on (series, year) with an optional year shift of the
    expected table; error, abs_error, pct_error (null when expected is 0)."""
    keys = list(keys)
    ex = expected.select(*keys, (F.col("year") - F.lit(int(year_shift))).cast("int").alias("year"),
                         F.col(expected_col).alias("expected"))
    j = forecast.select(*keys, "model", "year", F.col("pred").alias("prediction")).join(ex, keys + ["year"], "inner")
    err = F.col("prediction") - F.col("expected")
    return j.select(*keys, "model", "year", "prediction", "expected", err.alias("error"), F.abs(err).alias("abs_error"),
                    F.when(F.col("expected") != 0, F.lit(100.0) * err / F.col("expected")).alias("pct_error"))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def comparison_summary(details: DataFrame, keys=("series_id", "model")) -> DataFrame:
    """Over finite rows only: n, MAE, RMSE, MAPE, max abs error."""
    ok = details.where(_finite("prediction") & _finite("expected"))
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.abs("pct_error")).alias("mape"), F.max("abs_error").alias("max_abs_error"))


def left_join_report(expected: DataFrame, forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """E5: expected ⟕ forecast on (series, year); abs_error where both exist."""
    keys = list(keys)
    f = forecast.select(*keys, "year", F.col("pred").alias("forecast"))
    j = expected.select(*keys, "year", F.col("actual").alias("expected")).join(f, keys + ["year"], "left")
    return j.withColumn("abs_error", F.abs(F.col("forecast") - F.col("expected")))


def report_summary(report: DataFrame, keys=("series_id",)) -> DataFrame:
    """E5 summary: MAE, RMSE, MAPE and N over rows where both values exist."""
    both = report.where(F.col("abs_error").isNotNull())
    return both.groupBy(*keys).agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))).alias("rmse"),
        F.avg(F.when(F.col("expected") != 0, F.lit(100.0) * F.col("abs_error") / F.abs("expected"))).alias("mape"),
        F.count(F.lit(1)).alias("n"))


def interval_width(forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """Mean (upper - lower) over the horizon per (series, model, scenario)."""
    keys = list(keys)
    return forecast.groupBy(*keys, "model", "scenario_id").agg(F.avg(F.col("upper") - F.col("lower")).alias("interval_width"))


def _rmse_key(c: Column) -> Column:
    """RMSE compared at 1e-6 (half away from zero), so models whose errors are
    equal up to summation order tie deterministically and fall back to the
    model name, whatever the partitioning."""
    return F.round(c * F.lit(1e6)) / F.lit(1e6)


def leaderboard(fits: DataFrame, forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per (series, model): status, rmse, mae, r2, mape, mean interval
    width, and the rank within the series by (rmse, model) among ``ok`` fits;
    other fits have no rank."""
    keys = list(keys)
    # The first scenario by name stands for the forecast, unless one is called base.
    named = forecast.groupBy(*keys, "model").agg(F.min(F.struct(F.col("scenario_id") != "base", "scenario_id")).alias("s"))
    width = interval_width(forecast, keys).join(named.select(*keys, "model", F.col("s.scenario_id")), keys + ["model", "scenario_id"]).drop("scenario_id")
    m = fits.select(*keys, "model", "status", F.col("metrics.rmse").alias("rmse"), F.col("metrics.mae").alias("mae"),
                    F.col("metrics.r2").alias("r2"), F.col("metrics.mape").alias("mape"))
    lb = m.join(width, keys + ["model"], "left")
    ok = F.col("status") == "ok"
    w = Window.partitionBy(*keys).orderBy(ok.desc(), _rmse_key(F.col("rmse")).asc_nulls_last(), F.col("model").asc())
    return lb.withColumn("rank", F.when(ok, F.rank().over(w).cast("int")))


def best_model_per_series(fits: DataFrame, keys=("series_id",)) -> DataFrame:
    """Winner per series among ``ok`` fits: smallest RMSE, ties by model name."""
    keys = list(keys)
    ok = fits.where(F.col("status") == "ok")
    return ok.groupBy(*keys).agg(
        F.min_by("model", F.struct(F.col("metrics.rmse").isNull(), _rmse_key(F.col("metrics.rmse")), F.col("model"))).alias("best_model"),
        F.min("metrics.rmse").alias("best_rmse"),
        F.count(F.lit(1)).alias("n_models"))


def future_rows(expected: DataFrame, last_year: int | None = None) -> DataFrame:
    """``is_future`` rows, optionally capped at a last year."""
    cond = F.col("is_future")
    if last_year is not None:
        cond = cond & (F.col("year") <= F.lit(int(last_year)))
    return expected.where(cond)


# --- nested results (E12, E14) and their flattening ------------------------------------

def nest_results(fits: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per series: an array of model results (model, status, metrics) — the
    nested shape that exporters consume."""
    keys = list(keys)
    return fits.groupBy(*keys).agg(F.collect_list(F.struct(
        "model", "status", F.col("metrics.rmse").alias("RMSE"), F.col("metrics.mae").alias("mae"),
        F.col("metrics.mape").alias("MAPE"), F.col("metrics.r2").alias("r2"))).alias("models"))


def comparison_rows(nested: DataFrame, keys=("series_id",)) -> DataFrame:
    """E12 + E10: explode nested model results; each metric is the first
    present of its lower/upper-case spellings."""
    keys = list(keys)
    ex = nested.select(*keys, F.explode_outer("models").alias("m"))
    fields = set(nested.schema["models"].dataType.elementType.fieldNames())

    def pick(name):
        cands = [F.col(f"m.{n}") for n in (name.lower(), name.upper()) if n in fields]
        return F.coalesce(*cands) if cands else F.lit(None).cast("double")

    return ex.where(F.col("m").isNotNull()).select(
        *keys, F.col("m.model").alias("model"), F.col("m.status").alias("status"),
        pick("rmse").alias("rmse"), pick("mae").alias("mae"), pick("mape").alias("mape"), pick("r2").alias("r2"))


def diagnostics_rows(diag_json: DataFrame, keys=("series_id",), col: str = "diagnostics") -> DataFrame:
    """A JSON object of sections flattened to (section, metric, value). A
    section is an object of metrics, or a list or scalar, which becomes the one
    metric ``value``; lists are joined with '; '."""
    keys = list(keys)
    sections = F.from_json(F.col(col), "map<string, string>")
    s = diag_json.select(*keys, F.explode(sections).alias("section", "body"))
    inner = F.when(F.col("body").startswith("{"), F.from_json("body", "map<string, string>"))
    inner = F.coalesce(inner, F.create_map(F.lit("value"), F.col("body")))
    s = s.select(*keys, "section", F.explode(inner).alias("metric", "raw"))
    arr = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>"))
    return s.select(*keys, "section", "metric", F.coalesce(F.array_join(arr, "; "), F.col("raw")).alias("value"))


# --- rolling-origin backtest (E13) -------------------------------------------------------

def _refitted_folds(panel: DataFrame, model: str, cutoffs: list[int], horizon: int, params: dict | None, keys) -> DataFrame:
    """Fold rows by fitting anew per (series, cutoff) on copied rows: for models whose
    fits are no running sums (calibrated curves, resamples, plug-ins)."""
    from ..plans.forecast import forecast
    listed = F.array(*[F.lit(int(c)) for c in cutoffs])
    if isinstance(cutoffs, cutoffs_back):
        last = F.max("year").over(Window.partitionBy(*keys))
        dated = panel.withColumn("_last", last)
        folds = dated.select(*panel.columns, F.explode(F.transform(listed, lambda c: F.col("_last") - c)).alias("cutoff"))
    else:
        folds = panel.select("*", F.explode(listed).alias("cutoff"))
    folds = folds.where(F.col("year") <= F.col("cutoff"))
    fk = keys + ["cutoff"]
    _, fc = forecast(folds, model, params, horizon, keys=fk)
    pairs = fc.select(*fk, "model", "year", "pred").join(panel.select(*keys, "year", "actual"), keys + ["year"])
    err = F.col("actual") - F.col("pred")
    return pairs.select(*fk, "model", "year", "actual", "pred", err.alias("error"),
                        F.when(F.col("actual") != 0, F.abs(err / F.col("actual")) * F.lit(100.0)).alias("ape"))


def _running_folds(folds: DataFrame, model: str, horizon: int, params: dict | None, keys) -> DataFrame:
    from ..plans.forecast import predict
    return fold_pairs(predict(fits_of(folds, model), model, params, horizon, keys=keys + ["cutoff"]), keys)


def _split(models: list[str], params: dict[str, dict]) -> tuple[dict[str, dict], list[str]]:
    """(fit parameters of the models that running sums can fit, the other models)."""
    from ..plans.forecast import split_params
    fit = {m: split_params(m, params.get(m))[0] for m in models}
    return {m: p for m, p in fit.items() if is_running(m, p)}, [m for m in models if not is_running(m, fit[m])]


def rolling_backtest(panel: DataFrame, model: str, cutoffs: list[int], horizon: int,
                     params: dict | None = None, keys=("series_id",)) -> DataFrame:
    """Fold rows: for each cutoff, the fit on ``year <= cutoff``, its forecast of
    ``horizon`` years, paired with the actual later years. ``cutoffs`` are years, or
    ``cutoffs_back`` numbers of years before each series' last. Any registered model can
    be tested; closed forms are read off running sums (:mod:`.backtest`).
    Output: keys, model, cutoff, year, actual, pred, error, ape."""
    keys = list(keys)
    running, _ = _split([model], {model: params or {}})
    if not running:
        return _refitted_folds(panel, model, cutoffs, horizon, params, keys)
    return _running_folds(fold_fits(panel, running, cutoffs, horizon, keys), model, horizon, params, keys)


def backtest_summary(folds: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per (series, model): fold count, pooled RMSE/MAE/MAPE/R², and stability =
    sample std of the per-fold RMSE (null with one fold)."""
    keys = list(keys)
    per_fold = folds.groupBy(*keys, "model", "cutoff").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("fold_rmse"))
    stab = per_fold.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("n_folds"),
                                                F.stddev_samp("fold_rmse").alias("stability"))
    pooled = folds.groupBy(*keys, "model").agg(*[c for c in metric_aggs("actual", "pred")])
    return pooled.join(stab, keys + ["model"])


def best_model_forecast(forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """The forecast of each series' winning model (E7 winner: smallest in-sample
    RMSE at 1e-6, ties by model name). Forecast rows carry their fit's RMSE
    (``fit_rmse``) and only ``ok`` fits have rows, so the winner is a window
    over the forecast itself — no second pass over the fits."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    best = F.min(F.struct(F.col("fit_rmse").isNull().alias("u"), _rmse_key(F.col("fit_rmse")).alias("r"), F.col("model").alias("m"))).over(w)
    return (forecast.withColumn("_best", best["m"]).where(F.col("model") == F.col("_best")).drop("_best"))


def backtest_leaderboard(panel: DataFrame, models: list[str], cutoffs: list[int], horizon: int,
                         params: dict[str, dict] | None = None, keys=("series_id",)) -> DataFrame:
    """Rank models per series by pooled rolling-origin back-test RMSE (out of
    sample), ties at 1e-6 by model name. This is the ranking to trust for
    models whose in-sample fit is exact by construction (implied price)."""
    keys = list(keys)
    params = params or {}
    running, others = _split(models, params)
    if others:  # these fit anew, each from the panel
        panel = cut_lineage(panel.repartition(*keys))
    tested = []
    if running:
        fits = cut_lineage(fold_fits(panel, running, cutoffs, horizon, keys))
        tested = [_running_folds(fits, m, horizon, params.get(m), keys) for m in running]
    tested += [_refitted_folds(panel, m, cutoffs, horizon, params.get(m), keys) for m in others]
    folds = functools.reduce(DataFrame.unionByName, tested)
    pooled = folds.groupBy(*keys, "model").agg(*metric_aggs("actual", "pred"))
    w = Window.partitionBy(*keys).orderBy(_rmse_key(F.col("rmse")).asc_nulls_last(), F.col("model").asc())
    return pooled.withColumn("rank", F.rank().over(w).cast("int"))
