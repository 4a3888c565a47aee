"""Scenarios, sensitivity and parameter-noise simulation.

A sweep or simulation is a fan-out of the panel by a small literal list (the
swept values or the simulation ids), and the fan-out column joins the group
key. So one grouped job fits every (series, value) or (series, sim) at once,
with the parameters as columns — there is no per-value driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import noise_factor
from .quantiles import sketch_quantiles, sketches


def sensitivity_sweep(panel: DataFrame, model: str, parameter: str, values: list[float],
                      params: dict | None = None, horizon: int = 10, keys=("series_id",)):
    """One parameter, or one growth rate, over a list of values, horizon 10 by default.
    Returns (fits, forecast) keyed by (keys..., value_index, value)."""
    from ..plans.forecast import GROWTH_PARAMS, forecast, get_model
    keys = list(keys)
    if parameter not in GROWTH_PARAMS and isinstance(get_model(model).defaults.get(parameter, 0.0), bool):
        raise ValueError(f"parameter {parameter!r} is a switch and can't be swept")
    arr = F.array(*[F.lit(float(v)) for v in values])
    fan = panel.select("*", F.posexplode(arr).alias("value_index", "value"))
    p = dict(params or {})
    p[parameter] = F.col("value")
    k = keys + ["value_index", "value"]
    return forecast(fan, model, p, horizon, keys=k)


def sensitivity_rows(fits: DataFrame, forecast: DataFrame, model: str, parameter: str, keys=("series_id",)) -> DataFrame:
    """Per (series, value): final prediction, RMSE, and the impact against
    the first value of the sweep, ``100 (final - final_first) / final_first``."""
    keys = list(keys)
    k = keys + ["value_index", "value"]
    final = forecast.groupBy(*k).agg(F.max_by("pred", "year").alias("final_prediction"))
    rows = final.join(fits.select(*k, "status", F.col("metrics.rmse").alias("rmse")), k)
    w = Window.partitionBy(*keys).orderBy("value_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first("final_prediction").over(w)
    return rows.select(*keys, F.lit(model).alias("model"), F.lit(parameter).alias("parameter"),
                       F.lit("sweep").alias("mode"), "value", F.format_string("%s=%s", F.lit(parameter), F.col("value")).alias("label"),
                       "final_prediction",
                       F.when(base != 0, F.lit(100.0) * (F.col("final_prediction") - base) / base).alias("impact_pct"),
                       "rmse", "status")


def sensitivity_cells(panel: DataFrame, model: str, first: tuple[str, list[float]], second: tuple[str, list[float]],
                      params: dict | None = None, horizon: int = 10, keys=("series_id",)) -> DataFrame:
    """X2 in two dimensions: every cell (i, j) of two parameters' values, all fitted in
    one job keyed by (series, i, j). Parameters may be the fit's or growth rates.

    Per cell: final prediction, RMSE, impact in per cent against cell (0, 0), and
    ``error``: the status of a fit that failed (its numbers are null), else null."""
    from ..plans.forecast import GROWTH_PARAMS, forecast, get_model
    keys = list(keys)
    (name_a, values_a), (name_b, values_b) = first, second
    for name in (name_a, name_b):
        if name not in GROWTH_PARAMS and isinstance(get_model(model).defaults.get(name, 0.0), bool):
            raise ValueError(f"parameter {name!r} is a switch and can't be swept")
    listed = lambda values: F.array(*[F.lit(float(v)) for v in values])
    fan = panel.select("*", F.posexplode(listed(values_a)).alias("i", "value_a")).select("*", F.posexplode(listed(values_b)).alias("j", "value_b"))
    k = keys + ["i", "j", "value_a", "value_b"]
    fits, fc = forecast(fan, model, {**(params or {}), name_a: F.col("value_a"), name_b: F.col("value_b")}, horizon, keys=k)
    final = fc.groupBy(*k).agg(F.max_by("pred", "year").alias("final_prediction"))
    cells = fits.select(*k, "status", F.col("metrics.rmse").alias("rmse")).join(final, k, "left")
    whole = Window.partitionBy(*keys).orderBy("i", "j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first("final_prediction").over(whole)
    failed = F.col("status") != "ok"
    return cells.select(*keys, F.lit(model).alias("model"), F.lit(name_a).alias("parameter_a"), F.lit(name_b).alias("parameter_b"), "i", "j",
                        "value_a", "value_b", "final_prediction",
                        F.when(base != 0, F.lit(100.0) * (F.col("final_prediction") - base) / base).alias("impact_pct"),
                        F.when(~failed, F.col("rmse")).alias("rmse"), F.when(failed, F.col("status")).alias("error"))


def param_noise_mc(panel: DataFrame, model: str, params: dict, n_sims: int = 100, seed: int = 42,
                   horizon: int = 5, spread: float = 0.1, keys=("series_id",)):
    """Every numeric (non-boolean) parameter times U(1 - spread, 1 + spread),
    drawn per (series, sim, parameter) by a portable hash; all simulations
    fitted in one grouped job keyed by (series, sim). No cap on ``n_sims``.
    Returns (fits, forecast)."""
    from ..plans.forecast import GROWTH_PARAMS, PREDICT_PARAMS, forecast, get_model
    keys = list(keys)
    fan = panel.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(n_sims)))).alias("sim"))
    noisy = {}
    for name, v in {**get_model(model).defaults, **params}.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            continue
        if name in ("n_simulations", "seed", *GROWTH_PARAMS, *PREDICT_PARAMS.get(model, ())):
            continue
        noisy[name] = F.lit(float(v)) * noise_factor(*[F.col(k) for k in keys], F.col("sim"), F.lit(name),
                                                      F.lit(int(seed)), spread=spread)
    k = keys + ["sim"]
    return forecast(fan, model, dict(params, **noisy), horizon, keys=k)


def noise_stats(fits: DataFrame, keys=("series_id",)) -> DataFrame:
    """X3 statistics per series: simulations fitted and mean R²."""
    return fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_simulations"),
                                   F.count_if(F.col("status") == "ok").alias("n_ok"),
                                   F.avg("metrics.r2").alias("mean_r2"), F.avg("metrics.rmse").alias("mean_rmse"))


def noise_forecast_quantiles(forecast: DataFrame, keys=("series_id",), sketch: bool = False) -> DataFrame:
    """Per (series, year): mean and q05/q50/q95 of the simulated forecasts, interpolated;
    with ``sketch`` order statistics from mergeable sketches of bounded size, which any number
    of simulations fits (exact up to ``quantiles.SKETCH_K`` of them)."""
    by, probs = [*keys, "model", "scenario_id", "year"], (0.05, 0.5, 0.95)
    if sketch:
        g = sketches(forecast, by, "pred").select(*by, F.col("n").alias("n_sims"), F.col("mean").alias("mean_pred"), sketch_quantiles(probs).alias("_q"))
    else:
        q = F.percentile(F.col("pred"), F.array(*[F.lit(p) for p in probs]))
        g = forecast.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sims"), F.avg("pred").alias("mean_pred"), q.alias("_q"))
    return g.select(*by, "n_sims", "mean_pred", F.col("_q")[0].alias("q05"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q95"))


def scenario_summary(forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per (series, model, scenario): horizon span, first and last
    prediction and total growth (G2)."""
    from .horizon import total_growth
    keys = list(keys)
    span = forecast.groupBy(*keys, "model", "scenario_id").agg(F.min("year").alias("first_year"),
                                                               F.max("year").alias("last_year"))
    return span.join(total_growth(forecast, keys), keys + ["model", "scenario_id"])
