"""Prediction: horizon expansion, driver projection, model curves, bands,
growth rates and continuity anchor columns (P1–P7, P10, B1, B2, G1, G3, A3,
X4, X5).

A forecast is the fit table exploded over ``h = 1..horizon`` and the scenario
list — both narrow generators, so rows stay in the fit table's partitioning
(by series) and the growth-rate window adds a sort, never an exchange. The
scenario list is a literal array built from a Python list whose length the
caller controls; no join is needed to fan out scenarios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import curve as C

BASE_SCENARIO = {"scenario_id": "base", "gdp_growth": K.DEFAULT_GDP_GROWTH,
                 "pop_growth": K.DEFAULT_POP_GROWTH, "price_inflation": K.DEFAULT_PRICE_INFLATION,
                 "fare_growth": None}

def scenario_array(scenarios: list[dict] | None) -> Column:
    """The scenario list as one array of structs; rates may be numbers or columns."""
    scenarios = scenarios or [BASE_SCENARIO]

    def rate(x) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    structs = []
    for s in scenarios:
        full = dict(BASE_SCENARIO, **s)
        structs.append(F.struct(
            F.lit(str(full["scenario_id"])).alias("scenario_id"),
            rate(full["gdp_growth"]).alias("gdp_growth"),
            rate(full["pop_growth"]).alias("pop_growth"),
            rate(full["price_inflation"]).alias("price_inflation"),
            F.lit(None if full["fare_growth"] is None else float(full["fare_growth"])).cast("double").alias("fare_growth"),
        ))
    return F.array(*structs)


def expand_horizon(fits: DataFrame, horizon: int, scenarios: list[dict] | None = None,
                   paths: DataFrame | None = None, keys=("series_id",), price_fallback: bool = False) -> DataFrame:
    """P1 + P2 + X4 + X5: years ``last+1 .. last+h`` per fit row and scenario,
    drivers grown at constant rates, or taken from a driver path table
    ``(keys..., year[, scenario_id], population?, gdp?, price?)`` when given.
    ``price_fallback`` replaces a non-finite or non-positive last price by 1.0."""
    keys = list(keys)
    rows = fits.where(F.col("status") == "ok").select("*", F.explode(scenario_array(scenarios)).alias("_sc"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))).alias("h"))
    last_price = C.safe_price(F.col("last_price"), F.lit(1.0)) if price_fallback else F.col("last_price")
    h = F.col("h").cast("double")
    rows = rows.select(
        "*",
        F.col("_sc.scenario_id").alias("scenario_id"),
        F.col("_sc.fare_growth").alias("scenario_fare_growth"),
        (F.col("last_year") + F.col("h")).cast("int").alias("year"),
        (F.col("last_pop") * F.pow(F.lit(1.0) + F.col("_sc.pop_growth"), h)).alias("population"),
        (F.col("last_gdp") * F.pow(F.lit(1.0) + F.col("_sc.gdp_growth"), h)).alias("gdp"),
        (last_price * F.pow(F.lit(1.0) + F.col("_sc.price_inflation"), h)).alias("price"),
    ).drop("_sc")
    if paths is not None:
        on = keys + ["year"] + (["scenario_id"] if "scenario_id" in paths.columns else [])
        driver_cols = [c for c in ("population", "gdp", "price") if c in paths.columns]
        pth = paths.select(*on, *[F.col(c).alias(f"_path_{c}") for c in driver_cols])
        rows = rows.join(pth, on, "left")
        for c in driver_cols:
            rows = rows.withColumn(c, F.coalesce(F.col(f"_path_{c}"), F.col(c))).drop(f"_path_{c}")
    return rows


def _growth(keys, plain: bool) -> Column:
    """G1: ``100 (p_t - p_{t-1}) / p_{t-1}``, first year 0. ``plain`` divides by
    the previous value (null when it is 0), else by ``max(p_{t-1}, 1)``."""
    w = Window.partitionBy(*keys, "model", "scenario_id").orderBy("year")
    prev = F.lag("pred").over(w)
    den = prev if plain else F.greatest(prev, F.lit(1.0))
    return F.when(prev.isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("pred") - prev, den) * F.lit(100.0))


def finish_forecast(rows: DataFrame, keys, pred: Column, shared_builder: bool, band: str = "fixed") -> DataFrame:
    keys = list(keys)
    rows = rows.withColumn("pred", pred)
    if band == "residual_sigma":
        lower = F.greatest(F.lit(0.0), F.col("pred") - F.lit(K.BAND_Z) * F.col("resid_std"))
        upper = F.col("pred") + F.lit(K.BAND_Z) * F.col("resid_std")
        band_type = "residual_sigma_95"
    else:
        lower = F.col("pred") * F.lit(K.BAND_LOW)
        if shared_builder:
            lower = F.greatest(F.lit(0.0), lower)
        upper = F.col("pred") * F.lit(K.BAND_HIGH)
        band_type = "fixed_20pct"
    out = rows.select(
        *keys, "model", "scenario_id", "year", "population", "gdp", "price", "pred",
        lower.alias("lower"), upper.alias("upper"),
        F.lit(None).cast("double").alias("q25"), F.lit(None).cast("double").alias("q75"),
        F.lit(band_type).alias("band_type"), "last_actual", "h", F.col("metrics.rmse").alias("fit_rmse"),
        *[c for c in ("later",) if c in rows.columns])  # a back-test's actual values, see operators/backtest
    return out.withColumn("growth_rate", _growth(keys, plain=not shared_builder))


def anchor_columns(forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """A3: continuity anchor columns. factor = last actual / first prediction;
    adds raw, adjusted and adjusted-band columns plus the gap, without
    overwriting ``pred``. Guards: non-positive values leave the row unchanged
    (``anchor_applied = false``, anchor columns null)."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "model", "scenario_id").orderBy("year") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fc = forecast.withColumn("_first_pred", F.first("pred").over(w))
    ok = (F.col("_first_pred") > 0) & (F.col("last_actual") > 0)
    factor = F.when(ok, F.col("last_actual") / F.col("_first_pred"))
    return fc.select(
        *[c for c in forecast.columns],
        F.when(ok, F.col("pred")).alias("pred_raw"),
        (F.col("pred") * factor).alias("pred_adjusted"),
        (F.col("lower") * factor).alias("lower_adjusted"),
        (F.col("upper") * factor).alias("upper_adjusted"),
        factor.alias("anchor_factor"),
        F.when(ok, F.col("last_actual")).alias("anchor_reference"),
        F.when(ok, F.col("_first_pred") - F.col("last_actual")).alias("anchor_gap"),
        F.when(ok, (F.col("_first_pred") - F.col("last_actual")) / F.col("last_actual") * F.lit(100.0)).alias("anchor_gap_pct"),
        F.coalesce(ok, F.lit(False)).alias("anchor_applied"),
    )


# --- per-model predictions ------------------------------------------------------

def predict_logistic_price(fits, horizon, scenarios=None, paths=None, keys=("series_id",),
                           apply_continuity_adjustment: bool = True, monte_carlo_simulations: int = 0,
                           with_anchor: bool | None = None) -> DataFrame:
    """P3 (+ B1/B2, G1, A3)."""
    rows = expand_horizon(fits, horizon, scenarios, paths, keys)
    r = C.relative_price_index(F.col("price"), F.col("gdp"), F.col("scale"))
    pred = F.col("penetration") * F.col("population") * C.saturation(r, F.col("a"), F.col("b"), F.col("k1"), F.col("k2"))
    if apply_continuity_adjustment:
        pred = pred * F.col("continuity")
    band = "residual_sigma" if monte_carlo_simulations and monte_carlo_simulations > 0 else "fixed"
    out = finish_forecast(rows, keys, pred, shared_builder=False, band=band)
    if with_anchor is None:
        with_anchor = apply_continuity_adjustment
    return anchor_columns(out, keys) if with_anchor else out


def predict_linear_price(fits, horizon, scenarios=None, paths=None, keys=("series_id",)) -> DataFrame:
    """Same clipped index as the fit, factor always applied."""
    rows = expand_horizon(fits, horizon, scenarios, paths, keys)
    pn = C.clipped_index(F.try_divide(F.col("price"), F.col("gdp")) * F.try_divide(F.col("ref_gdp"), F.col("ref_price")))
    pred = C.floor_at(F.col("c1") * pn + F.col("c2"), 0.0) * F.col("population") * F.col("continuity")
    return finish_forecast(rows, keys, pred, shared_builder=False)


def predict_linear_income_index(fits, horizon, scenarios=None, paths=None, keys=("series_id",)) -> DataFrame:
    """P5: unclipped ``gdp0 / gdp`` index (the fit clips, the prediction does not)."""
    rows = expand_horizon(fits, horizon, scenarios, paths, keys, price_fallback=True)
    pn = F.col("ref_gdp") / C.floor_at(F.col("gdp"), 1e-10)
    pred = C.floor_at(F.col("c1") * pn + F.col("c2"), 0.0) * F.col("population") * F.col("continuity")
    return finish_forecast(rows, keys, pred, shared_builder=True)


def predict_trend_elasticity_blend(fits, horizon, scenarios=None, paths=None, keys=("series_id",)) -> DataFrame:
    """Both lines extrapolated, blended, floored, times the factor."""
    rows = expand_horizon(fits, horizon, scenarios, paths, keys, price_fallback=True)
    t = (F.col("year") - F.col("ref_year")).cast("double")
    pn = C.price_index_with_fallback(F.col("price"), F.col("gdp"), F.col("ref_price"), F.col("ref_gdp"))
    wt = C.clamp(F.col("trend_weight"), 0.0, 1.0)
    blend = (wt * (F.col("trend_slope") * t + F.col("trend_intercept"))
             + (F.lit(1.0) - wt) * (F.col("elast_slope") * pn + F.col("elast_intercept")))
    pred = C.floor_at(blend, 0.0) * F.col("population") * F.col("continuity")
    return finish_forecast(rows, keys, pred, shared_builder=True)


def predict_implied_price_logistic(fits, horizon, scenarios=None, paths=None, keys=("series_id",)) -> DataFrame:
    """``K1 pop F(K2 T (1 + fare_growth)^h gdp_ref / gdp)``; a scenario's
    ``fare_growth`` overrides the fitted default."""
    rows = expand_horizon(fits, horizon, scenarios, paths, keys, price_fallback=True)
    fare = F.coalesce(F.col("scenario_fare_growth"), F.col("fare_growth"))
    t = F.col("last_t") * F.pow(F.lit(1.0) + fare, F.col("h").cast("double"))
    s = F.col("model_ref_gdp") / C.floor_at(F.col("gdp"), 1e-10)
    pred = F.col("calib_k1") * F.col("population") * C.saturation(F.col("calib_k2") * t * s, F.col("a"), F.col("b"),
                                                                  F.col("k1"), F.col("k2"))
    return finish_forecast(rows, keys, pred, shared_builder=True)


PREDICTORS = {
    "logistic_price": predict_logistic_price,
    "linear_price": predict_linear_price,
    "linear_income_index": predict_linear_income_index,
    "trend_elasticity_blend": predict_trend_elasticity_blend,
    "implied_price_logistic": predict_implied_price_logistic,
}


def total_growth(forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """``100 (last / first - 1)`` per forecast; null with < 2 points or first <= 0."""
    keys = list(keys)
    g = forecast.groupBy(*keys, "model", "scenario_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by("pred", "year").alias("first_pred"),
        F.max_by("pred", "year").alias("last_pred"))
    return g.select(*keys, "model", "scenario_id", "n_points", "first_pred", "last_pred",
                    F.when((F.col("n_points") >= 2) & (F.col("first_pred") > 0),
                           F.lit(100.0) * (F.col("last_pred") / F.col("first_pred") - F.lit(1.0))).alias("total_growth_pct"))


def relabel_years(forecast: DataFrame, last_input_year: DataFrame, keys=("series_id",)) -> DataFrame:
    """G3 (opt-in): forecast years := last *input* year of the series + i.
    ``last_input_year`` is ``(keys..., last_input_year)``."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "model", "scenario_id").orderBy("year")
    return (forecast.join(last_input_year, keys)
            .withColumn("year", (F.col("last_input_year") + F.row_number().over(w)).cast("int"))
            .drop("last_input_year"))
