"""Fits of the five closed-form demand models (M1, M3–M7) on a panel.

Each ``fit_*`` takes a panel ``(keys..., year, actual, population, gdp, price)``
and returns one fit row per group with typed parameters, reference values,
the continuity factor, a ``status`` and in-sample ``metrics``. Parameters may
be Python numbers or columns (sweeps and simulations pass per-group columns).
``fit_together`` fits several models in one pass.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import curve as C
from .fitting import (BASE_COLS, PRICED, UNPRICED, blank_invalid, common_aggs, merge_params, metrics_struct, recent_factor, to_col,
                      weighted_factor, windows, with_group_context)
from .quantiles import join_null_safe
from ..session import written


@dataclass(frozen=True)
class Steps:
    """A closed-form fit as columns: parameters and stages of row columns (a stage may use
    the ones before it; one that is a function takes and returns the rows), then aggregates
    of the group. All columns bear the model's name, so that the stages of several models
    run side by side over one window pass and one aggregate."""

    model: str
    params: dict[str, Column]
    stages: list
    estimates: dict[str, Column]
    extra_status: Column | None = None
    drivers: tuple[str, ...] = PRICED
    min_years: int = 1

    def status(self) -> Column:
        return common_aggs(self.extra_status, self.drivers, self.min_years)[0]

    def aggregates(self) -> list[Column]:
        adj = f"_{self.model}_adj"
        return [*[c.alias(n) for n, c in self.estimates.items()], F.stddev_samp(F.col("actual") - F.col(adj)).alias("resid_std"),
                metrics_struct(pred=adj)]


def _own(model: str):
    return lambda name: F.col(f"_{model}_{name}")


def _named(p: dict, names: dict[str, str]) -> dict[str, Column]:
    return {a: to_col(p[k]).cast("double") for k, a in names.items()}


def _given(model: str, names: dict[str, str]) -> dict[str, Column]:
    return {a: F.first(f"_{model}_{a}") for a in names.values()}


def _staged(rows: DataFrame, steps: list[Steps]) -> DataFrame:
    """The rows with the columns of all steps, stage by stage."""
    for i in range(max(len(s.stages) for s in steps)):
        columns = []
        for s in steps:
            stage = s.stages[i] if i < len(s.stages) else {}
            if callable(stage):
                rows = stage(rows)
            else:
                columns += [c.alias(f"_{s.model}_{n}") for n, c in stage.items()]
        rows = rows.select("*", *columns)
    return rows


def _grouped_rows(panel: DataFrame, steps: list[Steps], keys: list[str]) -> DataFrame:
    params = [c.alias(f"_{s.model}_{n}") for s in steps for n, c in s.params.items()]
    return _staged(with_group_context(panel.select(*keys, *BASE_COLS, *params), keys), steps)


def _fit(panel: DataFrame, steps: Steps, keys: list[str]) -> DataFrame:
    rows = _grouped_rows(panel, [steps], keys)
    return blank_invalid(rows.groupBy(*keys).agg(
        F.lit(steps.model).alias("model"), *common_aggs(steps.extra_status, steps.drivers, steps.min_years), *steps.aggregates()))


def _adjusted(pred: Column, factor: Column) -> dict[str, Column]:
    return {"factor": factor, "adj": pred * factor}


# --- M1 logistic_price ----------------------------------------------------------

LOGISTIC_NAMES = {"k1": "k1", "k2": "k2", "distribution_a": "a", "distribution_b": "b",
                  "full_price_scale": "scale", "full_penetration": "penetration"}


def _logistic_steps(p: dict, keys: list[str]) -> Steps:
    own = _own("logistic_price")
    r = C.relative_price_index(F.col("price"), F.col("gdp"), own("scale"))
    pred = own("penetration") * F.col("population") * C.saturation(r, own("a"), own("b"), own("k1"), own("k2"))
    return Steps("logistic_price", _named(p, LOGISTIC_NAMES), [_adjusted(pred, recent_factor(None, keys, pred))],
                 {**_given("logistic_price", LOGISTIC_NAMES), "continuity": F.first(own("factor"))}, min_years=K.RECENT_MIN_YEARS)


def fit_logistic_price(panel: DataFrame, params: dict | None = None, keys=("series_id",)) -> DataFrame:
    """M1: ``pred = penetration * pop * F(scale * price / gdp)``; recent-window
    continuity factor (A1); metrics on adjusted predictions. With
    ``optimize_parameters`` the curve's (k1, k2) come from bounded least squares
    (M2) per group."""
    keys = list(keys)
    p = merge_params(K.LOGISTIC_PRICE_DEFAULTS, params, "logistic_price")
    if p.get("optimize_parameters") is True:
        from .least_squares import calibrate_bounded
        panel = written(panel, "panel")
        best = calibrate_bounded(panel, p, keys=keys)
        panel = join_null_safe(panel, best.select(*keys, F.col("k1").alias("_cal_k1"), F.col("k2").alias("_cal_k2")), keys)
        p = dict(p, k1=F.col("_cal_k1"), k2=F.col("_cal_k2"))
    return _fit(panel, _logistic_steps(p, keys), keys)


# --- M3 linear_price ------------------------------------------------------------

LINEAR_NAMES = {"C1": "c1", "C2": "c2"}


def _linear_steps(model: str, p: dict, keys: list[str], index: Column, drivers) -> Steps:
    own = _own(model)
    params, c1, c2 = _named(p, LINEAR_NAMES), own("c1"), own("c2")
    stages = [{"pn": index, "dn": C.demand_per_head(F.col("actual"), F.col("population"), 1e-8)}]
    degenerate = None
    if p.get("optimize_parameters") is True:
        # M4: calibrate C1, C2 by OLS of demand per head on the index, per group.
        _, w_all = windows(keys)
        params = {}
        stages.append({"c1": F.regr_slope(own("dn"), own("pn")).over(w_all), "c2": F.regr_intercept(own("dn"), own("pn")).over(w_all)})
        degenerate = F.when(F.first(c1).isNull(), F.lit("degenerate"))
    pred = C.floor_at(c1 * own("pn") + c2, 0.0) * F.col("population")
    stages.append(_adjusted(pred, weighted_factor(None, keys, pred)))
    return Steps(model, params, stages, {**_given(model, LINEAR_NAMES), "continuity": F.first(own("factor"))}, degenerate, drivers)


def _linear_price_steps(p: dict, keys: list[str]) -> Steps:
    pn = C.clipped_index(F.try_divide(F.col("price"), F.col("gdp")) * F.try_divide(F.col("ref_gdp"), F.col("ref_price")))
    return _linear_steps("linear_price", p, keys, pn, PRICED)


def _income_index_steps(p: dict, keys: list[str]) -> Steps:
    pn = C.clipped_index(F.col("ref_gdp") / C.floor_at(F.col("gdp"), 1e-8))
    return _linear_steps("linear_income_index", p, keys, pn, UNPRICED)


def fit_linear_price(panel: DataFrame, params: dict | None = None, keys=("series_id",)) -> DataFrame:
    """M3: ``pn = (price/gdp)(gdp0/price0)`` clipped to [0.2, 3];
    ``pred = max(0, C1 pn + C2) pop``; weighted continuity (A2)."""
    keys = list(keys)
    return _fit(panel, _linear_price_steps(merge_params(K.LINEAR_PRICE_DEFAULTS, params, "linear_price"), keys), keys)


def fit_linear_income_index(panel: DataFrame, params: dict | None = None, keys=("series_id",)) -> DataFrame:
    """M5: ``pn = gdp0 / gdp`` clipped in the fit only; otherwise as M3."""
    keys = list(keys)
    return _fit(panel, _income_index_steps(merge_params(K.LINEAR_INCOME_INDEX_DEFAULTS, params, "linear_income_index"), keys), keys)


# --- M6 trend_elasticity_blend --------------------------------------------------

def _blend_steps(p: dict, keys: list[str]) -> Steps:
    own = _own("trend_elasticity_blend")
    _, w_all = windows(keys)
    indexed = {
        "dn": C.demand_per_head(F.col("actual"), F.col("population"), 1e-10),
        "t": (F.col("year") - F.col("ref_year")).cast("double"),
        "pn": C.price_index_with_fallback(F.col("price"), F.col("gdp"), F.col("ref_price"), F.col("ref_gdp")),
    }
    lines = {f"{line}_{what}": f(own("dn"), own(x)).over(w_all)
             for line, x in (("trend", "t"), ("elast", "pn")) for what, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))}
    wt = C.clamp(own("trend_weight"), 0.0, 1.0)
    blend = (wt * (own("trend_slope") * own("t") + own("trend_intercept"))
             + (F.lit(1.0) - wt) * (own("elast_slope") * own("pn") + own("elast_intercept")))
    pred = C.floor_at(blend, 0.0) * F.col("population")
    degenerate = F.when(F.first(own("trend_slope")).isNull() | F.first(own("elast_slope")).isNull(), F.lit("degenerate"))
    kept = ["trend_weight", *lines]
    return Steps("trend_elasticity_blend", _named(p, {"trend_weight": "trend_weight"}), [indexed, lines, _adjusted(pred, weighted_factor(None, keys, pred))],
                 {**{n: F.first(own(n)) for n in kept}, "continuity": F.first(own("factor"))}, degenerate, UNPRICED)


def fit_trend_elasticity_blend(panel: DataFrame, params: dict | None = None, keys=("series_id",)) -> DataFrame:
    """M6: two OLS lines of demand per head — on the year offset and on the price
    index with fallback (C7) — blended with ``w = clamp(trend_weight, 0, 1)``,
    floored at 0, times population; weighted continuity (A2)."""
    keys = list(keys)
    return _fit(panel, _blend_steps(merge_params(K.BLEND_DEFAULTS, params, "trend_elasticity_blend"), keys), keys)


# --- M7 implied_price_logistic --------------------------------------------------

IMPLIED_NAMES = {"k1": "k1", "k2": "k2", "distribution_a": "a", "distribution_b": "b",
                 "ref_year": "ref_year_param", "ref_gdp_per_capita": "ref_gdp_param",
                 "ref_normalized_traffic": "ref_traffic_param", "ref_elasticity": "ref_elasticity",
                 "fare_growth_rate": "fare_growth"}
CURVE_PARAMS = ("ref_elasticity", "distribution_a", "distribution_b", "k1", "k2")


def _threshold_per_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """K1 and K2 of groups with parameters of their own (sweeps, simulations): solved
    on one row per group and joined back by the same keys."""
    m = "_implied_price_logistic_"
    calib = rows.groupBy(*keys).agg(
        F.first(f"{m}ref_traffic").alias("m_ref_pax_g"),
        *[F.first(f"{m}{a}").alias(f"g_{a}") for a in ("a", "b", "k1", "k2", "ref_elasticity")])
    k2 = C.elasticity_threshold(F.col("g_ref_elasticity"), F.col("g_a"), F.col("g_b"), F.col("g_k1"), F.col("g_k2"))
    calib = calib.withColumn(f"{m}calib_k2", k2)
    fk2 = C.saturation(F.col(f"{m}calib_k2"), F.col("g_a"), F.col("g_b"), F.col("g_k1"), F.col("g_k2"))
    calib = calib.withColumn(f"{m}calib_k1", F.col("m_ref_pax_g") / C.floor_at(fk2, 1e-12))
    return rows.join(calib.select(*keys, f"{m}calib_k1", f"{m}calib_k2"), keys)


def _implied_steps(p: dict, keys: list[str]) -> Steps:
    own = _own("implied_price_logistic")
    _, w_all = windows(keys)
    is_ref = (own("ref_year_param") > 0) & (F.col("year").cast("double") == own("ref_year_param"))
    ref_found = F.max(F.when(is_ref, F.lit(1)).otherwise(F.lit(0))).over(w_all) > 0
    at_ref = lambda c: F.max_by(F.when(is_ref, c), is_ref.cast("int")).over(w_all)
    per_head = F.col("actual") / C.floor_at(F.col("population"), 1e-10)
    ref_gdp = F.when(ref_found, at_ref(F.col("gdp"))).otherwise(F.col("ref_gdp"))
    ref_pax = F.when(ref_found, at_ref(per_head)).otherwise(F.col("ref_actual") / C.floor_at(F.col("ref_pop"), 1e-10))
    referred = {"ref_gdp": F.when(own("ref_gdp_param") > 0, own("ref_gdp_param")).otherwise(ref_gdp),
                "ref_traffic": F.when(own("ref_traffic_param") > 0, own("ref_traffic_param")).otherwise(ref_pax)}
    a, b, c, d = own("a"), own("b"), own("k1"), own("k2")
    if all(isinstance(p[k], (int, float)) for k in CURVE_PARAMS):
        # One parameter tuple for all groups: solved once, and no join.
        k2 = F.lit(C.threshold_value(*(float(p[k]) for k in CURVE_PARAMS))).cast("double")
        solved = {"calib_k2": k2, "calib_k1": own("ref_traffic") / C.floor_at(C.saturation(k2, a, b, c, d), 1e-12)}
    else:
        solved = functools.partial(_threshold_per_group, keys=keys)
    s = own("ref_gdp") / C.floor_at(F.col("gdp"), 1e-10)
    t = C.inverse_saturation(per_head / own("calib_k1"), a, b, c, d) / C.floor_at(own("calib_k2") * s, 1e-12)
    adj = own("calib_k1") * C.saturation(own("calib_k2") * own("t_implied") * s, a, b, c, d) * F.col("population")
    no_threshold = F.when(F.first(own("calib_k2")).isNull(), F.lit("no_threshold"))
    estimates = {n: F.first(own(n)) for n in ("a", "b", "k1", "k2", "ref_elasticity", "fare_growth")}
    estimates |= {"model_ref_gdp": F.first(own("ref_gdp")), "model_ref_traffic": F.first(own("ref_traffic")),
                  "calib_k1": F.first(own("calib_k1")), "calib_k2": F.first(own("calib_k2")),
                  "last_t": F.max_by(own("t_implied"), F.col("year")), "continuity": F.lit(1.0)}
    return Steps("implied_price_logistic", _named(p, IMPLIED_NAMES), [referred, solved, {"t_implied": t}, {"adj": adj}], estimates, no_threshold, UNPRICED)


def fit_implied_price_logistic(panel: DataFrame, params: dict | None = None, keys=("series_id",)) -> DataFrame:
    """M7: calibrate the curve threshold K2 to a reference elasticity (C4),
    K1 = reference traffic per head / F(K2); the implied price index of each
    year is T = F^-1(P / K1) / (K2 S) with S = gdp_ref / gdp; the last T is kept.

    The reference row is the row of ``ref_year`` when given and present, else the
    first row; ``ref_gdp_per_capita`` / ``ref_normalized_traffic`` override it
    when positive. K2 is solved once where the parameters are plain numbers, else
    once per group."""
    keys = list(keys)
    return _fit(panel, _implied_steps(merge_params(K.IMPLIED_PRICE_DEFAULTS, params, "implied_price_logistic"), keys), keys)


FITTERS = {
    "logistic_price": fit_logistic_price,
    "linear_price": fit_linear_price,
    "linear_income_index": fit_linear_income_index,
    "trend_elasticity_blend": fit_trend_elasticity_blend,
    "implied_price_logistic": fit_implied_price_logistic,
}

# --- several models in one aggregate ----------------------------------------------

_STEPS = {
    "logistic_price": (K.LOGISTIC_PRICE_DEFAULTS, _logistic_steps),
    "linear_price": (K.LINEAR_PRICE_DEFAULTS, _linear_price_steps),
    "linear_income_index": (K.LINEAR_INCOME_INDEX_DEFAULTS, _income_index_steps),
    "trend_elasticity_blend": (K.BLEND_DEFAULTS, _blend_steps),
    "implied_price_logistic": (K.IMPLIED_PRICE_DEFAULTS, _implied_steps),
}


def fits_together(model: str, params: dict | None) -> bool:
    """Whether ``model`` can share its pass with others: a closed form whose stages need
    no join, so neither a calibrated curve nor a threshold per group."""
    if model not in _STEPS:
        return False
    p = {**_STEPS[model][0], **(params or {})}
    if model == "logistic_price":
        return p.get("optimize_parameters") is not True
    return model != "implied_price_logistic" or all(isinstance(p[k], (int, float)) for k in CURVE_PARAMS)


def fit_together(panel: DataFrame, models: dict[str, dict | None], keys=("series_id",)) -> DataFrame:
    """The fits of several models ``{model: parameters}`` (see :func:`fits_together`) from
    one shuffle, one window pass and one aggregate: a row per group with the columns that
    all fits share, and a struct column of each model's status, estimates and metrics.
    :func:`fits_of` reads a model's fits off it."""
    keys = list(keys)
    steps = [_STEPS[m][1](merge_params(_STEPS[m][0], p, m), keys) for m, p in models.items()]
    return _grouped_rows(panel, steps, keys).groupBy(*keys).agg(
        *common_aggs()[1:], *[F.struct(s.status(), *s.aggregates()).alias(s.model) for s in steps])


def fits_of(together: DataFrame, model: str) -> DataFrame:
    """The fits of ``model`` out of :func:`fit_together`, as its own fit would give them."""
    shared = [c for c in together.columns if c not in _STEPS]
    at = shared.index("n_years")
    own = [f"{model}.{f.name}" for f in together.schema[model].dataType.fields]
    return blank_invalid(together.select(*shared[:at], F.lit(model).alias("model"), own[0], *shared[at:], *own[1:]))
