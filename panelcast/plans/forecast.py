"""Orchestration (R1–R6): model registry, ``forecast`` for one model,
``compare_models`` for several, model catalogue, and the golden comparison job.

Everything returns lazy DataFrames; the caller decides when to act.
``compare_models`` fits all closed forms in one pass over the panel; other models
fit inside its partitioning by the series key. Callers that run many jobs on an expensive
panel can cut its lineage with ``session.cut_lineage`` (reliable checkpoint in
the shared checkpoint directory) or write it to a table.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import evaluate as E
from ..operators import horizon as H
from ..operators import models as M
from ..session import cut_lineage


@dataclass(frozen=True)
class ModelSpec:
    name: str
    fit: Callable
    predict: Callable
    defaults: dict
    category: str = "traditional"
    best_for: str = "Any series that holds its drivers"
    time_horizon: str = "Variable"
    complexity: str = "Unknown"
    interpretability: str = "Medium"
    description: str = ""

    @property
    def capability_category(self) -> str:
        """A model without capability texts of its own gets the generic answer's category."""
        return "other" if self.best_for == ModelSpec.best_for else self.category


_REGISTRY: dict[str, ModelSpec] = {}


def register_model(spec: ModelSpec) -> None:
    """R2: plug-in point — a model is a pair of DataFrame functions, or of Python functions
    of a series' years by ``operators.plugin.plugin_model``."""
    _REGISTRY[spec.name] = spec


@contextmanager
def registered(spec: ModelSpec):
    """R2: ``spec`` is registered while jobs are put together inside the ``with`` block; a
    model that it hides comes back afterwards."""
    before = _REGISTRY.get(spec.name)
    register_model(spec)
    try:
        yield spec
    finally:
        del _REGISTRY[spec.name]
        if before:
            register_model(before)


def get_model(name: str) -> ModelSpec:
    if name not in _REGISTRY:
        raise KeyError(f"model {name!r} not found")
    return _REGISTRY[name]


def list_models() -> list[str]:
    return list(_REGISTRY)


def _register_defaults() -> None:
    # Capability texts of the catalogue; models without their own get the generic ones.
    register_model(ModelSpec("logistic_price", M.fit_logistic_price, H.predict_logistic_price,
                             K.LOGISTIC_PRICE_DEFAULTS, best_for="Horizons beyond five years, where demand nears saturation",
                             time_horizon="Long-term", complexity="High", interpretability="Medium",
                             description="Saturation curve of relative price, scaled by population"))
    register_model(ModelSpec("linear_price", M.fit_linear_price, H.predict_linear_price,
                             K.LINEAR_PRICE_DEFAULTS, best_for="Horizons up to five years with a steady response to price",
                             time_horizon="Medium-term", complexity="Medium", interpretability="High",
                             description="Demand per head linear in the normalised price"))
    register_model(ModelSpec("linear_income_index", M.fit_linear_income_index, H.predict_linear_income_index,
                             K.LINEAR_INCOME_INDEX_DEFAULTS,
                             best_for="Horizons up to five years where income drives demand",
                             time_horizon="Medium-term", complexity="Medium", interpretability="High",
                             description="Demand per head linear in an income index, no direct price"))
    register_model(ModelSpec("implied_price_logistic", M.fit_implied_price_logistic,
                             H.predict_implied_price_logistic, K.IMPLIED_PRICE_DEFAULTS,
                             description="Saturation curve with an implied price index"))
    register_model(ModelSpec("trend_elasticity_blend", M.fit_trend_elasticity_blend,
                             H.predict_trend_elasticity_blend, K.BLEND_DEFAULTS,
                             description="Blend of a trend line and a price-elasticity line"))
    from ..operators import bootstrap as B
    register_model(ModelSpec("bootstrap_logistic", B.fit_bootstrap_logistic, B.predict_bootstrap_logistic,
                             K.BOOTSTRAP_DEFAULTS,
                             best_for="Forecasts that need a distribution, not one path",
                             time_horizon="Variable", complexity="High", interpretability="Medium",
                             description="Saturation curve calibrated by bootstrap resampling"))


#: Growth parameters that every model's prediction takes, and their scenario names.
GROWTH_PARAMS = {"gdp_growth_rate": "gdp_growth", "population_growth_rate": "pop_growth",
                 "ticket_price_inflation": "price_inflation"}
#: Parameters that a model's prediction takes, not its fit.
PREDICT_PARAMS = {"logistic_price": ("apply_continuity_adjustment", "monte_carlo_simulations"),
                  "bootstrap_logistic": ("apply_continuity_adjustment", "sketch")}


def split_params(model: str, params: dict | None) -> tuple[dict, dict, dict]:
    """One parameter dictionary dealt to (fit, growth rates, predict options).
    The fit rejects names that it does not know."""
    fit, growth, options = {}, {}, {}
    for k, v in (params or {}).items():
        if k in GROWTH_PARAMS:
            growth[GROWTH_PARAMS[k]] = v
        elif k in PREDICT_PARAMS.get(model, ()):
            options[k] = v
        else:
            fit[k] = v
    return fit, growth, options


def predict(fits: DataFrame, model: str, params: dict | None, horizon: int, scenarios=None, paths=None,
            keys=("series_id",), **options) -> DataFrame:
    """Prediction with the parameters that concern it. Growth rates among them are
    the base rates of every scenario that does not set its own."""
    _, growth, own = split_params(model, params)
    if growth:
        scenarios = [{**growth, **s} for s in scenarios or [{}]]
    return get_model(model).predict(fits, horizon, scenarios=scenarios, paths=paths, keys=keys, **{**own, **options})


def forecast(panel: DataFrame, model: str, params: dict | None = None, horizon: int = 5,
             scenarios: list[dict] | None = None, paths: DataFrame | None = None,
             keys=("series_id",), **predict_options):
    """Fit then predict one model for every series; returns (fits, forecast).
    ``params`` may hold parameters of the fit, of the prediction and growth rates."""
    fits = get_model(model).fit(panel, split_params(model, params)[0], keys=keys)
    return fits, predict(fits, model, params, horizon, scenarios, paths, keys, **predict_options)


def compare_models(panel: DataFrame, models: list[str] | None = None, params: dict[str, dict] | None = None,
                   horizon: int = 5, scenarios: list[dict] | None = None, keys=("series_id",)):
    """E6 + E9: every model with its own parameters; fits and forecasts are
    unioned by name. A series a model cannot fit becomes a status row (its
    ``status`` is not ``ok`` and it has no forecast rows); other series and
    models go on."""
    models = models or list_models()
    params = params or {}
    # Closed forms share one pass over the panel; models that fit on their own find it
    # checkpointed and partitioned by the group key. Fits are checkpointed, so forecasts
    # and rankings do not fit again.
    own = {m: split_params(m, params.get(m))[0] for m in models}
    shared = {m: p for m, p in own.items() if get_model(m).fit is M.FITTERS.get(m) and M.fits_together(m, p)}
    if len(shared) < len(own):
        panel = cut_lineage(panel.repartition(*keys))
    together = cut_lineage(M.fit_together(panel, shared, keys)) if shared else None
    fits_all, fc_all = None, None
    common = [*keys, "model", "scenario_id", "year", "population", "gdp", "price", "pred", "lower", "upper",
              "q25", "q75", "growth_rate", "band_type", "fit_rmse"]
    for m in models:
        fits = M.fits_of(together, m) if m in shared else cut_lineage(get_model(m).fit(panel, own[m], keys=keys))
        fc = predict(fits, m, params.get(m), horizon, scenarios, keys=keys)
        fc = fc.select(*[c for c in common if c in fc.columns])
        fits_all = fits if fits_all is None else fits_all.unionByName(fits, allowMissingColumns=True)
        fc_all = fc if fc_all is None else fc_all.unionByName(fc, allowMissingColumns=True)
    return fits_all, fc_all


def model_catalog(spark: SparkSession) -> DataFrame:
    """R3 + R4: name, category, capabilities (with a category of their own: ``other`` for
    the generic answer), description and default parameters."""
    rows = []
    for name, s in _REGISTRY.items():
        defaults = {k: float(v) for k, v in s.defaults.items() if isinstance(v, (int, float))}  # false 0, true 1
        rows.append((name, s.category, s.capability_category, s.best_for, s.time_horizon, s.complexity, s.interpretability,
                     s.description, defaults))
    return spark.createDataFrame(rows, "model string, category string, capability_category string, best_for string, time_horizon string, "
                                       "complexity string, interpretability string, description string, "
                                       "default_params map<string,double>")


def model_info(spark: SparkSession, fits: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per series and model of ``fits`` the catalogue's entry, whether the model is
    fitted, and its metrics (null where it is not)."""
    keys = list(keys)
    fitted = F.col("status") == "ok"
    rows = fits.select(*keys, "model", fitted.alias("is_fitted"), F.when(fitted, F.col("metrics")).alias("metrics"))
    return rows.join(F.broadcast(model_catalog(spark)), "model", "left")  # one row a registered model


def golden_comparison(panels: dict[str, DataFrame], params: dict[str, dict], expected: DataFrame,
                      expected_cols: dict[str, str], horizon: int, year_shift: dict[str, int] | None = None,
                      predict_options: dict[str, dict] | None = None, paths: DataFrame | None = None):
    """Each model on its own input panel and parameters, compared with its
    expected column (inner join on year, optional shift), unioned, and
    summarised. Returns (details, summary)."""
    year_shift = year_shift or {}
    predict_options = predict_options or {}
    details = None
    for model, col in expected_cols.items():
        spec = get_model(model)
        fits = spec.fit(panels[model], split_params(model, params.get(model))[0])
        fc = predict(fits, model, params.get(model), horizon, paths=paths, **predict_options.get(model, {}))
        d = E.compare_forecast(fc, expected.select("series_id", "year", F.col(col).alias("expected")),
                               year_shift=year_shift.get(model, 0)).withColumn("expected_column", F.lit(col))
        details = d if details is None else details.unionByName(d)
    return details, E.comparison_summary(details)


_register_defaults()
