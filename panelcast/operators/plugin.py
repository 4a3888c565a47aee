"""Models of one's own (R2): a fit and a prediction given as Python functions.

``fit(years, params)`` gets one series' rows in year order as a pandas frame (year,
actual, population, gdp, price) and returns its parameters by name. ``predict(rows)``
gets rows of any series, each with its parameters, drivers, ``year`` and the series'
first year, GDP and price (``ref_year``, ``ref_gdp``, ``ref_price``), and returns one
value a row, before the continuity factor.

The functions run as Arrow functions on rows grouped by series, so a series' years are all
that is ever gathered. The panel is shuffled by series twice, for the fit and for the
continuity factor, since Spark forgets the partitioning of what Python returns: nothing
else moves. A series whose fit raises gets the status ``error`` and the message in the
column ``error``; others go on. A row whose prediction raises is null. The workers import
the functions by name: define them in a module that they have, or within a function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .fitting import BASE_COLS, PRICED, common_aggs, merge_params, metrics_struct, to_col, weighted_factor, with_group_context
from .horizon import expand_horizon, finish_forecast

#: What a prediction sees of a row beside its parameters.
SEEN = ("year", "population", "gdp", "price", "ref_year", "ref_gdp", "ref_price")
TAKEN = {"model", "status", "error", "n_years", "last_year", "last_actual", "last_pop", "last_gdp", "last_price", "continuity",
         "resid_std", "metrics", "scenario_id", "h", "pred", "actual", "w", *SEEN}


def _fit_function(fit: Callable, parameters: tuple[str, ...], names: list[str]):
    @F.pandas_udf(", ".join([*[f"{p} double" for p in parameters], "error string"]))
    def fitted(status: pd.Series, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, state in enumerate(status):
            if state != "ok":
                out.append({})
                continue
            try:
                own = {n: given[n].iloc[i] for n in names}
                found = fit(pd.DataFrame({c: rows[c].iloc[i] for c in BASE_COLS}), own)
                out.append({p: float(found[p]) for p in parameters})
            except Exception as failed:  # noqa: BLE001  (a user's function: its series fails, the job goes on)
                out.append({"error": f"{type(failed).__name__}: {failed}"})
        # Object columns: a missing message is null, not NaN.
        return pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object if c == "error" else float) for c in [*parameters, "error"]})

    return fitted


def _predict_function(predict: Callable):
    def one_by_one(rows: pd.DataFrame):
        for i in range(len(rows)):
            try:
                yield float(pd.Series(predict(rows.iloc[i : i + 1].reset_index(drop=True))).iloc[0])
            except Exception:  # noqa: BLE001
                yield None

    @F.pandas_udf("double")
    def predicted(rows: pd.DataFrame) -> pd.Series:
        try:
            return pd.Series(predict(rows), dtype=float).reset_index(drop=True)
        except Exception:  # noqa: BLE001  (the rows that fail are told apart below)
            return pd.Series(list(one_by_one(rows)), dtype=float)

    return predicted


def plugin_model(name: str, fit: Callable, predict: Callable, parameters: list[str], defaults: dict | None = None,
                 drivers: tuple[str, ...] = PRICED, min_years: int = 1, **texts):
    """A :class:`~panelcast.plans.forecast.ModelSpec` of two Python functions, for
    ``register_model`` or ``registered``: it then runs wherever a built-in model does.

    ``parameters`` are the names that ``fit`` returns; ``defaults`` the numbers it takes as
    ``params``, which callers override; a series that lacks a value of ``drivers`` is
    ``invalid``. ``texts`` are the catalogue's. The weighted continuity factor (A2) applies."""
    from ..plans.forecast import ModelSpec
    parameters, defaults = tuple(parameters), dict(defaults or {})
    clash = TAKEN.intersection(parameters)
    if clash or len(set(parameters)) != len(parameters):
        raise ValueError(f"parameters need names of their own: {sorted(clash) or parameters}")

    def fit_panel(panel: DataFrame, params: dict | None = None, keys=("series_id",)) -> DataFrame:
        keys = list(keys)
        ship_package(panel.sparkSession)
        given = {n: to_col(v).cast("double") for n, v in merge_params(defaults, params, name).items()}
        rows = with_group_context(panel.select(*keys, *BASE_COLS, *[c.alias(f"_p_{n}") for n, c in given.items()]), keys)
        shared = common_aggs(drivers=drivers, min_years=min_years)
        listed = F.sort_array(F.collect_list(F.struct(*BASE_COLS, "w")))
        series = rows.groupBy(*keys).agg(*shared, listed.alias("_rows"), *[F.first(f"_p_{n}").alias(f"_p_{n}") for n in given])
        columns = F.struct(*[F.col(f"_rows.{c}").alias(c) for c in BASE_COLS])
        own = F.struct(*[F.col(f"_p_{n}").alias(n) for n in given], F.lit(None).cast("double").alias("_none"))
        found = series.withColumn("_fit", _fit_function(fit, parameters, list(given))(F.col("status"), columns, own))
        kept = [c for c in series.columns if not c.startswith("_") and c not in keys]
        found = found.select(*keys, *kept, "_rows", "_fit.*").withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status")))
        years = found.select(*keys, *kept, "error", *parameters, F.explode("_rows").alias("_r"))
        years = years.select("*", *[f"_r.{c}" for c in (*BASE_COLS, "w")])
        years = years.withColumn("pred", F.when(F.col("status") == "ok", _predict_function(predict)(F.struct(*parameters, *SEEN))))
        years = years.withColumn("factor", weighted_factor(None, keys)).withColumn("adj", F.col("pred") * F.col("factor"))
        ok = F.first("status") == "ok"
        metrics = metrics_struct()
        return years.groupBy(*keys).agg(
            F.lit(name).alias("model"), *[F.first(c).alias(c) for c in (*kept, "error", *parameters)],
            F.when(ok, F.first("factor")).alias("continuity"),
            F.when(ok, F.stddev_samp(F.col("actual") - F.col("adj"))).alias("resid_std"), F.when(ok, metrics).alias("metrics"))

    def predict_fits(fits: DataFrame, horizon: int, scenarios=None, paths=None, keys=("series_id",)) -> DataFrame:
        ship_package(fits.sparkSession)
        rows = expand_horizon(fits, horizon, scenarios, paths, keys)
        pred = _predict_function(predict)(F.struct(*parameters, *SEEN)) * F.col("continuity")
        return finish_forecast(rows, keys, pred, shared_builder=True)

    return ModelSpec(name, fit_panel, predict_fits, defaults, **texts)


# --- a plug-in of our own, used by the registered queries -----------------------------

def fit_rising_share(years, params):
    """A line of demand per head on the year; a series whose line falls is refused."""
    t = (years["year"] - years["year"].iloc[0]).to_numpy(float)
    share = (years["actual"] / years["population"].clip(lower=params["least_population"])).to_numpy(float)
    centred = t - t.mean()
    spread = float(centred @ centred)
    rise = float(centred @ share) / spread if spread else 0.0
    if rise < -1e-9:
        raise ValueError("demand per head falls")
    return {"level": share.mean() - rise * t.mean(), "rise": rise}


def predict_rising_share(rows):
    share = rows["level"] + rows["rise"] * (rows["year"] - rows["ref_year"])
    return share.clip(lower=0.0) * rows["population"]


def rising_share():
    return plugin_model("rising_share", fit_rising_share, predict_rising_share, ["level", "rise"], {"least_population": 1e-8}, drivers=("population",),
                        description="Line of demand per head that does not fall")
