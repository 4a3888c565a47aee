"""Rolling-origin back-tests from running statistics.

A fold fits a model on a series' rows up to a cutoff. For the closed-form models that
fit is made of sums over those rows, so the running sums of one window pass over the
series hold the fits of *all* cutoffs: the fold's fit is read off the last row up to
its cutoff. No row is copied per fold, and the panel is derived and shuffled once for
all models and folds.

* M3, M5 with given C1 and C2: a row's prediction does not depend on the fold; the
  continuity factor (A2) is the quotient of two running weighted sums.
* M4, M6: the lines are running regressions (n, Σx, Σy, Σxy, Σx² of the rows so far).
  Predictions are floored at zero, which no sum can undo, so the factor folds over the
  running list of a series' rows, a few numbers a year.
* M1: the factor (A1) folds over the last rows of the same list.
* M7: the reference is the series' first row, and the implied index its last one's.

A fold's later actual values stand beside its fit, taken by a range window over the
next years; they meet the predictions without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import curve as C
from .fitting import PRICED, UNPRICED, merge_params, to_col

DEFAULTS = {"logistic_price": K.LOGISTIC_PRICE_DEFAULTS, "linear_price": K.LINEAR_PRICE_DEFAULTS,
            "linear_income_index": K.LINEAR_INCOME_INDEX_DEFAULTS, "trend_elasticity_blend": K.BLEND_DEFAULTS,
            "implied_price_logistic": K.IMPLIED_PRICE_DEFAULTS}


class cutoffs_back(list):
    """Cutoffs counted back from each series' own last year."""


def is_running(model: str, params: dict | None) -> bool:
    """Whether running statistics hold the fits of ``model``: a closed form with plain
    numbers as parameters, and no reference year that some folds lack."""
    if model not in DEFAULTS:
        return False
    p = {**DEFAULTS[model], **(params or {})}
    if any(isinstance(v, Column) for v in p.values()):
        return False
    if model == "logistic_price":
        return p.get("optimize_parameters") is not True
    if model == "implied_price_logistic":
        return not (p["ref_year"] or 0) > 0
    return True


class _Run:
    """The columns that all models share on the rows of a series, in year order."""

    def __init__(self, keys: list[str]):
        self.order = Window.partitionBy(*keys).orderBy("year")
        self.so_far = self.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def total(self, c: Column) -> Column:
        return F.sum(c).over(self.so_far)

    def slope(self, y: str, x: str) -> Column:
        return F.regr_slope(y, x).over(self.so_far)

    def intercept(self, y: str, x: str) -> Column:
        return F.regr_intercept(y, x).over(self.so_far)


def _fold(value) -> Column:
    """Σ of ``value(row)`` over the running list of rows."""
    return F.aggregate("rows", F.lit(0.0), lambda acc, x: acc + value(x))


def _factor(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(1.0))


def _status(drivers, extra: Column | None = None, min_years: int = 1) -> Column:
    bad = F.col("bad_row")
    for c in drivers:
        bad = bad | F.col(f"no_{c}")
    status = F.when(bad, F.lit("invalid")).when(F.col("n") < min_years, F.lit("too_short"))
    if extra is not None:
        status = status.when(extra, F.lit("degenerate"))
    return status.otherwise(F.lit("ok"))


def _linear(model: str, p: dict, index: str, drivers) -> dict[str, Column]:
    if p.get("optimize_parameters") is True:
        c1, c2 = F.col(f"{index}_slope"), F.col(f"{index}_intercept")
        den = _fold(lambda x: x["w"] * C.floor_at(c1 * x[index] + c2, 0.0) * x["population"])
        status = _status(drivers, c1.isNull())
    else:
        c1, c2 = to_col(p["C1"]).cast("double"), to_col(p["C2"]).cast("double")
        den, status = F.col(f"{index}_weighted"), _status(drivers)
    return {"status": status, "c1": c1, "c2": c2, "continuity": _factor(F.col("actual_weighted"), den)}


def _blend(p: dict) -> dict[str, Column]:
    wt = C.clamp(to_col(p["trend_weight"]).cast("double"), 0.0, 1.0)
    ts, ti, es, ei = (F.col(c) for c in ("t_slope", "t_intercept", "pnf_slope", "pnf_intercept"))
    den = _fold(lambda x: x["w"] * C.floor_at(wt * (ts * x["t"] + ti) + (F.lit(1.0) - wt) * (es * x["pnf"] + ei), 0.0) * x["population"])
    return {"status": _status(UNPRICED, ts.isNull() | es.isNull()), "trend_weight": to_col(p["trend_weight"]).cast("double"),
            "trend_slope": ts, "trend_intercept": ti, "elast_slope": es, "elast_intercept": ei,
            "continuity": _factor(F.col("actual_weighted"), den)}


def _logistic(p: dict) -> dict[str, Column]:
    k = F.greatest(F.lit(K.RECENT_MIN_YEARS), F.floor(F.col("n") * F.lit(K.RECENT_SHARE)).cast("int"))
    names = {"k1": "k1", "k2": "k2", "distribution_a": "a", "distribution_b": "b", "full_price_scale": "scale", "full_penetration": "penetration"}
    recent = F.slice("rows", F.greatest(F.lit(1), F.col("n") - k + 1), k)
    add = lambda name: F.aggregate(recent, F.lit(0.0), lambda acc, x: acc + x[name])
    return {"status": _status(PRICED, min_years=K.RECENT_MIN_YEARS), **{a: to_col(p[k]).cast("double") for k, a in names.items()},
            "continuity": _factor(add("actual"), add("curve"))}


def _implied(p: dict) -> dict[str, Column]:
    values = [float(p[k]) for k in ("ref_elasticity", "distribution_a", "distribution_b", "k1", "k2")]
    _, a, b, c, d = values
    k2 = F.lit(C.threshold_value(*values)).cast("double")
    given = lambda name, row: F.lit(float(p[name])) if (p[name] or 0) > 0 else row
    ref_gdp = given("ref_gdp_per_capita", F.col("ref_gdp"))
    traffic = given("ref_normalized_traffic", F.col("ref_actual") / C.floor_at(F.col("ref_pop"), 1e-10))
    k1 = traffic / C.floor_at(C.saturation(k2, a, b, c, d), 1e-12)
    s = ref_gdp / C.floor_at(F.col("last_gdp"), 1e-10)
    per_head = F.col("last_actual") / C.floor_at(F.col("last_pop"), 1e-10)
    t = C.inverse_saturation(per_head / k1, a, b, c, d) / C.floor_at(k2 * s, 1e-12)
    status = _status(UNPRICED)
    return {"status": F.when((status == "ok") & k2.isNull(), "no_threshold").otherwise(status),
            "a": F.lit(a), "b": F.lit(b), "k1": F.lit(c), "k2": F.lit(d), "fare_growth": to_col(p["fare_growth_rate"]).cast("double"),
            "model_ref_gdp": ref_gdp, "calib_k1": k1, "calib_k2": k2, "last_t": t, "continuity": F.lit(1.0)}


def fold_fits(panel: DataFrame, models: dict[str, dict | None], cutoffs: list[int], horizon: int, keys=("series_id",)) -> DataFrame:
    """One row per (series, cutoff) that has rows: the state of the series at its cutoff,
    ``later`` (year, actual of the next ``horizon`` years) and, for each of ``models``
    (see :func:`is_running`), a struct column of that name with its status, parameters
    and continuity factor."""
    keys = list(keys)
    params = {m: merge_params(DEFAULTS[m], p, m) for m, p in models.items()}
    run = _Run(keys)
    given = panel.where(F.col("year").isNotNull()).select(*keys, "year", "actual", "population", "gdp", "price")
    first = lambda c: F.first(c).over(run.so_far)
    rows = given.select(
        "*", first("year").alias("ref_year"), first("gdp").alias("ref_gdp"), first("price").alias("ref_price"),
        first("actual").alias("ref_actual"), first("population").alias("ref_pop"),
        F.row_number().over(run.order).cast("int").alias("w"), F.lag("year").over(run.order).alias("before"), F.lead("year").over(run.order).alias("next"),
        F.max("year").over(Window.partitionBy(*keys)).alias("end"))
    bad = F.coalesce(F.col("before") == F.col("year"), F.lit(False)) | F.col("actual").isNull() | F.coalesce(F.col("actual") < 0, F.lit(False))

    linear = {"linear_price": "pn", "linear_income_index": "gn"}
    price, gdp = F.col("price"), F.col("gdp")
    each = {
        "pn": C.clipped_index(F.try_divide(price, gdp) * F.try_divide(F.col("ref_gdp"), F.col("ref_price"))),
        "gn": C.clipped_index(F.col("ref_gdp") / C.floor_at(gdp, 1e-8)),
        "dn": C.demand_per_head(F.col("actual"), F.col("population"), 1e-8),
        "dnf": C.demand_per_head(F.col("actual"), F.col("population"), 1e-10),
        "t": (F.col("year") - F.col("ref_year")).cast("double"),
        "pnf": C.price_index_with_fallback(price, gdp, F.col("ref_price"), F.col("ref_gdp")),
    }
    if p := params.get("logistic_price"):
        r = C.relative_price_index(price, gdp, p["full_price_scale"])
        each["curve"] = F.lit(float(p["full_penetration"])) * F.col("population") * C.saturation(
            r, *(float(p[k]) for k in ("distribution_a", "distribution_b", "k1", "k2")))
    rows = rows.select("*", bad.alias("bad"), *[c.alias(n) for n, c in each.items()])

    stats = {"bad_row": F.max("bad").over(run.so_far), "actual_weighted": run.total(F.col("w") * F.col("actual")),
             **{f"no_{c}": F.max(F.col(c).isNull()).over(run.so_far) for c in PRICED}}
    listed: set[str] = set()
    for m, index in linear.items():
        if m in params and params[m].get("optimize_parameters") is True:
            stats |= {f"{index}_slope": run.slope("dn", index), f"{index}_intercept": run.intercept("dn", index)}
            listed |= {"w", index, "population"}
        elif m in params:
            row = C.floor_at(F.lit(float(params[m]["C1"])) * F.col(index) + F.lit(float(params[m]["C2"])), 0.0) * F.col("population")
            stats[f"{index}_weighted"] = run.total(F.col("w") * row)
    if "trend_elasticity_blend" in params:
        stats |= {f"{x}_{what}": getattr(run, what)("dnf", x) for x in ("t", "pnf") for what in ("slope", "intercept")}
        listed |= {"w", "t", "pnf", "population"}
    if "logistic_price" in params:
        listed |= {"actual", "curve"}
    if listed:
        stats["rows"] = F.collect_list(F.struct(*sorted(listed))).over(run.so_far)
    next_years = run.order.rangeBetween(1, int(horizon))
    stats["later"] = F.collect_list(F.struct("year", "actual")).over(next_years)

    at = F.array(*[F.lit(int(c)) for c in cutoffs])
    if isinstance(cutoffs, cutoffs_back):
        at = F.transform(at, lambda c: F.col("end") - c)
    # A fold's fit stands at the last row up to its cutoff.
    mine = F.filter(at, lambda c: (c >= F.col("year")) & (F.col("next").isNull() | (c < F.col("next"))))
    ends = (rows.select("*", *[c.alias(n) for n, c in stats.items()], mine.alias("mine")).where(F.size("mine") > 0)
            .withColumnsRenamed({"w": "n", "year": "last_year", "actual": "last_actual", "population": "last_pop", "gdp": "last_gdp", "price": "last_price"}))
    makers = {"logistic_price": _logistic, "linear_price": lambda p: _linear("linear_price", p, "pn", PRICED),
              "linear_income_index": lambda p: _linear("linear_income_index", p, "gn", UNPRICED),
              "trend_elasticity_blend": _blend, "implied_price_logistic": _implied}
    fitted = [F.struct(*[c.alias(n) for n, c in makers[m](p).items()]).alias(m) for m, p in params.items()]
    shared = ["last_year", "last_actual", "last_pop", "last_gdp", "last_price", "ref_year", "ref_gdp", "ref_price", "later"]
    return ends.withColumn("cutoff", F.explode("mine")).select(*keys, "cutoff", F.col("n").alias("n_years"), *shared, *fitted)


def fits_of(folds: DataFrame, model: str) -> DataFrame:
    """The fits of one of the models of :func:`fold_fits`, as its prediction takes them."""
    own = [f.name for f in folds.schema[model].dataType.fields]
    others = [c for c in folds.columns if c not in DEFAULTS]
    unknown = F.struct(F.lit(None).cast("double").alias("rmse"))
    return folds.select(*others, F.lit(model).alias("model"), *[F.col(f"{model}.{c}").alias(c) for c in own],
                        F.lit(None).cast("double").alias("resid_std"), unknown.alias("metrics"))


def fold_pairs(forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    """Fold rows of forecasts that carry ``later``: keys, model, cutoff, year, actual, pred,
    error, ape."""
    pairs = forecast.select(*keys, "model", "cutoff", "year", "pred", F.explode(F.filter("later", lambda x: x["year"] == F.col("year"))).alias("_l"))
    err = F.col("_l.actual") - F.col("pred")
    return pairs.select(*keys, "cutoff", "model", "year", F.col("_l.actual").alias("actual"), "pred", err.alias("error"),
                        F.when(F.col("_l.actual") != 0, F.abs(err / F.col("_l.actual")) * F.lit(100.0)).alias("ape"))
