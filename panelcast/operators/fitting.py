"""Shared building blocks of the model fits.

A fit is one grouped job keyed by ``keys`` (normally ``series_id``; sweeps and
simulations add their own key such as ``sim`` or ``value``):

1. one ordered window stage per group gives every row its group's reference
   values (first row), its position ``w`` (1..n by year) and ``n``;
2. the model's per-row prediction is a column expression;
3. a second window pass over the *same* partitioning adds the continuity
   factor, so adjusted predictions and in-sample metrics close in
4. one ``groupBy(keys)`` that needs no further exchange.

Only the first step shuffles (by the group key); a group is one annual series,
so its size is bounded by its number of years.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

BASE_COLS = ["year", "actual", "population", "gdp", "price"]


def to_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, bool):
        return F.lit(x)
    if isinstance(x, int):
        return F.lit(float(x))
    return F.lit(x)


#: Models whose fit is closed, whatever ``optimize_parameters`` says.
UNOPTIMISED = ("implied_price_logistic", "trend_elasticity_blend")


def merge_params(defaults: dict, overrides: dict | None, model: str) -> dict:
    """Only known keys may be overridden; unknown keys are rejected."""
    out = dict(defaults)
    if (overrides or {}).get("optimize_parameters") and model in UNOPTIMISED:
        raise ValueError(f"model {model!r} has no parameters to optimise")
    for k, v in (overrides or {}).items():
        if k not in defaults:
            raise ValueError(f"unknown parameter {k!r} for model {model!r}")
        out[k] = v
    return out


def windows(keys: Iterable[str]):
    keys = list(keys)
    w_run = Window.partitionBy(*keys).orderBy("year")
    w_all = w_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w_run, w_all


def with_group_context(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Step 1: first-row references, position and group size per row."""
    keys = list(keys)
    w_run, w_all = windows(keys)
    return df.select(
        *[F.col(c) for c in df.columns],
        F.first("year").over(w_all).alias("ref_year"),
        F.first("gdp").over(w_all).alias("ref_gdp"),
        F.first("price").over(w_all).alias("ref_price"),
        F.first("actual").over(w_all).alias("ref_actual"),
        F.first("population").over(w_all).alias("ref_pop"),
        F.count(F.lit(1)).over(w_all).cast("int").alias("n"),
        F.row_number().over(w_run).cast("int").alias("w"),
        F.coalesce(F.lag("year").over(w_run) == F.col("year"), F.lit(False)).alias("dup_year"),
    )


def _as_col(pred) -> Column:
    return F.col(pred) if isinstance(pred, str) else pred


def weighted_factor(df: DataFrame, keys, pred="pred") -> Column:
    """A2: ``sum(w actual) / sum(w pred)`` over the group (1 if not positive).
    ``pred`` is a column name or an expression."""
    _, w_all = windows(keys)
    num = F.sum(F.col("w") * F.col("actual")).over(w_all)
    den = F.sum(F.col("w") * _as_col(pred)).over(w_all)
    return F.when(den > 0, num / den).otherwise(F.lit(1.0))


def recent_factor(df: DataFrame, keys, pred="pred") -> Column:
    """A1: over the last ``max(3, floor(0.2 n))`` years, ``sum actual / sum pred``.
    ``pred`` is a column name or an expression."""
    _, w_all = windows(keys)
    k = F.greatest(F.lit(K.RECENT_MIN_YEARS), F.floor(F.col("n") * F.lit(K.RECENT_SHARE)).cast("int"))
    recent = F.col("w") > (F.col("n") - k)
    num = F.sum(F.when(recent, F.col("actual"))).over(w_all)
    den = F.sum(F.when(recent, _as_col(pred))).over(w_all)
    return F.when(den > 0, num / den).otherwise(F.lit(1.0))


def metrics_struct(actual: str = "actual", pred: str = "adj") -> Column:
    """E1 as aggregate expressions: MAE, MSE, RMSE, MAPE, R² (0 without variance)."""
    a, p = F.col(actual), F.col(pred)
    e = a - p
    n = F.count(F.lit(1))
    mse = F.avg(e * e)
    sst = F.var_pop(a) * n
    return F.struct(
        F.avg(F.abs(e)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(F.abs(F.try_divide(e, a + F.lit(K.MAPE_EPS)))) * F.lit(100.0)).alias("mape"),
        F.when(sst == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.sum(e * e) / sst).alias("r2"),
    ).alias("metrics")


PRICED = ("population", "gdp", "price")
UNPRICED = ("population", "gdp")


def common_aggs(extra_status: Column | None = None, drivers=PRICED, min_years: int = 1) -> list[Column]:
    """Aggregates shared by every fit: last row values, references, status.

    A group with a repeated or missing year, a missing or negative actual, or a
    missing value of a driver that the model needs is ``invalid``. Only models
    whose continuity factor looks at the last three years ask for ``min_years``."""
    n = F.count(F.lit(1))
    bad = F.col("dup_year") | F.col("year").isNull() | F.col("actual").isNull() | F.coalesce(F.col("actual") < 0, F.lit(False))
    for c in drivers:
        bad = bad | F.col(c).isNull()
    status = F.when(F.bool_or(bad), F.lit("invalid"))
    if min_years > 1:
        status = status.when(n < F.lit(min_years), F.lit("too_short"))
    if extra_status is not None:
        status = status.when(extra_status.isNotNull(), extra_status)
    status = status.otherwise(F.lit("ok"))
    return [
        status.alias("status"),
        n.cast("int").alias("n_years"),
        F.max("year").alias("last_year"),
        F.max_by("actual", "year").alias("last_actual"),
        F.max_by("population", "year").alias("last_pop"),
        F.max_by("gdp", "year").alias("last_gdp"),
        F.max_by("price", "year").alias("last_price"),
        F.first("ref_year").alias("ref_year"),
        F.first("ref_gdp").alias("ref_gdp"),
        F.first("ref_price").alias("ref_price"),
    ]


ESTIMATES = ("continuity", "resid_std", "metrics")


def blank_invalid(fits: DataFrame) -> DataFrame:
    """Fits of invalid input carry their status and counts, but no estimate."""
    return fits.select(*[F.when(F.col("status") != "invalid", F.col(c)).alias(c) if c in ESTIMATES else F.col(c)
                         for c in fits.columns])
