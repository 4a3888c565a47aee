"""Shared helpers for the registered queries: fixed query parameters, the
panel and output rounding (both engines round identically so the
order-insensitive value hashes compare)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.panel import demand_panel

# Query parameters, fixed for every registered query.
HOLDOUT_YEARS = 3       # hold-out / comparison queries leave out each series' last years
HORIZON = 5
DIGITS = 6


def train_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole demand panel: fits use every year there is."""
    return demand_panel(spark, sf_dir)


def round_col(c, digits: int = DIGITS):
    """Round half away from zero on the binary value: ``round(x 10^d) / 10^d``.

    Spark's ``round(x, d)`` rounds the shortest decimal string of ``x``, which
    differs from SQL engines that round the binary double on exact-looking
    ties (averages of cents); this form gives the same digits in both."""
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale)) / F.lit(scale)


def rounded(df: DataFrame, digits: int = DIGITS, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every DOUBLE column (``overrides`` gives per-column digits)."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            cols.append(round_col(c, overrides.get(f.name, digits)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def flat_metrics(fits: DataFrame, keys=("series_id",)) -> DataFrame:
    """Fit rows with the metrics struct flattened (for SQL comparison)."""
    others = [c for c in fits.columns if c != "metrics"]
    return fits.select(*others, *[F.col(f"metrics.{m}").alias(m) for m in ("mae", "mse", "rmse", "mape", "r2")])
