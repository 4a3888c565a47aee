"""Model parameters of each series as a relation.

A long table of parameters ``(series_id, source, name, value, ord)`` holds rows for one
series and rows for all series of a source. Each series takes, name by name, the first of
its own rows, else the first of its source's, else the default. That is one aggregate
over candidates; rows are reduced to the first of each source and name before they fan
out to its series. The result joins the panel and its columns are the parameters of the
fit, so all series are fitted in one job, each with its own parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.delimited import normalise_source
from .quantiles import join_null_safe


def resolve_params(series: DataFrame, params: DataFrame, defaults: dict[str, float], key: str = "series_id") -> DataFrame:
    """Per row of ``series (series_id, source)``: series_id and ``p_<name>`` for each of
    ``defaults``. A value that is no number is NaN; a row of ``params`` without series_id
    speaks for its source. Other names are ignored."""
    names = list(defaults)
    number = F.coalesce(F.trim("value").try_cast("double"), F.lit(float("nan"))).alias("value")
    rows = params.where(F.col("name").isin(names)).select(key, normalise_source(F.col("source")).alias("source"), F.trim("name").alias("name"), number, "ord")
    first = F.min_by("value", "ord").alias("value")
    own = rows.where(F.col(key).isNotNull()).groupBy(key, "name").agg(first).withColumn("level", F.lit(0))
    shared = rows.where(F.col(key).isNull() & F.col("source").isNotNull()).groupBy("source", "name").agg(first)
    named = series.select(key, normalise_source(F.col("source")).alias("source"))
    every = own.unionByName(named.join(shared, "source").select(key, "name", "value", F.lit(1).alias("level")))
    wide = every.groupBy(key).agg(*[F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("level"))).alias(f"p_{n}") for n in names])
    return join_null_safe(named.select(key).distinct(), wide, [key]).select(
        key, *[F.coalesce(F.col(f"p_{n}"), F.lit(float(defaults[n]))).alias(f"p_{n}") for n in names])


def with_params(panel: DataFrame, resolved: DataFrame, key: str = "series_id"):
    """(panel with its series' parameters, the parameters for :func:`forecast` and the
    fits). Spark broadcasts ``resolved`` where its measured size allows it."""
    names = [c[2:] for c in resolved.columns if c.startswith("p_")]
    return join_null_safe(panel, resolved, [key]), {n: F.col(f"p_{n}") for n in names}
