"""Export sinks (S6, S7) and nested result shapes.

S7 writes one JSON document per (series, model, scenario): export info, fit
status and metrics, and the forecast records ordered by year. A document holds
at most ``horizon`` records, so the per-group ``collect_list`` is bounded by a
parameter, never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_VERSION = "1.0"


def nested_forecast(fits: DataFrame, forecast: DataFrame, keys=("series_id",)) -> DataFrame:
    keys = list(keys)
    rec_cols = [c for c in ("year", "population", "gdp", "price", "pred", "lower", "upper", "q25", "q75",
                            "growth_rate", "band_type") if c in forecast.columns]
    docs = forecast.groupBy(*keys, "model", "scenario_id").agg(
        F.sort_array(F.collect_list(F.struct(*rec_cols))).alias("forecast"))
    meta = fits.select(*keys, "model", "status", "metrics")
    return docs.join(meta, keys + ["model"], "left").select(
        *keys, "model", "scenario_id", "status", "metrics", "forecast",
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"),
                 F.lit("json").alias("format"), F.lit(EXPORT_VERSION).alias("version")).alias("export_info"))


def write_forecast_json(fits: DataFrame, forecast: DataFrame, path: str, mode: str = "overwrite",
                        keys=("series_id",)) -> None:
    """JSON lines, one document per (series, model, scenario)."""
    nested_forecast(fits, forecast, keys).write.mode(mode).json(path)
