"""Nested result documents flattened to rows.

Documents come as JSON text of unlike shapes: other spellings of a metric, absent parts,
lists or objects where others have none. They are parsed once to VARIANT and read by
path, so a missing part is a null and not a schema. Documents that are no JSON, or hold
no list where one is expected, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "mape", "r2")


def _at(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _listed(v: Column, path: str) -> Column:
    """The list at ``path``; an empty one if there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _metric(v: str, part: str, name: str) -> Column:
    """The first spelling that is there."""
    return F.coalesce(_at(v, f"$.{part}.{name}", "double"), _at(v, f"$.{part}.{name.upper()}", "double")).alias(name)


def comparison_records(docs: DataFrame, keys=("series_id",), col: str = "document") -> DataFrame:
    """One row per object of the list ``comparison``, else ``results``: model, rmse,
    mae, mape, r2, global_score, continuity_score, stability_score, continuity_gap_pct,
    risk, error."""
    keys = list(keys)
    doc = docs.select(*keys, F.try_parse_json(F.col(col)).alias("d"))
    listed = F.coalesce(F.try_variant_get("d", "$.comparison", "array<variant>"), _listed(F.col("d"), "$.results"))
    rows = doc.select(*keys, F.explode(listed).alias("r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    text = lambda path, name: _at("r", path, "string").alias(name)
    number = lambda path, name: _at("r", path, "double").alias(name)
    return rows.select(
        *keys, F.coalesce(_at("r", "$.model", "string"), F.lit("")).alias("model"), *[_metric("r", "metrics", m) for m in METRICS],
        number("$.diagnostics.scores.global", "global_score"), number("$.diagnostics.scores.continuity", "continuity_score"),
        number("$.diagnostics.scores.stability", "stability_score"), number("$.diagnostics.continuity.gapPct", "continuity_gap_pct"),
        text("$.diagnostics.risk", "risk"), text("$.error", "error"))


def _models(docs: DataFrame, keys, col: str) -> DataFrame:
    doc = docs.select(*keys, F.try_parse_json(F.col(col)).alias("d"))
    return doc.select(*keys, F.explode(_listed(F.col("d"), "$.models")).alias("m")).where(F.schema_of_variant("m").startswith("OBJECT"))


def backtest_summaries(docs: DataFrame, keys=("series_id",), col: str = "document") -> DataFrame:
    """One row per object of the list ``models``: model, mode, cutoff_year, test_start,
    test_end, folds, rmse, mae, mape, r2, stability."""
    keys = list(keys)
    year = lambda path, name: _at("m", path, "int").alias(name)
    return _models(docs, keys, col).select(
        *keys, *[F.coalesce(_at("m", f"$.{x}", "string"), F.lit("")).alias(x) for x in ("model", "mode")],
        year("$.cutoffYear", "cutoff_year"), year("$.testStart", "test_start"), year("$.testEnd", "test_end"),
        F.size(_listed(F.col("m"), "$.folds")).cast("long").alias("folds"), *[_metric("m", "summary", m) for m in METRICS],
        _at("m", "$.stability", "double").alias("stability"))


def backtest_folds(docs: DataFrame, fields: dict[str, str], keys=("series_id",), col: str = "document") -> DataFrame:
    """One row per fold object with its model and mode and the given ``fields`` (name
    and type). Folds stand in ``models``, or in ``folds`` of a document without models;
    these have no model and mode but what their fields say."""
    keys = list(keys)
    doc = docs.select(*keys, F.try_parse_json(F.col(col)).alias("d"))
    own = doc.where(F.size(_listed(F.col("d"), "$.models")) == 0).select(
        *keys, F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("mode"), F.explode(_listed(F.col("d"), "$.folds")).alias("f"))
    of_models = _models(docs, keys, col).select(*keys, *[F.coalesce(_at("m", f"$.{x}", "string"), F.lit("")).alias(x) for x in ("model", "mode")],
                                                F.explode(_listed(F.col("m"), "$.folds")).alias("f"))
    rows = of_models.unionByName(own).where(F.schema_of_variant("f").startswith("OBJECT"))
    named = {x: F.coalesce(_at("f", f"$.{x}", "string"), F.col(x)) for x in ("model", "mode")}
    return rows.select(*keys, *[c.alias(x) for x, c in named.items()], *[_at("f", f"$.{n}", t).alias(n) for n, t in fields.items()])
