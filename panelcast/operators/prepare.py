"""Table preparation (D1–D15): names, validation, profile, cleaning.

All statistics are per series (one series of the reference = one group here). They
are grouped aggregates keyed by ``series_id`` that meet the rows in a join: partial
sums before the shuffle, and exact quantiles that split a series of any size
(:mod:`.quantiles`).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import written
from .quantiles import HOT_ROWS, group_modes, group_quantiles, join_null_safe

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


# --- D1 / D2 --------------------------------------------------------------------

def normalise_names(names: list[str]) -> list[str]:
    """D1 + D2: trim, lower-case, map synonyms, then number repeats (_2, _3, ...);
    a number that another column already has is passed over."""
    canonical = [K.COLUMN_SYNONYMS.get(n, n) for n in (raw.strip().lower() for raw in names)]
    taken: set[str] = set()
    out = []
    for name in canonical:
        spellings = itertools.chain([name], (f"{name}_{i}" for i in itertools.count(2)))
        out.append(next(s for s in spellings if s not in taken))
        taken.add(out[-1])
    return out


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Metadata only: one ``toDF`` call, no job."""
    return df.toDF(*normalise_names(df.columns))


def to_panel(df: DataFrame, series_id: int | Column | None = None) -> DataFrame:
    """Map a normalised file table (year, actual_passengers, ...) to panel names."""
    cols = []
    if "series_id" not in df.columns:
        cols.append((series_id if isinstance(series_id, Column) else F.lit(series_id or 0)).cast("bigint").alias("series_id"))
    for c in df.columns:
        cols.append(F.col(f"`{c}`").alias(K.LONG_TO_PANEL.get(c, c)))
    return df.select(*cols)


def numeric_columns(df: DataFrame, exclude=("series_id",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


# --- D3 validation ----------------------------------------------------------------

def iqr_bounds(df: DataFrame, cols: list[str], k: float, keys=("series_id",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each row with Q1, Q3 (exact, linear interpolation), the fences and the number of
    values of each column in its series. The rows are written once, since they meet
    their series' quantiles in a join, which splits a series of any size."""
    df = written(df, "panel")
    out = join_null_safe(df, group_quantiles(df, cols, (0.25, 0.75), keys, hot_rows), keys)
    sel = []
    for c in cols:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        sel += [q1.alias(f"_q1_{c}"), q3.alias(f"_q3_{c}"), F.col(f"_n_{c}"),
                (q1 - F.lit(k) * (q3 - q1)).alias(f"_lo_{c}"), (q3 + F.lit(k) * (q3 - q1)).alias(f"_hi_{c}")]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *sel)


def iqr_outliers(panel: DataFrame, cols: list[str] | None = None, k: float = 3.0, keys=("series_id",),
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per series and column: Q1, Q3, fences and the number of rows outside
    ``Q1 - k IQR .. Q3 + k IQR`` (nulls ignored). Long output."""
    keys = list(keys)
    cols = cols or numeric_columns(panel, exclude=tuple(keys))
    b = iqr_bounds(panel, cols, k, keys, hot_rows)
    aggs = []
    for c in cols:
        out = (F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.first(f"_q1_{c}").alias("q1"), F.first(f"_q3_{c}").alias("q3"),
                             F.first(f"_lo_{c}").alias("lower"), F.first(f"_hi_{c}").alias("upper"),
                             F.count_if(F.coalesce(out, F.lit(False))).alias("n_outliers")))
    g = b.groupBy(*keys).agg(F.array(*aggs).alias("_cols"))
    return g.select(*keys, F.inline("_cols"))


def validate_panel(panel: DataFrame, keys=("series_id",), iqr_k: float = 3.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """D3: one row per (series, rule) with ``severity`` and count ``n``.

    Errors: null_year, null_actual, negative_actual (nulls excluded),
    duplicate_years, year_not_integer. Warnings: year_converted (year arrived
    as a non-integer type), outliers_<col> (3·IQR fences). A series is valid
    when all its error counts are 0."""
    keys = list(keys)
    year_t = panel.schema["year"].dataType
    year_is_int = isinstance(year_t, (T.IntegerType, T.LongType, T.ShortType))
    num = [c for c in numeric_columns(panel, exclude=tuple(keys))]
    b = iqr_bounds(panel, num, iqr_k, keys, hot_rows)
    rules = [
        ("null_year", "error", F.count_if(F.col("year").isNull())),
        ("null_actual", "error", F.count_if(F.col("actual").isNull())),
        ("negative_actual", "error", F.count_if(F.coalesce(F.col("actual") < 0, F.lit(False)))),
        ("duplicate_years", "error", None),
        ("year_not_integer", "error",
         F.lit(0).cast("bigint") if year_is_int else F.count_if(F.col("year") != F.floor(F.col("year")))),
        ("year_converted", "warning",
         F.lit(0).cast("bigint") if year_is_int else F.count(F.col("year"))),
    ]
    for c in num:
        out = (F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))
        rules.append((f"outliers_{c}", "warning", F.count_if(F.coalesce(out, F.lit(False)))))
    counted = b.groupBy(*keys).agg(*[e.cast("bigint").alias(f"_rule_{r}") for r, _, e in rules if e is not None])
    # Rows of one year are counted before they are shuffled.
    years = b.where(F.col("year").isNotNull()).groupBy(*keys, "year").agg((F.count(F.lit(1)) - 1).alias("_again"))
    again = years.groupBy(*keys).agg(F.sum("_again").alias("_rule_duplicate_years"))
    counted = join_null_safe(counted, again, keys)
    arr = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.coalesce(F.col(f"_rule_{r}"), F.lit(0)).alias("n"))
                    for r, s, _ in rules])
    return counted.select(*keys, F.inline(arr))


def series_validity(checks: DataFrame, keys=("series_id",)) -> DataFrame:
    """``valid = no error rule with n > 0`` per series."""
    return checks.groupBy(*keys).agg(
        (F.sum(F.when((F.col("severity") == "error") & (F.col("n") > 0), 1).otherwise(0)) == 0).alias("valid"))


# --- D4 / D5 -----------------------------------------------------------------------

def profile(panel: DataFrame, keys=("series_id",), approx_distinct: bool = False) -> DataFrame:
    """Per series and column: type, rows, missing, min, max, mean, sample
    std (numeric) or distinct count (other). Long output, one aggregate job."""
    keys = list(keys)
    structs = []
    for f in panel.schema.fields:
        if f.name in keys:
            continue
        c = F.col(f"`{f.name}`")
        is_num = isinstance(f.dataType, NUMERIC_TYPES)
        is_date = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        kind = "numeric" if is_num else ("datetime" if is_date else "categorical")
        dist = F.approx_count_distinct(c) if approx_distinct else F.count_distinct(c)
        structs.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(kind).alias("type"),
            F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_missing"),
            (F.min(c).cast("double") if is_num else F.lit(None).cast("double")).alias("min"),
            (F.max(c).cast("double") if is_num else F.lit(None).cast("double")).alias("max"),
            (F.avg(c) if is_num else F.lit(None).cast("double")).alias("mean"),
            (F.stddev_samp(c) if is_num else F.lit(None).cast("double")).alias("std"),
            (F.lit(None).cast("bigint") if is_num else dist.cast("bigint")).alias("n_distinct"),
            (F.min(c).cast("string") if is_date else F.lit(None).cast("string")).alias("min_text"),
            (F.max(c).cast("string") if is_date else F.lit(None).cast("string")).alias("max_text"),
        ))
    return panel.groupBy(*keys).agg(F.array(*structs).alias("_p")).select(*keys, F.inline("_p"))


def validation_summary(panel: DataFrame, checks: DataFrame, keys=("series_id",)) -> DataFrame:
    """Numeric summary (min, max, mean, std, missing) of valid series only."""
    keys = list(keys)
    prof = profile(panel, keys).where(F.col("type") == "numeric")
    valid = series_validity(checks, keys).where("valid")
    return prof.join(valid.select(*keys), keys, "left_semi").select(
        *keys, "column", "min", "max", "mean", "std", F.col("n_missing").alias("missing"))


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """First rows for display only — never fed back as data."""
    return df.limit(n)


def year_range(panel: DataFrame, keys=("series_id",)) -> DataFrame:
    """First and last (rounded, non-null) year per series."""
    y = F.round(F.col("year")).cast("int")
    return panel.where(F.col("year").isNotNull()).groupBy(*keys).agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"))


# --- D7 / D8 / D9 / D14 ------------------------------------------------------------------

def impute(panel: DataFrame, keys=("series_id",), exclude=("year",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numeric nulls -> series median; other nulls -> series mode (ties:
    smallest value). Keys and ``year`` are never imputed. Medians and modes come from
    grouped aggregates and meet the rows in a join, so no series is a window."""
    keys = list(keys)
    panel = written(panel, "panel")
    open_ = [f for f in panel.schema.fields if f.name not in keys and f.name not in exclude]
    numeric = [f.name for f in open_ if isinstance(f.dataType, NUMERIC_TYPES)]
    modes = group_modes(panel, [f.name for f in open_ if f.name not in numeric], keys)
    out = panel
    if numeric:
        out = join_null_safe(out, group_quantiles(panel, numeric, (0.5,), keys, hot_rows), keys)
    if modes is not None:
        out = join_null_safe(out, modes, keys)
    cols = []
    for f in panel.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in numeric:
            c = F.coalesce(c, F.col(f"_q_{f.name}")[0].cast(f.dataType)).alias(f.name)
        elif f in open_:
            c = F.coalesce(c, F.col(f"_mode_{f.name}")).alias(f.name)
        cols.append(c)
    return out.select(*cols)


def dedup(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (partial aggregation collapses hot copies
    before the shuffle)."""
    return df.dropDuplicates()


def winsorize(panel: DataFrame, keys=("series_id",), k: float = 1.5, min_values: int = 4,
              exclude=("year",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Clamp numeric columns with at least ``min_values`` non-null values in
    the series to ``Q1 - k IQR .. Q3 + k IQR``. The key and ``year`` are never clipped."""
    keys = list(keys)
    num = [c for c in numeric_columns(panel, exclude=tuple(keys) + tuple(exclude))]
    b = iqr_bounds(panel, num, k, keys, hot_rows)
    out = []
    for f in panel.schema.fields:
        if f.name in num:
            c = F.col(f.name)
            clipped = F.least(F.greatest(c, F.col(f"_lo_{f.name}")), F.col(f"_hi_{f.name}"))
            keep = (F.col(f"_n_{f.name}") >= min_values) & c.isNotNull()
            out.append(F.when(keep, clipped).otherwise(c).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return b.select(*out)


def clean_panel(panel: DataFrame, keys=("series_id",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Impute -> de-duplicate -> winsorise."""
    return winsorize(dedup(impute(panel, keys, hot_rows=hot_rows)), keys, hot_rows=hot_rows)


def complete_years(panel: DataFrame, keys=("series_id",)) -> DataFrame:
    """Fill gaps inside each series' own year span with null rows (input to D7)."""
    keys = list(keys)
    span = panel.groupBy(*keys).agg(F.min("year").alias("_y0"), F.max("year").alias("_y1"))
    grid = span.select(*keys, F.explode(F.sequence("_y0", "_y1")).alias("year"))
    return grid.join(panel, keys + ["year"], "left")


# --- D13 -----------------------------------------------------------------------------------

def model_compatibility(panel: DataFrame, keys=("series_id",)) -> DataFrame:
    """D13 per series: a required column counts as present only if it exists and
    holds a non-null value in the series. Output per (series, model): required,
    missing, score = share present x 100, compatible flag."""
    keys = list(keys)
    present = {}
    for long_name, short in [("actual_passengers", "actual"), ("population", "population"),
                             ("gdp_per_capita", "gdp"), ("ticket_price", "price")]:
        present[long_name] = (F.max(F.col(short).isNotNull().cast("int")) > 0) if short in panel.columns else F.lit(False)
    g = panel.groupBy(*keys).agg(*[present[k].alias(k) for k in present])
    rows = []
    for model in K.MODEL_NAMES:
        req = K.MODEL_REQUIREMENTS[model]
        missing = F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in req]), lambda x: x.isNotNull())
        rows.append(F.struct(F.lit(model).alias("model"), F.lit(len(req)).alias("n_required"), missing.alias("missing")))
    out = g.select(*keys, F.explode(F.array(*rows)).alias("_m")).select(*keys, "_m.*")
    return out.select(*keys, "model", F.array_join("missing", ",").alias("missing_columns"),
                      ((F.col("n_required") - F.size("missing")) / F.col("n_required") * F.lit(100.0)).alias("compatibility_score"),
                      (F.size("missing") == 0).alias("is_compatible"))


# --- D15 -----------------------------------------------------------------------------------

def load_panel(spark: SparkSession, path: str | list[str], series_id: int = 0, by_file: bool = False):
    """Delimited file -> typed -> normalised names -> panel, plus its
    validation checks and profile. Without ``year`` or ``actual_passengers`` the
    checks are error rows ``missing_<column>``. The full data is returned (no
    preview cut).

    A list of paths is read as one table, its files matched by normalised names. With
    ``by_file`` each file without a ``series_id`` column is a series of its own, named
    by a hash of its path, so files spread over tasks."""
    from ..sources.delimited import read_delimited, read_delimited_many
    if by_file or not isinstance(path, str):
        df = normalize_column_names(read_delimited_many(spark, path, "_file", K.COLUMN_SYNONYMS))
        series = F.xxhash64("_file") if by_file else F.lit(series_id)
    else:
        df = normalize_column_names(read_delimited(spark, path))
        series = F.lit(series_id)
    missing = [c for c in ("year", "actual_passengers") if c not in df.columns]
    panel = to_panel(df, series).drop("_file")
    if missing:
        # The checks say what is missing; rules on other columns can't be asked.
        rows = F.array(*[F.struct(F.lit(f"missing_{c}").alias("rule"), F.lit("error").alias("severity"),
                                  F.lit(1).cast("bigint").alias("n")) for c in missing])
        checks = panel.select("series_id").distinct().select("series_id", F.inline(rows))
        return panel, checks, profile(panel)
    checks = validate_panel(panel)
    if not isinstance(panel.schema["year"].dataType, (T.IntegerType, T.LongType)):
        panel = panel.withColumn("year", F.when(F.col("year") == F.floor("year"), F.col("year").cast("int")))
    return panel, checks, profile(panel)
