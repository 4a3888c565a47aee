"""Exact quantiles per group, for groups of any size.

Groups of up to ``HOT_ROWS`` rows take the exact aggregate, whose buffer holds the
distinct values of one group. Larger ones are split over tasks:

1. one aggregate with bounded sketches brackets each quantile: the values at a rank a
   little below and a little above the one asked for;
2. a frequency table counts the values within each bracket, and all rows below it as
   one; rows of one value are added up before they are shuffled;
3. the exact order statistic is read off the counts and interpolated as Spark's own
   ``percentile`` does.

So a group that holds a third of all rows costs its tasks a sketch, and one task the
few thousandths of its rows that lie in a bracket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows of a group above which it is split.
HOT_ROWS = 1 << 20
#: Of the sketches: ranks are right to one part in so many.
ACCURACY = 10_000


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi-join in which a null key meets a null key; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(Column.__and__, [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys])
    out = left.join(named, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{k}" for k in keys])


def _whole(df: DataFrame, cols, probs, keys) -> DataFrame:
    at = F.array(*[F.lit(float(p)) for p in probs])
    return df.groupBy(*keys).agg(*[F.percentile(F.col(c), at).alias(f"_q_{c}") for c in cols],
                                 *[F.count(F.col(c)).alias(f"_n_{c}") for c in cols])


def _split(df: DataFrame, hot: DataFrame, cols, probs, keys, accuracy: int) -> DataFrame:
    by = [*keys, "_column"]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_m"))
    long = long.select(*keys, F.col("_m.c").alias("_column"), F.col("_m.v").alias("_value")).where(F.col("_value").isNotNull())
    margin = 2.0 / accuracy
    ranks = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    found = long.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_value", ranks, accuracy).alias("_s"),
                                  F.min("_value").alias("_least"), F.max("_value").alias("_most"))

    def bracket(i: int, p: float) -> Column:
        low = F.col("_s")[i] if p > margin else F.col("_least")
        high = F.col("_s")[len(probs) + i] if p < 1 - margin else F.col("_most")
        return F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at"))

    brackets = written(found.select(*by, "_n", F.array(*[bracket(i, p) for i, p in enumerate(probs)]).alias("_b")), "brackets")
    inside = join_null_safe(long, brackets, by, "inner").select(*by, "_value", "_n", F.explode("_b").alias("_b")).where(F.col("_value") <= F.col("_b.high"))
    value = F.when(F.col("_value") >= F.col("_b.low"), F.col("_value"))
    table = inside.groupBy(*by, "_n", F.col("_b.i").alias("_i"), F.col("_b.at").alias("_at"), value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = table.groupBy(*by, "_n", "_i", "_at").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("_below"),
        F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "c")))).alias("_inside"))

    def nth(k: Column) -> Column:
        start = F.struct(F.col("_below").alias("seen"), F.lit(None).cast("double").alias("hit"))
        step = lambda acc, x: F.struct((acc["seen"] + x["c"]).alias("seen"), F.coalesce(acc["hit"], F.when(acc["seen"] + x["c"] > k, x["v"])).alias("hit"))
        return F.when(F.col("_below") <= k, F.aggregate("_inside", start, step, lambda acc: acc["hit"]))

    lower, upper, at = F.floor("_at"), F.ceil("_at"), F.col("_at")
    counts = counts.withColumns({"_low": nth(lower), "_high": nth(upper)})
    missed = F.raise_error(F.lit("a quantile lies outside its bracket; raise the accuracy"))
    exact = (F.when(F.col("_low").isNull() | F.col("_high").isNull(), missed.cast("double"))
             .when((lower == upper) | (F.col("_low") == F.col("_high")), F.col("_low"))
             .otherwise((upper - at) * F.col("_low") + (at - lower) * F.col("_high")))
    placed = counts.select(*by, "_n", "_i", exact.alias("_x"))
    per = [F.array(*[F.max(F.when((F.col("_column") == c) & (F.col("_i") == i), F.col("_x"))) for i in range(len(probs))]) for c in cols]
    out = placed.groupBy(*keys).agg(*[a.alias(f"_q_{c}") for a, c in zip(per, cols)],
                                    *[F.max(F.when(F.col("_column") == c, F.col("_n"))).alias(f"_n_{c}") for c in cols])
    # A column without values has no quantiles, as in the plain aggregate.
    return join_null_safe(hot, out, keys).select(*keys, *[F.when(F.col(f"_n_{c}") > 0, F.col(f"_q_{c}")).alias(f"_q_{c}") for c in cols],
                                                 *[F.coalesce(F.col(f"_n_{c}"), F.lit(0)).alias(f"_n_{c}") for c in cols])


def group_quantiles(df: DataFrame, cols: list[str], probs, keys, hot_rows: int = HOT_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """Per group: ``_q_<column>`` (the quantiles ``probs``, null without values) and
    ``_n_<column>`` (its values that are not null). ``df`` is read more than once."""
    keys = list(keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)
    if hot.isEmpty():
        return _whole(df, cols, probs, keys)
    hot = written(hot, "hot-groups")
    calm = _whole(join_null_safe(df, hot, keys, "left_anti"), cols, probs, keys)
    return calm.unionByName(_split(join_null_safe(df, hot, keys, "left_semi"), hot, cols, probs, keys, accuracy))


def group_modes(df: DataFrame, cols: list[str], keys) -> DataFrame | None:
    """Per group the most frequent value of each column (ties: the least), from frequency
    tables; None without columns."""
    keys, out = list(keys), None
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        one = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_v").alias("v")))["v"].alias(f"_mode_{c}"))
        every = df.select(*keys).distinct()
        out = join_null_safe(every if out is None else out, one, keys)
    return out


# --- mergeable sketches ---------------------------------------------------------------

#: Size of a sketch: ranks are right to about 0.7 % with 99 % confidence (:func:`rank_error`).
#: A group of up to so many values is kept whole, so its quantiles are exact.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Largest error of a quantile's rank, as a share of the values, that a sketch of size
    ``k`` keeps with 99 % confidence (the published fit for KLL sketches)."""
    return 2.296 / k ** 0.9723


def sketches(rows: DataFrame, keys, value: str, k: int = SKETCH_K, others: dict[str, Column] | None = None) -> DataFrame:
    """One KLL sketch per group (column ``sketch``, binary), the number of its values ``n``, their
    ``total`` and ``mean``. Tasks sketch what they hold, and a few KB a task and group are shuffled, so
    no task holds a group's values. Null and NaN values are left out; a group of nothing else has no
    row. ``others`` are further aggregates by name."""
    v = F.col(value).cast("double")
    given = rows.where(F.col(value).isNotNull() & ~F.isnan(v))
    return _with_mean(given.groupBy(*keys).agg(
        F.kll_sketch_agg_double(v, F.lit(int(k))).alias("sketch"), F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"),
        *[c.alias(n) for n, c in (others or {}).items()]))


def merge_sketches(parts: DataFrame, keys, k: int = SKETCH_K) -> DataFrame:
    """Sketches of several runs or parts of the data (tables of :func:`sketches`, in one) as one per group."""
    return _with_mean(parts.groupBy(*keys).agg(
        F.kll_merge_agg_double(F.col("sketch"), F.lit(int(k))).alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total")))


def _with_mean(sketched: DataFrame) -> DataFrame:
    return sketched.withColumn("mean", F.col("total") / F.col("n"))


def sketch_quantiles(probs) -> Column:
    """The values at the ranks ``probs``, as an array: of a group of up to the sketch's size the
    exact order statistics (the least value whose rank reaches the share asked for)."""
    return F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
