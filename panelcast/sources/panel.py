"""Panel sources: the demand panel derived from the order tables, and a
seeded synthetic panel generator for scale runs.

Panel schema: ``series_id BIGINT, year INT, actual DOUBLE, population DOUBLE,
gdp DOUBLE, price DOUBLE`` — one row per (series, year).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform

PANEL_COLUMNS = ["series_id", "year", "actual", "population", "gdp", "price"]


def cents(c):
    """A two-decimal amount as integer cents (half-up on the binary value)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("long")


def money_sum(c):
    """Exact sum of a two-decimal amount, in integer cents (LongType): the
    result does not depend on partitioning or summation order, so reruns and
    recomputed tasks agree bit for bit, and it stays on the fast long path."""
    return F.sum(cents(c))


def from_cents(total):
    """Cents total -> amount as the correctly rounded double."""
    return total.cast("double") / F.lit(100.0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def demand_panel(spark: SparkSession, sf_dir: str, max_year: int | None = None,
                 min_year: int | None = None) -> DataFrame:
    """Derive the (nation, year) demand panel from orders, customer, lineitem.

    series_id = customer nation; year = order year; actual = number of orders;
    population = distinct ordering customers; gdp = average order total;
    price = sum(extended price) / sum(quantity).

    Plan, designed for very large order tables:
    * lineitem is aggregated per order first (map-side partial aggregation
      collapses even a hot order before its shuffle);
    * orders ⟕ that aggregate on the order key, then partially aggregated per
      (customer, year) *before* meeting the customer table, so the customer join
      shuffles at most customers × years rows, never orders;
    * the final (nation, year) aggregate is tiny; ``count(*)`` of the
      (customer, year) groups is the distinct-customer count without a
      separate distinct aggregation.
    Year bounds become timestamp predicates that reach the Parquet scan.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if min_year is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(f"{int(min_year):04d}-01-01").cast("timestamp_ntz"))
    if max_year is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(f"{int(max_year) + 1:04d}-01-01").cast("timestamp_ntz"))

    per_order = (read_table(spark, sf_dir, "lineitem")
                 .groupBy("l_orderkey")
                 .agg(money_sum("l_extendedprice").alias("ext"), money_sum("l_quantity").alias("qty")))

    per_cust_year = (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
                     .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
                     .agg(F.count(F.lit(1)).alias("n_orders"),
                          money_sum("o_totalprice").alias("tp_sum"),
                          F.count("o_totalprice").alias("tp_n"),
                          F.sum("ext").alias("ext"),
                          F.sum("qty").alias("qty")))

    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = per_cust_year.join(customer, per_cust_year.o_custkey == customer.c_custkey, "inner")

    return (joined.groupBy(F.col("c_nationkey").cast("bigint").alias("series_id"),
                           F.col("year").cast("int").alias("year"))
            .agg(F.sum("n_orders").cast("double").alias("actual"),
                 F.count(F.lit(1)).cast("double").alias("population"),
                 F.try_divide(from_cents(F.sum("tp_sum")), F.sum("tp_n").cast("double")).alias("gdp"),
                 F.try_divide(from_cents(F.sum("ext")), from_cents(F.sum("qty"))).alias("price")))


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer panel with one series per customer: orders per year, line items
    per year, average order total and average unit price. Customers skip years,
    so gaps, skew and outliers are real — the input of the cleaning queries.
    Lineitem is pre-aggregated per order before its shuffle."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    per_order = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("lines"), money_sum("l_extendedprice").alias("ext"),
                      money_sum("l_quantity").alias("qty")))
    j = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    return (j.groupBy(F.col("o_custkey").cast("bigint").alias("series_id"),
                      F.year("o_orderdate").cast("int").alias("year"))
            .agg(F.count(F.lit(1)).cast("double").alias("actual"),
                 F.coalesce(F.sum("lines"), F.lit(0)).cast("double").alias("population"),
                 F.try_divide(from_cents(money_sum("o_totalprice")), F.count("o_totalprice").cast("double")).alias("gdp"),
                 F.try_divide(from_cents(F.sum("ext")), from_cents(F.sum("qty"))).alias("price")))


def training_window(panel: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Keep ``start <= year <= end``; null years are dropped."""
    if start is not None and end is not None and start > end:
        raise ValueError("start year must not exceed end year")
    cond = F.col("year").isNotNull()
    if start is not None:
        cond = cond & (F.col("year") >= F.lit(int(start)))
    if end is not None:
        cond = cond & (F.col("year") <= F.lit(int(end)))
    return panel.where(cond)


def training_window_bounds(panel: DataFrame, bounds: DataFrame, key: str = "series_id") -> DataFrame:
    """D11 with a window for each series: ``bounds (series_id, first_year, last_year)``,
    where a null bound is open and a series without a row keeps all its years.

    Rows inside their window have status ``ok``. A series that keeps none, among those
    of either table, is one row without year: ``bad_bounds`` (first after last) or
    ``empty_window``."""
    limits = bounds.select(F.col(key).alias("_key"), F.col("first_year").alias("_lo"), F.col("last_year").alias("_hi"))
    dated = panel.where(F.col("year").isNotNull()).join(limits, F.col(key).eqNullSafe(F.col("_key")), "left")
    inside = dated.where((F.col("_lo").isNull() | (F.col("year") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("year") <= F.col("_hi"))))
    kept = inside.select(*panel.columns, F.lit("ok").alias("status"))
    every = panel.select(F.col(key).alias("_all")).unionAll(limits.select("_key")).distinct()
    having = kept.select(F.col(key).alias("_has")).distinct()
    empty = (every.join(having, F.col("_all").eqNullSafe(F.col("_has")), "left_anti")
             .join(limits, F.col("_all").eqNullSafe(F.col("_key")), "left")
             .select(F.col("_all").alias(key), F.when(F.col("_lo") > F.col("_hi"), "bad_bounds").otherwise("empty_window").alias("status")))
    return kept.unionByName(empty, allowMissingColumns=True)


# --- synthetic panel (S9) -----------------------------------------------------

def _normal(*keys) -> Column:
    """Standard normal by Box–Muller from two portable uniforms."""
    u1 = F.greatest(uniform(*keys, "u1"), F.lit(1e-12))
    u2 = uniform(*keys, "u2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def synthetic_panel(spark: SparkSession, n_series: int, n_years: int = 30, first_year: int = 1995,
                    seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """Seeded synthetic annual series: linear trend + 8-year cycle + shocks
    (2009-10 and 2020) + Gaussian noise with a floor, plus population, GDP per
    head and price trends. Generated on the executors, ``n_series`` may be
    millions; every value is a pure function of (series, year, seed).

    FIXED VALUES of the generator: trend 1,250,000 + 72,000 i; cycle
    115,000 sin(2 pi i / 8); shocks -180,000 in 2009-2010 and -520,000 in 2020;
    noise sd 35,000; floor 50,000; population 31,000,000 + 185,000 i (sd 40,000);
    GDP 2,900 + 85 i (sd 45); price 160 + 1.8 i (sd 3).
    """
    base = spark.range(0, n_series, numPartitions=num_partitions) if num_partitions else spark.range(0, n_series)
    rows = base.select(F.col("id").alias("series_id"),
                       F.explode(F.sequence(F.lit(1), F.lit(n_years))).alias("i"))
    i = F.col("i").cast("double")
    year = (F.lit(first_year) - F.lit(1) + F.col("i")).cast("int")
    sid = F.col("series_id")
    shock = (F.when(year.between(2009, 2010), F.lit(-180000.0))
             .when(year == 2020, F.lit(-520000.0)).otherwise(F.lit(0.0)))
    passengers = F.greatest(
        F.lit(50000.0),
        F.lit(1250000.0) + F.lit(72000.0) * i
        + F.lit(115000.0) * F.sin(F.lit(2 * math.pi) * i / F.lit(8.0))
        + shock + F.lit(35000.0) * _normal(sid, F.col("i"), seed, "y"))
    return rows.select(
        sid.cast("bigint").alias("series_id"),
        year.alias("year"),
        passengers.alias("actual"),
        (F.lit(31000000.0) + F.lit(185000.0) * i + F.lit(40000.0) * _normal(sid, F.col("i"), seed, "p")).alias("population"),
        (F.lit(2900.0) + F.lit(85.0) * i + F.lit(45.0) * _normal(sid, F.col("i"), seed, "g")).alias("gdp"),
        (F.lit(160.0) + F.lit(1.8) * i + F.lit(3.0) * _normal(sid, F.col("i"), seed, "c")).alias("price"),
    )
