"""M2: box-constrained calibration of the saturation curve's (k1, k2) per series.

A relational grid search with zoom rounds replaces the single-machine
quasi-Newton solver: every round evaluates the sum of squared errors of each
grid cell for every series in one grouped aggregate, keeps the best cell per
series, and shrinks the box around it. The start point (and, later, the
previous best) is always one of the cells, so the SSE never gets worse than
the starting parameters. Ties are broken by the smallest (k1, k2) after
rounding the SSE, which is partition-independent.

Shuffles: the panel rows are hash-partitioned by the series key once; every
later aggregate (by series+cell, then by series) reuses that partitioning, so
a round adds no exchange beyond the join of the next box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import curve as C
from ..session import cut_lineage
from .fitting import to_col


def _sse_round(c, digits: int = 6):
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale)) / F.lit(scale)


def _cells(lo1, hi1, n1, lo2, hi2, n2, start1, start2):
    """Array of (k1, k2) cells, k1 outer / k2 inner, plus the start cell."""
    idx = F.sequence(F.lit(0), F.lit(n1 * n2 - 1))
    step1 = (hi1 - lo1) / F.lit(float(max(n1 - 1, 1)))
    step2 = (hi2 - lo2) / F.lit(float(max(n2 - 1, 1)))
    grid = F.transform(idx, lambda i: F.struct(
        (lo1 + F.floor(i / F.lit(n2)).cast("double") * step1).alias("k1"),
        (lo2 + (i % F.lit(n2)).cast("double") * step2).alias("k2")))
    return F.concat(grid, F.array(F.struct(start1.alias("k1"), start2.alias("k2"))))


def calibrate_saturation(panel: DataFrame, params: dict | None = None, keys=("series_id",), rounds: int = 4,
                         grid=(41, 30), zoom_grid=(11, 11), with_penetration: bool = False,
                         checkpoint_every: int = 4) -> DataFrame:
    """Best (k1, k2) per series minimising ``sum (actual - pop F(r))^2`` over
    k1 in [-20, 20], k2 in [0.01, 5] (``with_penetration`` multiplies the
    curve by the penetration, the same factor the prediction uses).

    Returns ``(keys..., k1, k2, sse, sse_start)``."""
    keys = list(keys)
    p = dict(K.LOGISTIC_PRICE_DEFAULTS, **(params or {}))
    a, b = to_col(p["distribution_a"]), to_col(p["distribution_b"])
    scale, pen = to_col(p["full_price_scale"]), to_col(p["full_penetration"])
    rows = panel.select(*keys, C.relative_price_index(F.col("price"), F.col("gdp"), scale).alias("_r"),
                        (F.col("population") * (pen if with_penetration else F.lit(1.0))).alias("_pop"),
                        F.col("actual").alias("_act")).repartition(*keys)

    def sse_of(cells_rows: DataFrame) -> DataFrame:
        ex = cells_rows.select(*keys, "_r", "_pop", "_act", F.explode("_cells").alias("_c"))
        f = C.saturation(F.col("_r"), a, b, F.col("_c.k1"), F.col("_c.k2"))
        e = F.col("_act") - F.col("_pop") * f
        sse = ex.groupBy(*keys, F.col("_c.k1").alias("k1"), F.col("_c.k2").alias("k2")).agg(F.sum(e * e).alias("sse"))
        return sse.groupBy(*keys).agg(F.min(F.struct(_sse_round(F.col("sse")).alias("s"), "k1", "k2")).alias("_best"))

    start1, start2 = to_col(p["k1"]).cast("double"), to_col(p["k2"]).cast("double")
    lo1, hi1 = F.lit(K.CALIB_K1_LO), F.lit(K.CALIB_K1_HI)
    lo2, hi2 = F.lit(K.CALIB_K2_LO), F.lit(K.CALIB_K2_HI)
    first = rows.select("*", _cells(lo1, hi1, grid[0], lo2, hi2, grid[1], start1, start2).alias("_cells"))
    best = sse_of(first)
    start_sse = (rows.groupBy(*keys).agg(F.sum(
        (F.col("_act") - F.col("_pop") * C.saturation(F.col("_r"), a, b, start1, start2)) ** 2).alias("sse_start")))
    w1 = (K.CALIB_K1_HI - K.CALIB_K1_LO) / (grid[0] - 1)
    w2 = (K.CALIB_K2_HI - K.CALIB_K2_LO) / (grid[1] - 1)
    for r in range(1, rounds):
        b1, b2 = F.col("_best.k1"), F.col("_best.k2")
        box = best.select(*keys, "_best",
                          F.greatest(lo1, b1 - F.lit(w1)).alias("_lo1"), F.least(hi1, b1 + F.lit(w1)).alias("_hi1"),
                          F.greatest(lo2, b2 - F.lit(w2)).alias("_lo2"), F.least(hi2, b2 + F.lit(w2)).alias("_hi2"))
        nxt = rows.join(box, keys).select(
            *keys, "_r", "_pop", "_act",
            _cells(F.col("_lo1"), F.col("_hi1"), zoom_grid[0], F.col("_lo2"), F.col("_hi2"), zoom_grid[1],
                   b1, b2).alias("_cells"))
        best = sse_of(nxt)
        if checkpoint_every and r % checkpoint_every == 0 and r < rounds - 1:
            # Long zoom chains: cut the growing plan with a reliable checkpoint
            # in the shared checkpoint directory (survives executor loss).
            best = cut_lineage(best)
        w1 = 2 * w1 / (zoom_grid[0] - 1)
        w2 = 2 * w2 / (zoom_grid[1] - 1)
    return best.join(start_sse, keys).select(*keys, F.col("_best.k1").alias("k1"), F.col("_best.k2").alias("k2"),
                                             F.col("_best.s").alias("sse"), "sse_start")
