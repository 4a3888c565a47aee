"""Bootstrap saturation model (M8 fit, P8 forecast, P9 samples, B3 quantiles).

Fit. For each series and simulation ``sim``, ``n`` rows are drawn with
replacement by a portable hash draw ``index = floor(u(series, sim, slot, seed) n) + 1``.
With ``optimize_parameters`` each resample picks the first-best cell of the
41 x 30 grid (k1 outer, k2 inner) by SSE. The squared error of every (row,
cell) is computed once per series, not once per resample; a resample's SSE
per cell is then a sum over its drawn row indices. Both steps are array
higher-order functions inside one row per (series, block of simulations):
no (simulation x cell) pairs are materialised and nothing is shuffled but the
series rows once. Blocks of simulations give parallelism to deep simulations
on few series.

Parameters = the mean of the resampled (k1, k2); continuity = recent-window
factor (A1); residuals (centred) are kept for the forecast.

Forecast. Per simulation: the curve with that simulation's (k1, k2), times the
factor, plus a residual drawn with replacement by a hash of (series, sim, h),
floored at 0; then mean and q05/q25/q75/q95 per year (exact percentiles, or sketches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import curve as C
from ..functions.draws import draw_index
from .fitting import blank_invalid, common_aggs, merge_params, metrics_struct, recent_factor, to_col, windows, with_group_context
from ..session import cut_lineage, parallelism, ship_package
from .horizon import expand_horizon
from .quantiles import sketch_quantiles, sketches

SIM_BLOCK = 64


N_CELLS = K.BOOT_K1_N * K.BOOT_K2_N
_SPAN1 = K.BOOT_K1_HI - K.BOOT_K1_LO
_SPAN2 = K.BOOT_K2_HI - K.BOOT_K2_LO


def grid_cell(i):
    """Cell ``i`` (0-based) of the 41 x 30 grid, k1 outer and k2 inner:
    ``k1 = lo1 + (i div 30) span1 / 40``, ``k2 = lo2 + (i mod 30) span2 / 29``.
    Index arithmetic keeps the expression small (no 1230-element literal)."""
    i1 = F.floor(i / F.lit(K.BOOT_K2_N)).cast("double")
    i2 = (i % F.lit(K.BOOT_K2_N)).cast("double")
    k1 = F.lit(K.BOOT_K1_LO) + (i1 * F.lit(_SPAN1)) / F.lit(float(K.BOOT_K1_N - 1))
    k2 = F.lit(K.BOOT_K2_LO) + (i2 * F.lit(_SPAN2)) / F.lit(float(K.BOOT_K2_N - 1))
    return F.struct(k1.alias("k1"), k2.alias("k2"))


def _round6(c):
    """Round a non-negative SSE to 6 decimals (half up) with cheap double
    arithmetic; ties in the argmin are then decided by grid order."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def bootstrap_samples(rows: DataFrame, keys, a, b, n_sims: int, seed: int, optimize: bool,
                      k1_default, k2_default, engine: str = "numpy") -> DataFrame:
    """(keys..., sim, k1, k2): the per-resample grid winners (or the defaults).

    ``engine='numpy'`` hands each (series, block) row to a vectorised step
    (``mapInPandas``): SSE of all resamples x cells is one small matrix
    product multiplicities @ errors^T. ``engine='jvm'`` evaluates the same sums
    with array higher-order functions, without Python."""
    keys = list(keys)
    if not optimize:
        base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return base.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(int(n_sims)))).alias("sim"),
                           to_col(k1_default).cast("double").alias("k1"), to_col(k2_default).cast("double").alias("k2"))
    grid_col = F.transform(F.sequence(F.lit(0), F.lit(N_CELLS - 1)), grid_cell)
    per_series = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("year", "rho", "population", "actual"))).alias("_rows"))
    # Draws: one hash per (series, sim, slot), computed once and collected per
    # (series, block of simulations); groups are bounded by n and SIM_BLOCK.
    draws = per_series.select(*keys, F.size("_rows").alias("_n"),
                              F.explode(F.sequence(F.lit(1), F.lit(int(n_sims)))).alias("sim"))
    draws = draws.select(*keys, "sim", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("slot"),
                         draw_index(F.col("_n"), *[F.col(k) for k in keys], F.col("sim"), F.col("slot"),
                                    F.lit(int(seed))).alias("idx"))
    per_sim = draws.groupBy(*keys, "sim").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "idx"))), lambda x: x["idx"]).alias("idxs"))
    blocks = per_sim.groupBy(*keys, F.floor((F.col("sim") - F.lit(1)) / F.lit(SIM_BLOCK)).alias("_blk")).agg(
        F.collect_list(F.struct("sim", "idxs")).alias("_sims"))
    # Only small rows move: the block's draws and the series' n training rows.
    # The compute-heavy rows are spread with an explicit partition count (AQE would
    # coalesce the small input into one task): the session's shuffle partitions,
    # which a deployment sizes to its data, and at least one per core.
    spark = rows.sparkSession
    spread = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = blocks.join(per_series, keys).repartition(spread, *keys, "_blk")

    def sq_err(x, cell):
        e = x["actual"] - x["population"] * C.saturation(x["rho"], a, b, cell["k1"], cell["k2"])
        return e * e

    # Squared error of every (cell, row) for this block's series:
    # array<array<double>>, 1230 x n. It is bound once per row as the lambda
    # variable ``e2`` of a one-element transform, so the optimiser cannot
    # inline (and re-evaluate) it inside the per-simulation loop.
    e2_matrix = F.transform(grid_col, lambda cell: F.transform(F.col("_rows"), lambda x: sq_err(x, cell)))

    def winner(sm, e2):
        sse = F.transform(e2, lambda row_e2: _round6(
            F.aggregate(sm["idxs"], F.lit(0.0), lambda acc, i: acc + F.element_at(row_e2, i))))
        return F.struct(sm["sim"].alias("sim"), sse.alias("sse"))

    def pick(x):
        cell = grid_cell(F.array_position(x["sse"], F.array_min(x["sse"])) - F.lit(1))
        return F.struct(x["sim"].alias("sim"), cell["k1"].alias("k1"), cell["k2"].alias("k2"))

    if engine == "numpy":
        return _numpy_winners(work.select(*keys, F.col("_sims").alias("bsims"), F.col("_rows").alias("brows"),
                                          a.cast("double").alias("ba"), b.cast("double").alias("bb")), keys)
    per_block = F.element_at(F.transform(F.array(e2_matrix), lambda e2: F.transform(
        F.transform(F.col("_sims"), lambda sm: winner(sm, e2)), pick)), 1)
    out = work.select(*keys, F.explode(per_block).alias("_w"))
    return out.select(*keys, F.col("_w.sim").alias("sim"), F.col("_w.k1").alias("k1"), F.col("_w.k2").alias("k2"))


def _numpy_winners(work: DataFrame, keys) -> DataFrame:
    """Per (series, block) row: squared errors E (cells x n) of the 41 x 30
    grid on the series' rows, multiplicity matrix M (sims x n) from the drawn
    indices, SSE = M @ E^T (sims x cells), rounded half-up to 1e-6, first
    minimum in grid order. A row holds at most SIM_BLOCK sims and n rows, so
    every batch stays small; Spark partitions and shuffles the rows."""
    import numpy as np

    key_fields = [work.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", sim int, k1 double, k2 double"
    n2 = K.BOOT_K2_N
    ci = np.arange(N_CELLS)
    # Same arithmetic (and order of operations) as ``grid_cell``.
    gk1 = K.BOOT_K1_LO + ((ci // n2).astype(np.float64) * _SPAN1) / float(K.BOOT_K1_N - 1)
    gk2 = K.BOOT_K2_LO + ((ci % n2).astype(np.float64) * _SPAN2) / float(K.BOOT_K2_N - 1)

    def winners(batches):
        import pandas as pd
        for pdf in batches:
            out = {k: [] for k in keys}
            out.update(sim=[], k1=[], k2=[])
            for row in pdf.to_dict("records"):
                rws = row["brows"]
                rho = np.array([x["rho"] for x in rws], dtype=np.float64)
                pop = np.array([x["population"] for x in rws], dtype=np.float64)
                act = np.array([x["actual"] for x in rws], dtype=np.float64)
                n = len(rws)
                f = C.saturation_np(rho[None, :], row["ba"], row["bb"], gk1[:, None], gk2[:, None])
                err = act[None, :] - pop[None, :] * f
                e2 = err * err
                sims = row["bsims"]
                m = np.zeros((len(sims), n), dtype=np.float64)
                ids = []
                for j, sm in enumerate(sims):
                    np.add.at(m[j], np.asarray(sm["idxs"], dtype=np.int64) - 1, 1.0)
                    ids.append(int(sm["sim"]))
                sse = np.floor((m @ e2.T) * 1e6 + 0.5) / 1e6
                best = np.argmin(sse, axis=1)
                for j, c in enumerate(best.tolist()):
                    for k in keys:
                        out[k].append(row[k])
                    out["sim"].append(ids[j])
                    out["k1"].append(float(gk1[c]))
                    out["k2"].append(float(gk2[c]))
            yield pd.DataFrame(out)

    ship_package(work.sparkSession)
    return work.mapInPandas(winners, schema)


def fit_bootstrap_logistic(panel: DataFrame, params: dict | None = None, keys=("series_id",),
                           engine: str = "numpy") -> DataFrame:
    """M8. Returns one fit row per series with mean/std of the resampled
    parameters, the sample arrays (for the forecast), centred residuals,
    continuity and metrics."""
    keys = list(keys)
    p = merge_params(K.BOOTSTRAP_DEFAULTS, params, "bootstrap_logistic")
    a, b = to_col(p["distribution_a"]), to_col(p["distribution_b"])
    rows = with_group_context(panel.select(*keys, "year", "actual", "population", "gdp", "price"), keys)
    rho = C.income_normalised_price(F.try_divide(F.col("price"), F.col("ref_price")), F.col("gdp"), F.col("ref_gdp"))
    rows = rows.withColumn("rho", rho)
    samples = bootstrap_samples(rows, keys, a, b, int(p["n_simulations"]), int(p["seed"]),
                                p["optimize_parameters"] is True, p["k1"], p["k2"], engine=engine)
    dist = samples.groupBy(*keys).agg(
        F.avg("k1").alias("k1"), F.avg("k2").alias("k2"),
        F.stddev_samp("k1").alias("k1_std"), F.stddev_samp("k2").alias("k2_std"),
        F.sort_array(F.collect_list(F.struct("sim", "k1", "k2"))).alias("samples"))
    # Joined twice below: written once, so that the resampling stage runs once.
    dist = cut_lineage(dist)
    rows = rows.join(dist.select(*keys, F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), keys)
    _, w_all = windows(keys)
    rows = rows.withColumn("pred", F.col("population") * C.saturation(F.col("rho"), a, b, F.col("_k1"), F.col("_k2")))
    rows = rows.withColumn("factor", recent_factor(rows, keys))
    rows = rows.withColumn("adj", F.col("pred") * F.col("factor"))
    rows = rows.withColumn("resid", (F.col("actual") - F.col("adj")) - F.avg(F.col("actual") - F.col("adj")).over(w_all))
    fit = blank_invalid(rows.groupBy(*keys).agg(
        F.lit("bootstrap_logistic").alias("model"),
        *common_aggs(min_years=K.RECENT_MIN_YEARS),
        F.first("factor").alias("continuity"),
        F.transform(F.sort_array(F.collect_list(F.struct("year", "resid"))), lambda x: x["resid"]).alias("residuals"),
        F.stddev_samp(F.col("actual") - F.col("adj")).alias("resid_std"),
        metrics_struct(),
    ))
    return fit.join(dist, keys).select(
        "*", a.cast("double").alias("a"), b.cast("double").alias("b"),
        F.lit(int(p["n_simulations"])).alias("n_sims"), F.lit(int(p["seed"])).alias("seed"))


def simulate_bootstrap(fits: DataFrame, horizon: int, scenarios=None, paths=None, keys=("series_id",),
                       apply_continuity_adjustment: bool = True) -> DataFrame:
    """The long simulation table (keys..., model, scenario_id, sim, year, h, drivers, pred)."""
    keys = list(keys)
    rows = expand_horizon(fits, horizon, scenarios, paths, keys)
    rows = rows.select("*", F.explode("samples").alias("_s"))
    rho = C.income_normalised_price(F.try_divide(F.col("price"), F.col("ref_price")), F.col("gdp"), F.col("ref_gdp"))
    pred = F.col("population") * C.saturation(rho, F.col("a"), F.col("b"), F.col("_s.k1"), F.col("_s.k2"))
    if apply_continuity_adjustment:
        pred = pred * F.col("continuity")
    n_res = F.size("residuals")
    ridx = draw_index(n_res, *[F.col(k) for k in keys], F.col("_s.sim"), F.col("h"), F.col("seed"), F.lit("resid"))
    noisy = F.when(n_res > 0, C.floor_at(pred + F.element_at("residuals", ridx), 0.0)).otherwise(pred)
    return rows.select(*keys, "model", "scenario_id", F.col("_s.sim").alias("sim"), "year", "h", "population", "gdp",
                       "price", noisy.alias("pred"), F.col("metrics.rmse").alias("fit_rmse"))


def predict_bootstrap_logistic(fits: DataFrame, horizon: int, scenarios=None, paths=None, keys=("series_id",),
                               apply_continuity_adjustment: bool = True, sketch: bool = False) -> DataFrame:
    """P8 + B3: mean and empirical quantiles over simulations per year.
    Rows of one series stay in the fit's partition: no exchange before the
    per-year aggregate. With ``sketch`` the quantiles come from mergeable sketches of
    bounded size (:func:`.quantiles.rank_error`), for very many simulations."""
    keys = list(keys)
    sims = simulate_bootstrap(fits, horizon, scenarios, paths, keys, apply_continuity_adjustment)
    by, probs = [*keys, "model", "scenario_id", "year"], (0.05, 0.25, 0.75, 0.95)
    drivers = {c: F.first(c) for c in ("population", "gdp", "price", "fit_rmse")}
    if sketch:
        agg = sketches(sims, by, "pred", others=drivers).select("*", F.col("mean").alias("pred"), sketch_quantiles(probs).alias("_q"))
    else:
        q = F.percentile(F.col("pred"), F.array(*[F.lit(x) for x in probs]))
        agg = sims.groupBy(*by).agg(*[c.alias(n) for n, c in drivers.items()], F.avg("pred").alias("pred"), q.alias("_q"))
    out = agg.select(*keys, "model", "scenario_id", "year", "population", "gdp", "price", "pred",
                     F.col("_q")[0].alias("lower"), F.col("_q")[3].alias("upper"),
                     F.col("_q")[1].alias("q25"), F.col("_q")[2].alias("q75"),
                     F.lit("bootstrap_q05_q95").alias("band_type"), "fit_rmse")
    w = Window.partitionBy(*keys, "model", "scenario_id").orderBy("year")
    prev = F.lag("pred").over(w)
    growth = F.when(prev.isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("pred") - prev, prev) * F.lit(100.0))
    return out.withColumn("growth_rate", growth)
