"""M2 by bounded least squares: (k1, k2) of the saturation curve per series.

A projected Levenberg-Marquardt search: each step solves the damped 2 x 2 normal
equations JᵀJ δ = Jᵀe of a series, is cut off at the box, and is taken if it lowers the
sum of squared errors. A coordinate at a bound that the step would leave stays there. The
search starts from the best cells of a grid and from the given parameters, so its result
is never worse than either.

Spark groups a series' years into arrays (a few numbers a year); a task searches many
series together as numpy arrays, so there is no row per series, year and cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import curve as C
from ..session import ship_package
from .fitting import to_col

#: Years of all series searched together; bounds a task's memory.
BATCH_YEARS = 4096
STARTS = 3
STEPS = 60


class _Years:
    """The years of some series side by side: index r, population, actual."""

    def __init__(self, r, pop, act, sizes):
        self.r, self.pop, self.act = np.maximum(r, 1e-8), pop, act
        self.log_r = np.log(self.r)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def of(self, series: np.ndarray) -> _Years:
        """The years of the listed series, one list after the other."""
        n = self.sizes[series]
        at = np.repeat(self.starts[series] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return _Years(self.r[at], self.pop[at], self.act[at], n)

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=0)

    def per_year(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x, self.sizes)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def _sse(y: _Years, a, b, k1, k2) -> np.ndarray:
    z = b[:, None] + k1 * y.r[:, None] ** k2 if k1.ndim == 2 else b + k1 * y.r**k2
    pop, act = (y.pop[:, None], y.act[:, None]) if k1.ndim == 2 else (y.pop, y.act)
    top = a[:, None] if k1.ndim == 2 else a
    e = act - pop * np.clip(top * _sigmoid(z), 0.0, 1.0)
    return y.total(e * e)


def search(y: _Years, a, b, k1, k2, cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k1, k2, sse, sse of the start) of each series; ``a``, ``b``, ``k1``, ``k2`` hold one
    number a series, ``cells`` rows (k1, k2) of the grid."""
    n, lo, hi = len(y.sizes), np.array([K.CALIB_K1_LO, K.CALIB_K2_LO]), np.array([K.CALIB_K1_HI, K.CALIB_K2_HI])
    ya, yb = y.per_year(a), y.per_year(b)
    begin = _sse(y, ya, yb, y.per_year(k1), y.per_year(k2))
    grid = _sse(y, ya, yb, cells[:, 0][None, :], cells[:, 1][None, :])
    best = np.argsort(grid, axis=1, kind="stable")[:, :STARTS]
    series = np.repeat(np.arange(n), STARTS + 1)
    x = np.concatenate([cells[best], np.column_stack([k1, k2])[:, None, :]], axis=1).reshape(-1, 2)
    z, za, zb = y.of(series), a[series], b[series]
    pa, pb = z.per_year(za), z.per_year(zb)
    value = _sse(z, pa, pb, z.per_year(x[:, 0]), z.per_year(x[:, 1]))
    damp = np.full(len(x), 1e-3)
    for _ in range(STEPS):
        c, d = z.per_year(x[:, 0]), z.per_year(x[:, 1])
        power = z.r**d
        s = _sigmoid(pb + c * power)
        raw = pa * s
        slope = np.where((raw > 0) & (raw < 1), raw * (1.0 - s), 0.0) * z.pop
        e = z.act - z.pop * np.clip(raw, 0.0, 1.0)
        j1, j2 = slope * power, slope * c * power * z.log_r
        g = np.column_stack([z.total(j1 * e), z.total(j2 * e)])
        h11, h12, h22 = z.total(j1 * j1), z.total(j1 * j2), z.total(j2 * j2)
        held = ((x <= lo) & (g < 0)) | ((x >= hi) & (g > 0))
        m11, m22 = h11 * (1 + damp) + 1e-300, h22 * (1 + damp) + 1e-300
        m12 = np.where(held.any(axis=1), 0.0, h12)
        det = m11 * m22 - m12 * m12
        step = np.column_stack([(m22 * g[:, 0] - m12 * g[:, 1]), (m11 * g[:, 1] - m12 * g[:, 0])]) / np.where(det > 0, det, np.inf)[:, None]
        trial = np.clip(x + np.where(held, 0.0, np.nan_to_num(step)), lo, hi)
        after = _sse(z, pa, pb, z.per_year(trial[:, 0]), z.per_year(trial[:, 1]))
        better = after < value
        if not better.any() and (damp > 1e12).all():
            break
        x, value = np.where(better[:, None], trial, x), np.where(better, after, value)
        damp = np.where(better, damp / 3, damp * 4)
    value, x = value.reshape(n, -1), x.reshape(n, -1, 2)
    win = np.argmin(value, axis=1)
    out = x[np.arange(n), win]
    return out[:, 0], out[:, 1], value[np.arange(n), win], begin


def calibrate_bounded(panel: DataFrame, params: dict | None = None, keys=("series_id",), grid=(41, 30),
                      with_penetration: bool = False) -> DataFrame:
    """M2: the (k1, k2) of each series that minimise ``sum (actual - pop F(r))^2`` in the
    box; ``grid`` gives the number of start cells along k1 and k2. Years with a missing
    value do not count; a series without any keeps the given parameters, its sums null.

    Returns ``(keys..., k1, k2, sse, sse_start)``."""
    keys = list(keys)
    p = dict(K.LOGISTIC_PRICE_DEFAULTS, **(params or {}))
    scale, pen = to_col(p["full_price_scale"]), to_col(p["full_penetration"])
    r = C.relative_price_index(F.col("price"), F.col("gdp"), scale)
    pop = F.col("population") * (pen if with_penetration else F.lit(1.0))
    whole = r.isNotNull() & pop.isNotNull() & F.col("actual").isNotNull()
    given = {"_a": "distribution_a", "_b": "distribution_b", "_k1": "k1", "_k2": "k2"}
    # Sorted, so the sums do not depend on the order in which years arrive.
    years = F.sort_array(F.collect_list(F.when(whole, F.struct(F.col("year").alias("y"), r.alias("r"), pop.alias("pop"), F.col("actual").alias("act")))))
    series = panel.groupBy(*keys).agg(years.alias("_years"), *[F.first(to_col(p[v]).cast("double")).alias(k) for k, v in given.items()])
    cells = np.array([(c, d) for c in np.linspace(K.CALIB_K1_LO, K.CALIB_K1_HI, grid[0]) for d in np.linspace(K.CALIB_K2_LO, K.CALIB_K2_HI, grid[1])])
    arrays = series.select(*keys, *given, *[F.col("_years")[n].alias(f"_{n}") for n in ("r", "pop", "act")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["_r"].map(len).to_numpy()
            out = batch[keys].copy()
            out["k1"], out["k2"], out["sse"], out["sse_start"] = batch["_k1"], batch["_k2"], np.nan, np.nan
            full = np.flatnonzero(size)
            block = np.cumsum(size[full]) // BATCH_YEARS
            for part in (full[block == k] for k in np.unique(block)):
                own = batch.iloc[part]
                y = _Years(*[np.concatenate(own[c].to_list()) for c in ("_r", "_pop", "_act")], size[part])
                found = search(y, *[own[c].to_numpy() for c in given], cells)
                for name, values in zip(("k1", "k2", "sse", "sse_start"), found, strict=True):
                    out.iloc[part, out.columns.get_loc(name)] = values
            yield out

    ship_package(panel.sparkSession)
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in series.schema.fields if f.name in keys]
    found = arrays.mapInPandas(run, ", ".join(key_types) + ", k1 double, k2 double, sse double, sse_start double")
    return found.select(*keys, "k1", "k2", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("sse", "sse_start")])
