"""Column functions of the demand models (all JVM-side expressions).

Every function takes and returns ``Column`` objects, so callers may pass
literals (``F.lit``) or per-row parameter columns (sweeps, simulations).
Nothing here leaves whole-stage codegen except the bisection fold, which is
a higher-order ``aggregate`` evaluated once per fit row, not per data row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def floor_at(x, eps: float) -> Column:
    """``max(x, eps)`` that keeps nulls null (Spark's greatest skips nulls)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(eps))))


def clamp(x, lo, hi) -> Column:
    """``x`` between ``lo`` and ``hi``; a null stays null (Spark's greatest and
    least skip nulls, which would turn a missing value into a bound)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _c(lo)), _c(hi)))


def saturation(r, a, b, c, d) -> Column:
    """``clamp(a (1 - 1/(1 + exp(b + c r^d))), 0, 1)`` with ``r >= 1e-8``."""
    r, a, b, c, d = map(_c, (r, a, b, c, d))
    safe_r = floor_at(r, 1e-8)
    expo = b + c * F.pow(safe_r, d)
    raw = a * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(expo)))
    return clamp(raw, 0.0, 1.0)


def elasticity(r, a, b, c, d) -> Column:
    """Point elasticity of the curve, ``c d (1 - F/max(a,1e-10)) r^d``."""
    r, a, b, c, d = map(_c, (r, a, b, c, d))
    f = saturation(r, a, b, c, d)
    safe_r = floor_at(r, 1e-10)
    return c * d * (F.lit(1.0) - f / F.greatest(a, F.lit(1e-10))) * F.pow(safe_r, d)


def inverse_saturation(f_target, a, b, c, d) -> Column:
    """The ``r`` with ``saturation(r) == f_target`` (target clamped into range)."""
    f_target, a, b, c, d = map(_c, (f_target, a, b, c, d))
    ft = clamp(f_target, F.lit(1e-10), a - F.lit(1e-10))
    inner = floor_at(F.lit(1.0) / (F.lit(1.0) - ft / a) - F.lit(1.0), 1e-300)
    expo = floor_at((F.log(inner) - b) / c, 0.0)
    return F.pow(expo, F.lit(1.0) / d)


def _sign(x: Column) -> Column:
    return F.signum(x)


def elasticity_threshold(target, a, b, c, d) -> Column:
    """C4: root of ``elasticity(r) = target`` by bisection, as one fold.

    Bracket [1e-6, 10]; the upper end grows by 1.5 up to 60 times until the
    signs differ; then at most 200 halvings, stopping when |f| < 1e-12 or the
    bracket is narrower than 1e-12. Returns null when no bracket is found.
    """
    target, a, b, c, d = map(_c, (target, a, b, c, d))

    def f(r):
        return elasticity(r, a, b, c, d) - target

    lo0 = F.lit(K.BISECT_LO)
    flo = f(lo0)

    def grow(acc, _):
        same = _sign(flo) == _sign(acc["fhi"])
        hi = F.when(same, acc["hi"] * F.lit(K.BISECT_GROW)).otherwise(acc["hi"])
        return F.struct(hi.alias("hi"), F.when(same, f(hi)).otherwise(acc["fhi"]).alias("fhi"))

    hi0 = F.lit(K.BISECT_HI)
    bracket = F.aggregate(F.sequence(F.lit(1), F.lit(K.BISECT_EXPAND_STEPS)),
                          F.struct(hi0.alias("hi"), f(hi0).alias("fhi")), grow)

    def let(value: Column, body):
        """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
        (lambda bodies get no common-subexpression elimination)."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / F.lit(2.0)

        def step(x):
            m, fm = x["m"], x["fm"]
            stop = (F.abs(fm) < F.lit(K.BISECT_TOL)) | ((acc["hi"] - acc["lo"]) < F.lit(K.BISECT_TOL))
            move_lo = _sign(fm) == _sign(acc["flo"])
            done = acc["done"]
            return F.struct(
                F.when(done | stop | ~move_lo, acc["lo"]).otherwise(m).alias("lo"),
                F.when(done | stop | move_lo, acc["hi"]).otherwise(m).alias("hi"),
                F.when(done | stop | ~move_lo, acc["flo"]).otherwise(fm).alias("flo"),
                F.when(done, acc["res"]).when(stop, m).otherwise(acc["res"]).alias("res"),
                (done | stop).alias("done"),
            )

        return let(F.struct(mid.alias("m"), f(mid).alias("fm")), step)

    start = F.struct(lo0.alias("lo"), bracket["hi"].alias("hi"), flo.alias("flo"),
                     F.lit(None).cast("double").alias("res"), F.lit(False).alias("done"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(K.BISECT_MAX_STEPS)), start, halve)
    root = F.when(out["done"], out["res"]).otherwise((out["lo"] + out["hi"]) / F.lit(2.0))
    bracketed = _sign(flo) != _sign(bracket["fhi"])
    return F.when(bracketed, root)


def threshold_value(target: float, a: float, b: float, c: float, d: float) -> float | None:
    """C4 for plain numbers, the same steps as :func:`elasticity_threshold`: one
    parameter tuple is solved once, not once per series."""
    def f(r: float) -> float:
        x = max(r, 1e-8) ** d
        s = min(max(a * (1.0 - 1.0 / (1.0 + math.exp(b + c * x))), 0.0), 1.0)
        return c * d * (1.0 - s / max(a, 1e-10)) * max(r, 1e-10) ** d - target

    def sign(x: float) -> int:
        return (x > 0) - (x < 0)

    lo, hi = K.BISECT_LO, K.BISECT_HI
    flo, fhi = f(lo), f(hi)
    for _ in range(K.BISECT_EXPAND_STEPS):
        if sign(flo) != sign(fhi):
            break
        hi *= K.BISECT_GROW
        fhi = f(hi)
    if sign(flo) == sign(fhi):
        return None
    for _ in range(K.BISECT_MAX_STEPS):
        mid = (lo + hi) / 2.0
        fm = f(mid)
        if abs(fm) < K.BISECT_TOL or hi - lo < K.BISECT_TOL:
            return mid
        if sign(fm) == sign(flo):
            lo, flo = mid, fm
        else:
            hi = mid
    return (lo + hi) / 2.0


def relative_price_index(price, gdp, scale) -> Column:
    """``scale * price / max(gdp, 1e-10)``."""
    return _c(scale) * _c(price) / floor_at(gdp, 1e-10)


def income_normalised_price(price, gdp, ref_gdp) -> Column:
    """``price * ref_gdp / max(gdp, 1e-10)``."""
    return _c(price) * (_c(ref_gdp) / floor_at(gdp, 1e-10))


def safe_price(price, fallback) -> Column:
    """Price if finite and positive, else the fallback (C7 first step)."""
    p = _c(price)
    ok = p.isNotNull() & ~F.isnan(p) & (p > 0) & (p != F.lit(float("inf")))
    return F.when(ok, p).otherwise(_c(fallback))


def price_index_with_fallback(price, gdp, ref_price, ref_gdp) -> Column:
    """``safe_price / ref_price * (ref_gdp / max(gdp, 1e-10))``."""
    return (safe_price(price, ref_price) / _c(ref_price)) * (_c(ref_gdp) / floor_at(gdp, 1e-10))


def clipped_index(pn) -> Column:
    """Clamp into [0.2, 3.0]."""
    return clamp(pn, K.INDEX_CLIP_LOW, K.INDEX_CLIP_HIGH)


def demand_per_head(actual, population, eps: float = 1e-8) -> Column:
    """``actual / max(population, eps)``."""
    return _c(actual) / floor_at(population, eps)


def saturation_np(r, a, b, c, d):
    """C1 for numpy arrays inside vectorised task code; must equal
    :func:`saturation` (tested against it)."""
    import numpy as np
    safe_r = np.maximum(np.asarray(r, dtype=np.float64), 1e-8)
    with np.errstate(over="ignore"):
        raw = a * (1.0 - 1.0 / (1.0 + np.exp(b + c * np.power(safe_r, d))))
    return np.minimum(np.maximum(raw, 0.0), 1.0)
