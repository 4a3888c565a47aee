"""DuckDB oracle SQL for the registered queries.

Written independently of the DataFrame code: plain SQL over the driver's
views (orders, customer, lineitem, ...). Fixed values are the same published
model constants as in ``panelcast.constants``.
"""

from __future__ import annotations

from .. import constants as K
from .common import DIGITS, HOLDOUT_YEARS, HORIZON


def r(expr: str, alias: str, d: int = DIGITS) -> str:
    return f"round({expr}, {d}) AS {alias}"


def gmax(x: str, eps: str) -> str:
    """max(x, eps) keeping NULL."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {eps}) END)"


def regr(kind: str, y: str, x: str) -> str:
    """Slope or intercept over the series; NULL, not NaN, where there is no line."""
    e = f"regr_{kind}({y}, {x}) OVER {WA}"
    return f"CASE WHEN NOT isnan({e}) THEN {e} END"


def clamp(x: str, lo: str, hi: str) -> str:
    """x between lo and hi, keeping NULL."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"


def curve(rr: str, a: str, b: str, c: str, d: str) -> str:
    """C1 in SQL."""
    return clamp(f"({a}) * (1.0 - 1.0 / (1.0 + exp(({b}) + ({c}) * pow({gmax(rr, '1e-8')}, {d}))))", "0.0", "1.0")


def inv_curve(f: str, a: str, b: str, c: str, d: str) -> str:
    """C3 in SQL."""
    ft = clamp(f, "1e-10", f"({a}) - 1e-10")
    inner = gmax(f"1.0 / (1.0 - ({ft}) / ({a})) - 1.0", "1e-300")
    return f"pow({gmax(f'(ln({inner}) - ({b})) / ({c})', '0.0')}, 1.0 / ({d}))"


def elast(rr: str, a: str, b: str, c: str, d: str) -> str:
    """C2 in SQL."""
    return (f"(({c}) * ({d}) * (1.0 - ({curve(rr, a, b, c, d)}) / greatest({a}, 1e-10))"
            f" * pow({gmax(rr, '1e-10')}, {d}))")


def panel_cte(hold: int = 0, name: str = "panel") -> str:
    """The whole panel; ``hold`` leaves out the last years of every series."""
    if hold:
        return (f"{panel_cte(0, name + '_whole')},\n{name} AS (SELECT * EXCLUDE (ly) FROM (SELECT *, max(year) OVER "
                f"(PARTITION BY series_id) AS ly FROM {name}_whole) WHERE year <= ly - {hold})")
    return f"""{name} AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS series_id,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(count(*) AS DOUBLE) AS actual,
         CAST(count(DISTINCT o.o_custkey) AS DOUBLE) AS population,
         (CAST(sum(CAST(floor(o.o_totalprice * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(o.o_totalprice) AS DOUBLE) AS gdp,
         (CAST(sum(li.ext) AS DOUBLE) / 100.0) / (CAST(sum(li.qty) AS DOUBLE) / 100.0) AS price
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, sum(CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT)) AS ext,
                    sum(CAST(floor(l_quantity * 100.0 + 0.5) AS BIGINT)) AS qty
             FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)"""


def ctx_cte(src: str = "panel", name: str = "ctx") -> str:
    """Per-row group context: first-row references, n, position w, dup flag."""
    return f"""{name} AS (
  SELECT *,
    first_value(year) OVER wa AS ref_year, first_value(gdp) OVER wa AS ref_gdp,
    first_value(price) OVER wa AS ref_price, first_value(actual) OVER wa AS ref_actual,
    first_value(population) OVER wa AS ref_pop,
    CAST(count(*) OVER wa AS INTEGER) AS n,
    CAST(row_number() OVER wr AS INTEGER) AS w,
    coalesce(lag(year) OVER wr = year, false) AS dup_year
  FROM {src}
  WINDOW wr AS (PARTITION BY series_id ORDER BY year),
         wa AS (PARTITION BY series_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


WA = "(PARTITION BY series_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def weighted_factor(pred: str = "pred") -> str:
    return (f"CASE WHEN sum(w * {pred}) OVER {WA} > 0 THEN sum(w * actual) OVER {WA} / sum(w * {pred}) OVER {WA}"
            f" ELSE 1.0 END")


def recent_factor(pred: str = "pred") -> str:
    k = f"greatest({K.RECENT_MIN_YEARS}, CAST(floor(n * {K.RECENT_SHARE}) AS INTEGER))"
    rec = f"w > n - {k}"
    return (f"CASE WHEN sum(CASE WHEN {rec} THEN {pred} END) OVER {WA} > 0 THEN "
            f"sum(CASE WHEN {rec} THEN actual END) OVER {WA} / sum(CASE WHEN {rec} THEN {pred} END) OVER {WA} ELSE 1.0 END")


def status_expr(extra: str | None = None, drivers: tuple = (), min_years: int = 1) -> str:
    mid = f" WHEN {extra} IS NOT NULL THEN {extra}" if extra else ""
    short = f" WHEN count(*) < {min_years} THEN 'too_short'" if min_years > 1 else ""
    need = " OR ".join(f"{c} IS NULL" for c in ("year", "actual", *drivers))
    return (f"CASE WHEN bool_or(dup_year OR {need} OR coalesce(actual < 0, false)) THEN 'invalid'"
            f"{short}{mid} ELSE 'ok' END")


def blank_invalid(cte: str, name: str) -> str:
    """Rows of invalid input carry no estimate: only key, model, status and counts."""
    return f"""{name} AS (SELECT * REPLACE ({', '.join(f"CASE WHEN status <> 'invalid' THEN {c} END AS {c}" for c in ('continuity', 'mae', 'mse', 'rmse', 'mape', 'r2'))}) FROM {cte})"""


def metric_cols(actual: str = "actual", pred: str = "adj", rounding: bool = True) -> str:
    e = f"({actual} - {pred})"
    mse = f"avg({e} * {e})"
    sst = f"(var_pop({actual}) * count(*))"
    rr = r if rounding else (lambda x, a: f"{x} AS {a}")
    return ", ".join([
        rr(f"avg(abs({e}))", "mae"), rr(mse, "mse"), rr(f"sqrt({mse})", "rmse"),
        rr(f"avg(abs({e} / ({actual} + {K.MAPE_EPS}))) * 100.0", "mape"),
        rr(f"CASE WHEN {sst} = 0 THEN 0.0 ELSE 1.0 - sum({e} * {e}) / {sst} END", "r2"),
    ])


PRICED = ("population", "gdp", "price")
UNPRICED = ("population", "gdp")


def common_fit_cols(extra: str | None = None, drivers: tuple = PRICED, min_years: int = 1) -> str:
    return (f"{status_expr(extra, drivers, min_years)} AS status, CAST(count(*) AS INTEGER) AS n_years, max(year) AS last_year, "
            "arg_max(actual, year) AS last_actual, arg_max(population, year) AS last_pop, "
            "arg_max(gdp, year) AS last_gdp, arg_max(price, year) AS last_price, "
            "any_value(ref_year) AS ref_year, any_value(ref_gdp) AS ref_gdp, any_value(ref_price) AS ref_price")


def _base(base: bool, hold: int) -> str:
    return f"{panel_cte(hold)},\n{ctx_cte()},\n" if base else ""


# --- linear_price ---------------------------------------------------------------

def linear_price_fit_ctes(c1: float = -0.5, c2: float = 0.5, base: bool = True, hold: int = 0) -> str:
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    return f"""{_base(base, hold)}lp_rows AS (SELECT *, greatest(0.0, {c1} * pn + {c2}) * population AS pred
            FROM (SELECT *, {pn} AS pn FROM ctx)),
lp_rows2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, {weighted_factor()} AS factor FROM lp_rows)),
lp_fit0 AS (
  SELECT series_id, 'linear_price' AS model, {common_fit_cols(None, PRICED, 1)},
         CAST({c1} AS DOUBLE) AS c1, CAST({c2} AS DOUBLE) AS c2, any_value(factor) AS continuity,
         stddev_samp(actual - adj) AS resid_std,
         {metric_cols()}
  FROM lp_rows2 GROUP BY series_id),
{blank_invalid('lp_fit0', 'lp_fit')}"""


FIT_SELECT = "series_id, model, status, n_years, last_year"
FIT_TAIL = "round(continuity, 6) AS continuity, mae, mse, rmse, mape, r2"


def horizon_cte(fits: str, name: str = "hz", price_fallback: bool = False, h: int = HORIZON,
                scenarios: list[tuple] | None = None) -> str:
    scenarios = scenarios or [("base", K.DEFAULT_GDP_GROWTH, K.DEFAULT_POP_GROWTH, K.DEFAULT_PRICE_INFLATION, None)]
    vals = ", ".join(
        f"('{s[0]}', {s[1]}, {s[2]}, {s[3]}, {('NULL' if s[4] is None else s[4])}::DOUBLE)" for s in scenarios)
    lp = ("CASE WHEN last_price IS NOT NULL AND NOT isnan(last_price) AND last_price > 0 "
          "AND last_price <> 'inf'::DOUBLE THEN last_price ELSE 1.0 END") if price_fallback else "last_price"
    return f"""{name} AS (
  SELECT f.*, sc.scenario_id, sc.fare_g AS scenario_fare_growth, hh.h,
         CAST(f.last_year + hh.h AS INTEGER) AS year,
         f.last_pop * pow(1.0 + sc.pop_g, hh.h) AS population,
         f.last_gdp * pow(1.0 + sc.gdp_g, hh.h) AS gdp,
         {lp} * pow(1.0 + sc.price_i, hh.h) AS price
  FROM (SELECT * FROM {fits} WHERE status = 'ok') f
  CROSS JOIN (VALUES {vals}) sc(scenario_id, gdp_g, pop_g, price_i, fare_g)
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {h + 1})) hh)"""


def growth(plain: bool) -> str:
    w = "(PARTITION BY series_id, model, scenario_id ORDER BY year)"
    den = f"lag(pred) OVER {w}" if plain else f"greatest(lag(pred) OVER {w}, 1.0)"
    if plain:
        return (f"CASE WHEN lag(pred) OVER {w} IS NULL THEN 0.0 WHEN {den} = 0 THEN NULL "
                f"ELSE (pred - lag(pred) OVER {w}) / {den} * 100.0 END")
    return f"CASE WHEN lag(pred) OVER {w} IS NULL THEN 0.0 ELSE (pred - lag(pred) OVER {w}) / {den} * 100.0 END"


def forecast_select(src: str, shared: bool, band: str = "fixed") -> str:
    if band == "fixed":
        lower = "greatest(0.0, pred * 0.8)" if shared else "pred * 0.8"
        upper, bt = "pred * 1.2", "fixed_20pct"
    else:
        lower, upper, bt = "greatest(0.0, pred - 1.96 * resid_std)", "pred + 1.96 * resid_std", "residual_sigma_95"
    return f"""SELECT series_id, model, scenario_id, year, {r('population', 'population')}, {r('gdp', 'gdp')},
       {r('price', 'price')}, {r('pred', 'pred')}, {r(lower, 'lower')}, {r(upper, 'upper')},
       {r(growth(not shared), 'growth_rate')}, '{bt}' AS band_type
FROM {src}"""


# --- queries ----------------------------------------------------------------------

def sql_demand_panel() -> str:
    return f"""WITH {panel_cte()}
SELECT series_id, year, {r('actual', 'actual')}, {r('population', 'population')}, {r('gdp', 'gdp')},
       {r('price', 'price')} FROM panel"""


def sql_fit_linear_price() -> str:
    return f"""WITH {linear_price_fit_ctes()}
SELECT {FIT_SELECT}, round(c1, 6) AS c1, round(c2, 6) AS c2, {FIT_TAIL} FROM lp_fit"""


def sql_forecast_linear_price() -> str:
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    return f"""WITH {linear_price_fit_ctes()},
{horizon_cte('lp_fit')},
p AS (SELECT *, greatest(0.0, c1 * {pn} + c2) * population * continuity AS pred FROM hz)
{forecast_select('p', shared=False)}"""


ORACLE = {
    "demand_panel": sql_demand_panel(),
    "fit_linear_price": sql_fit_linear_price(),
    "forecast_linear_price": sql_forecast_linear_price(),
}


# --- logistic_price -------------------------------------------------------------

LP = K.LOGISTIC_PRICE_DEFAULTS


def _lg_consts():
    return (str(LP["distribution_a"]), str(LP["distribution_b"]), str(LP["k1"]), str(LP["k2"]),
            str(LP["full_price_scale"]), str(LP["full_penetration"]))


def logistic_fit_ctes(base: bool = True, hold: int = 0) -> str:
    a, b, c, d, scale, pen = _lg_consts()
    pred = f"{pen} * population * {curve(f'{scale} * price / {gmax('gdp', '1e-10')}', a, b, c, d)}"
    return f"""{_base(base, hold)}lg_rows AS (SELECT *, {pred} AS pred FROM ctx),
lg_rows2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, {recent_factor()} AS factor FROM lg_rows)),
lg_fit0 AS (
  SELECT series_id, 'logistic_price' AS model, {common_fit_cols(None, PRICED, 3)},
         CAST({c} AS DOUBLE) AS k1, CAST({d} AS DOUBLE) AS k2, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b,
         CAST({scale} AS DOUBLE) AS scale, CAST({pen} AS DOUBLE) AS penetration,
         any_value(factor) AS continuity, stddev_samp(actual - adj) AS resid_std, {metric_cols()}
  FROM lg_rows2 GROUP BY series_id),
{blank_invalid('lg_fit0', 'lg_fit')}"""


def logistic_forecast_ctes() -> str:
    pred = (f"penetration * population * {curve(f'scale * price / {gmax('gdp', '1e-10')}', 'a', 'b', 'k1', 'k2')}"
            " * continuity")
    return f"""{logistic_fit_ctes()},
{horizon_cte('lg_fit')},
lg_p AS (SELECT *, {pred} AS pred FROM hz)"""


def sql_fit_logistic_price() -> str:
    return f"""WITH {logistic_fit_ctes()}
SELECT {FIT_SELECT}, {r('k1', 'k1')}, {r('k2', 'k2')}, {FIT_TAIL} FROM lg_fit"""


def sql_forecast_logistic_price() -> str:
    return f"""WITH {logistic_forecast_ctes()}
{forecast_select('lg_p', shared=False)}"""


def sql_residual_band() -> str:
    return f"""WITH {logistic_forecast_ctes()}
{forecast_select('lg_p', shared=False, band='sigma')}"""


def sql_anchor_columns() -> str:
    w = "(PARTITION BY series_id, model, scenario_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""WITH {logistic_forecast_ctes()},
fp AS (SELECT *, first_value(pred) OVER {w} AS first_pred FROM lg_p),
ok AS (SELECT *, (first_pred > 0 AND last_actual > 0) AS ok, last_actual / first_pred AS fac FROM fp)
SELECT series_id, model, scenario_id, year, {r('pred', 'pred')},
       {r('CASE WHEN ok THEN pred END', 'pred_raw')},
       {r('CASE WHEN ok THEN pred * fac END', 'pred_adjusted')},
       {r('CASE WHEN ok THEN pred * 0.8 * fac END', 'lower_adjusted')},
       {r('CASE WHEN ok THEN pred * 1.2 * fac END', 'upper_adjusted')},
       {r('CASE WHEN ok THEN fac END', 'anchor_factor')},
       {r('CASE WHEN ok THEN last_actual END', 'anchor_reference')},
       {r('CASE WHEN ok THEN first_pred - last_actual END', 'anchor_gap')},
       {r('CASE WHEN ok THEN (first_pred - last_actual) / last_actual * 100.0 END', 'anchor_gap_pct')},
       coalesce(ok, false) AS anchor_applied
FROM ok"""


# --- linear_income_index ----------------------------------------------------------

def income_fit_ctes(c1: float = -0.5, c2: float = 0.5, base: bool = True, hold: int = 0) -> str:
    pn = clamp(f"ref_gdp / {gmax('gdp', '1e-8')}", "0.2", "3.0")
    return f"""{_base(base, hold)}ii_rows AS (SELECT *, greatest(0.0, {c1} * ({pn}) + {c2}) * population AS pred FROM ctx),
ii_rows2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, {weighted_factor()} AS factor FROM ii_rows)),
ii_fit0 AS (
  SELECT series_id, 'linear_income_index' AS model, {common_fit_cols(None, UNPRICED, 1)},
         CAST({c1} AS DOUBLE) AS c1, CAST({c2} AS DOUBLE) AS c2, any_value(factor) AS continuity, {metric_cols()}
  FROM ii_rows2 GROUP BY series_id),
{blank_invalid('ii_fit0', 'ii_fit')}"""


def sql_fit_income_index() -> str:
    return f"""WITH {income_fit_ctes()}
SELECT {FIT_SELECT}, round(c1, 6) AS c1, round(c2, 6) AS c2, {FIT_TAIL} FROM ii_fit"""


def sql_forecast_income_index() -> str:
    pred = f"greatest(0.0, c1 * (ref_gdp / {gmax('gdp', '1e-10')}) + c2) * population * continuity"
    return f"""WITH {income_fit_ctes()},
{horizon_cte('ii_fit', price_fallback=True)},
ii_p AS (SELECT *, {pred} AS pred FROM hz)
{forecast_select('ii_p', shared=True)}"""


def income_ols_ctes() -> str:
    """M4 + M5 with ``optimize_parameters``: C1, C2 by OLS on the clipped index."""
    pn = clamp(f"ref_gdp / {gmax('gdp', '1e-8')}", "0.2", "3.0")
    dn = f"actual / {gmax('population', '1e-8')}"
    return f"""{panel_cte()},
{ctx_cte()},
io_a AS (SELECT *, {pn} AS pn, {dn} AS dn FROM ctx),
io_b AS (SELECT *, {regr('slope', 'dn', 'pn')} AS c1, {regr('intercept', 'dn', 'pn')} AS c2 FROM io_a),
io_c AS (SELECT *, greatest(0.0, c1 * pn + c2) * population AS pred FROM io_b),
io_d AS (SELECT *, pred * factor AS adj FROM (SELECT *, {weighted_factor()} AS factor FROM io_c)),
io_fit0 AS (
  SELECT series_id, 'linear_income_index' AS model,
         {common_fit_cols("CASE WHEN any_value(c1) IS NULL THEN 'degenerate' END", UNPRICED, 1)},
         any_value(c1) AS c1, any_value(c2) AS c2, any_value(factor) AS continuity, {metric_cols()}
  FROM io_d GROUP BY series_id),
{blank_invalid('io_fit0', 'io_fit')}"""


def sql_fit_income_index_ols() -> str:
    return f"""WITH {income_ols_ctes()}
SELECT {FIT_SELECT}, round(c1, 6) AS c1, round(c2, 6) AS c2, {FIT_TAIL} FROM io_fit"""


# --- trend_elasticity_blend -----------------------------------------------------------

def _price_ok(p: str) -> str:
    return f"({p} IS NOT NULL AND NOT isnan({p}) AND {p} > 0 AND {p} <> 'inf'::DOUBLE)"


def blend_fit_ctes(weight: float = 0.5, base: bool = True, hold: int = 0) -> str:
    dn = f"actual / {gmax('population', '1e-10')}"
    pn = f"(CASE WHEN {_price_ok('price')} THEN price ELSE ref_price END) / ref_price * (ref_gdp / {gmax('gdp', '1e-10')})"
    wt = clamp(str(weight), "0.0", "1.0")
    blend = f"{wt} * (ts * t + ti) + (1.0 - {wt}) * (es * pn + ei)"
    return f"""{_base(base, hold)}bl_a AS (SELECT *, {dn} AS dn, CAST(year - ref_year AS DOUBLE) AS t, {pn} AS pn FROM ctx),
bl_b AS (SELECT *, {regr('slope', 'dn', 't')} AS ts, {regr('intercept', 'dn', 't')} AS ti,
                {regr('slope', 'dn', 'pn')} AS es, {regr('intercept', 'dn', 'pn')} AS ei FROM bl_a),
bl_c AS (SELECT *, greatest(0.0, {blend}) * population AS pred FROM bl_b),
bl_d AS (SELECT *, pred * factor AS adj FROM (SELECT *, {weighted_factor()} AS factor FROM bl_c)),
bl_fit0 AS (
  SELECT series_id, 'trend_elasticity_blend' AS model,
         {common_fit_cols("CASE WHEN any_value(ts) IS NULL OR any_value(es) IS NULL THEN 'degenerate' END", UNPRICED, 1)},
         CAST({weight} AS DOUBLE) AS trend_weight, any_value(ts) AS trend_slope, any_value(ti) AS trend_intercept,
         any_value(es) AS elast_slope, any_value(ei) AS elast_intercept,
         any_value(factor) AS continuity, {metric_cols()}
  FROM bl_d GROUP BY series_id),
{blank_invalid('bl_fit0', 'bl_fit')}"""


def sql_fit_blend() -> str:
    return f"""WITH {blend_fit_ctes()}
SELECT {FIT_SELECT}, {r('trend_slope', 'trend_slope')}, {r('trend_intercept', 'trend_intercept')},
       {r('elast_slope', 'elast_slope')}, {r('elast_intercept', 'elast_intercept')}, {FIT_TAIL} FROM bl_fit"""


def blend_forecast_ctes() -> str:
    pn = f"(CASE WHEN {_price_ok('price')} THEN price ELSE ref_price END) / ref_price * (ref_gdp / {gmax('gdp', '1e-10')})"
    wt = clamp("trend_weight", "0.0", "1.0")
    t = "CAST(year - ref_year AS DOUBLE)"
    blend = f"{wt} * (trend_slope * {t} + trend_intercept) + (1.0 - {wt}) * (elast_slope * ({pn}) + elast_intercept)"
    return f"""{blend_fit_ctes()},
{horizon_cte('bl_fit', price_fallback=True)},
bl_p AS (SELECT *, greatest(0.0, {blend}) * population * continuity AS pred FROM hz)"""


def sql_forecast_blend() -> str:
    return f"""WITH {blend_forecast_ctes()}
{forecast_select('bl_p', shared=True)}"""


# --- implied_price_logistic -------------------------------------------------------------

IP = K.IMPLIED_PRICE_DEFAULTS


def threshold_ctes(target: str, a: str, b: str, c: str, d: str, src: str | None = None,
                   key: str = "series_id", prefix: str = "th") -> str:
    """C4 as two recursive CTEs: bracket growth (60 steps) then bisection
    (200 steps). With ``src`` the target varies per ``key`` row of ``src``;
    otherwise a single constant row is solved. Result CTE: ``{prefix}_root(key, root)``."""
    def f(x):
        return f"({elast(x, a, b, c, d)} - ({target}))"
    base = (f"SELECT {key}, CAST({target} AS DOUBLE) AS tgt FROM {src}" if src
            else f"SELECT 0 AS {key}, CAST({target} AS DOUBLE) AS tgt")
    fl = f(K.BISECT_LO)
    return f"""{prefix}_in AS ({base}),
{prefix}_grow AS (
  SELECT {key}, tgt, 0 AS i, CAST({K.BISECT_HI} AS DOUBLE) AS hi, {f(K.BISECT_HI).replace(f'({target})', 'tgt')} AS fhi,
         {fl.replace(f'({target})', 'tgt')} AS flo
  FROM {prefix}_in
  UNION ALL
  SELECT {key}, tgt, i + 1,
         CASE WHEN sign(flo) = sign(fhi) THEN hi * {K.BISECT_GROW} ELSE hi END,
         CASE WHEN sign(flo) = sign(fhi) THEN {f(f'hi * {K.BISECT_GROW}').replace(f'({target})', 'tgt')} ELSE fhi END,
         flo
  FROM {prefix}_grow WHERE i < {K.BISECT_EXPAND_STEPS}),
{prefix}_br AS (SELECT {key}, tgt, hi, fhi, flo FROM {prefix}_grow WHERE i = {K.BISECT_EXPAND_STEPS}),
{prefix}_bis AS (
  SELECT {key}, tgt, 0 AS i, CAST({K.BISECT_LO} AS DOUBLE) AS lo, hi, flo, CAST(NULL AS DOUBLE) AS res, false AS done,
         sign(flo) <> sign(fhi) AS bracketed
  FROM {prefix}_br
  UNION ALL
  SELECT {key}, tgt, i + 1,
         CASE WHEN done OR stop OR NOT mv THEN lo ELSE mid END,
         CASE WHEN done OR stop OR mv THEN hi ELSE mid END,
         CASE WHEN done OR stop OR NOT mv THEN flo ELSE fm END,
         CASE WHEN done THEN res WHEN stop THEN mid ELSE res END,
         done OR stop, bracketed
  FROM (SELECT *, (lo + hi) / 2.0 AS mid, {f('((lo + hi) / 2.0)').replace(f'({target})', 'tgt')} AS fm FROM {prefix}_bis) s0,
       LATERAL (SELECT abs(fm) < {K.BISECT_TOL} OR (hi - lo) < {K.BISECT_TOL} AS stop, sign(fm) = sign(flo) AS mv) s1
  WHERE i < {K.BISECT_MAX_STEPS}),
{prefix}_root AS (
  SELECT {key}, tgt, CASE WHEN bracketed THEN (CASE WHEN done THEN res ELSE (lo + hi) / 2.0 END) END AS root
  FROM {prefix}_bis WHERE i = {K.BISECT_MAX_STEPS})"""


def implied_fit_ctes(base: bool = True, hold: int = 0) -> str:
    a, b, c, d = str(IP["distribution_a"]), str(IP["distribution_b"]), str(IP["k1"]), str(IP["k2"])
    s = f"(ref_gdp / {gmax('gdp', '1e-10')})"
    pp = f"(actual / {gmax('population', '1e-10')})"
    t = f"({inv_curve(f'{pp} / ck1', a, b, c, d)} / {gmax(f"ck2 * {s}", "1e-12")})"
    return f"""{_base(base, hold)}{threshold_ctes(str(IP['ref_elasticity']), a, b, c, d)},
ip_k AS (SELECT root AS ck2, {curve('root', a, b, c, d)} AS fk2 FROM th_root),
ip_a AS (SELECT ctx.*, ip_k.ck2,
                (ref_actual / {gmax('ref_pop', '1e-10')}) / greatest(ip_k.fk2, 1e-12) AS ck1
         FROM ctx CROSS JOIN ip_k),
ip_b AS (SELECT *, {t} AS t_implied FROM ip_a),
ip_c AS (SELECT *, ck1 * {curve(f'ck2 * t_implied * {s}', a, b, c, d)} * population AS adj FROM ip_b),
ip_fit0 AS (
  SELECT series_id, 'implied_price_logistic' AS model,
         {common_fit_cols("CASE WHEN any_value(ck2) IS NULL THEN 'no_threshold' END", UNPRICED, 1)},
         CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, CAST({c} AS DOUBLE) AS k1, CAST({d} AS DOUBLE) AS k2,
         CAST({IP['fare_growth_rate']} AS DOUBLE) AS fare_growth,
         any_value(ref_gdp) AS model_ref_gdp, any_value(ck1) AS calib_k1, any_value(ck2) AS calib_k2,
         arg_max(t_implied, year) AS last_t, CAST(1.0 AS DOUBLE) AS continuity, {metric_cols()}
  FROM ip_c GROUP BY series_id),
{blank_invalid('ip_fit0', 'ip_fit')}"""


def sql_fit_implied_price() -> str:
    return f"""WITH RECURSIVE {implied_fit_ctes()}
SELECT {FIT_SELECT}, {r('calib_k1', 'calib_k1')}, {r('calib_k2', 'calib_k2')}, {r('last_t', 'last_t')},
       {FIT_TAIL} FROM ip_fit"""


def implied_forecast_ctes() -> str:
    s = f"(model_ref_gdp / {gmax('gdp', '1e-10')})"
    t = "(last_t * pow(1.0 + coalesce(scenario_fare_growth, fare_growth), h))"
    return f"""{implied_fit_ctes()},
{horizon_cte('ip_fit', price_fallback=True)},
ip_p AS (SELECT *, calib_k1 * population * {curve(f'calib_k2 * {t} * {s}', 'a', 'b', 'k1', 'k2')} AS pred FROM hz)"""


def sql_forecast_implied_price() -> str:
    return f"""WITH RECURSIVE {implied_forecast_ctes()}
{forecast_select('ip_p', shared=True)}"""


# --- curve functions ----------------------------------------------------------------------

def curve_rows_cte() -> str:
    a, b, c, d, scale, _ = _lg_consts()
    return f"""{panel_cte()},
cv AS (SELECT series_id, year, {scale} * price / {gmax('gdp', '1e-10')} AS rr FROM panel),
cv2 AS (SELECT *, {curve('rr', a, b, c, d)} AS f, {elast('rr', a, b, c, d)} AS elasticity FROM cv)"""


def sql_curve_values() -> str:
    return f"""WITH {curve_rows_cte()}
SELECT series_id, year, {r('rr', 'r')}, {r('f', 'f')} FROM cv2"""


def sql_curve_elasticity() -> str:
    return f"""WITH {curve_rows_cte()}
SELECT series_id, year, {r('rr', 'r')}, {r('elasticity', 'elasticity')} FROM cv2"""


def sql_curve_inverse() -> str:
    a, b, c, d, _, _ = _lg_consts()
    return f"""WITH {curve_rows_cte()}
SELECT series_id, year, {r('rr', 'r')}, {r('f', 'f')}, {r(inv_curve('f', a, b, c, d), 'r_back')} FROM cv2"""


def sql_elasticity_threshold() -> str:
    a, b, c, d, _, _ = _lg_consts()
    return f"""WITH RECURSIVE {curve_rows_cte()},
tg AS (SELECT series_id, avg(elasticity) AS target FROM cv2 GROUP BY series_id),
{threshold_ctes('target', a, b, c, d, src='tg')}
SELECT series_id, {r('tgt', 'target')}, {r('root', 'threshold')},
       {r(elast('root', a, b, c, d), 'elasticity_at_threshold')} FROM th_root"""


ORACLE.update({
    "fit_logistic_price": sql_fit_logistic_price(),
    "forecast_logistic_price": sql_forecast_logistic_price(),
    "residual_band": sql_residual_band(),
    "anchor_columns": sql_anchor_columns(),
    "fit_income_index": sql_fit_income_index(),
    "fit_income_index_ols": sql_fit_income_index_ols(),
    "forecast_income_index": sql_forecast_income_index(),
    "fit_blend": sql_fit_blend(),
    "forecast_blend": sql_forecast_blend(),
    "fit_implied_price": sql_fit_implied_price(),
    "forecast_implied_price": sql_forecast_implied_price(),
    "curve_values": sql_curve_values(),
    "curve_elasticity": sql_curve_elasticity(),
    "curve_inverse": sql_curve_inverse(),
    "elasticity_threshold": sql_elasticity_threshold(),
})


# --- table preparation -----------------------------------------------------------------

PANEL_NUM = ["year", "actual", "population", "gdp", "price"]
CP_NUM = ["actual", "population", "gdp", "price"]


def customer_panel_cte(name: str = "cpanel") -> str:
    return f"""{name} AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS series_id, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(count(*) AS DOUBLE) AS actual, CAST(coalesce(sum(li.lines), 0) AS DOUBLE) AS population,
         (CAST(sum(CAST(floor(o.o_totalprice * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(o.o_totalprice) AS DOUBLE) AS gdp,
         (CAST(sum(li.ext) AS DOUBLE) / 100.0) / (CAST(sum(li.qty) AS DOUBLE) / 100.0) AS price
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT)) AS ext,
                    sum(CAST(floor(l_quantity * 100.0 + 0.5) AS BIGINT)) AS qty
             FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  GROUP BY 1, 2)"""


def _quartiles(cols, src, name, extra=""):
    qs = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER (PARTITION BY series_id) AS q1_{c}, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER (PARTITION BY series_id) AS q3_{c}" for c in cols)
    return f"{name} AS (SELECT *, {qs}{extra} FROM {src})"


def _outside(c, k):
    return f"({c} < q1_{c} - {k} * (q3_{c} - q1_{c}) OR {c} > q3_{c} + {k} * (q3_{c} - q1_{c}))"


def sql_panel_validation() -> str:
    dup = ", coalesce(lag(year) OVER (PARTITION BY series_id ORDER BY year) = year, false) AS dup"
    rules = [("null_year", "error", "count_if(year IS NULL)"),
             ("null_actual", "error", "count_if(actual IS NULL)"),
             ("negative_actual", "error", "count_if(actual < 0)"),
             ("duplicate_years", "error", "count_if(dup)"),
             ("year_not_integer", "error", "0"),
             ("year_converted", "warning", "0")]
    rules += [(f"outliers_{c}", "warning", f"count_if(coalesce({_outside(c, 3.0)}, false))") for c in PANEL_NUM]
    parts = " UNION ALL ".join(
        f"SELECT series_id, '{r_}' AS rule, '{s}' AS severity, CAST({e} AS BIGINT) AS n FROM b GROUP BY series_id"
        for r_, s, e in rules)
    return f"""WITH {panel_cte(0, 'panel_all')},
{_quartiles(PANEL_NUM, 'panel_all', 'b', dup)}
{parts}"""


def _profile_parts(src: str, cols, valid_only: bool = False) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT series_id, '{c}' AS column, 'numeric' AS type, count(*) AS n_rows, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
            f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, "
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM {src} GROUP BY series_id")
    return " UNION ALL ".join(parts)


def sql_panel_profile() -> str:
    return f"""WITH {panel_cte(0, 'panel_all')}
{_profile_parts('panel_all', PANEL_NUM)}"""


def sql_validation_summary() -> str:
    # Every derived series passes the error rules (no nulls, negatives or
    # duplicate years by construction of the panel); checked in the CTE.
    return f"""WITH {panel_cte(0, 'panel_all')},
bad AS (SELECT series_id FROM panel_all GROUP BY series_id
        HAVING count_if(year IS NULL) + count_if(actual IS NULL) + count_if(actual < 0)
               + count(*) - count(DISTINCT year) > 0),
ok AS (SELECT * FROM panel_all WHERE series_id NOT IN (SELECT series_id FROM bad)),
prof AS ({_profile_parts('ok', PANEL_NUM)})
SELECT series_id, "column", min, max, mean, std, n_missing AS missing FROM prof"""


def sql_panel_iqr_outliers() -> str:
    parts = " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS column, round(any_value(q1_{c}), 8) AS q1, round(any_value(q3_{c}), 8) AS q3, "
        f"round(any_value(q1_{c} - 3.0 * (q3_{c} - q1_{c})), 8) AS lower, "
        f"round(any_value(q3_{c} + 3.0 * (q3_{c} - q1_{c})), 8) AS upper, "
        f"CAST(count_if(coalesce({_outside(c, 3.0)}, false)) AS BIGINT) AS n_outliers FROM b GROUP BY series_id"
        for c in CP_NUM)
    return f"""WITH {customer_panel_cte()},
{_quartiles(CP_NUM, 'cpanel', 'b')}
{parts}"""


def _complete_years_cte(src: str = "cpanel", name: str = "cy") -> str:
    return f"""span AS (SELECT series_id, min(year) AS y0, max(year) AS y1 FROM {src} GROUP BY series_id),
grid AS (SELECT series_id, CAST(unnest(range(y0, y1 + 1)) AS INTEGER) AS year FROM span),
{name} AS (SELECT g.series_id, g.year, p.actual, p.population, p.gdp, p.price
           FROM grid g LEFT JOIN {src} p ON g.series_id = p.series_id AND g.year = p.year)"""


def _impute_cte(src: str, name: str) -> str:
    cols = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY series_id)) AS {c}" for c in CP_NUM)
    return f"{name} AS (SELECT series_id, year, {cols} FROM {src})"


def _winsor_cte(src: str, name: str) -> str:
    counts = ", " + ", ".join(f"count({c}) OVER (PARTITION BY series_id) AS n_{c}" for c in CP_NUM)
    clipped = ", ".join(
        f"CASE WHEN n_{c} >= 4 AND {c} IS NOT NULL THEN least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), "
        f"q3_{c} + 1.5 * (q3_{c} - q1_{c})) ELSE {c} END AS {c}" for c in CP_NUM)
    return f"""{_quartiles(CP_NUM, src, name + '_q', counts)},
{name} AS (SELECT series_id, year, {clipped} FROM {name}_q)"""


def _round_cp(src: str, d: int = 4) -> str:
    return f"SELECT series_id, year, {', '.join(r(c, c, d) for c in CP_NUM)} FROM {src}"


def sql_panel_impute() -> str:
    return f"""WITH {customer_panel_cte()},
{_complete_years_cte()},
{_impute_cte('cy', 'imp')}
{_round_cp('imp')}"""


def sql_panel_winsorize() -> str:
    return f"""WITH {customer_panel_cte()},
{_winsor_cte('cpanel', 'win')}
{_round_cp('win', 8)}"""


def sql_panel_clean() -> str:
    return f"""WITH {customer_panel_cte()},
{_complete_years_cte()},
{_impute_cte('cy', 'imp')},
dd AS (SELECT DISTINCT * FROM imp),
{_winsor_cte('dd', 'win')}
{_round_cp('win', 8)}"""


def sql_panel_dedup() -> str:
    return """SELECT DISTINCT o_custkey AS series_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status
FROM orders"""


def sql_model_compatibility() -> str:
    names = {"actual_passengers": "actual", "population": "population", "gdp_per_capita": "gdp",
             "ticket_price": "price"}
    flags = ", ".join(f"bool_or({v} IS NOT NULL) AS has_{k}" for k, v in names.items())
    parts = []
    for m in K.MODEL_NAMES:
        req = K.MODEL_REQUIREMENTS[m]
        miss = ", ".join(f"CASE WHEN NOT has_{c} THEN '{c}' END" for c in req)
        nmiss = " + ".join(f"CASE WHEN NOT has_{c} THEN 1 ELSE 0 END" for c in req)
        parts.append(
            f"SELECT series_id, '{m}' AS model, concat_ws(',', {miss}) AS missing_columns, "
            f"round(({len(req)} - ({nmiss})) / {len(req)} * 100.0, 6) AS compatibility_score, "
            f"({nmiss}) = 0 AS is_compatible FROM g")
    return f"""WITH {panel_cte(0, 'panel_all')},
g AS (SELECT series_id, {flags} FROM panel_all GROUP BY series_id)
{' UNION ALL '.join(parts)}"""


def sql_year_range() -> str:
    return f"""WITH {panel_cte(0, 'panel_all')}
SELECT series_id, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year
FROM panel_all WHERE year IS NOT NULL GROUP BY series_id"""


ORACLE.update({
    "panel_validation": sql_panel_validation(),
    "panel_profile": sql_panel_profile(),
    "validation_summary": sql_validation_summary(),
    "panel_iqr_outliers": sql_panel_iqr_outliers(),
    "panel_impute": sql_panel_impute(),
    "panel_winsorize": sql_panel_winsorize(),
    "panel_clean": sql_panel_clean(),
    "panel_dedup": sql_panel_dedup(),
    "model_compatibility": sql_model_compatibility(),
    "year_range": sql_year_range(),
})


# --- generic per-model forecast CTEs ------------------------------------------------------

PREFIX = {"linear_price": "lp", "logistic_price": "lg", "linear_income_index": "ii",
          "trend_elasticity_blend": "bl", "implied_price_logistic": "ip"}
SHARED = {"linear_price": False, "logistic_price": False, "linear_income_index": True,
          "trend_elasticity_blend": True, "implied_price_logistic": True}


def _pred_expr(model: str) -> str:
    if model == "linear_price":
        pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
        return f"greatest(0.0, c1 * {pn} + c2) * population * continuity"
    if model == "logistic_price":
        return (f"penetration * population * {curve(f'scale * price / {gmax('gdp', '1e-10')}', 'a', 'b', 'k1', 'k2')}"
                " * continuity")
    if model == "linear_income_index":
        return f"greatest(0.0, c1 * (ref_gdp / {gmax('gdp', '1e-10')}) + c2) * population * continuity"
    if model == "trend_elasticity_blend":
        pn = (f"(CASE WHEN {_price_ok('price')} THEN price ELSE ref_price END) / ref_price * "
              f"(ref_gdp / {gmax('gdp', '1e-10')})")
        wt = clamp("trend_weight", "0.0", "1.0")
        t = "CAST(year - ref_year AS DOUBLE)"
        blend = f"{wt} * (trend_slope * {t} + trend_intercept) + (1.0 - {wt}) * (elast_slope * ({pn}) + elast_intercept)"
        return f"greatest(0.0, {blend}) * population * continuity"
    s_ = f"(model_ref_gdp / {gmax('gdp', '1e-10')})"
    t = "(last_t * pow(1.0 + coalesce(scenario_fare_growth, fare_growth), h))"
    return f"calib_k1 * population * {curve(f'calib_k2 * {t} * {s_}', 'a', 'b', 'k1', 'k2')}"


def _fit_ctes(model: str, base: bool, hold: int) -> str:
    return {"linear_price": lambda: linear_price_fit_ctes(base=base, hold=hold),
            "logistic_price": lambda: logistic_fit_ctes(base=base, hold=hold),
            "linear_income_index": lambda: income_fit_ctes(base=base, hold=hold),
            "trend_elasticity_blend": lambda: blend_fit_ctes(base=base, hold=hold),
            "implied_price_logistic": lambda: implied_fit_ctes(base=base, hold=hold)}[model]()


def model_fc_ctes(model: str, h: int = HORIZON, base: bool = True, hold: int = 0,
                  scenarios: list[tuple] | None = None, with_fit: bool = True) -> str:
    """Fit + forecast CTEs of one model: ``{px}_fit``, ``{px}_hz``, ``{px}_p``, ``{px}_fc``."""
    px = PREFIX[model]
    shared = SHARED[model]
    lower = "greatest(0.0, pred * 0.8)" if shared else "pred * 0.8"
    w = "(PARTITION BY series_id, model, scenario_id ORDER BY year)"
    fit = _fit_ctes(model, base, hold) + ",\n" if with_fit else ""
    return f"""{fit}{horizon_cte(f'{px}_fit', name=f'{px}_hz', price_fallback=shared, h=h, scenarios=scenarios)},
{px}_p AS (SELECT *, {_pred_expr(model)} AS pred FROM {px}_hz),
{px}_fc AS (SELECT series_id, model, scenario_id, year, h, population, gdp, price, pred, {lower} AS lower,
                   pred * 1.2 AS upper, {growth(not shared)} AS growth_rate, last_actual FROM {px}_p)"""


def needs_recursive(models) -> bool:
    return "implied_price_logistic" in models


FIVE = ["logistic_price", "linear_price", "linear_income_index", "implied_price_logistic", "trend_elasticity_blend"]


# --- evaluation -----------------------------------------------------------------------------

SCEN3 = [("base", K.DEFAULT_GDP_GROWTH, K.DEFAULT_POP_GROWTH, K.DEFAULT_PRICE_INFLATION, None),
         ("high", 0.04, 0.015, 0.01, None),
         ("low", 0.01, 0.005, 0.03, None)]


def _wrap(models, body: str) -> str:
    return ("WITH RECURSIVE " if needs_recursive(models) else "WITH ") + body


def sql_holdout_accuracy() -> str:
    return _wrap([], f"""{model_fc_ctes('linear_price', h=2, hold=HOLDOUT_YEARS)},
{panel_cte(0, 'panel_all')},
pairs AS (SELECT f.series_id, f.model, f.pred, a.actual FROM lp_fc f
          JOIN panel_all a ON f.series_id = a.series_id AND f.year = a.year)
SELECT series_id, model, count(*) AS n, {metric_cols('actual', 'pred')} FROM pairs GROUP BY series_id, model""")


def _compare_cte(model: str = "logistic_price") -> str:
    px = PREFIX[model]
    return f"""{model_fc_ctes(model, h=2, hold=HOLDOUT_YEARS)},
{panel_cte(0, 'panel_all')},
cmp AS (SELECT f.series_id, f.model, f.year, f.pred AS prediction, a.actual AS expected,
               f.pred - a.actual AS error, abs(f.pred - a.actual) AS abs_error,
               CASE WHEN a.actual <> 0 THEN 100.0 * (f.pred - a.actual) / a.actual END AS pct_error
        FROM {px}_fc f JOIN panel_all a ON f.series_id = a.series_id AND f.year = a.year)"""


def sql_forecast_vs_expected() -> str:
    return _wrap([], f"""{_compare_cte()}
SELECT series_id, model, year, {r('prediction', 'prediction')}, {r('expected', 'expected')}, {r('error', 'error')},
       {r('abs_error', 'abs_error')}, {r('pct_error', 'pct_error')} FROM cmp""")


def sql_comparison_summary() -> str:
    return _wrap([], f"""{_compare_cte()}
SELECT series_id, model, count(*) AS n, {r('avg(abs_error)', 'mae')}, {r('sqrt(avg(error * error))', 'rmse')},
       {r('avg(abs(pct_error))', 'mape')}, {r('max(abs_error)', 'max_abs_error')}
FROM cmp WHERE prediction IS NOT NULL AND NOT isnan(prediction) AND expected IS NOT NULL AND NOT isnan(expected)
GROUP BY series_id, model""")


def _report_cte() -> str:
    return f"""{model_fc_ctes('linear_price', h=3, hold=HOLDOUT_YEARS)},
{panel_cte(0, 'panel_all')},
rep AS (SELECT a.series_id, a.year, a.actual AS expected, f.pred AS forecast, abs(f.pred - a.actual) AS abs_error
        FROM panel_all a LEFT JOIN lp_fc f ON a.series_id = f.series_id AND a.year = f.year)"""


def sql_left_join_report() -> str:
    return _wrap([], f"""{_report_cte()}
SELECT series_id, year, {r('expected', 'expected')}, {r('forecast', 'forecast')}, {r('abs_error', 'abs_error')} FROM rep""")


def sql_report_summary() -> str:
    return _wrap([], f"""{_report_cte()}
SELECT series_id, {r('avg(abs_error)', 'mae')}, {r('sqrt(avg(abs_error * abs_error))', 'rmse')},
       {r('avg(CASE WHEN expected <> 0 THEN 100.0 * abs_error / abs(expected) END)', 'mape')}, count(*) AS n
FROM rep WHERE abs_error IS NOT NULL GROUP BY series_id""")


def _five_fc() -> str:
    parts = [model_fc_ctes(FIVE[0])]
    parts += [model_fc_ctes(m, base=False) for m in FIVE[1:]]
    fits = " UNION ALL ".join(
        f"SELECT series_id, model, status, rmse, mae, r2, mape FROM {PREFIX[m]}_fit" for m in FIVE)
    fcs = " UNION ALL ".join(f"SELECT series_id, model, scenario_id, year, pred, lower, upper FROM {PREFIX[m]}_fc"
                             for m in FIVE)
    return ",\n".join(parts) + f""",
allfits AS ({fits}),
allfc AS ({fcs}),
width AS (SELECT series_id, model, avg(upper - lower) AS interval_width FROM allfc WHERE scenario_id = 'base'
          GROUP BY series_id, model)"""


def _six_fc() -> str:
    boot = sql_bootstrap_forecast().removeprefix("WITH ").rpartition("\nSELECT series_id, model, scenario_id, year,")[0]
    boot = boot.removeprefix(f"{panel_cte()},\n{ctx_cte()},\n").replace("bfit", "boot_fit")
    return f"""{_five_fc()},
{boot},
six AS (SELECT series_id, model, status, rmse, mae, r2, mape FROM allfits
        UNION ALL SELECT series_id, model, status, rmse, mae, r2, mape FROM boot_fit),
six_width AS (SELECT * FROM width UNION ALL SELECT series_id, model, avg(upper - lower) FROM agg GROUP BY series_id, model)"""


def sql_leaderboard() -> str:
    return _wrap(FIVE, f"""{_six_fc()}
SELECT f.series_id, f.model, f.status, f.rmse, f.mae, f.r2, f.mape, {r('w.interval_width', 'interval_width')},
       CASE WHEN f.status = 'ok' THEN CAST(rank() OVER (PARTITION BY f.series_id
            ORDER BY f.status = 'ok' DESC, f.rmse ASC NULLS LAST, f.model ASC) AS INTEGER) END AS rank
FROM six f LEFT JOIN six_width w ON f.series_id = w.series_id AND f.model = w.model""")


def sql_interval_width() -> str:
    return _wrap(FIVE, f"""{_six_fc()}
SELECT series_id, model, 'base' AS scenario_id, {r('interval_width', 'interval_width')} FROM six_width""")


def sql_best_model_per_series() -> str:
    return _wrap(FIVE, f"""{_six_fc()}
SELECT series_id, arg_min(model, (rmse, model)) AS best_model, min(rmse) AS best_rmse, count(*) AS n_models
FROM six WHERE status = 'ok' GROUP BY series_id""")


BT_BACK = [4, 3, 2]
BT_H = 2


def _folds(src: str) -> str:
    """Every row of ``src`` once for each fold that it belongs to, with the fold's cutoff."""
    back = ", ".join(f"({b})" for b in BT_BACK)
    return (f"SELECT p.* EXCLUDE (ly), p.ly - c.back AS cutoff FROM (SELECT *, max(year) OVER (PARTITION BY series_id) AS ly "
            f"FROM {src}) p JOIN (VALUES {back}) c(back) ON p.year <= p.ly - c.back")


def _backtest_cte() -> str:
    c1, c2 = -0.5, 0.5
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    wa = "(PARTITION BY series_id, cutoff ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    wr = "(PARTITION BY series_id, cutoff ORDER BY year)"
    return f"""{panel_cte()},
folds AS ({_folds('panel')}),
bctx AS (SELECT *, first_value(gdp) OVER {wa} AS ref_gdp, first_value(price) OVER {wa} AS ref_price,
                CAST(row_number() OVER {wr} AS INTEGER) AS w FROM folds),
b1 AS (SELECT *, greatest(0.0, {c1} * ({pn}) + {c2}) * population AS pred FROM bctx),
b2 AS (SELECT *, CASE WHEN sum(w * pred) OVER {wa} > 0 THEN sum(w * actual) OVER {wa} / sum(w * pred) OVER {wa}
                 ELSE 1.0 END AS factor FROM b1),
bfit AS (SELECT series_id, cutoff, max(year) AS last_year, arg_max(population, year) AS last_pop,
                arg_max(gdp, year) AS last_gdp, arg_max(price, year) AS last_price,
                any_value(ref_gdp) AS ref_gdp, any_value(ref_price) AS ref_price, any_value(factor) AS continuity,
                count(*) AS n, max(CASE WHEN w > 1 AND 0 = 1 THEN 1 ELSE 0 END) AS dup
         FROM b2 GROUP BY series_id, cutoff),
bhz AS (SELECT f.*, hh.h, CAST(f.last_year + hh.h AS INTEGER) AS year,
               f.last_pop * pow(1.01, hh.h) AS fpop, f.last_gdp * pow(1.03, hh.h) AS fgdp,
               f.last_price * pow(1.02, hh.h) AS fprice
        FROM bfit f CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {BT_H + 1})) hh),
bp AS (SELECT series_id, cutoff, year,
              greatest(0.0, {c1} * {clamp('(fprice / fgdp) * (ref_gdp / ref_price)', '0.2', '3.0')} + {c2}) * fpop * continuity AS pred
       FROM bhz),
bt AS (SELECT p.series_id, 'linear_price' AS model, p.cutoff, p.year, a.actual, p.pred, a.actual - p.pred AS error,
              CASE WHEN a.actual <> 0 THEN abs((a.actual - p.pred) / a.actual) * 100.0 END AS ape
       FROM bp p JOIN panel a ON p.series_id = a.series_id AND p.year = a.year)"""


def sql_rolling_backtest() -> str:
    return f"""WITH {_backtest_cte()}
SELECT series_id, model, cutoff, year, {r('actual', 'actual')}, {r('pred', 'pred')}, {r('error', 'error')},
       {r('ape', 'ape')} FROM bt"""


def sql_backtest_summary() -> str:
    return f"""WITH {_backtest_cte()},
pf AS (SELECT series_id, model, cutoff, sqrt(avg(error * error)) AS fold_rmse FROM bt GROUP BY 1, 2, 3),
st AS (SELECT series_id, model, count(*) AS n_folds, stddev_samp(fold_rmse) AS stability FROM pf GROUP BY 1, 2),
po AS (SELECT series_id, model, count(*) AS n, {metric_cols('actual', 'pred')} FROM bt GROUP BY 1, 2)
SELECT po.*, st.n_folds, {r('st.stability', 'stability')} FROM po JOIN st USING (series_id, model)"""


ORACLE.update({
    "holdout_accuracy": sql_holdout_accuracy(),
    "forecast_vs_expected": sql_forecast_vs_expected(),
    "comparison_summary": sql_comparison_summary(),
    "left_join_report": sql_left_join_report(),
    "report_summary": sql_report_summary(),
    "rolling_backtest": sql_rolling_backtest(),
    "backtest_summary": sql_backtest_summary(),
})


# --- drivers, scenarios, growth ------------------------------------------------------------

def _drivers_select(src: str) -> str:
    return (f"SELECT series_id, scenario_id, year, {r('population', 'population')}, {r('gdp', 'gdp')}, "
            f"{r('price', 'price')} FROM {src}")


def sql_future_drivers() -> str:
    return f"""WITH {linear_price_fit_ctes()},
{horizon_cte('lp_fit')}
{_drivers_select('hz')}"""


def sql_scenario_drivers() -> str:
    return f"""WITH {linear_price_fit_ctes()},
{horizon_cte('lp_fit', scenarios=SCEN3)}
{_drivers_select('hz')}"""


def sql_driver_path_override() -> str:
    return f"""WITH RECURSIVE {implied_fit_ctes()},
{panel_cte(0, 'panel_all')},
path AS (SELECT series_id, CAST(year + 3 AS INTEGER) AS year, population, gdp
         FROM (SELECT *, max(year) OVER (PARTITION BY series_id) AS ly FROM panel_all) WHERE year < ly),
{horizon_cte('ip_fit', name='hz0', price_fallback=True)},
hz AS (SELECT hz0.* REPLACE (coalesce(path.population, hz0.population) AS population,
                             coalesce(path.gdp, hz0.gdp) AS gdp)
       FROM hz0 LEFT JOIN path ON hz0.series_id = path.series_id AND hz0.year = path.year),
ip_p AS (SELECT *, {_pred_expr('implied_price_logistic')} AS pred FROM hz)
{forecast_select('ip_p', shared=True)}"""


def sql_growth_rates() -> str:
    return f"""WITH {model_fc_ctes('linear_price')},
{model_fc_ctes('trend_elasticity_blend', base=False)}
SELECT series_id, model, year, {r('pred', 'pred')}, {r('growth_rate', 'growth_rate')} FROM lp_fc
UNION ALL
SELECT series_id, model, year, {r('pred', 'pred')}, {r('growth_rate', 'growth_rate')} FROM bl_fc"""


def _tg_cte() -> str:
    return f"""{model_fc_ctes('linear_price', scenarios=SCEN3)},
tg AS (SELECT series_id, model, scenario_id, count(*) AS n_points, arg_min(pred, year) AS first_pred,
              arg_max(pred, year) AS last_pred, min(year) AS first_year, max(year) AS last_year
       FROM lp_fc GROUP BY series_id, model, scenario_id)"""


def _tg_cols() -> str:
    g = "CASE WHEN n_points >= 2 AND first_pred > 0 THEN 100.0 * (last_pred / first_pred - 1.0) END"
    return (f"series_id, model, scenario_id, n_points, {r('first_pred', 'first_pred')}, {r('last_pred', 'last_pred')}, "
            f"{r(g, 'total_growth_pct')}")


def sql_total_growth() -> str:
    return f"""WITH {_tg_cte()}
SELECT {_tg_cols()} FROM tg"""


def sql_scenario_summary() -> str:
    return f"""WITH {_tg_cte()}
SELECT first_year, last_year, {_tg_cols()} FROM tg"""


SWEEP_VALUES = [-0.6, -0.5, -0.4, -0.3]


def sql_sensitivity_sweep() -> str:
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    vals = ", ".join(f"({i}, CAST({v} AS DOUBLE))" for i, v in enumerate(SWEEP_VALUES))
    part = "PARTITION BY series_id, vi ORDER BY year"
    wa = f"({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""WITH {panel_cte()},
fan AS (SELECT p.*, v.vi, v.value FROM panel p CROSS JOIN (VALUES {vals}) v(vi, value)),
sx AS (SELECT *, first_value(gdp) OVER {wa} AS ref_gdp, first_value(price) OVER {wa} AS ref_price,
              CAST(row_number() OVER ({part}) AS INTEGER) AS w FROM fan),
s1 AS (SELECT *, greatest(0.0, value * {pn} + 0.5) * population AS pred FROM sx),
s2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, CASE WHEN sum(w * pred) OVER {wa} > 0
          THEN sum(w * actual) OVER {wa} / sum(w * pred) OVER {wa} ELSE 1.0 END AS factor FROM s1)),
sfit AS (SELECT series_id, vi, any_value(value) AS value, max(year) AS last_year,
                arg_max(population, year) AS last_pop, arg_max(gdp, year) AS last_gdp,
                arg_max(price, year) AS last_price, any_value(ref_gdp) AS ref_gdp, any_value(ref_price) AS ref_price,
                any_value(factor) AS continuity, {metric_cols(rounding=False)} FROM s2 GROUP BY series_id, vi),
sh AS (SELECT f.*, CAST(f.last_year + hh.h AS INTEGER) AS year, f.last_pop * pow(1.01, hh.h) AS fpop,
              f.last_gdp * pow(1.03, hh.h) AS fgdp, f.last_price * pow(1.02, hh.h) AS fprice
       FROM sfit f CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, 11)) hh),
sp AS (SELECT *, greatest(0.0, value * {clamp('(fprice / fgdp) * (ref_gdp / ref_price)', '0.2', '3.0')} + 0.5)
                 * fpop * continuity AS pred FROM sh),
fin AS (SELECT series_id, vi, any_value(value) AS value, arg_max(pred, year) AS final_prediction,
               any_value(rmse) AS rmse FROM sp GROUP BY series_id, vi),
imp AS (SELECT *, first_value(final_prediction) OVER (PARTITION BY series_id ORDER BY vi
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM fin)
SELECT series_id, 'linear_price' AS model, 'C1' AS parameter, {r('value', 'value')},
       {r('final_prediction', 'final_prediction')},
       {r('CASE WHEN base <> 0 THEN 100.0 * (final_prediction - base) / base END', 'impact_pct')},
       {r('rmse', 'rmse')} FROM imp"""


# --- calibration and bootstrap --------------------------------------------------------------

def _cal_rows_cte(src: str = "panel") -> str:
    _, _, _, _, scale, _ = _lg_consts()
    return f"""cr AS (SELECT series_id, {scale} * price / {gmax('gdp', '1e-10')} AS rr, population AS pop, actual AS act
       FROM {src})"""


def sql_grid_calibration() -> str:
    a, b, c0, d0, _, _ = _lg_consts()
    n1, n2 = 41, 30
    k1 = f"({K.CALIB_K1_LO} + CAST(floor(i / {n2}) AS DOUBLE) * (({K.CALIB_K1_HI} - ({K.CALIB_K1_LO})) / {float(n1 - 1)}))"
    k2 = f"({K.CALIB_K2_LO} + CAST(i % {n2} AS DOUBLE) * (({K.CALIB_K2_HI} - {K.CALIB_K2_LO}) / {float(n2 - 1)}))"
    fexpr = curve("rr", a, b, "k1", "k2")
    return f"""WITH {panel_cte()},
{_cal_rows_cte()},
cells AS (SELECT CAST({k1} AS DOUBLE) AS k1, CAST({k2} AS DOUBLE) AS k2 FROM range(0, {n1 * n2}) t(i)
          UNION ALL SELECT CAST({c0} AS DOUBLE), CAST({d0} AS DOUBLE)),
sse AS (SELECT series_id, k1, k2, sum((act - pop * {fexpr}) * (act - pop * {fexpr})) AS sse
        FROM cr CROSS JOIN cells GROUP BY series_id, k1, k2),
best AS (SELECT series_id, min((round(sse, 6), k1, k2)) AS b FROM sse GROUP BY series_id),
st AS (SELECT series_id, sum((act - pop * {curve('rr', a, b, c0, d0)}) * (act - pop * {curve('rr', a, b, c0, d0)})) AS sse_start
       FROM cr GROUP BY series_id)
SELECT best.series_id, {r('b[2]', 'k1')}, {r('b[3]', 'k2')}, {r('b[1]', 'sse')}, {r('sse_start', 'sse_start')}
FROM best JOIN st ON best.series_id = st.series_id"""


BOOT_SIMS = 200
BOOT_SEED = 42


def _u(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def bootstrap_ctes() -> str:
    BP = K.BOOTSTRAP_DEFAULTS
    a, b = str(BP["distribution_a"]), str(BP["distribution_b"])
    n1, n2 = K.BOOT_K1_N, K.BOOT_K2_N
    k1 = (f"({K.BOOT_K1_LO} + (CAST(floor(i / {n2}) AS DOUBLE) * {K.BOOT_K1_HI - K.BOOT_K1_LO}) / {float(n1 - 1)})")
    k2 = (f"({K.BOOT_K2_LO} + (CAST(i % {n2} AS DOUBLE) * {K.BOOT_K2_HI - K.BOOT_K2_LO}) / {float(n2 - 1)})")
    rho = f"(price / ref_price) * (ref_gdp / {gmax('gdp', '1e-10')})"
    fk = curve("rho", a, b, "g.k1", "g.k2")
    return f"""{panel_cte()},
{ctx_cte()},
br AS (SELECT *, {rho} AS rho FROM ctx),
grid AS (SELECT CAST(i AS INTEGER) AS ci, {k1} AS k1, {k2} AS k2 FROM range(0, {n1 * n2}) t(i)),
e2 AS (SELECT br.series_id, br.w, g.ci, (actual - population * {fk}) * (actual - population * {fk}) AS e2
       FROM br CROSS JOIN grid g),
draws AS (SELECT s.series_id, s.n, sim.sim, slot.slot,
                 CAST(floor({_u('s.series_id', 'sim.sim', 'slot.slot', str(BOOT_SEED))} * s.n) + 1 AS INTEGER) AS idx
          FROM (SELECT series_id, count(*) AS n FROM panel GROUP BY series_id) s
          CROSS JOIN (SELECT CAST(range AS INTEGER) AS sim FROM range(1, {BOOT_SIMS + 1})) sim
          CROSS JOIN (SELECT CAST(range AS INTEGER) AS slot FROM range(1, 1000)) slot
          WHERE slot.slot <= s.n),
sse AS (SELECT d.series_id, d.sim, e.ci, round(sum(e.e2), 6) AS sse
        FROM draws d JOIN e2 e ON d.series_id = e.series_id AND d.idx = e.w GROUP BY d.series_id, d.sim, e.ci),
win AS (SELECT series_id, sim, arg_min(ci, (sse, ci)) AS ci FROM sse GROUP BY series_id, sim),
samples AS (SELECT w.series_id, w.sim, g.k1, g.k2 FROM win w JOIN grid g ON w.ci = g.ci),
dist AS (SELECT series_id, avg(k1) AS k1m, avg(k2) AS k2m, stddev_samp(k1) AS k1_std, stddev_samp(k2) AS k2_std
         FROM samples GROUP BY series_id),
bf1 AS (SELECT br.*, d.k1m, d.k2m, population * {curve('rho', a, b, 'd.k1m', 'd.k2m')} AS pred
        FROM br JOIN dist d ON br.series_id = d.series_id),
bf2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, {recent_factor()} AS factor FROM bf1)),
bf3 AS (SELECT *, (actual - adj) - avg(actual - adj) OVER (PARTITION BY series_id) AS resid FROM bf2),
bfit0 AS (SELECT series_id, 'bootstrap_logistic' AS model, {common_fit_cols(None, PRICED, 3)},
                any_value(k1m) AS k1, any_value(k2m) AS k2, any_value(factor) AS continuity, {metric_cols()}
         FROM bf3 GROUP BY series_id),
{blank_invalid('bfit0', 'bfit')}"""


def sql_bootstrap_fit() -> str:
    return f"""WITH {bootstrap_ctes()}
SELECT {FIT_SELECT}, {r('k1', 'k1')}, {r('k2', 'k2')}, {r('d.k1_std', 'k1_std')}, {r('d.k2_std', 'k2_std')}, {FIT_TAIL}
FROM bfit JOIN dist d USING (series_id)"""


def boot_fc_select() -> str:
    w = "(PARTITION BY series_id, model, scenario_id ORDER BY year)"
    return f"""SELECT series_id, model, scenario_id, year, {r('population', 'population')}, {r('gdp', 'gdp')}, {r('price', 'price')},
       {r('pred', 'pred')}, {r('lower', 'lower')}, {r('upper', 'upper')}, {r('q25', 'q25')}, {r('q75', 'q75')},
       {r(f'CASE WHEN lag(pred) OVER {w} IS NULL THEN 0.0 WHEN lag(pred) OVER {w} = 0 THEN NULL ELSE (pred - lag(pred) OVER {w}) / lag(pred) OVER {w} * 100.0 END', 'growth_rate')},
       'bootstrap_q05_q95' AS band_type
FROM agg"""


def sql_bootstrap_forecast() -> str:
    BP = K.BOOTSTRAP_DEFAULTS
    a, b = str(BP["distribution_a"]), str(BP["distribution_b"])
    rho = f"(price / ref_price) * (ref_gdp / {gmax('gdp', '1e-10')})"
    ridx = f"CAST(floor({_u('s.series_id', 's.sim', 'h', str(BOOT_SEED), chr(39) + 'resid' + chr(39))} * n_years) + 1 AS INTEGER)"
    return f"""WITH {bootstrap_ctes()},
{horizon_cte('bfit', name='bhz')},
bs0 AS (SELECT hz.*, s.sim, s.k1 AS sk1, s.k2 AS sk2, {ridx} AS ridx
        FROM bhz hz JOIN samples s ON hz.series_id = s.series_id),
bs AS (SELECT series_id, model, scenario_id, year, population, gdp, price, sim, ridx,
              population * {curve(rho, a, b, 'sk1', 'sk2')} * continuity AS base_pred FROM bs0),
bsp AS (SELECT bs.*, greatest(0.0, bs.base_pred + r.resid) AS pred
        FROM bs JOIN bf3 r ON bs.series_id = r.series_id AND bs.ridx = r.w),
agg AS (SELECT series_id, model, scenario_id, year, any_value(population) AS population, any_value(gdp) AS gdp,
               any_value(price) AS price, avg(pred) AS pred, quantile_cont(pred, 0.05) AS lower,
               quantile_cont(pred, 0.95) AS upper, quantile_cont(pred, 0.25) AS q25, quantile_cont(pred, 0.75) AS q75
        FROM bsp GROUP BY series_id, model, scenario_id, year)
{boot_fc_select()}"""


# --- parameter noise -------------------------------------------------------------------------

NOISE_SIMS = 100


def _noise_ctes() -> str:
    LPD = K.LOGISTIC_PRICE_DEFAULTS
    names = ["k1", "k2", "distribution_a", "distribution_b", "full_price_scale", "full_penetration"]
    nz = ", ".join(
        f"CAST({LPD[n]} AS DOUBLE) * (1.0 + 0.1 * (2.0 * {_u('p.series_id', 's.sim', chr(39) + n + chr(39), '42')} - 1.0)) AS {n}"
        for n in names)
    part = "PARTITION BY series_id, sim ORDER BY year"
    wa = f"({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    k = f"greatest(3, CAST(floor(n * 0.2) AS INTEGER))"
    rec = f"w > n - {k}"
    fx = curve(f"full_price_scale * price / {gmax('gdp', '1e-10')}", "distribution_a", "distribution_b", "k1", "k2")
    ffx = curve(f"full_price_scale * fprice / {gmax('fgdp', '1e-10')}", "distribution_a", "distribution_b", "k1", "k2")
    return f"""{panel_cte()},
fan AS (SELECT p.*, s.sim, {nz} FROM panel p CROSS JOIN (SELECT CAST(range AS INTEGER) AS sim FROM range(1, {NOISE_SIMS + 1})) s),
nx AS (SELECT *, CAST(count(*) OVER {wa} AS INTEGER) AS n, CAST(row_number() OVER ({part}) AS INTEGER) AS w FROM fan),
n1 AS (SELECT *, full_penetration * population * {fx} AS pred FROM nx),
n2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, CASE WHEN sum(CASE WHEN {rec} THEN pred END) OVER {wa} > 0 THEN
          sum(CASE WHEN {rec} THEN actual END) OVER {wa} / sum(CASE WHEN {rec} THEN pred END) OVER {wa} ELSE 1.0 END
          AS factor FROM n1)),
nfit AS (SELECT series_id, sim, CASE WHEN count(*) < 3 THEN 'too_short' ELSE 'ok' END AS status,
                max(year) AS last_year, arg_max(population, year) AS last_pop, arg_max(gdp, year) AS last_gdp,
                arg_max(price, year) AS last_price, any_value(k1) AS k1, any_value(k2) AS k2,
                any_value(distribution_a) AS distribution_a, any_value(distribution_b) AS distribution_b,
                any_value(full_price_scale) AS full_price_scale, any_value(full_penetration) AS full_penetration,
                any_value(factor) AS continuity, {metric_cols(rounding=False)}
         FROM n2 GROUP BY series_id, sim),
nh AS (SELECT f.*, CAST(f.last_year + hh.h AS INTEGER) AS year, f.last_pop * pow(1.01, hh.h) AS fpop,
              f.last_gdp * pow(1.03, hh.h) AS fgdp, f.last_price * pow(1.02, hh.h) AS fprice
       FROM nfit f CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {HORIZON + 1})) hh
       WHERE f.status = 'ok'),
np AS (SELECT *, full_penetration * fpop * {ffx} * continuity AS pred FROM nh)"""


def sql_param_noise_mc() -> str:
    return f"""WITH {_noise_ctes()}
SELECT series_id, count(*) AS n_simulations, CAST(count_if(status = 'ok') AS BIGINT) AS n_ok, {r('avg(r2)', 'mean_r2')},
       {r('avg(rmse)', 'mean_rmse')} FROM nfit GROUP BY series_id"""


def sql_param_noise_forecast() -> str:
    return f"""WITH {_noise_ctes()}
SELECT series_id, 'logistic_price' AS model, 'base' AS scenario_id, year, count(*) AS n_sims,
       {r('avg(pred)', 'mean_pred')}, {r('quantile_cont(pred, 0.05)', 'q05')}, {r('quantile_cont(pred, 0.5)', 'q50')},
       {r('quantile_cont(pred, 0.95)', 'q95')}
FROM np GROUP BY series_id, year"""


def sql_param_noise_sketch() -> str:
    return sql_param_noise_forecast().replace("quantile_cont", "quantile_disc")


# --- formatting and flattened results ------------------------------------------------------

def sql_format_report() -> str:
    g = "growth_rate / 100.0"
    pct = f"CASE WHEN {g} >= 0 AND {g} <= 1 THEN {g} * 100.0 ELSE {g} END"
    return f"""WITH {model_fc_ctes('linear_price')}
SELECT series_id, year,
       coalesce(replace(printf('%.2f', round(pred, 2)), '.', ','), '') AS pred,
       coalesce(printf('%.2f', round({pct}, 2)) || '%', '') AS growth,
       coalesce(replace(printf('%.2f', round(price, 2)), '.', ','), '') || ' EUR' AS price,
       coalesce(strftime(make_date(year, 12, 31), '%d/%m/%Y'), '') AS period_end
FROM lp_fc"""


def sql_comparison_rows() -> str:
    return _wrap(FIVE, f"""{_six_fc()}
SELECT series_id, model, status, rmse, mae, mape, r2 FROM six""")


ORACLE.update({
    "future_drivers": sql_future_drivers(),
    "scenario_drivers": sql_scenario_drivers(),
    "driver_path_override": sql_driver_path_override(),
    "growth_rates": sql_growth_rates(),
    "total_growth": sql_total_growth(),
    "scenario_summary": sql_scenario_summary(),
    "sensitivity_sweep": sql_sensitivity_sweep(),
    "grid_calibration": sql_grid_calibration(),
    "bootstrap_fit": sql_bootstrap_fit(),
    "bootstrap_forecast": sql_bootstrap_forecast(),
    "param_noise_mc": sql_param_noise_mc(),
    "param_noise_forecast": sql_param_noise_forecast(),
    "param_noise_sketch": sql_param_noise_sketch(),
    "format_report": sql_format_report(),
    "comparison_rows": sql_comparison_rows(),
})


def _cal_round_sql(src_best: str, name: str, n1: int, n2: int, w1: float, w2: float) -> str:
    a, b, _, _, _, _ = _lg_consts()
    lo1 = f"greatest({K.CALIB_K1_LO}, bb.b1 - {w1!r})"
    hi1 = f"least({K.CALIB_K1_HI}, bb.b1 + {w1!r})"
    lo2 = f"greatest({K.CALIB_K2_LO}, bb.b2 - {w2!r})"
    hi2 = f"least({K.CALIB_K2_HI}, bb.b2 + {w2!r})"
    k1 = f"(lo1 + CAST(floor(i / {n2}) AS DOUBLE) * ((hi1 - lo1) / {float(n1 - 1)}))"
    k2 = f"(lo2 + CAST(i % {n2} AS DOUBLE) * ((hi2 - lo2) / {float(n2 - 1)}))"
    fexpr = curve("rr", a, b, "k1", "k2")
    return f"""{name}_box AS (SELECT series_id, b[2] AS b1, b[3] AS b2 FROM {src_best}),
{name}_bx AS (SELECT bb.series_id, bb.b1, bb.b2, {lo1} AS lo1, {hi1} AS hi1, {lo2} AS lo2, {hi2} AS hi2 FROM {name}_box bb),
{name}_cells AS (SELECT series_id, {k1} AS k1, {k2} AS k2 FROM {name}_bx CROSS JOIN range(0, {n1 * n2}) t(i)
                 UNION ALL SELECT series_id, b1, b2 FROM {name}_bx),
{name}_sse AS (SELECT cr.series_id, c.k1, c.k2, sum((act - pop * {fexpr}) * (act - pop * {fexpr})) AS sse
               FROM cr JOIN {name}_cells c ON cr.series_id = c.series_id GROUP BY cr.series_id, c.k1, c.k2),
{name} AS (SELECT series_id, min((round(sse, 6), k1, k2)) AS b FROM {name}_sse GROUP BY series_id)"""


def sql_grid_calibration_zoom(rounds: int = 4, grid=(41, 30), zoom=(11, 11)) -> str:
    base = sql_grid_calibration()
    head, tail = base.split("\nSELECT best.series_id", 1)
    w1 = (K.CALIB_K1_HI - K.CALIB_K1_LO) / (grid[0] - 1)
    w2 = (K.CALIB_K2_HI - K.CALIB_K2_LO) / (grid[1] - 1)
    ctes, prev = [], "best"
    for k in range(1, rounds):
        ctes.append(_cal_round_sql(prev, f"z{k}", zoom[0], zoom[1], w1, w2))
        prev = f"z{k}"
        w1 = 2 * w1 / (zoom[0] - 1)
        w2 = 2 * w2 / (zoom[1] - 1)
    return (head + ",\n" + ",\n".join(ctes) +
            f"\nSELECT z.series_id, {r('b[2]', 'k1')}, {r('b[3]', 'k2')}, {r('b[1]', 'sse')}, {r('sse_start', 'sse_start')}"
            f"\nFROM {prev} z JOIN st ON z.series_id = st.series_id")


def sql_diagnostics_rows() -> str:
    v = sql_panel_validation()
    return f"""WITH chk AS ({v})
SELECT series_id, 'counts' AS section, rule AS metric, CAST(n AS VARCHAR) AS value FROM chk
UNION ALL
SELECT series_id, 'summary' AS section, 'failed_rules' AS metric,
       coalesce(string_agg(CASE WHEN n > 0 THEN rule END, '; ' ORDER BY rule), '') AS value
FROM chk GROUP BY series_id"""


ORACLE.update({
    "grid_calibration_zoom": sql_grid_calibration_zoom(),
    "diagnostics_rows": sql_diagnostics_rows(),
})


def sql_accuracy_metrics() -> str:
    return _wrap([], f"""{model_fc_ctes('logistic_price', h=2, hold=HOLDOUT_YEARS)},
{panel_cte(0, 'panel_all')},
pairs AS (SELECT f.series_id, f.model, f.pred, a.actual FROM lg_fc f
          JOIN panel_all a ON f.series_id = a.series_id AND f.year = a.year)
SELECT series_id, model, count(*) AS n, {metric_cols('actual', 'pred')} FROM pairs GROUP BY series_id, model""")


def sql_bootstrap_samples() -> str:
    full = sql_bootstrap_forecast()
    head = full.split("\nagg AS (")[0]
    return head.rstrip(",") + f"""
SELECT series_id, model, scenario_id, sim, year, {r('pred', 'pred')} FROM bsp"""


ORACLE.update({
    "accuracy_metrics": sql_accuracy_metrics(),
    "bootstrap_samples": sql_bootstrap_samples(),
})


def sql_best_model_forecast() -> str:
    fcs = " UNION ALL ".join(
        f"SELECT series_id, model, scenario_id, year, population, gdp, price, pred, lower, upper, growth_rate, "
        f"'fixed_20pct' AS band_type FROM {PREFIX[m]}_fc" for m in FIVE)
    columns = "series_id, model, scenario_id, year, population, gdp, price, pred, lower, upper, growth_rate, band_type"
    return _wrap(FIVE, f"""{_six_fc()},
boot_rows AS ({boot_fc_select()}),
fcall AS ({fcs} UNION ALL SELECT {columns} FROM boot_rows),
best AS (SELECT series_id, arg_min(model, (rmse, model)) AS model FROM six WHERE status = 'ok' GROUP BY series_id)
SELECT f.series_id, f.model, f.scenario_id, f.year, {r('f.population', 'population')}, {r('f.gdp', 'gdp')},
       {r('f.price', 'price')}, {r('f.pred', 'pred')}, {r('f.lower', 'lower')}, {r('f.upper', 'upper')},
       {r('f.growth_rate', 'growth_rate')}, f.band_type
FROM fcall f JOIN best b ON f.series_id = b.series_id AND f.model = b.model""")


ORACLE["best_model_forecast"] = sql_best_model_forecast()


FOLD = 10000   # composite key: series_id * FOLD + cutoff (years < FOLD)


def sql_backtest_leaderboard() -> str:
    fits = ",\n".join(model_fc_ctes(m, h=BT_H, base=False) for m in FIVE)
    fcs = " UNION ALL ".join(f"SELECT series_id, model, year, pred FROM {PREFIX[m]}_fc" for m in FIVE)
    return _wrap(FIVE, f"""{panel_cte(0, 'praw')},
panel AS (SELECT series_id * {FOLD} + cutoff AS series_id, year, actual, population, gdp, price FROM ({_folds('praw')})),
{ctx_cte()},
{fits},
fcall AS ({fcs}),
pairs AS (SELECT CAST(f.series_id // {FOLD} AS BIGINT) AS series_id, f.model, f.pred, a.actual
          FROM fcall f JOIN praw a ON f.series_id // {FOLD} = a.series_id AND f.year = a.year),
pooled AS (SELECT series_id, model, count(*) AS n, {metric_cols('actual', 'pred', rounding=False)}
           FROM pairs GROUP BY series_id, model)
SELECT series_id, model, n, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('mape', 'mape')},
       CAST(rank() OVER (PARTITION BY series_id ORDER BY round(rmse, 6) ASC NULLS LAST, model ASC) AS INTEGER) AS rank
FROM pooled""")


ORACLE["backtest_leaderboard"] = sql_backtest_leaderboard()

ORACLE.update({"leaderboard": sql_leaderboard(), "interval_width": sql_interval_width(), "best_model_per_series": sql_best_model_per_series()})


def _dirty_ctes() -> str:
    parts = [customer_panel_cte(), _complete_years_cte(), ctx_cte("cy")]
    return ",\n".join(parts + [model_fc_ctes(m, h=2, base=False) for m in FIVE])


def sql_fit_status_dirty_panel() -> str:
    rows = " UNION ALL ".join(
        f"SELECT series_id, model, status, n_years, last_year, {r('continuity', 'continuity', 4)} FROM {PREFIX[m]}_fit" for m in FIVE)
    return _wrap(FIVE, f"""{_dirty_ctes()}
{rows}""")


def sql_forecast_dirty_panel() -> str:
    rows = " UNION ALL ".join(f"SELECT series_id, model, year, {r('pred', 'pred', 4)} FROM {PREFIX[m]}_fc" for m in FIVE)
    return _wrap(FIVE, f"""{_dirty_ctes()}
{rows}""")


def sql_training_window() -> str:
    return f"""WITH {panel_cte()}
SELECT series_id, year, {r('actual', 'actual')}, {r('population', 'population')}, {r('gdp', 'gdp')},
       {r('price', 'price')} FROM panel WHERE year BETWEEN 1997 AND 1999"""


def sql_relabelled_years() -> str:
    return f"""WITH {model_fc_ctes('linear_price', h=2, hold=HOLDOUT_YEARS)},
{panel_cte(0, 'panel_all')},
ly AS (SELECT series_id, max(year) AS last_input_year FROM panel_all GROUP BY series_id)
SELECT f.series_id, f.model, f.scenario_id, CAST(l.last_input_year + f.h AS INTEGER) AS year, {r('f.pred', 'pred')}
FROM lp_fc f JOIN ly l USING (series_id)"""


def sql_future_rows() -> str:
    return f"""WITH {panel_cte()}
SELECT series_id, year, {r('actual', 'actual')}
FROM (SELECT *, max(year) OVER (PARTITION BY series_id) AS ly FROM panel) WHERE year > ly - {HOLDOUT_YEARS} AND year <= 2000"""


def sql_diagnostics_sections() -> str:
    return f"""WITH chk AS ({sql_panel_validation()})
SELECT series_id, 'counts' AS section, rule AS metric, CAST(n AS VARCHAR) AS value FROM chk
UNION ALL
SELECT series_id, 'rules', 'value', string_agg(rule, '; ' ORDER BY rule) FROM chk GROUP BY series_id
UNION ALL
SELECT series_id, 'findings', 'value', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM chk GROUP BY series_id"""


ORACLE.update({
    "fit_status_dirty_panel": sql_fit_status_dirty_panel(),
    "forecast_dirty_panel": sql_forecast_dirty_panel(),
    "training_window": sql_training_window(),
    "relabelled_years": sql_relabelled_years(),
    "future_rows": sql_future_rows(),
    "diagnostics_sections": sql_diagnostics_sections(),
})


def sql_forecast_logistic_unadjusted() -> str:
    pred = f"penetration * population * {curve(f'scale * price / {gmax('gdp', '1e-10')}', 'a', 'b', 'k1', 'k2')}"
    return f"""WITH {logistic_fit_ctes()},
{horizon_cte('lg_fit')},
p AS (SELECT *, {pred} AS pred FROM hz)
{forecast_select('p', shared=False)}"""


def sql_forecast_growth_params() -> str:
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    return f"""WITH {linear_price_fit_ctes()},
{horizon_cte('lp_fit', scenarios=[("base", 0.02, 0.005, 0.04, None)])},
p AS (SELECT *, greatest(0.0, c1 * {pn} + c2) * population * continuity AS pred FROM hz)
{forecast_select('p', shared=False)}"""


GROWTH_VALUES = [0.01, 0.03, 0.05]


def sql_sensitivity_growth() -> str:
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    rates = [(str(v), v, K.DEFAULT_POP_GROWTH, K.DEFAULT_PRICE_INFLATION, None) for v in GROWTH_VALUES]
    return f"""WITH {linear_price_fit_ctes()},
{horizon_cte('lp_fit', h=10, scenarios=rates)},
p AS (SELECT *, greatest(0.0, c1 * {pn} + c2) * population * continuity AS pred FROM hz),
fin AS (SELECT series_id, CAST(scenario_id AS DOUBLE) AS value, arg_max(pred, year) AS last FROM p GROUP BY series_id, scenario_id),
imp AS (SELECT *, first_value(last) OVER (PARTITION BY series_id ORDER BY value) AS base FROM fin)
SELECT series_id, 'linear_price' AS model, 'gdp_growth_rate' AS parameter, {r('value', 'value')}, {r('last', 'final_prediction')},
       {r('CASE WHEN base <> 0 THEN 100.0 * (last - base) / base END', 'impact_pct')} FROM imp"""


def sql_catalog_fit() -> str:
    defaults = {"logistic_price": 9, "linear_price": 3, "linear_income_index": 3, "implied_price_logistic": 10,
                "trend_elasticity_blend": 2, "bootstrap_logistic": 8}
    rows = ", ".join(f"('{m}', {n})" for m, n in defaults.items())
    return f"""WITH comp AS ({sql_model_compatibility()})
SELECT c.model, 'traditional' AS category, CAST(v.n AS BIGINT) AS n_defaults, count_if(c.is_compatible)::BIGINT AS n_compatible
FROM comp c JOIN (VALUES {rows}) v(model, n) USING (model) GROUP BY c.model, v.n"""


ORACLE.update({
    "forecast_logistic_unadjusted": sql_forecast_logistic_unadjusted(),
    "forecast_growth_params": sql_forecast_growth_params(),
    "sensitivity_growth": sql_sensitivity_growth(),
    "catalog_fit": sql_catalog_fit(),
})


def sql_many_files_by_name() -> str:
    return f"""WITH {panel_cte()}
SELECT series_id, year, {r('actual', 'actual')}, {r('population', 'population')}, {r('gdp', 'gdp')}, {r('price', 'price')},
       CASE WHEN series_id % 3 = 2 THEN 'n, ' || year END AS note FROM panel"""


ORACLE["many_files_by_name"] = sql_many_files_by_name()


def sql_calibration_bounded(rounds: int = 12) -> str:
    """The least error sum of a grid search that goes on zooming in."""
    head = sql_grid_calibration_zoom(rounds).rsplit("\nSELECT z.series_id", 1)[0]
    return (head + f"\nSELECT z.series_id, {r('log10(b[1])', 'log_sse', 4)}, {r('log10(sse_start)', 'log_sse_start', 4)}"
            f"\nFROM z{rounds - 1} z JOIN st ON z.series_id = st.series_id")


def sql_forecast_series_params() -> str:
    fit = linear_price_fit_ctes("pc1", "pc2", base=False).replace("CAST(pc1 AS DOUBLE)", "any_value(pc1)").replace("CAST(pc2 AS DOUBLE)", "any_value(pc2)")
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    return f"""WITH {panel_cte(0, 'plain')},
panel AS (SELECT p.*, CASE WHEN n_nationkey % 6 = 0 THEN -0.3 WHEN n_regionkey > 0 THEN CAST(CAST(-0.5 - n_regionkey * 0.02 AS DECIMAL(9, 3)) AS DOUBLE) ELSE -0.5 END::DOUBLE AS pc1,
                 CASE WHEN n_nationkey % 4 = 1 THEN CAST(CAST(0.5 + n_nationkey * 0.01 AS DECIMAL(9, 3)) AS DOUBLE) ELSE 0.5 END::DOUBLE AS pc2
          FROM plain p JOIN nation ON series_id = n_nationkey),
{ctx_cte()},
{fit},
{horizon_cte('lp_fit')},
p AS (SELECT *, greatest(0.0, c1 * {pn} + c2) * population * continuity AS pred FROM hz)
{forecast_select('p', shared=False)}"""


def sql_training_window_bounds() -> str:
    return f"""WITH {panel_cte()},
b AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = 3 THEN 2050 WHEN n_nationkey = 4 THEN 2001
             WHEN n_nationkey % 5 <> 0 THEN 1995 + n_nationkey % 4 END AS lo, CASE WHEN n_nationkey % 7 <> 0 THEN 1998 END AS hi FROM nation WHERE n_nationkey <> 6),
kept AS (SELECT panel.* FROM panel LEFT JOIN b ON series_id = k WHERE coalesce(year >= lo, true) AND coalesce(year <= hi, true)),
ids AS (SELECT k AS id FROM b UNION SELECT series_id FROM panel)
SELECT series_id, year, {r('actual', 'actual')}, {r('population', 'population')}, {r('gdp', 'gdp')}, {r('price', 'price')}, 'ok' AS status FROM kept
UNION ALL
SELECT id, 0, NULL, NULL, NULL, NULL, CASE WHEN lo > hi THEN 'bad_bounds' ELSE 'empty_window' END
FROM ids LEFT JOIN b ON id = k WHERE id NOT IN (SELECT series_id FROM kept)"""


CELLS = ([-0.6, -0.5, -0.4], [0.5, 0.7])


def sql_sensitivity_cells() -> str:
    pn = clamp("(price / gdp) * (ref_gdp / ref_price)", "0.2", "3.0")
    axis = lambda name, values: f"(VALUES {', '.join(f'({i}, CAST({v} AS DOUBLE))' for i, v in enumerate(values))}) {name}(n, v)"
    part = "PARTITION BY series_id, i, j ORDER BY year"
    wa = f"({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""WITH {panel_cte()},
fan AS (SELECT p.*, CAST(a.n AS INTEGER) AS i, CAST(b.n AS INTEGER) AS j, a.v AS va, b.v AS vb FROM panel p CROSS JOIN {axis('a', CELLS[0])} CROSS JOIN {axis('b', CELLS[1])}),
sx AS (SELECT *, first_value(gdp) OVER {wa} AS ref_gdp, first_value(price) OVER {wa} AS ref_price, CAST(row_number() OVER ({part}) AS INTEGER) AS w FROM fan),
s1 AS (SELECT *, greatest(0.0, va * {pn} + vb) * population AS pred FROM sx),
s2 AS (SELECT *, pred * factor AS adj FROM (SELECT *, CASE WHEN sum(w * pred) OVER {wa} > 0 THEN sum(w * actual) OVER {wa} / sum(w * pred) OVER {wa} ELSE 1.0 END AS factor FROM s1)),
sfit AS (SELECT series_id, i, j, any_value(va) AS va, any_value(vb) AS vb, max(year) AS last_year, arg_max(population, year) AS last_pop, arg_max(gdp, year) AS last_gdp,
                arg_max(price, year) AS last_price, any_value(ref_gdp) AS ref_gdp, any_value(ref_price) AS ref_price, any_value(factor) AS continuity, {metric_cols(rounding=False)}
         FROM s2 GROUP BY series_id, i, j),
sh AS (SELECT *, last_pop * pow(1.01, 10) AS fpop, last_gdp * pow(1.03, 10) AS fgdp, last_price * pow(1.02, 10) AS fprice FROM sfit),
fin AS (SELECT *, greatest(0.0, va * {clamp('(fprice / fgdp) * (ref_gdp / ref_price)', '0.2', '3.0')} + vb) * fpop * continuity AS final FROM sh),
imp AS (SELECT *, first_value(final) OVER (PARTITION BY series_id ORDER BY i, j) AS base FROM fin)
SELECT series_id, 'linear_price' AS model, 'C1' AS parameter_a, 'C2' AS parameter_b, i, j, {r('va', 'value_a')}, {r('vb', 'value_b')}, {r('final', 'final_prediction')},
       {r('CASE WHEN base <> 0 THEN 100.0 * (final - base) / base END', 'impact_pct')}, {r('rmse', 'rmse')}, CAST(NULL AS VARCHAR) AS error FROM imp"""


def sql_metric_display() -> str:
    shown = lambda c: f"CASE WHEN {c} IS NOT NULL THEN printf('%.3f', round({c}, 3)) ELSE 'n/a' END"
    return _wrap(FIVE, f"""{_five_fc()}
SELECT series_id, model, {shown('rmse')} AS rmse, {shown('mape')} AS mape, 'n/a' AS wape FROM allfits""")


def sql_model_info() -> str:
    return _wrap(FIVE, f"""{_five_fc()}
SELECT series_id, model, 'traditional' AS category, CASE WHEN model IN ('implied_price_logistic', 'trend_elasticity_blend') THEN 'other' ELSE 'traditional' END AS capability_category,
       status = 'ok' AS is_fitted, CASE WHEN status = 'ok' THEN rmse END AS rmse FROM allfits""")


def sql_comparison_documents() -> str:
    full = "status = 'ok' AND model LIKE 'linear%'"
    own = ", ".join(f"CASE WHEN status = 'ok' THEN {m} END AS {m}" for m in ("rmse", "mae", "mape", "r2"))
    return _wrap(FIVE, f"""{_five_fc()}
SELECT series_id, model, {own}, {r(f'CASE WHEN {full} THEN r2 * 100 END', 'global_score')}, {r(f'CASE WHEN {full} THEN 100 - mape END', 'continuity_score')},
       CASE WHEN {full} THEN mae END AS stability_score, CASE WHEN {full} THEN mape END AS continuity_gap_pct,
       CASE WHEN {full} THEN CASE WHEN mape > 20 THEN 'high' ELSE 'low' END END AS risk, CASE WHEN status <> 'ok' THEN status END AS error FROM allfits""")


def sql_backtest_documents() -> str:
    return f"""WITH s AS ({sql_backtest_summary()}), f AS ({sql_rolling_backtest()}),
g AS (SELECT series_id, model, max(cutoff) AS cutoff_year, min(year) AS test_start, max(year) AS test_end, count(*) AS folds FROM f GROUP BY 1, 2)
SELECT g.series_id, g.model, 'rolling' AS mode, CAST(cutoff_year AS INTEGER) AS cutoff_year, test_start, test_end, folds, rmse, mae, mape, r2, stability
FROM g JOIN s USING (series_id, model)"""


def sql_backtest_document_folds() -> str:
    return f"""SELECT series_id, model, 'rolling' AS mode, CAST(cutoff AS INTEGER) AS cutoff, year, actual, pred FROM ({sql_rolling_backtest()})"""


ORACLE.update({
    "calibration_bounded": sql_calibration_bounded(),
    "forecast_series_params": sql_forecast_series_params(),
    "training_window_bounds": sql_training_window_bounds(),
    "sensitivity_cells": sql_sensitivity_cells(),
    "metric_display": sql_metric_display(),
    "model_info": sql_model_info(),
    "comparison_documents": sql_comparison_documents(),
    "backtest_documents": sql_backtest_documents(),
    "backtest_document_folds": sql_backtest_document_folds(),
})


# --- plug-in models (R2) -------------------------------------------------------------------

def _rising_ctes(src: str, by: str, name: str) -> str:
    """Fits of the rising share per ``by``: a line of demand per head, refused where it falls."""
    wa = f"(PARTITION BY {by} ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    line = lambda kind: f"regr_{kind}(dn, t) OVER {wa}"
    known = lambda kind, other: f"CASE WHEN count(*) OVER {wa} > 1 THEN {line(kind)} ELSE {other} END"
    return f"""{name}0 AS (SELECT *, CAST(year - first_value(year) OVER {wa} AS DOUBLE) AS t, first_value(year) OVER {wa} AS first_year,
             actual / greatest(population, 1e-8) AS dn, CAST(row_number() OVER (PARTITION BY {by} ORDER BY year) AS INTEGER) AS pos FROM {src}),
{name}1 AS (SELECT *, {known('slope', '0.0')} AS rise, {known('intercept', f'avg(dn) OVER {wa}')} AS level FROM {name}0),
{name}2 AS (SELECT *, greatest(0.0, level + rise * t) * population AS pred FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN sum(pos * pred) OVER {wa} > 0 THEN sum(pos * actual) OVER {wa} / sum(pos * pred) OVER {wa} ELSE 1.0 END AS factor FROM {name}2),
{name}4 AS (SELECT *, pred * factor AS adj FROM {name}3),
{name} AS (SELECT {by}, any_value(rise) < -1e-9 AS falls, CAST(count(*) AS INTEGER) AS n_years, any_value(level) AS level, any_value(rise) AS rise,
           any_value(factor) AS continuity, max(year) AS last_year, any_value(first_year) AS first_year, arg_max(population, year) AS last_pop,
           {metric_cols()} FROM {name}4 GROUP BY {by})"""


def sql_plugin_comparison() -> str:
    of_ok = lambda c: f"CASE WHEN NOT falls THEN {c} END AS {c}"
    last = f"greatest(0.0, level + rise * (last_year + {HORIZON} - first_year)) * last_pop * pow(1.0 + {K.DEFAULT_POP_GROWTH}, {HORIZON}) * continuity"
    return f"""WITH {model_fc_ctes('linear_price')},
{_rising_ctes('panel', 'series_id', 'rs')},
ends AS (SELECT series_id, arg_max(pred, year) AS last_pred FROM lp_fc GROUP BY series_id)
SELECT series_id, model, status, CAST(NULL AS VARCHAR) AS error, n_years, CAST(NULL AS DOUBLE) AS level, CAST(NULL AS DOUBLE) AS rise,
       round(continuity, 6) AS continuity, mae, rmse, mape, r2, {r('last_pred', 'last_pred')} FROM lp_fit LEFT JOIN ends USING (series_id)
UNION ALL
SELECT series_id, 'rising_share', CASE WHEN falls THEN 'error' ELSE 'ok' END, CASE WHEN falls THEN 'ValueError: demand per head falls' END, n_years,
       {', '.join(f"CASE WHEN NOT falls THEN round({c}, 6) END" for c in ('level', 'rise', 'continuity'))},
       {', '.join(of_ok(c) for c in ('mae', 'rmse', 'mape', 'r2'))}, CASE WHEN NOT falls THEN round({last}, 6) END
FROM rs"""


def sql_plugin_backtest() -> str:
    return f"""WITH {panel_cte()},
folds AS ({_folds('panel')}),
{_rising_ctes('folds', 'series_id, cutoff', 'rs')},
hz AS (SELECT series_id, cutoff, CAST(last_year + h AS INTEGER) AS year,
              greatest(0.0, level + rise * (last_year + h - first_year)) * last_pop * pow(1.0 + {K.DEFAULT_POP_GROWTH}, h) * continuity AS pred
       FROM rs CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {BT_H + 1})) WHERE NOT falls)
SELECT p.series_id, 'rising_share' AS model, p.cutoff, p.year, {r('a.actual', 'actual')}, {r('p.pred', 'pred')}, {r('a.actual - p.pred', 'error')},
       {r('CASE WHEN a.actual <> 0 THEN abs((a.actual - p.pred) / a.actual) * 100.0 END', 'ape')}
FROM hz p JOIN panel a ON p.series_id = a.series_id AND p.year = a.year"""


ORACLE.update({"plugin_comparison": sql_plugin_comparison(), "plugin_backtest": sql_plugin_backtest()})
