"""Driver contract: the flagship query runs, and registered queries agree with
their DuckDB oracle on the smallest tables (the full sf0.01 comparison is
``tools/check_oracle.py``)."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.check_oracle import TABLES, _rows

FAST = ["demand_panel", "fit_linear_price", "forecast_logistic_price", "fit_implied_price", "elasticity_threshold",
        "panel_validation", "panel_impute", "model_compatibility", "rolling_backtest", "sensitivity_sweep",
        "grid_calibration", "format_report", "driver_path_override", "total_growth", "fit_status_dirty_panel",
        "forecast_growth_params", "diagnostics_sections"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"series_id", "year", "pred", "lower", "upper", "growth_rate"} <= set(df.columns)


def test_every_query_has_a_callable_and_most_have_sql():
    from panelcast.plans.oracle import ORACLE
    from panelcast.plans.queries import QUERIES
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(ORACLE) == set(QUERIES) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    dd = con.sql(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)
