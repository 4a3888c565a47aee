"""Sources, sinks, load pipeline, orchestration and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelcast.operators import prepare as P
from panelcast.plans import forecast as R
from panelcast.sources import delimited as S
from panelcast.sources.export import write_forecast_json
from panelcast.sources.panel import synthetic_panel
from tests.fixtures import EXPECTED_PATH, FULL, FULL_INPUT, GOLDEN, INDEXED, INPUT, LINEAR, panel


def test_locale_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1234.5, None)], "year int, value double, other double")
    out = str(tmp_path / "loc")
    S.write_locale_csv(df.coalesce(1), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert "year;value;other" in text and "1;1234,5;NA" in text
    back = S.read_delimited(spark, out)
    assert back.first()["value"] == 1234.5


def test_json_sink_has_export_info(spark, tmp_path):
    fits, fc = R.forecast(panel(spark, INPUT), "linear_price", dict(LINEAR), horizon=3)
    out = str(tmp_path / "js")
    write_forecast_json(fits, fc, out)
    line = next(open(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".json")).readline()
    doc = json.loads(line)
    assert doc["export_info"]["format"] == "json" and len(doc["forecast"]) == 3


def test_empty_forecast_export_refused(spark, tmp_path):
    fits, fc = R.forecast(panel(spark, INPUT), "linear_price", dict(LINEAR), horizon=3)
    with pytest.raises(ValueError):
        S.write_forecast_csv(fc.where("false"), str(tmp_path / "x"))


def test_params_table_first_match_and_spaces(spark, tmp_path):
    f = tmp_path / "params.csv"
    f.write_text("source,name,value\nSimplified  Model,linear_a,-0.135\nSimplified Model,linear_a,9\n"
                 "Full Model,k1_c,-6.59917386\nFull Model,bad,abc\n")
    params = S.read_params(spark, str(f))
    got = S.param_values(params, "Simplified  Model", {"C1": "linear_a", "C2": "linear_b"}, {"C2": 0.5})
    assert got == {"C1": -0.135, "C2": 0.5}
    bad = S.param_values(params, "Full Model", {"x": "bad"})
    assert bad["x"] != bad["x"]  # NaN


def test_load_panel_pipeline(spark, tmp_path):
    f = tmp_path / "data.csv"
    lines = ["Annee;Passagers;Pop;PIB;Prix"] + [f"{y};{a};{p};{g};{c}".replace(".", ",") for y, a, p, g, c in INPUT]
    f.write_text("\n".join(lines) + "\n")
    p, checks, prof = P.load_panel(spark, str(f), series_id=7)
    assert p.count() == 13 and dict(p.dtypes)["year"] == "int"
    assert {r["rule"] for r in checks.collect()} >= {"duplicate_years", "null_actual"}
    assert prof.where("column = 'actual'").first()["n_rows"] == 13


def test_golden_comparison_job(spark):
    panels = {"logistic_price": panel(spark, FULL_INPUT)}
    for m in ("linear_price", "trend_elasticity_blend", "linear_income_index", "implied_price_logistic"):
        panels[m] = panel(spark, INPUT)
    params = {"logistic_price": dict(FULL), "linear_price": dict(LINEAR), "linear_income_index": dict(LINEAR),
              "trend_elasticity_blend": {"trend_weight": 0.5}, "implied_price_logistic": dict(INDEXED)}
    exp_rows = [(1, y, v) for y, _, _, v in EXPECTED_PATH]
    expected = spark.createDataFrame(exp_rows, "series_id bigint, year int, excel_indexed double")
    details, summary = R.golden_comparison(
        panels, params, expected, {"implied_price_logistic": "excel_indexed"}, horizon=32,
        paths=spark.createDataFrame([(1, y, p, g) for y, p, g, _ in EXPECTED_PATH],
                                    "series_id bigint, year int, population double, gdp double"))
    s = summary.first()
    assert s["n"] == 32 and s["mae"] < 5e-5


def test_compare_models_status_rows(spark):
    rows = [(1, *r) for r in INPUT] + [(2, *INPUT[0]), (2, *INPUT[1])]
    p = spark.createDataFrame(rows, "series_id bigint, year int, actual double, population double, gdp double, price double")
    fits, fc = R.compare_models(p, params={"bootstrap_logistic": {"n_simulations": 10}}, horizon=2)
    st = {(r["series_id"], r["model"]): r["status"] for r in fits.collect()}
    assert len(st) == 12 and st[(2, "logistic_price")] == st[(2, "bootstrap_logistic")] == "too_short"
    assert st[(1, "linear_price")] == st[(2, "linear_price")] == "ok"
    assert fc.where("series_id = 2").count() == 8 and fc.where("series_id = 1").count() == 12


def test_model_catalog(spark):
    cat = {r["model"]: r for r in R.model_catalog(spark).collect()}
    assert set(cat) == set(GOLDEN) | {"bootstrap_logistic"}
    assert cat["implied_price_logistic"]["best_for"] == "Any series that holds its drivers"
    assert {m for m, r in cat.items() if r["capability_category"] == "other"} == {"implied_price_logistic", "trend_elasticity_blend"}


def test_synthetic_panel_is_deterministic(spark):
    a = synthetic_panel(spark, 50, n_years=30).orderBy("series_id", "year").collect()
    b = synthetic_panel(spark, 50, n_years=30, num_partitions=3).orderBy("series_id", "year").collect()
    assert a == b and len(a) == 1500 and min(r["actual"] for r in a) >= 50000


def test_many_files_grouped_by_delimiter(spark, tmp_path):
    a = tmp_path / "a.csv"
    b = tmp_path / "b.csv"
    a.write_text("year,actual\n2001,1.5\n")
    b.write_text("year;actual;extra\n2002;2,5;x\n")
    df = S.read_delimited_many(spark, [str(a), str(b)])
    rows = {r["year"]: (r["actual"], r["extra"]) for r in df.collect()}
    assert rows == {2001.0: (1.5, None), 2002.0: (2.5, "x")}


def test_training_window_and_errors(spark):
    from panelcast.sources.panel import training_window
    p = panel(spark, INPUT)
    assert training_window(p, 2007, 2010).count() == 4
    with pytest.raises(ValueError):
        training_window(p, 2010, 2007)


def test_relabel_years_after_window(spark):
    from panelcast.operators import horizon as H
    from panelcast.operators import models as M
    from panelcast.sources.panel import training_window
    p = panel(spark, INPUT)
    fits = M.fit_linear_price(training_window(p, 2005, 2012), dict(LINEAR))
    fc = H.predict_linear_price(fits, 3)
    last_input = p.groupBy("series_id").agg(F.max("year").alias("last_input_year"))
    years = sorted(r["year"] for r in H.relabel_years(fc, last_input).collect())
    assert years == [2018, 2019, 2020]


def test_future_rows_filter(spark):
    from panelcast.operators import evaluate as E
    df = spark.createDataFrame([(2017, False), (2018, True), (2049, True), (2050, True)], "year int, is_future boolean")
    assert [r["year"] for r in E.future_rows(df, 2049).orderBy("year").collect()] == [2018, 2049]


def test_typed_csv_and_profile_types(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("series_id,day,label,v\n1,2020-01-05,a,1.5\n1,2020-02-01,b,\n1,2020-03-01,a,3.5\n")
    df = S.read_csv_typed(spark, str(f), "series_id bigint, day date, label string, v double")
    prof = {r["column"]: r for r in P.profile(df).collect()}
    assert prof["v"]["type"] == "numeric" and prof["v"]["n_missing"] == 1 and prof["v"]["mean"] == 2.5
    assert prof["label"]["type"] == "categorical" and prof["label"]["n_distinct"] == 2
    assert prof["day"]["type"] == "datetime" and prof["day"]["min_text"] == "2020-01-05"
    assert P.preview(df, 2).count() == 2


def write_files(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_many_files_are_matched_by_name(spark, tmp_path):
    """Files of one delimiter whose columns stand in another order."""
    at = write_files(tmp_path / "m", {
        "a.csv": "year;pop;gdp\n2001;1;100\n2002;2;200\n",
        "b.csv": "\ufeffyear;gdp;pop\n2003;300;3\n\n",
        "c.csv": 'gdp,"pop",note,year\n"4,5",4,"x;y, z",2004\n400, ,,2005\n',
        "d.csv": "year;note\n",
    })
    rows = {r["year"]: (r["pop"], r["gdp"], r["note"]) for r in S.read_delimited_many(spark, at).collect()}
    assert rows == {2001: (1, 100, None), 2002: (2, 200, None), 2003: (3, 300, None), 2004: (4, 4.5, "x;y, z"), 2005: (None, 400, None)}
    listed = S.read_delimited(spark, [f"{at}/b.csv", f"{at}/a.csv"])
    assert listed.where("year = 2003").first().asDict() == {"year": 2003, "pop": 3, "gdp": 300}


def test_types_are_merged_over_files(spark, tmp_path):
    at = write_files(tmp_path / "t", {"a.csv": "v,w,u\n1.5,2,\n", "b.csv": "w;v;u\nabc;2,5;\n"})
    df = S.read_delimited_many(spark, at, file_column="file")
    assert dict(df.dtypes) == {"v": "double", "w": "string", "u": "double", "file": "string"}
    assert sorted((r["v"], r["w"], r["file"][-5:]) for r in df.collect()) == [(1.5, "2", "a.csv"), (2.5, "abc", "b.csv")]


def test_awkward_files(spark, tmp_path):
    at = write_files(tmp_path / "e", {"empty.csv": "", "head.csv": "a,b,a\n", "short.csv": "a,b,a\n1\n1,2,3,4\n"})
    df = S.read_delimited_many(spark, at)
    assert df.columns == ["a", "b", "a_2"] and sorted(map(tuple, df.collect()), key=str) == [(1, 2, 3), (1, None, None)]
    assert S.read_delimited_many(spark, f"{at}/empty.csv").columns == []


def test_thousand_files_take_a_few_jobs(spark, tmp_path):
    heads = [("year;v;w", "{y};{v},5;n{y}"), ("w;year;v", "n{y};{y};{v},5"), ("v,w,year", "{v}.5,n{y},{y}"), ("year,v,w,x", "{y},{v}.5,n{y},1")]
    files = {f"f{i:04}.csv": heads[i % 4][0] + "\n" + "".join(heads[i % 4][1].format(y=2000 + k, v=i) + "\n" for k in range(3)) for i in range(1000)}
    at = write_files(tmp_path / "k", files)
    sc = spark.sparkContext
    sc.setJobGroup("thousand", "read")
    df = S.read_delimited_many(spark, [f"{at}/{f}" for f in files])
    jobs = len(sc.statusTracker().getJobIdsForGroup("thousand"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20
    got = sorted((r["v"], r["year"], r["w"], r["x"]) for r in df.collect())
    assert got == sorted((i + 0.5, 2000.0 + k, f"n{2000 + k}", 1.0 if i % 4 == 3 else None) for i in range(1000) for k in range(3))


def test_load_panel_by_file(spark, tmp_path):
    at = write_files(tmp_path / "p", {"a.csv": "Annee;Passagers;Pop\n2001;10;1\n2002;11;1\n", "b.csv": "pop,year,passengers\n2,2001,20\n"})
    p, checks, _ = P.load_panel(spark, [f"{at}/a.csv", f"{at}/b.csv"], by_file=True)
    rows = sorted((r["actual"], r["year"], r["population"]) for r in p.collect())
    assert rows == [(10, 2001, 1), (11, 2002, 1), (20, 2001, 2)]
    assert p.select("series_id").distinct().count() == 2 and checks.where("n > 0 AND severity = 'error'").count() == 0
