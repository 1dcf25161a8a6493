"""Exact answers on NaN, null keys, near ties, quoted CSV text and more measures than a report shows."""

import math

import pytest

from quarry.functions.formula import add_formula_measures
from quarry.functions.names import dataset_name
from quarry.operators import answers, audit, charts, profile, summary
from quarry.sources import tables


def test_nan_is_no_outlier(spark):
    rows = [(float(i),) for i in range(20)] + [(float("nan"),)] * 5 + [(1000.0,)]
    assert profile.iqr_outliers(spark.createDataFrame(rows, "v double"), ["v"]) == {"v": 1}


def test_near_ties_rank_by_the_unrounded_value(spark):
    frame = spark.createDataFrame([("a", 0.40001, 1.0), ("z", 0.40004, 1.0)], "category string, gross_profit double, revenue double")
    assert answers.top_margin(frame, "category").first()["subject"] == "z"
    assert charts.bar_data(frame, "category", "gross_profit", "sum", top=1, digits=4).first()["x"] == "z"


def test_null_key_reconciles(spark):
    frame = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "k string, v double")
    out = audit.audit_kpis(frame, frame, "k", ["v"]).collect()
    assert len(out) == 2 and all(r["ok"] for r in out)


def test_formulas_keep_all_and_never_give_nan(spark):
    frame = spark.createDataFrame([(-8.0, 1.0)], "revenue double, cost double")
    wide, status = add_formula_measures(frame, [{"name": f"m{i}", "formula": f"revenue + {i}"} for i in range(9)] + [{"name": "Revenue", "formula": "cost * 2"}, {"name": "root", "formula": "revenue ** 0.5"}])
    row = wide.first()
    assert len(status) == 10 and row["revenue"] == -8.0 and row["root"] is None and row["m8"] == 0.0


@pytest.mark.parametrize("path,name", [("/x/sales.2024.csv", "sales_2024"), ("/x/a.parquet/", "a"), ("/x/b", "b")])
def test_only_the_last_suffix_is_cut(path, name):
    assert dataset_name(path) == name


def test_quotes_and_line_ends_in_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"x ""q"" y",#N/A N/A\n"two\nlines",1.#QNAN\n')
    rows = tables.read_csv_strings(spark, str(path), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [('x "q" y', None), ("two\nlines", None)]
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "/x/a.xyz")


def test_no_column_or_fact_is_cut(spark):
    frame = spark.createDataFrame([tuple(f"v{i}" for i in range(14)) + tuple(float(i * k) for i in range(9)) for k in (1, 2, 3)], ", ".join([f"s{i} string" for i in range(14)] + [f"n{i} double" for i in range(9)]))
    assert summary.category_topk(frame).select("column").distinct().count() == 14
    kinds = [r["kind"] for r in summary.insight_facts(frame).collect()]
    assert kinds.count("range") == 9 and kinds.count("leader") == 14 and kinds.count("correlation") == 1
    assert answers.ranges_outliers(frame, [f"n{i}" for i in range(9)]).count() == 9
    assert not any(math.isnan(r["mean"]) for r in answers.ranges_outliers(frame, ["n1"]).collect())
