import math

import numpy as np
import pandas as pd
import pytest

from quarry.operators import charts
from quarry.operators.audit import audit_kpis, audit_rows
from quarry.operators.measures import add_measures
from quarry.operators.profile import prepare
from quarry.operators.summary import (category_topk, correlation_rows, insight_facts,
                                      numeric_summary)
from quarry.plans.chart_plan import chart_bundle, choose_charts


def _sales_single(df):
    raw = df([("2026-01-01", "North", "Atlas", 1000, 600, 10, "SMB"),
              ("2026-01-02", "South", "Nova", 1400, 900, 14, "Enterprise"),
              ("2026-01-03", "North", "Atlas", 700, 300, 7, "SMB")],
             "date string, region string, product string, revenue long, cost long, "
             "units_sold long, customer_segment string")
    return prepare(raw)


def test_reference_analysis_summary(df):
    frame = _sales_single(df)
    summ = {r.column: r for r in numeric_summary(frame).collect()}
    assert summ["revenue"]["count"] == 3 and summ["revenue"].median == 1000.0
    assert summ["revenue"].std == pytest.approx(351.1885, abs=1e-4)
    facts = insight_facts(frame).collect()
    assert facts and facts[0].kind == "range"


def test_std_of_one_value_is_null(df):
    row = numeric_summary(df([(5.0,)], "x double")).first()
    assert row.std is None and row.median == 5.0


def test_correlation_constant_and_symmetric(df):
    frame = df([(1.0, 2.0, 3.0, None), (2.0, 4.1, 3.0, 1.0), (3.0, 5.9, 3.0, 2.0), (4.0, 8.2, 3.0, 2.5)],
               "a double, b double, c double, d double")
    r = {(a, b): v for a, b, v in correlation_rows(frame)}
    assert r[("a", "c")] is None and r[("c", "c")] is None and r[("a", "a")] == 1.0
    assert r[("a", "b")] == r[("b", "a")] and r[("a", "b")] > 0.99
    # pairwise complete: a and d use only the last three rows
    xs, ys = [2.0, 3.0, 4.0], [1.0, 2.0, 2.5]
    mx, my = sum(xs) / 3, sum(ys) / 3
    cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
    want = cov / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    assert r[("a", "d")] == round(want, 4)


def test_topk_ties_broken_by_value(df):
    frame = df([("b",), ("a",), ("c",), ("a",), ("b",), (" ",), (None,)], "s string")
    rows = [(r.value, r.n, r.rank) for r in category_topk(frame, k=2).orderBy("rank").collect()]
    assert rows == [("a", 2, 1), ("b", 2, 2)]


def test_bar_keeps_null_group_with_zero_sum(df):
    frame = df([("x", 1.0), (None, None), (None, None), ("y", None)], "k string, v double")
    got = {r.x: r.y for r in charts.bar_data(frame, "k", "v").collect()}
    assert got == {"x": 1.0, None: 0.0, "y": 0.0}


def test_histogram_invariants(spark):
    vals = [float(i % 37) * 1.5 for i in range(500)]
    frame = spark.createDataFrame([(v,) for v in vals], "x double")
    h = charts.histogram(frame, "x").orderBy("bin").collect()
    assert sum(r.n for r in h) == 500 and h[-1].hi == max(vals) and h[0].lo == min(vals)
    one = charts.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x").collect()
    assert [(r.lo, r.hi, r.n) for r in one] == [(1.5, 2.5, 3)]


def test_density_integrates_to_one(spark):
    vals = [float((i * 7919) % 101) for i in range(400)]
    frame = spark.createDataFrame([(v,) for v in vals], "x double")
    d = charts.density(frame, "x", points=200, cut=3.0).orderBy("point").collect()
    step = d[1].x - d[0].x
    assert sum(r.density for r in d) * step == pytest.approx(1.0, abs=0.01)


def test_reference_chart_choice_has_two_types(df):
    frame, measures = add_measures(_sales_single(df))
    specs = choose_charts(frame, measures)
    assert len({s.chart_type for s in specs}) >= 2 and len(specs) <= 5
    bundle = chart_bundle(frame, measures)
    assert bundle.select("chart_id").distinct().count() == len(specs)


def test_audits(df):
    a = df([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = df([("x", 1.0), ("x", 1.0), ("y", 2.0)], "k string, v double")
    assert audit_rows(a, a).first().ok and not audit_rows(a, b).first().ok
    res = {(r.key, r.kpi): r.ok for r in audit_kpis(a, b, "k", ["v"]).collect()}
    assert res == {("x", "v"): False, ("y", "v"): True}


def test_validate_specs_filters_and_dedupes(df):
    from quarry.plans.chart_plan import validate_specs
    frame = df([("a", 1.0, 2.0, 3.0)], "k string, x double, y double, z double")
    specs = validate_specs(frame, [
        {"chart_type": "pie", "x": "k", "y": "x"},
        {"chart_type": "BAR", "x": "k", "y": "x", "story_role": "driver"},
        {"chart_type": "bar", "x": "k", "y": "x", "story_role": "driver"},
        {"chart_type": "line", "x": "missing", "y": "x"},
        {"chart_type": "heatmap", "columns": ["x", "nope"]},
        {"chart_type": "heatmap", "columns": ["x", "y", "nope"], "aggregation": "correlation"},
        {"chart_type": "histogram", "x": "z"}])
    assert [(s.chart_type, s.x) for s in specs] == [("bar", "k"), ("heatmap", None), ("histogram", "z")]


def test_profile_new_columns_only(df):
    from quarry.operators.profile import profile, profile_new_columns
    frame = df([(1.0, 2.0), (3.0, None)], "a double, b double")
    first = profile(frame.select("a"))
    both = profile_new_columns(frame, first)
    assert [c.column for c in both.columns] == ["a", "b"] and both.by_name()["b"].null_count == 1


def test_histogram_of_a_wide_range_lists_filled_bins_only(spark):
    frame = spark.createDataFrame([(float(i % 100),) for i in range(2000)] + [(1e12,)], "x double")
    h = charts.histogram(frame, "x").orderBy("bin").collect()
    assert sum(r.n for r in h) == 2001 and len(h) <= 101 and h[-1].bin > 2**31 and h[-1].hi == 1e12


def test_density_sums_repeated_values(spark):
    vals = [1.0, 1.0, 1.0, 2.0, 4.0]
    d = charts.density(spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double"), "x", points=3).orderBy("point").collect()
    h = round(np.std(vals, ddof=1) * 5 ** -0.2, 10)
    want = [sum(np.exp(-0.5 * ((g - v) / h) ** 2) for v in vals) / (5 * h * np.sqrt(2 * np.pi)) for g in (1.0, 2.5, 4.0)]
    assert [r.density for r in d] == pytest.approx(want)


def test_wide_correlations_with_nulls(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 30))
    x[:, 1:] += x[:, :1]
    x[:, 7] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    names = [f"c{i}" for i in range(30)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = {(a, b): r for a, b, r in correlation_rows(frame)}
    want = pd.DataFrame(x, columns=names).corr()
    assert len(got) == 900
    for a in names:
        for b in names:
            if a in ("c7", "c9") or b in ("c7", "c9"):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=6e-5)
    assert {r for _, _, r in correlation_rows(frame.limit(0))} == {None}


def test_weighted_bar_is_ratio_of_sums(spark):
    rows = [("a", 0.5, 100.0), ("a", 0.1, 300.0), ("a", None, 900.0), ("b", 0.4, 10.0), ("b", 0.9, None), ("c", 0.3, 0.0)]
    frame = spark.createDataFrame(rows, "k string, margin double, revenue double")
    got = {r.x: r.y for r in charts.bar_data(frame, "k", "margin", "mean", digits=4, weight="revenue").collect()}
    assert got == {"a": 0.2, "b": 0.4, "c": None}
    with pytest.raises(ValueError):
        charts.bar_data(frame, "k", "margin", "sum", weight="revenue")
