"""Infinite values: no correlation, no place on an axis, no crash; wide correlations and binned densities."""

import math

import numpy as np
import pytest

from quarry.operators import charts, summary
from quarry.plans import chart_plan
from quarry.sources import tables
from quarry.operators import types as ty

INF, NAN = math.inf, math.nan


def matrix(frame, cols=None):
    return {(a, b): r for a, b, r in summary.correlation_rows(frame, cols)}


def test_a_column_with_an_infinity_correlates_with_nothing(spark):
    rows = [(float(i), float(i * i % 17), INF if i == 5 else float(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    r = matrix(frame)
    assert r[("a", "c")] is None and r[("c", "b")] is None and r[("c", "c")] is None
    assert r[("a", "a")] == 1.0 and r[("a", "b")] is not None
    best = summary.strongest_correlation(frame).first()
    assert (best["left"], best["right"]) == ("a", "b")
    facts = [f for f in summary.insight_facts(frame).collect() if f["kind"] == "correlation"]
    assert [(f["subject"], f["other"]) for f in facts] == [("a", "b")]


def test_an_infinity_in_a_csv_cell(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "\n".join(f"{i},{'inf' if i == 3 else i * 2}" for i in range(40)))
    typed, _ = ty.infer_and_coerce(tables.read_dataset(spark, str(tmp_path / "t.csv")))
    assert dict(typed.dtypes)["b"] == "double"
    assert matrix(typed)[("a", "b")] is None


def test_infinities_outside_a_pair_s_rows_do_not_count(spark):
    """The infinite row has no partner value, so the other rows decide."""
    rows = [(float(i), float(3 * i)) for i in range(20)] + [(INF, None)]
    assert matrix(spark.createDataFrame(rows, "a double, b double"))[("a", "b")] == 1.0


def test_axes_leave_out_what_is_not_finite(spark):
    finite = [0.5 * i for i in range(100)]
    mixed = spark.createDataFrame([(v, v) for v in finite] + [(INF, 1.0), (-INF, 2.0), (NAN, 3.0), (None, 4.0), (1.0, INF)], "x double, y double")
    plain = spark.createDataFrame([(v,) for v in [*finite, 1.0]], "x double")
    key = lambda f: sorted(tuple(r) for r in f.collect())
    assert key(charts.histogram(mixed, "x")) == key(charts.histogram(plain, "x"))
    curves = [np.array(key(charts.density(f, "x"))) for f in (mixed, plain)]
    assert np.allclose(*curves)
    assert sum(r["n"] for r in charts.scatter_grid(mixed, "x", "y").collect()) == 100
    only = spark.createDataFrame([(INF,), (NAN,)], "x double")
    assert charts.histogram(only, "x").count() == 0 and charts.density(only, "x").count() == 0


def test_charts_of_a_view_with_infinities(spark):
    rows = [(f"r{i % 3}", float(i) if i % 9 else INF, float(i * 2), i % 5) for i in range(60)]
    frame = spark.createDataFrame(rows, "region string, revenue double, cost double, quantity int")
    assert chart_plan.chart_bundle(frame, []).count() > 0


def naive(values):
    k = values.shape[1]
    out = {}
    for i in range(k):
        for j in range(i + 1, k):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            x, y = values[both, i], values[both, j]
            usable = len(x) > 1 and np.isfinite(x).all() and np.isfinite(y).all() and x.min() < x.max() and y.min() < y.max()
            out[(i, j)] = float(np.corrcoef(x, y)[0, 1]) if usable else None
    return out


def test_wide_correlations_by_products_of_blocks(spark):
    rng = np.random.default_rng(2)
    k, n = 60, 500
    values = rng.standard_normal((n, k)) @ rng.standard_normal((k, k)) + rng.uniform(-1e6, 1e6, k)
    values[rng.random((n, k)) < 0.1] = np.nan
    values[:, 7] = 4.0
    values[:, 8] = np.nan
    values[3, 9] = np.inf
    values[:, 11] = np.where(np.isnan(values[:, 12]), values[:, 11], 5.0)
    cols = [f"c{i}" for i in range(k)]
    frame = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in values], ", ".join(f"{c} double" for c in cols)).repartition(5)
    got, want = matrix(frame), naive(values)
    for (i, j), r in want.items():
        g = got[(cols[i], cols[j])]
        assert (g is None) == (r is None), (i, j, g, r)
        assert g is None or g == pytest.approx(r, abs=1.01e-4)
        assert got[(cols[j], cols[i])] == g
    assert got[("c7", "c7")] is None and got[("c9", "c9")] is None and got[("c0", "c0")] == 1.0


def test_a_thousand_columns_in_two_scans(spark):
    """No row is dealt to its pairs: the rows that leave the tasks are one for each column and task."""
    k = 1000
    frame = spark.range(300).selectExpr(*[f"sin(id * {i + 1}) AS c{i}" for i in range(k)])
    rows = summary.correlation_rows(frame)
    assert len(rows) == k * k
    x = np.sin(np.arange(300)[:, None] * np.arange(1, k + 1))
    want = np.corrcoef(x.T)
    for at in range(0, k * k, 9973):
        a, b, r = rows[at]
        assert r == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1.01e-4)


@pytest.mark.parametrize("shape", ["normal", "heavy", "lumps"])
def test_density_equals_all_kernels(spark, shape):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(50, 3, 3000), "heavy": rng.standard_cauchy(3000), "lumps": rng.integers(0, 9, 3000) * 0.01}[shape]
    got = charts.density(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").orderBy("point").collect()
    h = np.std(x, ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["x"] for r in got] == pytest.approx(list(grid))
    assert np.abs(np.array([r["density"] for r in got]) - want).max() < 1e-7 / (h * math.sqrt(2 * math.pi))


def test_density_shuffles_no_values(spark):
    frame = charts._bin_series(spark.range(1000).selectExpr("sqrt(id) AS v"), 0.0, 5.0)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin" in plan and "hashpartitioning(v" not in plan and "partial_sum" in plan
