import random

import numpy as np
import pytest

from quarry.operators import profile as pf
from quarry.operators.quantiles import column_quantiles, exact_quantiles


def test_null_ratio_exactly_threshold_not_warned(df):
    frame = df([(None if i < 3 else i, None if i < 4 else i) for i in range(10)], "a long, b long")
    warn = {r.column: r.null_ratio for r in pf.missing_warnings(frame).collect()}
    assert warn == {"b": 0.4}


def test_iqr_rules(df):
    assert pf.iqr_outliers(df([(1.0,), (2.0,), (100.0,)], "x double"), ["x"]) == {"x": 0}
    assert pf.iqr_outliers(df([(5.0,)] * 10 + [(100.0,)], "x double"), ["x"]) == {"x": 0}
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0, -50.0]
    got = pf.iqr_outliers(df([(v,) for v in vals], "x double"), ["x"])
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert got == {"x": sum(v < lo or v > hi for v in vals)} == {"x": 2}


def test_distinct_counts_fold_negative_zero_and_skip_nulls(df):
    frame = df([(0.0, "a"), (-0.0, "a"), (None, None), (1.5, "b")], "x double, s string")
    assert pf.distinct_counts(frame) == {"x": 2, "s": 2}


def test_profile_edge_frames(df, spark):
    empty = df([], "a long, s string")
    p = pf.profile(empty)
    assert p.rows == 0 and all(c.null_ratio == 0.0 for c in p.columns)
    const = df([(7, None)] * 5, "a long, s string")
    cols = pf.profile(const).by_name()
    assert cols["a"].unique_count == 1 and cols["a"].outlier_count == 0
    assert cols["s"].type == "text" and cols["s"].null_ratio == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy_with_narrowing(spark, seed):
    rnd = random.Random(seed)
    vals = [float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1000])) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(frame, ["x"], probs, buckets=4)["x"]
    want = list(np.quantile(vals, probs))
    assert got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantiles_of_empty_and_single(spark):
    frame = spark.createDataFrame([(None, 3.0)], "a double, b double")
    got = column_quantiles(frame, ["a", "b"], [0.5])
    assert got == {"a": [None], "b": [3.0]}


def test_grouped_quantile_hot_and_null_groups(spark):
    from quarry.operators.quantiles import grouped_quantile
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]),
             float(rnd.choice([rnd.randint(0, 9), rnd.random() * 50]))) for _ in range(1500)]
    rows += [("one", 4.0), ("ties", 2.0), ("ties", 2.0)]
    frame = spark.createDataFrame(rows, "k string, x double")
    groups: dict = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    got = {r.k: r.quantile for r in
           grouped_quantile(frame, "k", "x", 0.5).collect()}
    assert got == pytest.approx({k: float(np.quantile(v, 0.5)) for k, v in groups.items()})


def test_approx_profile_close_to_exact(spark):
    frame = spark.range(0, 5000).selectExpr("id", "id % 37 AS k", "CAST(id AS DOUBLE) / 7 AS x",
                                            "IF(id % 10 = 0, NULL, CAST(id % 5 AS STRING)) AS s")
    exact = pf.profile(frame).by_name()
    approx = pf.profile(frame, approx=True).by_name()
    for c in ("id", "k", "x", "s"):
        assert approx[c].null_count == exact[c].null_count
        assert abs(approx[c].unique_count - exact[c].unique_count) <= 0.05 * exact[c].unique_count
    assert exact["s"].null_ratio == 0.1 and exact["s"].type == "categorical"
    q = column_quantiles(frame, ["x"], [0.5], method="approx")["x"][0]
    assert abs(q - np.median([i / 7 for i in range(5000)])) < 5


def test_quantile_pass_counts_and_profile_sketch_reuse(df):
    # NaN and NULL are both missing; the counts come from the quantile pass
    rows = [(float(i % 7) if i % 5 else None, float("nan") if i % 11 == 0 else i * 1.5)
            for i in range(60)] + [(500.0, -900.0)]
    frame = df(rows, "x double, y double")
    counts = {}
    q = column_quantiles(frame, ["x", "y"], [0.25, 0.75], counts=counts)
    xs = [r[0] for r in rows if r[0] is not None]
    ys = [r[1] for r in rows if r[1] == r[1]]
    assert counts == {"x": len(xs), "y": len(ys)}
    assert np.allclose(q["x"], np.quantile(xs, [0.25, 0.75]))
    assert np.allclose(q["y"], np.quantile(ys, [0.25, 0.75]))
    # the profile gives the same answers as the stand-alone operator
    by_col = pf.profile(frame).by_name()
    alone = pf.iqr_outliers(frame, ["x", "y"])
    assert {c: by_col[c].outlier_count for c in ("x", "y")} == alone
    assert alone["x"] >= 1 and alone["y"] >= 1
    assert by_col["y"].null_count == len(rows) - len(ys)


def test_exact_quantiles_of_extreme_values(spark):
    vals = [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0 + 2 ** -52, 2.0 - 2 ** -52, 2.0, -2.0, 1e308, -1e308, 1e12] + [0.1] * 5
    frame = spark.createDataFrame([(v,) for v in vals] + [(float("nan"),), (None,)], "x double")
    probs = [i / (len(vals) - 1) for i in range(len(vals))]
    for buckets in (2, 1024):
        counts = {}
        got = exact_quantiles(frame, ["x"], probs, counts_out=counts, buckets=buckets)["x"]
        assert counts == {"x": len(vals)}
        ordered = sorted(vals)
        for p, g in zip(probs, got):
            k = int(p * (len(vals) - 1))
            step = p * (len(vals) - 1) - k
            assert g == (ordered[k] + (ordered[min(k + 1, len(vals) - 1)] - ordered[k]) * step if step else ordered[k])


def test_infinities_are_order_statistics(spark):
    frame = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "3", "inf")], "x double")
    assert exact_quantiles(frame, ["x"], [0.0, 0.25, 0.5, 1.0])["x"] == [float("-inf"), 1.0, 2.0, float("inf")]


def test_quantile_jobs_do_not_grow_with_columns_and_ranks(spark):
    frame = spark.range(2000).selectExpr("sqrt(id) AS a", "id * 0.37 AS b", "exp(id / 300) AS c", "-id / 7 AS d").cache()
    frame.count()
    tracker = spark.sparkContext.statusTracker()

    def jobs(cols, probs):
        group = f"quantiles-{len(cols)}-{len(probs)}"
        spark.sparkContext.setJobGroup(group, group)
        exact_quantiles(frame, cols, probs)
        return len(tracker.getJobIdsForGroup(group))

    few, many = jobs(["a"], [0.5]), jobs(["a", "b", "c", "d"], [0.1, 0.25, 0.5, 0.75, 0.9])
    frame.unpersist()
    assert many <= 2 * few + 2


def test_hot_group_without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_grouped_quantile_hot_and_null_groups(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
