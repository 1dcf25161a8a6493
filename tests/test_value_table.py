"""Value tables, exact sums and selection: order-free results that no task or shuffle of all rows makes."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.exact import exact_mean, exact_sum
from quarry.operators import answers, audit, profile, values
from quarry.operators.selection import first_rows
from quarry.operators.values import value_table


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


# ---------------------------------------------------------------- value table

def test_value_table_equals_numpy_and_sets(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.randint(-5, 5), 2**60 + rng.randint(0, 3)]), rng.choice([None, float("nan"), rng.gauss(0, 1e3), -0.0, 0.0, math.inf]),
             rng.choice([None, "", "a", "b" * rng.randint(0, 40)]), Decimal(rng.randint(-200, 200)) / 8, [1] if i % 3 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "l long, d double, s string, m decimal(12,3), nested array<int>").repartition(7)
    table = value_table(frame)
    assert table.rows == 3000
    columns = list(zip(*rows))
    values = {c: [x for x in col if x is not None and x == x] for c, col in zip(frame.columns, columns)}
    for c in ("l", "d", "s", "m"):
        assert table.non_null(c) == len(values[c]) and table.distinct(c) == len(set(values[c]))
    assert table.non_null("nested") == len(values["nested"])
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = table.quantiles(["l", "m"], probs)
    for c in ("l", "m"):
        assert got[c] == pytest.approx(list(np.quantile(sorted(map(float, values[c])), probs)), rel=1e-15)
    ordered = sorted(values["d"])
    assert table.quantiles(["d"], [0.0, 1.0])["d"] == [ordered[0], ordered[-1]]
    bounds = {"l": (-3.0, 4.0), "d": (-500.0, 700.0), "m": (-1e9, 1e9)}
    assert table.outside(bounds) == {c: sum(float(x) < lo or float(x) > hi for x in values[c]) for c, (lo, hi) in bounds.items()}


def test_value_table_of_nothing(spark):
    empty = value_table(spark.createDataFrame([], "a double, s string"))
    assert empty.rows == 0 and empty.distinct("s") == 0 and empty.quantiles(["a"], [0.5]) == {"a": [None]}
    nulls = value_table(spark.createDataFrame([(None, None)] * 4, "a double, s string"))
    assert nulls.rows == 4 and nulls.non_null("a") == 0 and nulls.outside({"a": (0.0, 1.0)}) == {"a": 0}


def test_hot_and_distinct_values_over_many_slices(spark):
    """A value with most rows, and ranks inside and at the ends of slices."""
    frame = spark.range(20000).selectExpr("CASE WHEN id % 3 = 0 THEN 7.5 ELSE id * 0.25 END AS x", "CAST(id AS string) AS s")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = value_table(frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    x = sorted(7.5 if i % 3 == 0 else i * 0.25 for i in range(20000))
    assert len(table.slices["x"]) > 3 and len(table.slices["s"]) > 3
    probs = [i / 40 for i in range(41)]
    assert table.quantiles(["x"], probs)["x"] == pytest.approx(list(np.quantile(x, probs)), rel=1e-15)
    assert table.distinct("s") == 20000 and table.non_null("x") == 20000


def test_a_profile_reads_its_table_once(spark, tmp_path):
    spark.range(2000).selectExpr("id AS a", "id % 7 AS b", "CAST(id % 11 AS string) AS c", "sqrt(id) AS d").write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)
    frame = spark.read.parquet(str(tmp_path / "t"))

    @F.udf("double")
    def seen(v):
        reads.add(1)
        return v
    found = profile.profile(frame.withColumn("d", seen.asNondeterministic()("d"))).by_name()
    assert reads.value == 2000
    assert [found[c].unique_count for c in "abcd"] == [2000, 7, 11, 2000] and found["c"].type == "categorical"


# ---------------------------------------------------------------- exact sums

def test_sums_do_not_depend_on_the_partitioning(spark):
    """Amounts whose plain sums differ in the last digits, at a total near 1e14."""
    amounts = spark.range(0, 2_000_000, 1, 16).select(F.round(F.pmod(F.xxhash64("id"), F.lit(12_000_000_000)) / 100, 2).alias("v"))
    totals = {amounts.repartition(n).agg(exact_sum(F.col("v")).alias("s")).first()["s"] for n in (3, 8, 50)}
    assert len(totals) == 1
    whole = amounts.agg(F.sum(F.col("v").cast("decimal(20,2)"))).first()[0]
    assert abs(Decimal(totals.pop()) - whole) <= Decimal("0.02")


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e6, 1e17])
def test_sums_are_those_of_fractions(spark, scale):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * scale for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m")).first()
    want = float(sum(map(Fraction, values)))
    assert got["s"] == pytest.approx(want, rel=1e-12, abs=500 * 2.0**-45)
    assert got["m"] == got["s"] / 500


def test_sums_of_odd_values(spark):
    inf, nan = math.inf, math.nan

    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v"))).first()[0]
    assert total(None, nan) is None and total(nan, 1.5, None) == 1.5
    assert total(inf, 1.0) == inf and math.isnan(total(inf, -inf))
    assert total(1e300, 1.0) == 1e300 and total(2.0**64, -(2.0**64), 0.25) == 0.25
    assert total(0.1, 0.2, 0.3) == pytest.approx(0.6, abs=1e-13) and total(-0.0) == 0.0


def test_audit_of_large_totals_raises_no_alarm(spark):
    rows = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.round(F.pmod(F.xxhash64("id"), F.lit(10**11)) / 100, 2).alias("v"))
    out = audit.audit_kpis(rows.repartition(3), rows.repartition(50), "k", ["v"]).collect()
    assert [r["diff"] for r in out] == [0.0, 0.0] and all(r["ok"] for r in out) and out[0]["left"] > 1e13
    less = audit.audit_kpis(rows, rows.where("v > 1e6"), "k", ["v"]).collect()
    assert not all(r["ok"] for r in less)


# ---------------------------------------------------------------- selection

def sort_key(row):
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in row)


@pytest.mark.parametrize("rows", [10_001, 20_000, 29_999])
def test_first_rows_equal_a_sort(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice([None, rng.randint(0, 40), 2**61]), rng.choice([None, math.nan, -math.inf, round(rng.gauss(0, 5), 1)]), rng.choice([None, "", "x", "xy", "xyz\x00", "é" + str(rng.randint(0, 99))])) for _ in range(30_000)]
    frame = spark.createDataFrame(data, "a long, b double, c string").repartition(6)
    got = [tuple(r) for r in first_rows(frame, ["a", "b", "c"], rows).collect()]
    assert [sort_key(r) for r in got] == sorted(sort_key(r) for r in data)[:rows]


def test_first_rows_of_copies(spark):
    """More equal rows than fit: as many as are wanted, and no task holds the others."""
    frame = spark.range(40_000).selectExpr("CAST(1 AS long) AS a", "'same' AS b").unionByName(spark.createDataFrame([(0, "first"), (2, "last")], "a long, b string"))
    got = first_rows(frame, ["a"], 15_000).collect()
    assert len(got) == 15_000 and tuple(got[0]) == (0, "first") and {tuple(r) for r in got[1:]} == {(1, "same")}


def test_first_rows_plan(spark):
    frame = spark.range(100_000).selectExpr("id * 7919 % 100003 AS a", "id AS b")
    chosen = first_rows(frame, ["a", "b"], 50_000)
    assert "TakeOrdered" not in plan_of(chosen) and "SinglePartition" not in plan_of(chosen)
    assert [r["a"] for r in chosen.collect()] == sorted(i * 7919 % 100003 for i in range(100_000))[:50_000]


def test_first_rows_by_time(spark):
    frame = spark.range(30_000).selectExpr("timestamp_micros(id * 7919 % 30011 * 1000003) AS t", "date_from_unix_date(CAST(id % 50 AS int)) AS d")
    got = [(r["d"], r["t"]) for r in first_rows(frame, ["d", "t"], 12_000).collect()]
    assert got == sorted((r["d"], r["t"]) for r in frame.collect())[:12_000]


# ---------------------------------------------------------------- changes over time

def test_change_at_the_grain_of_seconds(spark):
    """The lag goes over range borders, and no plan puts the series into one partition."""
    frame = spark.range(5000).selectExpr("timestamp_seconds(id * 977 % 5003 * 3) AS t", "CAST(id % 13 AS double) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = answers.trend_change(frame, "t", "v", grain="second")
        assert "SinglePartition" not in plan_of(out)
        got = [(r["period"], r["value"], r["previous"], r["change"]) for r in out.orderBy("period").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    series = sorted((i * 977 % 5003 * 3, float(i % 13)) for i in range(5000))
    assert len(got) == 5000 and got[0][2] is None
    assert [g[1] for g in got] == [v for _, v in series]
    assert [g[2] for g in got[1:]] == [v for _, v in series[:-1]]
    assert all(g[3] == g[1] - g[2] for g in got[1:])


def test_slices_follow_the_rows(spark, monkeypatch):
    """A slice stays small whatever the number of shuffle partitions, and is not merged with others at run time."""
    monkeypatch.setattr(values, "SLICE_ROWS", 500)
    frame = spark.range(20_000).select((F.col("id") * 7 % 20_000).cast("double").alias("x"))
    table = value_table(frame)
    assert len(table.slices["x"]) > 20 and max(s.values for s in table.slices["x"]) < 3_000
    assert table.rows == table.distinct("x") == 20_000 and table.quantiles(["x"], [0.25, 0.5]) == {"x": [4999.75, 9999.5]}
    assert table.outside({"x": (100.0, 19_000.5)}) == {"x": 100 + 999}


def test_columns_share_what_a_task_holds(spark, monkeypatch):
    """Counts that a task holds are bounded for all columns together."""
    monkeypatch.setattr(values, "HELD_BYTES", 1_200_000)
    n, same = 100_000, 20_000
    frame = spark.range(0, n, 1, 1).select(*[(F.col("id") % same + i).alias(f"c{i}") for i in range(6)])
    sent = values._counted(frame, frame.schema.fields).where("k >= 0").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in sent} == dict.fromkeys(range(6), n)
    table = value_table(frame)
    assert table.rows == n and all(table.distinct(c) == same and table.non_null(c) == n for c in frame.columns)


def test_profile_of_many_batches(spark, monkeypatch):
    """Few values in very many batches: their counts are added up as they come, and the profile is right."""
    monkeypatch.setattr(values, "HELD_BATCHES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = profile.profile(spark.range(0, 5_000, 1, 1).select((F.col("id") % 5).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("s"))).by_name()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (found["a"].unique_count, found["a"].null_count, found["s"].unique_count, found["s"].null_count) == (5, 0, 1, 2_500)
