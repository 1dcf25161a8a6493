"""Reconciliation checks (AUD-1, AUD-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exact import exact_sum

# Fixed value: default absolute tolerance for KPI totals.
KPI_TOLERANCE = 0.01


def audit_rows(left: DataFrame, right: DataFrame,
               check: str = "summary_rows_match_model") -> DataFrame:
    """Row counts of two frames side by side and whether they agree."""
    left_n = left.count()
    right_n = right.count()
    return left.sparkSession.createDataFrame(
        [(check, left_n, right_n, left_n == right_n)],
        "check string, left_n long, right_n long, ok boolean")


def _long_kpis(df: DataFrame, key: str, kpis: list[str]) -> DataFrame:
    agg = df.groupBy(F.col(key).cast("string").alias("key")).agg(
        *[exact_sum(F.col(k)).alias(k) for k in kpis])
    return agg.unpivot(["key"], kpis, "kpi", "total")


def audit_kpis(left: DataFrame, right: DataFrame, key: str, kpis: list[str],
               tol: float = KPI_TOLERANCE) -> DataFrame:
    """KPI totals per key in two frames, full-outer-joined on (key, kpi).

    A row is ok when both totals exist and differ by at most ``tol``; a key
    present on one side only is a failure.  Totals are exact sums, so equal
    rows in any order and partitioning give equal totals, at any size.  Comparing base-table totals with
    star-join totals this way exposes row fan-out.
    """
    # shown, and compared, at 4 decimals
    total = F.round("total", 4)
    # a null key is a key like any other
    l = _long_kpis(left, key, kpis).select("key", "kpi", total.alias("left"))
    r = _long_kpis(right, key, kpis).select(F.col("key").alias("rkey"), F.col("kpi").alias("rkpi"), total.alias("right"))
    j = l.join(r, F.col("key").eqNullSafe(F.col("rkey")) & (F.col("kpi") == F.col("rkpi")), "full_outer")
    diff = F.abs(F.col("left") - F.col("right"))
    return j.select(F.coalesce("key", "rkey").alias("key"), F.coalesce("kpi", "rkpi").alias("kpi"), "left", "right",
                    F.round(diff, 6).alias("diff"),
                    F.coalesce(diff <= F.lit(tol), F.lit(False)).alias("ok"))
