"""Answers to the standard business questions (ANS-1..8, join coverage).

Each answer is one grouped job over the analysis table; windows (``lag``)
run only on the already aggregated time series, by ranges of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exact import exact_sum
from quarry.functions.numeric import no_nan, round_half_up, safe_divide
from quarry.operators.model import Model
from quarry.operators.profile import MISSING_RATIO_WARN, iqr_outliers, null_counts, table_outliers
from quarry.operators.quantiles import (column_quantiles, grouped_percentile_approx,
                                        grouped_quantile)
from quarry.operators.values import value_table
from quarry.session import reused, stored
from quarry.operators.summary import category_topk, numeric_summary_rows

DIGITS = 4
# decimals of money totals
MONEY = 4
# Fixed value: a slope smaller than this in absolute value counts as flat.
FLAT_SLOPE = 1e-9


def _v(c: str) -> Column:
    return no_nan(F.col(c).cast("double"))


def ranges_outliers(df: DataFrame, cols: list[str], quantiles: str = "exact",
                    persist: bool = False) -> DataFrame:
    """ANS-1: count, mean, min, max and IQR outliers of every column given.
    The exact quartiles and outliers come from one value table."""
    with reused(df, persist) as kept:
        if quantiles == "exact":
            table = value_table(kept.select(*cols))
            q = table.quantiles(cols, [0.25, 0.5, 0.75])
            outliers = table_outliers(table, cols, {c: (q[c][0], q[c][2]) for c in cols})
        else:
            q = column_quantiles(kept, cols, [0.25, 0.5, 0.75], method=quantiles)
            outliers = iqr_outliers(kept, cols, method=quantiles)
        summary = numeric_summary_rows(kept, cols, quantiles, medians={c: q[c][1] for c in cols})
    rows = [(c, n, mean, lo, hi, outliers[c]) for c, n, mean, _m, lo, hi, _s in summary]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, min double, max double, outlier_count long")


def by_category(df: DataFrame, value: str, category: str, quantiles: str = "exact") -> DataFrame:
    """ANS-2: distribution of ``value`` per ``category``.  The exact median
    per group comes from :func:`grouped_quantile`, which never gathers a
    (possibly hot) group's values into one task."""
    v = _v(value)
    keyed = df.select(F.col(category).cast("string").alias("category"), v.alias("value"))
    stats = keyed.groupBy("category").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), DIGITS).alias("mean"),
        F.round(F.min("value"), DIGITS).alias("min"), F.round(F.max("value"), DIGITS).alias("max"),
        F.round(F.stddev_samp("value"), DIGITS).alias("std"),
        *([F.round(grouped_percentile_approx("value", 0.5), DIGITS).alias("median")]
          if quantiles == "approx" else []))
    if quantiles == "approx":
        return stats
    med = grouped_quantile(keyed, "category", "value", 0.5).withColumnRenamed("category", "c")
    return (stats.join(med, stats["category"].eqNullSafe(med["c"]), "left")
            .select("category", "n", "mean", "min", "max", "std",
                    F.round("quantile", DIGITS).alias("median")))


def _period(date: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(date))


def trend_change(df: DataFrame, date: str, value: str, grain: str = "month") -> DataFrame:
    """ANS-3: ``value`` summed per period with the change from the previous
    period (absolute and relative)."""
    series = (df.where(F.col(date).isNotNull())
              .groupBy(_period(date, grain).alias("t"))
              .agg(F.round(F.coalesce(exact_sum(_v(value)), F.lit(0.0)), MONEY).alias("value")))
    out = with_previous(series, "t", "value")
    prev = F.col("previous")
    return out.select(
        F.date_format("t", _period_format(grain)).alias("period"), "value",
        "previous", F.round(F.col("value") - prev, MONEY).alias("change"),
        F.round(safe_divide(F.col("value") - prev, prev), DIGITS).alias("pct_change"))


def _period_format(grain: str) -> str:
    return "yyyy-MM-dd" if grain in ("year", "quarter", "month", "week", "day") else "yyyy-MM-dd HH:mm:ss"


def with_previous(series: DataFrame, at: str, value: str) -> DataFrame:
    """``series`` (one row for each value of ``at``) with ``previous``, the ``value`` of the row before.

    Rows are put in order by ranges of ``at`` and written; within a range the
    previous row is a window's, and each range is told the last value of the
    range before it.  So a series of any length is never one task's.
    """
    ranges = stored(series.repartitionByRange(at).withColumn("_range", F.spark_partition_id()), "series")
    ends = sorted(ranges.groupBy("_range").agg(F.max_by(value, at).alias("last")).collect(), key=lambda r: r["_range"])
    carried = [(after["_range"], before["last"]) for before, after in zip(ends, ends[1:])]
    carry = series.sparkSession.createDataFrame(carried, f"_of int, _carried {dict(series.dtypes)[value]}")
    w = Window.partitionBy("_range").orderBy(at)
    first = F.row_number().over(w) == 1
    joined = ranges.join(F.broadcast(carry), F.col("_range") == F.col("_of"), "left")
    return joined.withColumn("previous", F.when(first, F.col("_carried")).otherwise(F.lag(value).over(w))).drop("_range", "_of", "_carried")


def top_contributor(df: DataFrame, category: str, measure: str = "gross_profit") -> DataFrame:
    """ANS-4: the category with the largest total of ``measure`` and its
    share of the overall total."""
    per = df.groupBy(F.col(category).cast("string").alias("subject")).agg(
        exact_sum(_v(measure)).alias("total"))
    # two one-row results: the leader and the grand total of the groups
    best = (per.orderBy(F.col("total").desc_nulls_last(), F.col("subject").asc_nulls_first())
            .limit(1).collect())
    grand = per.agg(exact_sum(F.col("total")).alias("all")).first()["all"]
    rows = [(b["subject"], None if b["total"] is None else round_half_up(b["total"], MONEY),
             round_half_up(b["total"] / grand, DIGITS) if grand and b["total"] is not None else None)
            for b in best]
    return df.sparkSession.createDataFrame(rows, "subject string, value double, share double")


def _top_ratio(df, category, num, den) -> DataFrame:
    per = df.groupBy(F.col(category).cast("string").alias("subject")).agg(
        safe_divide(exact_sum(_v(num)), exact_sum(_v(den))).alias("value"))
    best = per.orderBy(F.col("value").desc_nulls_last(), F.col("subject").asc_nulls_first()).limit(1)
    return best.select("subject", F.round("value", DIGITS).alias("value"))


def top_margin(df: DataFrame, category: str) -> DataFrame:
    """ANS-5: the category with the highest sum(profit) / sum(revenue)."""
    return _top_ratio(df, category, "gross_profit", "revenue")


def top_revenue_per_unit(df: DataFrame, category: str, units: str = "quantity") -> DataFrame:
    """ANS-6: the category with the highest sum(revenue) / sum(units)."""
    return _top_ratio(df, category, "revenue", units)


def margin_direction(df: DataFrame, date: str, grain: str = "month") -> DataFrame:
    """ANS-7: monthly margin (sum profit / sum revenue), the least-squares
    slope of margin over the month index, and its direction."""
    monthly = (df.where(F.col(date).isNotNull())
               .groupBy(_period(date, grain).alias("t"))
               .agg(safe_divide(exact_sum(_v("gross_profit")), exact_sum(_v("revenue"))).alias("margin")))
    idx = (F.year("t") * 12 + F.month("t")).cast("double")
    fit = monthly.agg(F.regr_slope("margin", idx).alias("slope"),
                      F.count("margin").alias("periods"))
    slope = F.col("slope")
    return fit.select(
        "periods", F.round(slope, 8).alias("slope"),
        F.when(slope.isNull(), F.lit("unknown"))
        .when(slope > FLAT_SLOPE, F.lit("improving"))
        .when(slope < -FLAT_SLOPE, F.lit("declining"))
        .otherwise(F.lit("flat")).alias("direction"))


def quality_fallback(df: DataFrame, k: int = 3) -> DataFrame:
    """ANS-8: most frequent values per text column and the columns with a
    high missing ratio, as (kind, subject, value, measure)."""
    top = (category_topk(df, k=k)
           .select(F.lit("frequent").alias("kind"), F.col("column").alias("subject"),
                   F.col("value"), F.col("n").cast("double").alias("measure")))
    rows, nulls = null_counts(df)
    warn = [("missing", c, None, round_half_up(n / max(rows, 1), DIGITS)) for c, n in nulls.items()
            if n / max(rows, 1) > MISSING_RATIO_WARN]
    missing = df.sparkSession.createDataFrame(
        warn, "kind string, subject string, value string, measure double")
    return top.unionByName(missing)


def join_coverage(model: Model) -> DataFrame:
    """Share of analysis rows that found a partner in each joined table
    (needs a model built with ``match_flags=True``)."""
    frame = model.frame
    parts = [F.count(F.col(flag)).alias(f"m{i}") for i, flag in enumerate(model.flags.values())]
    row = frame.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    data = []
    for i, (table, _flag) in enumerate(model.flags.items()):
        join = next(j for j in model.joins if j["table"] == table)
        data.append((table, join["right_key"], row["rows"], row[f"m{i}"],
                     round_half_up(row[f"m{i}"] / row["rows"], DIGITS) if row["rows"] else None))
    return frame.sparkSession.createDataFrame(
        data, "table_name string, key string, rows long, matched long, coverage double")
