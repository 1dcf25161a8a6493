"""Quantiles of many numeric columns with linear interpolation.

``method="exact"`` gives the same numbers as pandas/numpy ``quantile`` (linear
interpolation between order statistics) without ever holding a column's
values in one task: see :func:`exact_quantiles`.  ``method="approx"`` is one
pass of ``percentile_approx`` (bounded sketch per column).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reused, stored

# Buckets that a bracket is cut into in each round of the exact method.
BUCKETS = 1024
SKETCH_ACCURACY = 10_000
# Above the largest and below the smallest binary exponent of a double.
EXPONENT_BOUND = 1100


def _values(c: str) -> Column:
    """The column as double, NaN as NULL and -0.0 as 0.0."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = SKETCH_ACCURACY,
                     counts: dict | None = None) -> dict[str, list[float | None]]:
    """One sketch pass.  ``counts`` (a dict) receives each column's non-null,
    non-NaN count from the same pass."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(_values(c), list(probs), accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)],
                 *[F.count(_values(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if counts is not None:
        counts.update({c: row[f"n{i}"] for i, c in enumerate(cols)})
    return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
            for i, c in enumerate(cols)}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    counts_out: dict | None = None,
                    buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles for several columns.

    For n non-null values and probability p the answer is
    ``x[k] + (x[k+1] - x[k]) * frac`` with ``k = floor(p (n-1))`` on the sorted
    values.  The order statistics are found by narrowing: the first round
    counts the values of every column by sign and binary exponent; each later
    round cuts the buckets that hold a wanted rank into ``buckets`` equal parts.
    A round is one aggregate over all columns and ranks (count, least and
    largest value of each bucket, counted map-side), whose result has a
    bounded size; it ends where a bucket holds one value.  Values of one
    exponent lie on a grid of 2^52 steps, so 1024 buckets take 7 rounds at most,
    and a table of n values about log(n) / log(1024) + 2.

    ``counts_out`` (a dict) receives each column's non-null, non-NaN count.
    """
    if not cols:
        return {}
    histograms = _bucket_counts(df, {c: _magnitude(_values(c)) for c in cols})
    counts = {c: sum(n for _, n, _, _ in histograms.get(c, [])) for c in cols}
    if counts_out is not None:
        counts_out.update(counts)
    position = {(c, p): p * (counts[c] - 1) for c in cols if counts[c] for p in probs}
    ranks: dict[str, set[int]] = {}
    for (c, _), at in position.items():
        k = math.floor(at)
        ranks.setdefault(c, set()).update((k, min(k + 1, counts[c] - 1)))

    value: dict[tuple[str, int], float] = {}
    # column -> bracket (least value, largest value) -> [(wanted rank, its rank in the bracket)]
    pending: dict[str, dict[tuple[float, float], list[tuple[int, int]]]] = {}

    def settle(c: str, histogram: list, wanted: list[tuple[int, int]]) -> None:
        for name, inner, lo, hi in _locate(histogram, wanted):
            if lo == hi:
                value[(c, name)] = lo
            else:
                pending.setdefault(c, {}).setdefault((lo, hi), []).append((name, inner))

    for c, wanted in ranks.items():
        settle(c, histograms[c], [(r, r) for r in wanted])
    while pending:
        open_brackets, pending = pending, {}
        histograms = _bucket_counts(df, {
            c: _bracket_bucket(_values(c), list(brackets), buckets)
            for c, brackets in open_brackets.items()})
        for c, brackets in open_brackets.items():
            for i, wanted in enumerate(brackets.values()):
                mine = [h for h in histograms[c] if h[0] // buckets == i]
                settle(c, mine, wanted)

    def interpolate(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        k = math.floor(position[(c, p)])
        frac = position[(c, p)] - k
        low = value[(c, k)]
        return low + (value[(c, min(k + 1, counts[c] - 1))] - low) * frac if frac else low

    return {c: [interpolate(c, p) for p in probs] for c in cols}


def _magnitude(v: Column) -> Column:
    """A bucket number that never falls as ``v`` grows: sign and binary
    exponent (the logarithm rounds monotonically, which is all it takes)."""
    def exponent(x: Column) -> Column:
        return F.floor(F.least(F.log2(x), F.lit(float(EXPONENT_BOUND)))).cast("int") + 2 * EXPONENT_BOUND
    return (F.when(v > 0, exponent(v)).when(v < 0, -exponent(-v)).when(v == 0, F.lit(0)))


def _bracket_bucket(v: Column, brackets: list[tuple[float, float]], buckets: int) -> Column:
    """Bucket of ``v`` in the (disjoint, closed) bracket it lies in, NULL
    outside all of them; bracket i has the numbers from ``i * buckets``."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(brackets):
        share = (v - F.lit(lo)) / F.lit(hi - lo)
        part = F.least(F.floor(share * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))
        out = F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), part + i * buckets).otherwise(out)
    return out


def _bucket_counts(df: DataFrame, bucket: dict[str, Column]) -> dict[str, list[tuple]]:
    """Per column the (bucket, count, least, largest value) rows in bucket
    order, from one scan."""
    names = list(bucket)
    hits = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), bucket[c].alias("b"), _values(c).alias("v"))
        for i, c in enumerate(names)]))).where(F.col("b").isNotNull())
    rows = hits.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                      F.max("v").alias("hi")).collect()
    out: dict[str, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r["c"], r["b"])):
        out.setdefault(names[r["c"]], []).append((r["b"], r["n"], r["lo"], r["hi"]))
    return out


def _locate(histogram: list[tuple], wanted: list[tuple[int, int]]) -> Iterator[tuple]:
    """(name, rank inside the bucket, least, largest value) of the bucket that
    holds each wanted (name, rank)."""
    for name, rank in wanted:
        below = 0
        for _, n, lo, hi in histogram:
            if rank < below + n:
                yield name, rank - below, lo, hi
                break
            below += n


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     method: str = "exact", counts: dict | None = None) -> dict[str, list[float | None]]:
    """``counts`` (a dict) receives the non-null, non-NaN count per column,
    computed in the same first pass."""
    if method == "approx":
        return approx_quantiles(df, cols, probs, counts=counts)
    if method == "exact":
        with reused(df.select(*cols), "auto") as kept:
            return exact_quantiles(kept, cols, probs, counts_out=counts)
    raise ValueError(f"unknown quantile method {method!r}")


def grouped_percentile_approx(c: str, p: float) -> Column:
    """Per-group approximate quantile as an aggregate expression."""
    return F.percentile_approx(_values(c), p, SKETCH_ACCURACY)


def grouped_quantile(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """Exact linear-interpolated ``p``-quantile of ``value`` per ``group``
    (columns ``group``, ``quantile``); groups without a value have no row.

    Equal (group, value) pairs are counted map-side and range-partitioned by
    group and value, so a group that holds most rows spreads over many
    slices; the slices are written once to shared storage.  Sums by (group,
    slice) tell which slice holds each wanted rank, and only those slices'
    rows of the group are put in order.  No step meets a whole group.
    """
    counted = (df.select(F.col(group).alias("g"), _values(value).alias("v"))
               .where(F.col("v").isNotNull())
               .groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    slices = stored(counted.repartitionByRange("g", "v")
                    .withColumn("slice", F.spark_partition_id()), "quantile")
    sums = slices.groupBy("g", "slice").agg(F.sum("c").alias("m"))
    in_order = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("m").over(in_order)).withColumn(
        "n", F.sum("m").over(Window.partitionBy("g")))
    at = F.lit(p) * (F.col("n") - 1)
    k = F.floor(at).cast("long")
    wanted = F.array_distinct(F.array(k, F.least(k + 1, F.col("n") - 1)))
    targets = (ends.select("g", "slice", (F.col("upto") - F.col("m")).alias("before"), "upto",
                           (at - k).alias("frac"), k.alias("k"), F.explode(wanted).alias("r"))
               .where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("upto"))))
    held = (targets.groupBy("g", "slice")
            .agg(F.first("before").alias("before"), F.first("frac").alias("frac"),
                 F.first("k").alias("k"), F.collect_set("r").alias("ranks"))
            .withColumnsRenamed({"g": "tg", "slice": "ts"}))
    near = slices.join(held, F.col("g").eqNullSafe(F.col("tg")) & (F.col("slice") == F.col("ts")))
    running = Window.partitionBy("g", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (near.withColumn("end", F.col("before") + F.sum("c").over(running))
             .select("g", "v", "frac", "k", "end", "c", F.explode("ranks").alias("r"))
             .where((F.col("end") - F.col("c") <= F.col("r")) & (F.col("r") < F.col("end"))))
    # one or two rows a group: the values at ranks k and k + 1
    pair = found.groupBy("g").agg(F.first("frac").alias("frac"), F.min("v").alias("lo"),
                                  F.max("v").alias("hi"))
    quantile = F.when(F.col("frac") == 0, F.col("lo")).otherwise(
        F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac"))
    return pair.select(F.col("g").alias(group), quantile.alias("quantile"))
