"""The aggregated data behind each chart (CHT-1..8).

Rendering is not done here; every function returns the (small) aggregated
DataFrame a chart would draw.  All of them are grouped aggregates with
partial (map-side) aggregation, so a hot x value costs one row per task in
the shuffle; top-k is ``orderBy().limit()`` which Spark plans as a
``TakeOrderedAndProject`` (per-partition top-k, no global sort).
"""

from __future__ import annotations

import math
from functools import reduce

from numpy.polynomial import hermite_e
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exact import exact_mean, exact_sum
from quarry.functions.numeric import is_datetime_type, no_nan, round_half_up
from quarry.operators.quantiles import column_quantiles
from quarry.operators.summary import correlations
from quarry.session import reused

# Fixed values of the chart step.
BAR_TOP = 12
DENSITY_POINTS = 200
# bins of the density for each bandwidth, and the highest power that their series keeps
DENSITY_BINS = 4
DENSITY_ORDER = 7
ISO_SECONDS = "yyyy-MM-dd HH:mm:ss"
ISO_DAY = "yyyy-MM-dd"


def _label(df: DataFrame, x: str, fmt: str = ISO_SECONDS) -> Column:
    if is_datetime_type(df.schema[x].dataType):
        return F.date_format(F.col(x), fmt)
    return F.col(x).cast("string")


def _value(y: str) -> Column:
    return no_nan(F.col(y).cast("double"))


def aggregate_expr(y: str, agg: str) -> Column:
    """sum (all-null group -> 0), mean, or count of non-null ``y``; sums and means do not depend on the order of the rows."""
    v = _value(y)
    if agg == "sum":
        return F.coalesce(exact_sum(v), F.lit(0.0))
    if agg == "mean":
        return exact_mean(v)
    if agg == "count":
        return F.count(v).cast("double")
    raise ValueError(f"unknown aggregation {agg!r}")


def bar_data(df: DataFrame, x: str, y: str, agg: str = "sum", top: int = BAR_TOP,
             digits: int | None = None, weight: str | None = None) -> DataFrame:
    """Group by ``x`` (the NULL group is kept), aggregate ``y``, keep the
    ``top`` largest (ties by label); result columns ``x`` (string), ``y``.
    Ranks follow the unrounded values; ``digits`` rounds only what is shown.
    ``weight`` makes a mean a weighted one (a margin weighted by revenue is
    total profit over total revenue); rows without value or weight do not
    count, and a total weight of 0 gives NULL."""
    value = aggregate_expr(y, agg)
    if weight is not None:
        if agg != "mean":
            raise ValueError("only a mean can be weighted")
        v, w = _value(y), _value(weight)
        value = F.try_divide(exact_sum(v * w), exact_sum(F.when(v.isNotNull(), w)))
    grouped = df.groupBy(_label(df, x).alias("x")).agg(value.alias("y"))
    best = grouped.orderBy(F.col("y").desc_nulls_last(), F.col("x").asc_nulls_first()).limit(top)
    return best if digits is None else best.select("x", F.round("y", digits).alias("y"))


def line_data(df: DataFrame, x: str, y: str, agg: str = "sum", grain: str | None = None,
              digits: int | None = None) -> DataFrame:
    """Aggregate ``y`` per time value (or per ``date_trunc(grain)``), sorted
    by time; ``x`` is an ISO string."""
    value = aggregate_expr(y, agg)
    if digits is not None:
        value = F.round(value, digits)
    if grain:
        key = F.date_trunc(grain, F.col(x))
        fmt = ISO_DAY if grain in ("year", "quarter", "month", "week", "day") else ISO_SECONDS
    else:
        key = F.col(x)
        fmt = ISO_SECONDS
    grouped = df.groupBy(key.alias("t")).agg(value.alias("y"))
    return grouped.orderBy("t").select(F.date_format("t", fmt).alias("x"), "y")


def _finite(y: str) -> Column:
    """The value as a double; NaN and infinities, which have no place on an axis, as NULL."""
    v = _value(y)
    return F.when(F.abs(v) < F.lit(math.inf), v)


def pair_projection(df: DataFrame, x: str, y: str) -> DataFrame:
    """The raw (x, y) points of a scatter chart: both non-null."""
    return df.select(x, y).dropna()


def _range_stats(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.min(_value(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(_value(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def _bin_index(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``v`` on [lo, hi]; the maximum goes to the last bin."""
    if hi == lo:
        return F.lit(0)
    raw = F.floor((v - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)).cast("int")
    return F.least(raw, F.lit(bins - 1))


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Scatter data of any size as a ``bins`` x ``bins`` grid of counts over
    the (x, y) ranges: x_bin, y_bin, n (empty cells omitted).  Points with a
    null, NaN or infinite side are left out."""
    pts = df.select(_finite(x).alias("x"), _finite(y).alias("y")).dropna()
    stats = _range_stats(pts, ["x", "y"])
    (n, xlo, xhi), (_, ylo, yhi) = stats["x"], stats["y"]
    if not n:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, n long")
    return (pts.groupBy(_bin_index(F.col("x"), xlo, xhi, bins).alias("x_bin"),
                        _bin_index(F.col("y"), ylo, yhi, bins).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], rows: int) -> DataFrame:
    """About ``rows`` of the raw points of a scatter chart (all, if there are
    no more), with their ``key`` columns: those whose key has a low hash, so the
    choice is the same in every run and partitioning.  Two scans, no shuffle of
    points."""
    pts = df.select(*key, _finite(x).alias("x"), _finite(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = pts.count()
    if n <= rows:
        return pts
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    share = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return pts.where(share < F.lit(rows * 2**48 // n))


def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> tuple[int, float, float]:
    """Bin count and edges for an automatic histogram: the smaller of the
    Sturges and Freedman-Diaconis widths (Sturges alone when the IQR is 0).
    A zero range becomes one bin of width 1 around the value."""
    if hi == lo:
        return 1, lo - 0.5, hi + 0.5
    span = hi - lo
    sturges = span / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(span / width))), lo, hi


HIST_SCHEMA = "bin long, lo double, hi double, n long"


def histogram(df: DataFrame, x: str, bins: int | None = None) -> DataFrame:
    """Counts per equal-width bin: bin, lo, hi, n (empty bins omitted).

    Pass 1 (one aggregate plus the exact quartiles) fixes the edges; pass 2 is
    a grouped count by bin index, from which the edges follow.  So the result
    has at most one row per value, however wide the range.  NaN and infinite
    values are left out, like nulls.
    """
    with reused(df.select(_finite(x).alias("v")), "auto") as vals:
        return _histogram(vals, bins)


def _histogram(vals: DataFrame, bins: int | None) -> DataFrame:
    n, lo, hi = _range_stats(vals, ["v"])["v"]
    spark = vals.sparkSession
    if not n:
        return spark.createDataFrame([], HIST_SCHEMA)
    if bins is None:
        q1, q3 = column_quantiles(vals, ["v"], [0.25, 0.75])["v"]
        bins, lo, hi = auto_bins(n, lo, hi, q1, q3)
    elif hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    step, at = F.lit((hi - lo) / bins), F.col("bin")
    raw = F.floor((F.col("v") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo))
    return (vals.where(F.col("v").isNotNull())
            .groupBy(F.least(raw, F.lit(bins - 1)).cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(lo) + at * step).alias("lo"),
                    F.when(at == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (at + 1) * step).alias("hi"), "n"))


DENSITY_SCHEMA = "point int, x double, density double"


def density(df: DataFrame, x: str, points: int = DENSITY_POINTS, cut: float = 0.0) -> DataFrame:
    """Gaussian kernel density of ``x`` on an even grid of ``points``.

    Bandwidth by Scott's rule, ``h = std * n^(-1/5)``; the grid spans
    [min - cut*h, max + cut*h].  Two scans over all rows: one for count, range
    and deviation, one that sums, map-side, the first DENSITY_ORDER powers of
    the distance to the middle of its bin, in bins of h / 4.  The kernel's
    Hermite series (Greengard and Strain 1991) turns a bin's power sums into
    its part of the curve; what the series leaves out is below 1e-7 of the
    curve's greatest possible value.  A task sends one row for each filled bin
    (a few thousand for most columns), never a value.  NaN and infinite values
    are left out, like nulls.
    """
    vals = df.select(_finite(x).alias("v")).where(F.col("v").isNotNull())
    row = vals.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                   F.stddev_samp("v").alias("sd")).first()
    spark = vals.sparkSession
    n, sd = row["n"], row["sd"]
    if not n or sd is None or sd == 0 or not math.isfinite(sd):
        return spark.createDataFrame([], DENSITY_SCHEMA)
    h = round_half_up(sd * n ** (-0.2), 10) or sd * n ** (-0.2)
    lo, hi = row["lo"] - cut * h, row["hi"] + cut * h
    grid = [lo + k * (hi - lo) / (points - 1) for k in range(points)]
    series = _bin_series(vals, row["lo"], h)
    # each bin adds its part to every point of the grid, map-side
    at_points = series.select("*", F.posexplode(F.lit(grid)).alias("point", "x"))
    curve = at_points.groupBy("point", "x").agg(F.sum(_part_at(F.col("x"), h)).alias("s"))
    norm = n * h * math.sqrt(2.0 * math.pi)
    return curve.select("point", "x", (F.greatest(F.lit(0.0), "s") / F.lit(norm)).alias("density"))


def _bin_series(vals: DataFrame, lo: float, h: float) -> DataFrame:
    """For each bin of h / 4 its middle ``c`` and the coefficients a0, a1, ... of its kernels' sum, as a polynomial
    in t = (point - c) / h that exp(-t^2 / 2) multiplies."""
    width = h / DENSITY_BINS
    middle = F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(width)
    at = vals.select("v", F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).alias("bin")).select("bin", ((F.col("v") - middle) / F.lit(h)).alias("u"))
    power, powers = F.lit(1.0), []
    for k in range(DENSITY_ORDER + 1):
        powers.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("u")
    sums = at.groupBy("bin").agg(*powers)
    # He_k(t) / k! times the k-th power sum, gathered by powers of t
    terms: list[list[Column]] = [[] for _ in range(DENSITY_ORDER + 1)]
    for k in range(DENSITY_ORDER + 1):
        for j, a in enumerate(hermite_e.herme2poly([0] * k + [1])):
            if a:
                terms[j].append(F.lit(float(a) / math.factorial(k)) * F.col(f"m{k}"))
    return sums.select(middle.alias("c"), *[reduce(Column.__add__, t).alias(f"a{j}") for j, t in enumerate(terms)])


def _part_at(point: Column, h: float) -> Column:
    """A bin's part of the kernels' sum at a point."""
    t = (point - F.col("c")) / F.lit(h)
    value = F.col(f"a{DENSITY_ORDER}")
    for j in reversed(range(DENSITY_ORDER)):
        value = value * t + F.col(f"a{j}")
    return value * F.exp(F.lit(-0.5) * t * t)


def heatmap(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation matrix of the chosen columns (at least 2)."""
    cols = [c for c in cols if c in df.columns]
    if len(cols) < 2:
        raise ValueError("a heatmap needs at least two columns")
    return correlations(df, cols)
