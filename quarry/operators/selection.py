"""The first rows of a table in the order of some columns, without moving the others.

``orderBy().limit(n)`` sends n rows of every task to one task.  Here the place
of the n-th row is found by counting: for one column after another, values are
counted in buckets, map-side, and the bucket that holds the wanted rank is cut
again until it holds one value.  A filter then picks the rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import INTEGRAL_TYPES
from quarry.operators.quantiles import BUCKETS, _magnitude

#: so few rows are ordered by Spark's own top-n
SMALL = 10_000
#: classes of an ascending order: nulls, values, NaN
NULL, VALUE, NAN = 0, 1, 2


def _key(df: DataFrame, name: str) -> Column:
    """A column whose order is that of ``name``: whole numbers as bigint, other numbers as double, all else as bytes."""
    c, dt = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dt, INTEGRAL_TYPES):
        return c.cast("bigint")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.cast("double") + F.lit(0.0)
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("bigint")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return c.cast("binary")
    raise TypeError(f"rows cannot be selected by {name}, a {dt.simpleString()}")


def _class(key: Column, floating: bool) -> Column:
    named = F.when(key.isNull(), NULL)
    return (named.when(F.isnan(key), NAN) if floating else named).otherwise(VALUE)


def _bucket(key: Column, bracket: tuple | None, kind: str) -> Column:
    """A bucket number that never falls as the key grows."""
    if kind == "binary":
        shared = 0 if bracket is None else len(os.path.commonprefix([bytes(bracket[0]), bytes(bracket[1])]))
        # two bytes behind the shared ones; a value that ends before counts as lower than any byte
        two = F.hex(F.substring(key, shared + 1, 2))
        return F.coalesce(F.conv(F.rpad(two, 4, "0"), 16, 10).cast("bigint") * 3 + F.length(two) / 2, F.lit(0)).cast("bigint")
    if bracket is None:
        return _magnitude(key.cast("double")).cast("bigint")
    lo, hi = bracket
    if kind == "bigint" and hi - lo < 1 << 62:
        return F.floor((key - F.lit(lo)) / F.lit(max(1, -(-(hi - lo + 1) // BUCKETS)))).cast("bigint")
    share = (key.cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return F.least(F.floor(share * F.lit(float(BUCKETS))), F.lit(BUCKETS - 1)).cast("bigint")


def _locate(df: DataFrame, name: str, rank: int) -> tuple[int, object, int, int]:
    """(class, value, rows before it, rows equal to it) of the row of ``rank`` (from 0) in the order of one column."""
    kind = df.select(_key(df, name).alias("key")).dtypes[0][1]
    keys = df.select(_key(df, name).alias("key"))
    counts = {r["c"]: r["n"] for r in keys.groupBy(_class(F.col("key"), kind == "double").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = 0
    for c in (NULL, VALUE, NAN):
        if rank < before + counts.get(c, 0):
            break
        before += counts.get(c, 0)
    if c != VALUE:
        return c, None, before, counts[c]
    values = keys.where(_class(F.col("key"), kind == "double") == VALUE)
    bracket = None
    while True:
        inside = values if bracket is None else values.where((F.col("key") >= F.lit(bracket[0])) & (F.col("key") <= F.lit(bracket[1])))
        rows = inside.groupBy(_bucket(F.col("key"), bracket, kind).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: r["b"]):
            if rank < before + r["n"]:
                break
            before += r["n"]
        if r["lo"] == r["hi"]:
            return VALUE, r["lo"], before, r["n"]
        bracket = (r["lo"], r["hi"])


def first_rows(df: DataFrame, order_by: list[str], rows: int) -> DataFrame:
    """The first ``rows`` rows of ``df`` by ``order_by`` (ascending, nulls first, as Spark orders), in that order.

    Rows that are equal in ``order_by`` follow a hash of all their columns; of
    rows equal in that too, as many as fit are given.
    """
    if rows <= SMALL:
        return df.orderBy(*order_by).limit(rows)
    total = df.count()
    if total <= rows:
        return df.orderBy(*order_by)
    mark = "_mark"
    while mark in df.columns:
        mark += "_"
    marked = df.withColumn(mark, F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if isinstance(t, T.MapType) else F.col(f"`{c}`") for c, t in ((f.name, f.dataType) for f in df.schema.fields)]))
    lower, same, left = F.lit(False), F.lit(True), rows
    for name in [*order_by, mark]:
        tied = marked.where(same)
        c, value, before, equal = _locate(tied, name, left - 1)
        key = _key(marked, name)
        floating = isinstance(marked.schema[name].dataType, (T.FloatType, T.DoubleType))
        below = _class(key, floating) < c
        at = _class(key, floating) == c
        if c == VALUE:
            below, at = below | (at & (key < F.lit(value))), at & (key == F.lit(value))
        lower, same, left = lower | (same & below), same & at, left - before
        if equal <= SMALL or equal == left:
            break
    if equal == left:
        last = marked.where(same)
    elif equal <= SMALL:
        last = marked.where(same).orderBy(*order_by, mark).limit(left)
    else:
        # more rows than SMALL that are alike in all columns: one of them, as often as needed
        one = marked.where(same).agg(*[F.first(f"`{c}`").alias(c) for c in marked.columns])
        last = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(left)))).drop("_copy")
    return marked.where(lower).unionByName(last).drop(mark).orderBy(*order_by)
