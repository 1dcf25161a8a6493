"""Column-expression builders for null-safe arithmetic and statistics.

Everything here returns ``Column`` objects built from built-in functions, so
the work stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator, denominator) -> Column:
    """Division where a zero or null denominator yields NULL (never an error
    or infinity)."""
    return F.try_divide(col(numerator), col(denominator))


def floor_mod(a, b) -> Column:
    """Modulo whose sign follows the divisor (``-7 % 3 == 2``); NULL on 0."""
    a, b = col(a), col(b)
    return a - b * F.floor(F.try_divide(a, b))


def no_nan(c) -> Column:
    """Map floating NaN to NULL so that NaN and NULL are one concept."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime_type(dt) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def round_half_up(value, digits: int):
    """Round like Spark's and DuckDB's ``round`` on doubles (half away from
    zero on the shortest decimal form), for statistics finished on the driver."""
    if value is None:
        return None
    from decimal import ROUND_HALF_UP, Decimal
    import math
    if isinstance(value, float) and (math.isnan(value) or math.isinf(value)):
        return None
    q = Decimal(1).scaleb(-digits)
    return float(Decimal(repr(float(value))).quantize(q, rounding=ROUND_HALF_UP))


# Whole-stage codegen is skipped for aggregates with more buffer fields than
# spark.sql.codegen.maxFields (100 by default); wide statistic lists are
# therefore evaluated in chunks below that size.
MAX_AGG_FIELDS = 90


def aggregate_row(df, exprs: list[Column], max_fields: int = MAX_AGG_FIELDS) -> dict:
    """Evaluate many named aggregate expressions; one job per chunk of
    ``max_fields`` so every chunk keeps generated code.  Returns name -> value."""
    out: dict = {}
    for start in range(0, len(exprs), max_fields):
        row = df.agg(*exprs[start:start + max_fields]).first()
        out.update(row.asDict())
    return out


# The shape of a number the numeric parser accepts (decimal
# digits with optional sign, point and exponent) and the special words.
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_SHAPE = r"^[+-]?[0-9]{1,18}$"
NUMBER_WORDS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan")


def parse_number(v: Column) -> Column:
    """String -> double, NULL when the text is not a number.  A cheap shape
    test runs first, so ``try_cast`` never meets text it would reject (a
    rejected cast is an exception inside the task)."""
    plausible = v.rlike(NUMBER_SHAPE) | ((F.length(v) <= max(map(len, NUMBER_WORDS))) & F.lower(v).isin(*NUMBER_WORDS))
    return no_nan(F.when(plausible, v.try_cast("double")))


def parse_integer(v: Column) -> Column:
    """String -> bigint for whole numbers (also ``7.0`` or ``1e3``)."""
    return F.when(v.rlike(INTEGER_SHAPE), v.try_cast("bigint")).otherwise(
        parse_number(v).try_cast("bigint"))
