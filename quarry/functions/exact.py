"""Sums of doubles that do not depend on the order in which they are added.

Spark adds partial sums in the order in which tasks end, and floating-point
addition is not associative, so the last digits of a plain ``sum`` of a double
change from run to run and with the partitioning.  Here every value is cut
into whole numbers of 22 bits each (its parts at 2^44, 2^22, 1, 2^-22 and
2^-44); sums of these are exact ``bigint`` sums, map-side as well, and the total
is put together from them at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.numeric import no_nan

#: bits of a part, and the scale of the highest and the lowest one
PART_BITS = 22
SCALES = (44, 22, 0, -22, -44)
#: values up to this size have all their parts; larger ones are added as doubles
LIMIT = 2.0**65


def _parts(v: Column) -> list[Column]:
    """Whole numbers whose sum, each times its scale, is ``v`` (to within 2^-45, the same for equal values)."""
    rounded = [F.rint(v * F.lit(2.0**-s)) for s in SCALES]
    low = [r - F.lit(2.0**PART_BITS) * above for above, r in zip(rounded, rounded[1:])]
    return [p.cast("bigint") for p in (rounded[0], *low)]


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of a double column, the same for every order of its rows; NULL where there is no value.

    NaN counts as NULL.  Values are taken to the nearest 2^-45, their sums are
    exact for up to 2^41 rows of a group (beyond, an overflow is an error, not a
    wrong number).  Values beyond 2^65 and infinities are added as doubles.
    """
    v = no_nan(value.cast("double"))
    small = F.abs(v) < F.lit(LIMIT)
    sums = [F.sum(p) for p in _parts(F.when(small, v))]
    whole = sum((s.cast("double") * F.lit(2.0**e) for s, e in zip(sums[1:3], SCALES[1:3])), sums[0].cast("double") * F.lit(2.0**SCALES[0]))
    rest = sums[3].cast("double") * F.lit(2.0**SCALES[3]) + sums[4].cast("double") * F.lit(2.0**SCALES[4])
    large = F.sum(F.when(~small, v))
    return F.when(large.isNull(), whole + rest).otherwise(large + F.coalesce(whole + rest, F.lit(0.0)))


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean from :func:`exact_sum`; NULL where there is no value."""
    return F.try_divide(exact_sum(value), F.count(no_nan(value.cast("double"))))
