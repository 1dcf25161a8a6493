"""Semantic type inference (PRJ-2) and coercion (PRJ-3).

Inference is at most two aggregate passes over all columns together (see
``infer_types``); the decision is taken on the driver from one row of
counts per column.  Coercion is then a projection with shape-checked
``try_cast`` / ``try_to_timestamp``.
The chosen semantic type travels in ``StructField.metadata``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import (NESTED_TYPES, is_datetime_type,
                                      is_numeric_type, no_nan, parse_integer, parse_number)
from quarry.session import reused

NUMERIC, DATETIME, BOOLEAN, CATEGORICAL, TEXT, NESTED = (
    "numeric", "datetime", "boolean", "categorical", "text", "nested")

# The inference thresholds.
PARSE_SHARE = 0.9          # share of non-nulls that must parse
CATEGORICAL_MIN_LEVELS = 20
CATEGORICAL_SHARE = 0.1
# relative standard deviation of HLL distinct counts, and how many of them an estimate is trusted to
APPROX_RSD = 0.01
SURE = 5

# Timestamp patterns tried besides ISO-8601 (which ``try_cast`` covers).
DATE_PATTERNS = ("MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
                 "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy",
                 "dd-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd'T'HHmmss",
                 "dd/MM/yyyy", "MMM d yyyy", "d MMM yyyy", "d MMMM yyyy")
ISO = "iso"
# Shape of the text each pattern can parse; the parser runs only on matches.
DATE_SHAPES = {
    ISO: r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$",
    "MM/dd/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "MM/dd/yyyy HH:mm:ss": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "MM/dd/yyyy HH:mm": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "yyyy/MM/dd": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    "yyyy/MM/dd HH:mm:ss": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "dd.MM.yyyy": r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$",
    "dd-MMM-yyyy": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$",
    "dd/MM/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "MMM d yyyy": r"^[A-Za-z]{3} [0-9]{1,2} [0-9]{4}$",
    "d MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$",
    "d MMMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}$",
    "yyyyMMdd'T'HHmmss": r"^[0-9]{8}T[0-9]{6}$",
}

META_KEY = "semantic_type"


@dataclass(frozen=True)
class ColumnType:
    column: str
    semantic_type: str
    storage: str = "string"      # spark type to coerce to
    date_pattern: str | None = None


def blank_to_null(c: str) -> Column:
    """The trimmed text of a column, NULL where nothing is left (PRJ-5)."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def _parse_ts(value: Column, pattern: str) -> Column:
    parsed = (value.try_cast("timestamp") if pattern == ISO
              else F.try_to_timestamp(value, F.lit(pattern)))
    shape = DATE_SHAPES.get(pattern)
    return F.when(value.rlike(shape), parsed) if shape else parsed


def categorical_limit(non_null: int) -> float:
    return max(CATEGORICAL_MIN_LEVELS, non_null * CATEGORICAL_SHARE)


def string_kind(distinct: int, non_null: int) -> str:
    if non_null == 0:
        return TEXT
    return CATEGORICAL if distinct <= categorical_limit(non_null) else TEXT


def type_of_field(field: T.StructField) -> str | None:
    """Semantic type fixed by Spark's own type (None for strings)."""
    meta = field.metadata.get(META_KEY) if field.metadata else None
    if meta:
        return meta
    dt = field.dataType
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if is_numeric_type(dt):
        return NUMERIC
    if is_datetime_type(dt):
        return DATETIME
    if isinstance(dt, NESTED_TYPES):
        return NESTED
    return None


def infer_types(df: DataFrame, patterns: tuple[str, ...] = DATE_PATTERNS,
                approx: bool = False) -> list[ColumnType]:
    """Infer one semantic type per column.

    Rule order, first match wins: boolean, numeric (>= 90% of non-null values
    parse as numbers), datetime (>= 90% parse under one pattern; the pattern
    with most hits is kept), categorical (distinct <= max(20, 10% of
    non-nulls)), text.  Blank strings count as null.  An all-null column is
    text.

    Pass 1 counts the cells of every string column by what they parse as
    (number, whole number, boolean, timestamp under each pattern), grouped by
    column.  Pass 2 runs only for the columns still undecided: distinct counts by
    sketches, made exact where a sketch cannot settle the categorical rule
    (with ``approx`` nowhere).
    """
    with reused(df, "auto") as kept:
        return _infer_types(kept, tuple(patterns), approx)


def _infer_types(df: DataFrame, patterns: tuple[str, ...], approx: bool) -> list[ColumnType]:
    fields = df.schema.fields
    decided: dict[str, ColumnType] = {}
    strings = []
    for field in fields:
        known = type_of_field(field)
        if known is not None:
            decided[field.name] = ColumnType(field.name, known, field.dataType.simpleString())
        else:
            strings.append(field.name)
    first = _cell_counts(df, strings, patterns) if strings else {}

    undecided = []
    for c in strings:
        n = first[c]["n"]
        if n == 0:
            decided[c] = ColumnType(c, TEXT)
        elif first[c]["b"] == n:
            decided[c] = ColumnType(c, BOOLEAN, "boolean")
        elif first[c]["d"] >= PARSE_SHARE * n:
            decided[c] = ColumnType(c, NUMERIC, "bigint" if first[c]["f"] == 0 else "double")
        else:
            undecided.append(c)

    if undecided:
        distinct = _string_distinct(df, undecided, approx, {c: first[c]["n"] for c in undecided})
        for c in undecided:
            n = first[c]["n"]
            best, _, pattern = max((first[c][f"t{k}"], -k, p) for k, p in enumerate((ISO, *patterns)))
            if best >= PARSE_SHARE * n:
                decided[c] = ColumnType(c, DATETIME, "timestamp", pattern)
            else:
                decided[c] = ColumnType(c, string_kind(distinct[c], n))
    return [decided[f.name] for f in fields]


def _cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(k, v): the number of its column and the trimmed text of every cell that is not blank."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("k"), blank_to_null(c).alias("v")) for i, c in enumerate(cols)
    ]))).where(F.col("v").isNotNull())


def _cell_counts(df: DataFrame, cols: list[str], patterns: tuple[str, ...]) -> dict[str, dict[str, int]]:
    """Per column the cells (n) that parse as numbers (d), as numbers that are no bigint (f), as booleans (b), and under ISO and each pattern (t0, t1, ...).

    One scan; a text's number is parsed once, and the date shapes are tried on
    such texts only as can have one: no number has any, an ISO date has its dash
    at the fifth place, where no other shape has one, and all others have a year of four digits.
    """
    v, d = F.col("v"), F.col("d")
    dash = F.substring(v, 5, 1) == "-"
    tried = dict.fromkeys(DATE_SHAPES, "other") | {ISO: "iso"}
    cells = (_cells(df, cols).withColumn("d", parse_number(v))
             .withColumn("iso", F.when(d.isNull() & dash, v))
             .withColumn("other", F.when(d.isNull() & ~dash & v.rlike("[0-9]{4}"), v)))
    rows = cells.groupBy("k").agg(
        F.count(v).alias("n"), F.count(d).alias("d"),
        # bigint storage only when every parsed number is whole and in range
        F.count(F.when(d.isNotNull() & ((F.floor(d) != d) | (F.abs(d) >= 9.2e18)), 1)).alias("f"),
        F.count(F.when(F.length(v).between(4, 5) & F.lower(v).isin("true", "false"), 1)).alias("b"),
        F.count(_parse_ts(F.col("iso"), ISO)).alias("t0"),
        *[F.count(_parse_ts(F.col(tried.get(p, "v")), p)).alias(f"t{i + 1}") for i, p in enumerate(patterns)]).collect()
    none = dict.fromkeys(("n", "d", "f", "b", *[f"t{i}" for i in range(len(patterns) + 1)]), 0)
    return dict.fromkeys(cols, none) | {cols[r["k"]]: r.asDict() for r in rows}


def _string_distinct(df: DataFrame, cols: list[str], approx: bool, non_null: dict[str, int] | None = None) -> dict[str, int]:
    """Distinct non-blank values per column, as exact as the categorical rule needs.

    One scan of sketches; only columns whose estimate is within its error of
    the rule's limit are counted exactly, in one grouped job (the partial
    aggregate dedups before the shuffle).  An id-like column is never shuffled.
    """
    estimate = {r["k"]: r["u"] for r in _cells(df, cols).groupBy("k").agg(F.approx_count_distinct("v", rsd=APPROX_RSD).alias("u")).collect()}
    found = {c: estimate.get(i, 0) for i, c in enumerate(cols)}
    close = [] if approx else [c for c in cols if abs(found[c] - categorical_limit((non_null or {}).get(c, 0))) <= SURE * APPROX_RSD * found[c] + 1]
    if close:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("k"), blank_to_null(c).alias("v")) for i, c in enumerate(close)
        ])).alias("p")).select("p.k", "p.v").where(F.col("v").isNotNull())
        exact = {r["k"]: r["u"] for r in pairs.distinct().groupBy("k")
                 .agg(F.count(F.lit(1)).alias("u")).collect()}
        found |= {c: exact.get(i, 0) for i, c in enumerate(close)}
    return found


def _coerced(name: str, ctype: ColumnType) -> Column:
    v = blank_to_null(name)
    if ctype.semantic_type == NUMERIC:
        if ctype.storage == "bigint":
            return parse_integer(v)
        return parse_number(v)
    if ctype.semantic_type == DATETIME:
        return _parse_ts(v, ctype.date_pattern or ISO)
    if ctype.semantic_type == BOOLEAN:
        return F.lower(v).try_cast("boolean")
    return F.col(name).cast("string")


def coerce(df: DataFrame, types: list[ColumnType]) -> DataFrame:
    """Cast every column to its inferred type; unparseable values become NULL.
    Columns that already have a Spark type are kept (floats get NaN -> NULL).
    The semantic type is attached as column metadata."""
    by_name = {t.column: t for t in types}
    cols = []
    for field in df.schema.fields:
        ctype = by_name[field.name]
        if isinstance(field.dataType, T.StringType) and ctype.semantic_type != NESTED:
            expr = _coerced(field.name, ctype)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            expr = no_nan(field.name).cast(field.dataType)
        else:
            expr = F.col(field.name)
        cols.append(expr.alias(field.name, metadata={META_KEY: ctype.semantic_type}))
    return df.select(*cols)


def infer_and_coerce(df: DataFrame, approx: bool = False) -> tuple[DataFrame, list[ColumnType]]:
    types = infer_types(df, approx=approx)
    return coerce(df, types), types


def types_frame(spark, types: list[ColumnType]) -> DataFrame:
    return spark.createDataFrame([(t.column, t.semantic_type) for t in types],
                                 "column string, type string")
