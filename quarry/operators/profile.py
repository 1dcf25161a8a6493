"""Column profiling (PRF-1..7).

Cost model: an exact profile reads its table once, whatever the width: its
value table (:mod:`quarry.operators.values`) is written, and null counts,
distinct counts, quartiles and IQR outliers are read off its slices.  The
approximate one takes a fixed number of sketch passes.  Only sums by slice
return to the driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import normalized_columns, semantic_hint
from quarry.functions.numeric import aggregate_row, round_half_up
from quarry.operators import types as ty
from quarry.operators.quantiles import column_quantiles
from quarry.operators.values import ValueTable, value_table
from quarry.session import reused

# Warning threshold and IQR rule of the profile.
MISSING_RATIO_WARN = 0.3
IQR_MIN_VALUES = 4
IQR_FACTOR = 1.5
IQR_PROBS = [0.25, 0.75]
# relative standard deviation of HLL distinct counts in approximate mode
APPROX_RSD = 0.01

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("spark_type", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_ratio", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("semantic_hint", T.StringType()),
])


@dataclass
class ColumnProfile:
    column: str
    type: str
    spark_type: str
    null_count: int
    null_ratio: float
    unique_count: int | None
    outlier_count: int | None
    semantic_hint: str | None


@dataclass
class TableProfile:
    rows: int
    columns: list[ColumnProfile]

    def by_name(self) -> dict[str, ColumnProfile]:
        return {c.column: c for c in self.columns}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(c).values()) for c in self.columns],
                                     PROFILE_SCHEMA)


def distinct_key(field: T.StructField) -> Column:
    """Value of a column as a typed key for distinct counting: whole numbers
    in a bigint slot, other numbers in a double slot (Spark folds -0.0 onto
    0.0 and unifies NaN when grouping), everything else as text.  No number
    is turned into a string."""
    c = F.col(field.name)
    dt = field.dataType
    none_l, none_d, none_s = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.struct(c.cast("bigint").alias("l"), none_d.alias("d"), none_s.alias("s"))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.struct(none_l.alias("l"), ty.no_nan(c).cast("double").alias("d"), none_s.alias("s"))
    return F.struct(none_l.alias("l"), none_d.alias("d"), c.cast("string").alias("s"))


def _key_present(key: str = "v") -> Column:
    return F.col(f"{key}.l").isNotNull() | F.col(f"{key}.d").isNotNull() | F.col(f"{key}.s").isNotNull()


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and per-column null count in one aggregate."""
    fields = df.schema.fields
    row = aggregate_row(df, [F.count(F.lit(1)).alias("rows")] + [
        F.count(ty.no_nan(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType))
                else F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = row["rows"]
    return rows, {f.name: rows - row[f"c{i}"] for i, f in enumerate(fields)}


def distinct_counts(df: DataFrame, cols: list[str] | None = None,
                    approx: bool = False) -> dict[str, int]:
    """Exact (or HLL-approximate) distinct non-null count per column."""
    fields = [f for f in df.schema.fields
              if (cols is None or f.name in cols) and ty.type_of_field(f) != ty.NESTED]
    if not fields:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.col(f.name), rsd=APPROX_RSD).alias(f"u{i}")
                       for i, f in enumerate(fields)]).first()
        return {f.name: row[f"u{i}"] for i, f in enumerate(fields)}
    pairs = (df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), distinct_key(f).alias("v")) for i, f in enumerate(fields)
    ])).alias("p")).where(_key_present("p.v"))
        .select(F.col("p.k").alias("k"), F.col("p.v.l").alias("l"), F.col("p.v.d").alias("d"),
                F.col("p.v.s").alias("s")))
    rows = (pairs.distinct()                        # partial dedup before the shuffle
            .groupBy("k").agg(F.count(F.lit(1)).alias("u")).collect())
    found = {r["k"]: r["u"] for r in rows}
    return {f.name: found.get(i, 0) for i, f in enumerate(fields)}


def iqr_outliers(df: DataFrame, cols: list[str], method: str = "exact",
                 with_bounds: bool = False, persist="auto") -> dict:
    """Per numeric column: values strictly outside [q1 - 1.5 iqr, q3 + 1.5 iqr].
    Fewer than 4 values or an IQR of 0 give 0 outliers.  The exact method reads
    ``df`` once, into a value table; the approximate one takes a sketch pass and
    a counting pass."""
    if not cols:
        return {}
    if method == "exact":
        table = value_table(df.select(*[F.col(f"`{c}`") for c in cols]))
        quartiles = table.quantiles(cols, IQR_PROBS)
        bounds = {c: _bounds(table.non_null(c), *quartiles[c]) for c in cols}
        outliers = table.outside({c: b for c, b in bounds.items() if b is not None})
    elif method == "approx":
        with reused(df.select(*cols), persist) as kept:
            counts: dict = {}
            quartiles = column_quantiles(kept, cols, IQR_PROBS, method=method, counts=counts)
            bounds = {c: _bounds(counts[c], *quartiles[c]) for c in cols}
            outliers = _count_outside(kept, {c: b for c, b in bounds.items() if b is not None})
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    if not with_bounds:
        return {c: outliers.get(c, 0) for c in cols}
    return {c: {"q1": quartiles[c][0], "q3": quartiles[c][1], "bounds": bounds[c], "outliers": outliers.get(c, 0)}
            for c in cols}


def _bounds(n: int, q1: float | None, q3: float | None) -> tuple[float, float] | None:
    if n < IQR_MIN_VALUES or q1 is None or q3 - q1 == 0:
        return None
    return q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)


def table_outliers(table: ValueTable, cols: list[str], quartiles: dict[str, tuple[float | None, float | None]]) -> dict[str, int]:
    """IQR outliers of each column from a value table and quartiles already known."""
    bounds = {c: _bounds(table.non_null(c), *quartiles[c]) for c in cols}
    return dict.fromkeys(cols, 0) | table.outside({c: b for c, b in bounds.items() if b is not None})


def _count_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    value = {c: ty.no_nan(F.col(c).cast("double")) for c in bounds}  # NaN is above any bound in Spark
    row = aggregate_row(df, [F.count(F.when((value[c] < F.lit(lo)) | (value[c] > F.lit(hi)), 1)).alias(f"o{i}")
                             for i, (c, (lo, hi)) in enumerate(bounds.items())])
    return {c: row[f"o{i}"] for i, c in enumerate(bounds)}


def profile(df: DataFrame, approx: bool = False, persist="auto") -> TableProfile:
    """Profile every column of ``df`` (already typed, e.g. by ``coerce``).

    The exact profile reads ``df`` once.  ``approx=True`` swaps exact distinct
    counts and quantiles for HLL and quantile sketches: one pass each, fixed
    memory, for very large tables; ``persist=True`` keeps a derived ``df`` (e.g.
    a join) for these passes, the default only when it is small (see
    ``session.reused``).
    """
    numeric = [f.name for f in df.schema.fields if ty.type_of_field(f) == ty.NUMERIC]
    if not approx:
        table = value_table(df)
        quartiles = table.quantiles(numeric, IQR_PROBS)
        nulls = {c: table.rows - table.non_null(c) for c in df.columns}
        distinct = {f.name: table.distinct(f.name) for f in df.schema.fields if ty.type_of_field(f) != ty.NESTED}
        return _described(df, table.rows, nulls, distinct, table_outliers(table, numeric, quartiles))
    with reused(df, persist) as kept:
        rows, nulls = null_counts(kept)
        return _described(kept, rows, nulls, distinct_counts(kept, approx=True), iqr_outliers(kept, numeric, method="approx"))


def _described(df: DataFrame, rows: int, nulls: dict, distinct: dict, outliers: dict) -> TableProfile:
    kinds = {}
    for f in df.schema.fields:
        kind = ty.type_of_field(f)
        if kind is None:  # plain string column
            kind = ty.string_kind(distinct.get(f.name, 0), rows - nulls[f.name])
        kinds[f.name] = kind
    cols = [ColumnProfile(
        column=f.name, type=kinds[f.name], spark_type=f.dataType.simpleString(),
        null_count=nulls[f.name], null_ratio=round_half_up(nulls[f.name] / max(rows, 1), 4),
        unique_count=distinct.get(f.name), outlier_count=outliers.get(f.name),
        semantic_hint=semantic_hint(f.name)) for f in df.schema.fields]
    return TableProfile(rows=rows, columns=cols)


def profile_new_columns(df: DataFrame, previous: TableProfile, approx: bool = False) -> TableProfile:
    """Profile only the columns not in ``previous`` (e.g. after formula
    measures were added) and append them; earlier entries are kept."""
    known = {c.column for c in previous.columns}
    new = [c for c in df.columns if c not in known]
    if not new:
        return previous
    extra = profile(df.select(*new), approx=approx)
    return TableProfile(rows=previous.rows, columns=previous.columns + extra.columns)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename columns by the normalisation rule; clashes get _2, _3, ..."""
    return df.toDF(*normalized_columns(df.columns))


def prepare(df: DataFrame, approx: bool = False) -> DataFrame:
    """Clean names, infer and coerce types: the table every later step uses."""
    clean = normalize_columns(df)
    typed, _ = ty.infer_and_coerce(clean, approx=approx)
    return typed


def profile_table(df: DataFrame, approx: bool = False) -> tuple[DataFrame, TableProfile]:
    clean = prepare(df, approx=approx)
    return clean, profile(clean, approx=approx)


def missing_warnings(df: DataFrame, threshold: float = MISSING_RATIO_WARN) -> DataFrame:
    """Columns whose null ratio exceeds ``threshold`` (column, null_ratio)."""
    rows, nulls = null_counts(df)
    spark = df.sparkSession
    data = [(c, round_half_up(n / max(rows, 1), 4)) for c, n in nulls.items()
            if n / max(rows, 1) > threshold]
    return spark.createDataFrame(data, "column string, null_ratio double")


def combined_profile(tables: dict[str, DataFrame], model: DataFrame | None = None) -> DataFrame:
    """Manifest over a set of tables: per table rows and columns, the total
    over all tables and, when given, the analysis (star-joined) table."""
    spark = next(iter(tables.values())).sparkSession
    parts = [t.agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(name).alias("entry"), "rows", F.lit(len(t.columns)).alias("columns"))
             for name, t in tables.items()]
    if model is not None:
        parts.append(model.agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit("analysis").alias("entry"), "rows",
                             F.lit(len(model.columns)).alias("columns")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    per = union.collect()
    data = [(r["entry"], r["rows"], r["columns"]) for r in per]
    data.append(("all_tables", sum(r[1] for r in data if r[0] != "analysis"),
                 sum(r[2] for r in data if r[0] != "analysis")))
    data.append(("dataset_count", len(tables), None))
    return spark.createDataFrame(data, "entry string, rows long, columns int")
