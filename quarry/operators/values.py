"""One value table for a frame: every column's different values with their counts.

The frame is read once.  A task counts the values of each column as it reads
them, so a value that most rows share is one row for each task.  The counts are
then put in order of column and value by range partitions, where equal values
meet, and written once, each row with the number of its slice.  Sums by (column, slice)
answer null and distinct counts at once and name the few slices that hold a
wanted rank or an outlier bound; only these are read again.  No step meets a
whole column, and the driver holds one row for each slice and column.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import INTEGRAL_TYPES, NESTED_TYPES, is_numeric_type, no_nan
from quarry.session import stored

#: the column number under which rows are counted
ROWS = -1
#: bytes of counts that a task holds, shared out over the columns, before it adds them up or sends them on; the least share
HELD_BYTES = 16 << 20
LEAST_HELD = 1 << 18
#: counts of batches that a task holds for a column at most
HELD_BATCHES = 64
#: counted rows of a slice: at most about, wished for, and those from which on it is worth a task of its own
MOST_ROWS = 2_000_000
SLICE_ROWS = 400_000
FEW_ROWS = 50_000
#: ranges up to which the sending side of a shuffle holds no rows in memory (Spark's default)
DIRECT_RANGES = 200


@dataclass
class Slice:
    """What one slice holds of one column: rows of the frame, different values, least and largest value (numbers only)."""

    number: int
    rows: int
    values: int
    lo: float | None
    hi: float | None


@dataclass
class ValueTable:
    """The written (column, value, count) rows of a frame and their sums by slice."""

    frame: DataFrame
    columns: dict[str, int]
    rows: int
    slices: dict[str, list[Slice]] = field(default_factory=dict)

    def non_null(self, column: str) -> int:
        """Rows with a value (NaN counts as null)."""
        return sum(s.rows for s in self.slices[column])

    def distinct(self, column: str) -> int:
        return sum(s.values for s in self.slices[column])

    def quantiles(self, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
        """Exact quantiles of numeric columns, interpolated between the order statistics k and k + 1 of p (n - 1) = k + frac."""
        at = {(c, p): p * (self.non_null(c) - 1) for c in columns for p in probs if self.non_null(c)}
        value: dict[tuple[str, int], float] = {}
        wanted = []
        for c, rank in {(c, min(math.floor(x) + step, self.non_null(c) - 1)) for (c, _), x in at.items() for step in (0, 1)}:
            before = 0
            for s in self.slices[c]:
                if rank < before + s.rows:
                    break
                before += s.rows
            if s.lo == s.hi:
                value[(c, rank)] = s.lo
            else:
                wanted.append((self.columns[c], s.number, before, rank))
        value.update(self._ranked(wanted))

        def interpolated(c: str, p: float) -> float | None:
            if (c, p) not in at:
                return None
            k = math.floor(at[(c, p)])
            frac, low = at[(c, p)] - k, value[(c, k)]
            return low + (value[(c, min(k + 1, self.non_null(c) - 1))] - low) * frac if frac else low

        return {c: [interpolated(c, p) for p in probs] for c in columns}

    def _ranked(self, wanted: list[tuple[int, int, int, int]]) -> dict[tuple[str, int], float]:
        """The values at (column, slice, rows before the slice, rank): the named slices are put in order, each by itself."""
        if not wanted:
            return {}
        targets = self.frame.sparkSession.createDataFrame(wanted, "tk int, ts int, before long, rank long")
        held = targets.groupBy("tk", "ts").agg(F.first("before").alias("before"), F.collect_list("rank").alias("ranks"))
        near = self._slices_of({s for _, s, _, _ in wanted}).join(F.broadcast(held), (F.col("k") == F.col("tk")) & (F.col("slice") == F.col("ts")))
        running = Window.partitionBy("k", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ended = near.withColumn("end", F.col("before") + F.sum("n").over(running)).select("k", "v", "n", "end", F.explode("ranks").alias("rank"))
        found = ended.where((F.col("end") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("end"))).collect()
        names = {i: c for c, i in self.columns.items()}
        return {(names[r["k"]], r["rank"]): r["v"] for r in found}

    def outside(self, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
        """How many rows lie strictly outside (low, high) of each numeric column; only slices that a bound cuts are read."""
        total, cut = dict.fromkeys(bounds, 0), []
        for c, (low, high) in bounds.items():
            for s in self.slices[c]:
                if s.hi < low or s.lo > high:
                    total[c] += s.rows
                elif s.lo < low or s.hi > high:
                    cut.append((self.columns[c], s.number, low, high))
        if cut:
            limits = self.frame.sparkSession.createDataFrame(cut, "tk int, ts int, low double, high double")
            near = self._slices_of({s for _, s, _, _ in cut}).join(F.broadcast(limits), (F.col("k") == F.col("tk")) & (F.col("slice") == F.col("ts")))
            names = {i: c for c, i in self.columns.items()}
            for r in near.where("v < low OR v > high").groupBy("k").agg(F.sum("n").alias("n")).collect():
                total[names[r["k"]]] += r["n"]
        return total

    def _slices_of(self, numbers: set[int]) -> DataFrame:
        """The rows of these slices: each is in files of its own, which Parquet's statistics tell apart."""
        return self.frame.where(F.col("slice").isin(sorted(numbers))).select("k", "slice", "v", "n")


def _slot(f: T.StructField) -> tuple[str, Column]:
    """The slot of a column's values and the value in it: whole numbers in l, other floats in d, all else as text in s.

    No number becomes a string, but for decimals; of nested values only their
    presence counts.
    """
    c, dt = F.col(f"`{f.name}`"), f.dataType
    if isinstance(dt, INTEGRAL_TYPES):
        return "l", c.cast("bigint")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "d", no_nan(c).cast("double") + F.lit(0.0)  # -0.0 is 0.0
    if isinstance(dt, NESTED_TYPES):
        return "l", F.when(c.isNotNull(), F.lit(1)).cast("bigint")
    return "s", c.cast("string")


def _counted(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(k, l, d, s, n): each task's different values of each column with their counts, and its rows under ROWS.

    A batch's values are counted column by column (Arrow's hash counts, no row is
    dealt to its cells); counts are added up until a column holds its share of
    HELD_BYTES, and sent on where adding does not shrink them.
    """
    columns = [_slot(f) for f in fields]
    slots = [slot for slot, _ in columns]
    kinds = {"l": pa.int64(), "d": pa.float64(), "s": pa.string()}
    share = max(HELD_BYTES // max(len(slots), 1), LEAST_HELD)

    def cells(k: int, slot: str, counts: pa.Table) -> pa.RecordBatch:
        n = counts.num_rows
        value = {x: counts.column("v").combine_chunks().cast(t) if x == slot else pa.nulls(n, t) for x, t in kinds.items()}
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int32()), *value.values(), counts.column("n").combine_chunks()], names=["k", *value, "n"])

    def added(waiting: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(waiting).group_by("v", use_threads=False).aggregate([("n", "sum")]).rename_columns(["v", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[pa.Table]] = [[] for _ in slots]
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for k, slot in enumerate(slots):
                counts = pc.value_counts(batch.column(k).drop_null())
                waiting[k].append(pa.table({"v": counts.field("values"), "n": counts.field("counts")}))
                if len(waiting[k]) > HELD_BATCHES or sum(t.nbytes for t in waiting[k]) > share:
                    merged = added(waiting[k])
                    waiting[k] = [merged]
                    if 2 * merged.nbytes > share:
                        yield cells(k, slot, merged)
                        waiting[k] = []
                    del merged
                    pa.default_memory_pool().release_unused()
        for k, slot in enumerate(slots):
            if waiting[k]:
                yield cells(k, slot, added(waiting[k]))
        yield cells(ROWS, "l", pa.table({"v": pa.array([1], pa.int64()), "n": pa.array([rows], pa.int64())}))

    values = df.select(*[value.alias(f"c{i}") for i, (_, value) in enumerate(columns)]) if columns else df.select(F.lit(1).alias("c0"))
    return values.mapInArrow(of, "k int, l long, d double, s string, n long")


def value_table(df: DataFrame, columns: list[str] | None = None) -> ValueTable:
    """The value table of ``columns`` (all, if not given) of ``df``, from one scan of it.

    Numeric columns are in order of their value as a double; of other columns
    only a hash keeps the order, so their slices are even as well.  An empty
    frame gives a table without values.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    numbers = {f.name: i for i, f in enumerate(fields)}
    # written, as the ranges' bounds need a pass of their own over it
    counted = stored(_counted(df, fields), "counted")
    decimals = [numbers[f.name] for f in fields if isinstance(f.dataType, T.DecimalType)]
    text_number = F.when(F.col("k").isin(decimals), F.col("s").try_cast("double")) if decimals else F.lit(None).cast("double")
    keyed = counted.select("k", F.coalesce("d", F.col("l").cast("double"), text_number).alias("v"), F.xxhash64("s").alias("h"), "l", "s", "n")
    # equal values are in one range: the counts of the tasks are added up where they are.  The number of ranges
    # follows the rows, so that a range stays small; a number that is given is not lowered at run time (few rows need none)
    rows = counted.count()
    ranges = max(math.ceil(rows / MOST_ROWS), min(math.ceil(rows / SLICE_ROWS), DIRECT_RANGES), min(math.ceil(rows / FEW_ROWS), df.sparkSession.sparkContext.defaultParallelism))
    placed = keyed.repartitionByRange(*([ranges] if rows > SLICE_ROWS else []), "k", "v", "h").groupBy("k", "v", "h", "l", "s").agg(F.sum("n").alias("n"))
    table = stored(placed.select("k", "v", "n", F.spark_partition_id().alias("slice")), "values")
    sums = table.groupBy("k", "slice").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    by_column: dict[int, list[Slice]] = defaultdict(list)
    for r in sorted(sums, key=lambda r: (r["k"], r["slice"])):
        by_column[r["k"]].append(Slice(r["slice"], r["n"], r["u"], r["lo"], r["hi"]))
    return ValueTable(table, numbers, sum(s.rows for s in by_column[ROWS]), {c: by_column[i] for c, i in numbers.items()})


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
