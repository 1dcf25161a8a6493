"""Each row beside the row that follows it in the order of an id, over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shuffle_partitions

#: bytes of text in one Arrow batch that leaves a task
OUT_BYTES = 4 << 20


def in_order(rows: DataFrame, id_col: str, ties: list[str]) -> DataFrame:
    """``rows`` dealt to ranges of a numeric ``id_col`` and sorted within them, with ``_ghost``.

    Each range ends in a copy of the first row of the next range that has rows
    (after the last: of the first), marked by ``_ghost``; so a pass over a
    partition sees every row's successor.  Ranges are cut at quantiles of the
    id: the driver keeps one bound for each shuffle partition.  Rows with a
    null id come first; rows with equal ids follow ``ties``.
    """
    parts = shuffle_partitions(rows.sparkSession)
    cuts = rows.select(F.col(f"`{id_col}`").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    bounds = np.unique(np.floor(cuts).astype(np.int64)) if cuts else np.zeros(0, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype(np.int32))

    key = F.col(f"`{id_col}`")
    dealt = rows.withColumn("_range", F.when(key.isNull(), 0).otherwise(range_of(F.coalesce(key, F.lit(0)).cast("long"))))
    first = {r[0]: (r[1], r[2]) for r in dealt.groupBy("_range").agg(F.min(key).alias("low"), F.max(key.isNull().cast("int")).alias("null")).collect()}
    ranges = sorted(first)
    copy_to = F.lit(None).cast("int")
    for before, after in zip([ranges[-1], *ranges[:-1]] if ranges else [], ranges):
        low, null = first[after]
        leads = key.isNull() if null else key == F.lit(low)
        copy_to = F.when((F.col("_range") == after) & leads, before).otherwise(copy_to)
    if len(ranges) > 64:  # a lookup instead of a long chain of conditions
        table = pd.Series({after: (before, *first[after]) for before, after in zip([ranges[-1], *ranges[:-1]], ranges)})

        @F.pandas_udf("int")
        def ghost_of(range_: pd.Series, ids: pd.Series) -> pd.Series:
            before = range_.map(lambda r: table[r][0])
            lead = [pd.isna(i) if table[r][2] else (not pd.isna(i) and int(i) == table[r][1]) for r, i in zip(range_, ids)]
            return before.where(pd.Series(lead, index=range_.index), -1)

        copy_to = F.nullif(ghost_of("_range", key.cast("string")), F.lit(-1))
    homes = F.array(F.struct(F.col("_range").alias("home"), F.lit(False).alias("ghost")), F.struct(copy_to.alias("home"), F.lit(True).alias("ghost")))
    homes = F.explode(F.filter(homes, lambda h: h["home"].isNotNull()))
    return (dealt.withColumn("_home", homes).withColumn("_range", F.col("_home.home")).withColumn("_ghost", F.col("_home.ghost")).drop("_home")
            .repartitionById(parts, F.col("_range")).sortWithinPartitions("_range", "_ghost", key.asc_nulls_first(), *[F.col(f"`{t}`").asc_nulls_first() for t in ties]))


def beside_next(ordered: DataFrame, schema: str, row_of: Callable[[tuple, tuple | None], tuple], size_of: Callable[[tuple], int]) -> DataFrame:
    """Map each row of :func:`in_order` and the row after it (of a ghost: None) to a row of ``schema``.

    ``row_of`` gets the columns before ``_range``; the first two columns of the result are ``_range`` and ``_ghost``.
    ``size_of`` tells a row's size, to keep batches small.
    """
    names = [c for c in ordered.columns if c not in ("_range", "_ghost")]
    out_schema = ordered.sparkSession.createDataFrame([], f"_range int, _ghost boolean, {schema}").schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, out, size = to_arrow_schema(out_schema), None, [], 0
        for batch in batches:
            for row in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ["_range", "_ghost", *names]]):
                row = tuple(x.as_py() for x in row)
                if held is not None:
                    made = (*held[:2], *row_of(held[2:], row[2:] if row[0] == held[0] and not held[1] else None))
                    out.append(made)
                    size += size_of(made)
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out, size = [], 0
                held = row
        if held is not None:
            out.append((*held[:2], *row_of(held[2:], None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return ordered.mapInArrow(of, out_schema)
