"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: a key with at least a HOT-th of all rows is joined by a broadcast, the others by a shuffle
HOT = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage on storage that all executors share, so work before
    it is never repeated, and later passes read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, key: str, table: DataFrame, table_key: str, size: str) -> DataFrame:
    """``rows`` joined to the one row of ``table`` with their ``key`` (others drop out).

    ``size`` counts the rows that each row of ``table`` meets.  At most ``HOT``
    of them can each meet a ``HOT``-th of all rows: these are broadcast, which
    is a proven bound, and the rest is joined by a shuffle with no hot key.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(size) * HOT >= total))
    common = rows.join(hot, F.col(key) == F.col(table_key))
    others = rows.join(hot.select(table_key), F.col(key) == F.col(table_key), "left_anti")
    return common.unionByName(others.join(table.where(F.col(size) * HOT < total), F.col(key) == F.col(table_key)))


def small_batches(spark: SparkSession, limit: str = "16m") -> None:
    """Let Arrow batches to Python hold 16 MB at most in this session (Spark's default is 64 MB): several workers of a task hold one each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wrapped(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that working columns beside it cannot clash with its names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unwrapped(df: DataFrame, *added: str) -> DataFrame:
    """The columns of ``row``, but for those that ``added`` columns replace (in any case), then these."""
    names = {a.lower() for a in added}
    kept = [F.col("row")[c].alias(c) for c in df.schema["row"].dataType.names if c.lower() not in names]
    return df.select(*kept, *[F.col(a) for a in added])


def uniform(seed: int, *cols: Column) -> Column:
    """A double in [0, 1) with 52 bits, a hash of the seed and the columns' text (null: empty)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def bounded_sample(df: DataFrame, key: Column, bound: int, seed: int = 42) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of ``key`` (all rows, if there are no more)."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(uniform(seed, key) < F.lit(bound / n))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
