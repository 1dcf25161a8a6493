"""Sinks (SNK-1, SNK-2): clean analysis table and summaries to files.

Writes are distributed (one file per task); paths should be on shared
storage.  Timestamps are written as ``yyyy-MM-ddTHH:mm:ss`` text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import is_datetime_type

ISO_T = "yyyy-MM-dd'T'HH:mm:ss"


def iso_timestamps(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(F.col(f.name), ISO_T).alias(f.name)
                       if is_datetime_type(f.dataType) else F.col(f.name)
                       for f in df.schema.fields])


def export_clean(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write the analysis table with ISO timestamp text; returns the path."""
    writer = iso_timestamps(df).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def export_summary(df: DataFrame, path: str) -> str:
    """Write a summary/profile frame as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path
