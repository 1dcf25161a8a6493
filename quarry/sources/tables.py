"""Table sources (SRC-1..3): Parquet/CSV scans into named DataFrames.

Splitting files into tasks is Spark's job; nothing here reads data on the
driver.  CSV files are read with an all-string schema and typed afterwards
by :mod:`quarry.operators.types` (one inference pass), never with Spark's
``inferSchema`` (an extra full scan with different rules).
"""

from __future__ import annotations

import csv
import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import dataset_name
from quarry.operators.selection import first_rows

SUPPORTED = (".csv", ".parquet", ".json")
# Tokens read as missing in CSV input, and the scan defaults.
NA_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "#N/A", "-NaN",
             "-nan", "<NA>", "#NA", "#N/A N/A", "-1.#IND", "1.#IND", "-1.#QNAN", "1.#QNAN")
DEFAULT_CHUNK_SIZE = 100_000
DEFAULT_SAMPLE_ROWS = 50_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _extension(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    return os.path.splitext(base)[1].lower()


def header_names(line: str) -> list[str]:
    """Column names of a CSV header line, as read: an empty one is ``Unnamed: i``,
    a repeated one gets ``_1``, ``_2``, ..., one that differs from an earlier one
    in case only ``_2``, ``_3``, ...  (Spark holds no two such names)."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(next(csv.reader([line.removeprefix("\ufeff")]), [])):
        raw = cell if cell.strip() else f"Unnamed: {i}"
        name, k = raw, 1 if raw in names else 2
        while name.lower() in taken:
            name, k = f"{raw}_{k}", k + 1
        taken.add(name.lower())
        names.append(name)
    return names


def _file_headers(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """(file, line): the header line of every file under ``path`` (files without a line have none)."""
    if multi_line:  # a header may span lines: the whole of each file is one text
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        return whole.select("file", F.regexp_extract("value", r'(?s)^((?:[^"\r\n]|"[^"]*")*)', 1).alias("line")).where("line <> ''")
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    # a task reads the block at 0 from its first line on: the least number is the header's
    return (lines.where("file_block_start = 0 AND value <> ''").groupBy(F.col("file_path").alias("file"))
            .agg(F.min_by("value", "at").alias("line")))


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with header, every column a string; NA tokens become NULL.

    Each file of a folder is read by its own header: files may hold the columns
    in any order, and a column that a file lacks is NULL in its rows.  A doubled
    quote inside quotes is a quote.  ``multi_line`` allows line ends inside
    quotes; such a file cannot be split, so it is off unless asked for.
    """
    headers = _file_headers(spark, path, multi_line)
    lines = sorted(r["line"] for r in headers.select("line").distinct().collect())
    if not lines:
        return spark.createDataFrame([], T.StructType([]))
    if len(lines) == 1:
        return _read_csv(spark, [path], header_names(lines[0]), multi_line)
    # parts whose headers differ: one read for each different header
    files: dict[str, list[str]] = {}
    for r in headers.collect():
        files.setdefault(r["line"], []).append(unquote(r["file"]))
    parts = [_read_csv(spark, sorted(files[line]), header_names(line), multi_line) for line in sorted(files, key=lambda line: min(files[line]))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_csv(spark: SparkSession, paths: list[str], header: list[str], multi_line: bool) -> DataFrame:
    """CSV files of one header, read by position."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    df = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
          .option("mode", "PERMISSIVE").schema(schema).csv(paths))
    return df.select(*[F.when(F.trim(F.col(f"c{i}")).isin(*NA_TOKENS), F.lit(None))
                       .otherwise(F.col(f"c{i}")).alias(c) for i, c in enumerate(header)])


def read_dataset(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One file (or folder of part files) by extension, in any store that Spark
    reads.  An unknown extension is a ValueError; a missing path is Spark's own error."""
    ext = _extension(path)
    if ext not in SUPPORTED:
        raise ValueError(f"no reader for {ext or 'a name without extension'}: {path} (readers: {' '.join(SUPPORTED)})")
    if ext == ".csv":
        return read_csv_strings(spark, path, multi_line)
    if ext == ".json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def read_tables(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Named set of tables; the name is the normalised file stem.  A second
    file with the same name gets ``_2`` (nothing is silently replaced)."""
    out: dict[str, DataFrame] = {}
    for path in paths:
        name = base = dataset_name(path)
        k = 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out[name] = read_dataset(spark, path)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every table, as one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_stats(df: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE,
               sample_rows: int = DEFAULT_SAMPLE_ROWS) -> DataFrame:
    """total_rows, sample_rows (= min(total, sample_rows)), chunks
    (= ceil(total / chunk_size)): the scan statistics of a chunked read."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.least(F.col("total_rows"), F.lit(sample_rows)).cast("bigint").alias("sample_rows"),
        F.ceil(F.col("total_rows") / F.lit(chunk_size)).cast("bigint").alias("chunks"))


def head_sample(df: DataFrame, order_by: list[str], rows: int = DEFAULT_SAMPLE_ROWS) -> DataFrame:
    """A deterministic sample: the first ``rows`` rows by ``order_by``, found
    by counting (see :func:`quarry.operators.selection.first_rows`)."""
    return first_rows(df, order_by, rows)
