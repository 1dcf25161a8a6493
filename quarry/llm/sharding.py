"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The files of the written input are the partitions.  How many rows of each go to
each cell (a slice of a shard) in a uniform shuffle is multivariate
hypergeometric, given the partitions' counts and the cells' sizes; that matrix
is drawn exactly.  Then partitions permute their rows, send them to the cells by
the matrix, and cells permute what they got.  No row's place depends on a draw
for that row alone, so shard sizes are exact, and the rows move once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, unwrapped, wrapped

#: rows meant for a cell, and the bounds of the numbers of cells and of partitions (files beyond that share one): the matrix has at most 2048 x 2048 counts
TARGET_ROWS = 100_000
LEAST_CELLS, MOST_CELLS, MOST_BLOCKS = 256, 2048, 2048


def communication_matrix(block_counts: np.ndarray, cell_sizes: np.ndarray, seed: int) -> np.ndarray:
    """Exact draw: entry (b, c) is how many rows of block b go to cell c.  Row sums are the block counts, column sums the cell sizes."""
    rng, left = np.random.default_rng(seed), cell_sizes.copy()
    out = np.zeros((len(block_counts), len(left)), dtype=np.int64)
    for b, n in enumerate(block_counts):
        out[b] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[b]
    return out


def even_split(n: int, parts: int) -> np.ndarray:
    """``parts`` sizes, at most one apart, that sum to n."""
    return np.array([n * (i + 1) // parts - n * i // parts for i in range(parts)], dtype=np.int64)


def shard(rows: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Every row comes out once; shard sizes are at most one apart (some are empty
    if there are fewer rows than shards); every assignment is equally likely
    over seeds.  The rows are written to shared storage first: a row's file and its
    index there, which no lost task changes, stand for it in all draws.  So
    nulls, ties and repeated rows need no care, and no key is hot.
    Columns named ``shard`` or ``slot`` are replaced; the others stay.  An empty
    table gives an empty result.
    """
    rows = stored(wrapped(rows), "shard").select("row", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    files = sorted(rows.groupBy("file").count().collect())
    n = sum(r["count"] for r in files)
    blocks = max(1, min(MOST_BLOCKS, len(files)))
    counts, home = np.zeros(blocks, dtype=np.int64), {}
    for i, r in enumerate(files):
        home[r["file"]] = (i % blocks, int(counts[i % blocks]))
        counts[i % blocks] += r["count"]

    sizes = even_split(n, shards)[np.random.default_rng(seed).permutation(shards)]
    slices = max(1, min(MOST_CELLS, max(LEAST_CELLS, ceil(n / TARGET_ROWS))) // shards)
    cells = np.concatenate([even_split(int(s), slices) for s in sizes])
    ends = np.cumsum(communication_matrix(counts, cells, seed), axis=1)
    starts = np.concatenate([np.cumsum(c) - c for c in cells.reshape(shards, slices)])

    @F.pandas_udf("int")
    def cell_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        block, order = -1, np.zeros(0, dtype=np.int64)
        for files_, indexes in batches:
            f, at = files_.to_numpy(), indexes.to_numpy()
            out = np.empty(len(f), dtype=np.int32)
            for one in np.unique(f):
                mine, first = home[one]
                if mine != block:
                    block, order = mine, np.random.default_rng([seed, mine]).permutation(counts[mine])
                here = f == one
                out[here] = np.searchsorted(ends[mine], order[first + at[here]], side="right")
            yield pd.Series(out)

    @F.pandas_udf("long")
    def first_slot(cell: pd.Series) -> pd.Series:
        return pd.Series(starts[cell.to_numpy()])

    dealt = rows.withColumn("cell", cell_of("file", "index"))
    again = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(f"again-{seed}"), "file", "index"), "file", "index")) - 1
    placed = dealt.withColumn("at", again.cast("long"))
    return unwrapped(placed.select("row", (F.col("cell") / slices).cast("int").alias("shard"), (first_slot("cell") + F.col("at")).alias("slot")), "shard", "slot")
