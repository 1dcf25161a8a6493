"""Packing documents into training sequences along a space-filling curve.

Every document's hashed token vector is projected to a few dimensions; the
Hilbert key of the projected point orders the corpus so that similar documents
are neighbours; sequences are cut from that order without gaps, so that only
the very last one needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Encoder
from quarry.llm.common import shuffle_partitions, stored

DIMS = 4
#: bits of each coordinate; DIMS * DEPTH + TIE_BITS = 53, so that an order key is exact as a double
DEPTH = 8
TIE_BITS = 21
END_ID = 1
#: entries of the hashed token vector (a power of two)
HASHED = 1 << 16
#: the greatest number of slices of the order (one for each shuffle partition): the driver keeps one total of each
MAX_SLICES = 20_000


def directions(n_ids: int, seed: int = 42) -> np.ndarray:
    """For each token id, its pseudo-random direction in DIMS dimensions (+1 or -1 each)."""
    x = np.arange(n_ids, dtype=np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.stack([((x >> np.uint64(7 * d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMS)], axis=1)


def hilbert_keys(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Index along the Hilbert curve of each row of grid coordinates in [0, 2**depth).

    Skilling's transform (2004): undo the excess work of each bit plane, Gray
    encode, then interleave the bits of all coordinates.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in reversed(range(1, depth)):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for level in reversed(range(1, depth)):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for level in reversed(range(depth)):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", specials: dict[str, int] | None = None) -> DataFrame:
    """(id, ids, n_ids, p0..p3) of each document: packed ids with the end id, their number, the projected vector."""
    kind = dict(docs.dtypes)[id_col]
    points = ", ".join(f"p{d} double" for d in range(DIMS))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern, specials)
        ways = directions(HASHED)
        end = END_ID.to_bytes(encoder.width, "little")
        for batch in batches:
            packed, sizes, means = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "") + end
                numbers = np.frombuffer(ids, dtype=f"<u{encoder.width}")
                packed.append(ids)
                sizes.append(len(numbers))
                means.append(ways[numbers & (HASHED - 1)].mean(axis=0, dtype=np.float64))
            means = np.array(means).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(means[:, d]) for d in range(DIMS)]], names=["_id", "ids", "n_ids", *[f"p{d}" for d in range(DIMS)]])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(of, f"_id {kind}, ids binary, n_ids long, {points}")


def order_key(tokens: DataFrame) -> DataFrame:
    """Adds ``order``: the Hilbert key, scaled by the mean and deviation over all documents, then a hash of the id and the row's place in the written table."""
    names = [f"p{d}" for d in range(DIMS)]
    stats = tokens.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first()
    mid = np.array([stats[f"mean_{n}"] or 0.0 for n in names])
    dev = np.array([stats[f"dev_{n}"] or 1.0 for n in names])

    @F.pandas_udf("long")
    def curve(*cols: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in cols], axis=1) - mid) / dev
        grid = np.floor((0.5 + 0.5 * np.tanh(0.8 * z)) * (1 << DEPTH)).clip(0, (1 << DEPTH) - 1)
        return pd.Series(hilbert_keys(grid))

    tie = F.pmod(F.xxhash64("_id", "_place"), F.lit(1 << TIE_BITS))
    return tokens.withColumn("order", F.shiftleft(curve(*names), TIE_BITS).bitwiseOR(tie))


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
         specials: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    Columns: ``id_col``, ``start`` (the document's ids before the piece),
    ``length``, ``doc_tokens`` (with the end id), ``sequence_id`` (gapless from
    0 along the curve), ``offset`` (in the sequence, gapless from 0) and
    ``ids`` (binary, unsigned little-endian 32-bit).  All sequences but the
    last are full.  Null and empty texts are one end id; null ids, repeated
    rows and ties are documents of their own (equal points follow a hash of
    the id and the row's place in the written tokens, so that rows of one id
    spread like others); strings of ``specials`` are their ids, all others plain text; other columns are ignored; an empty table gives an
    empty result.  Equal texts spread over as many slices as they fill, so none is
    hot; a task holds one document and one Arrow batch at a time.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    tokens = stored(tokenised(docs, ranks_path, pattern, id_col, text_col, specials).withColumn("_place", F.monotonically_increasing_id()), "tokens")
    keyed = order_key(tokens)
    slices = min(MAX_SLICES, shuffle_partitions(spark))
    narrow = stored(keyed.select("_id", "order", "n_ids"), "order")
    cuts = narrow.approxQuantile("order", [i / slices for i in range(1, slices)], 1 / (4 * slices))
    bounds = np.unique(np.array(cuts, dtype=np.int64)) if cuts else np.zeros(0, dtype=np.int64)

    @F.pandas_udf("int")
    def slice_of(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, order.to_numpy(), side="right").astype(np.int32))

    totals = dict(narrow.groupBy(slice_of("order").alias("slice")).agg(F.sum("n_ids")).collect())
    first = dict(zip(range(slices), accumulate((totals.get(i, 0) for i in range(slices)), initial=0)))
    width = 2 if _narrow_ids(ranks_path, specials) else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = 0, None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for slice_, doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if slice_ != current:
                    current, at = slice_, first[slice_]
                ids = np.frombuffer(packed.as_buffer(), dtype=f"<u{width}").astype("<u4").tobytes()
                total, start = len(ids) // 4, 0
                while start < total:
                    size = min(total - start, length - at % length)
                    for column, value in zip(out, (doc, start, size, total, at // length, at % length, ids[4 * start:4 * (start + size)])):
                        column.append(value)
                    start, at = start + size, at + size
            kinds = [batch.schema.field(1).type, *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    ranged = (keyed.select(slice_of("order").alias("slice"), "_id", "ids", "order").repartitionById(slices, F.col("slice"))
              .sortWithinPartitions("slice", "order", "_id", "ids").select("slice", "_id", "ids"))
    pieces = ranged.mapInArrow(cut, f"_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("_id", id_col)


def _narrow_ids(ranks_path: str, specials: dict[str, int] | None) -> bool:
    with open(ranks_path, "rb") as f:
        return max([int(line.split()[1]) for line in f if line.strip()] + list((specials or {}).values())) < 1 << 16
