"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the text of the k smallest distinct shingle hashes of a document
in ascending order (16 hex digits each).  Sketches of parts merge to that of
the whole; two sketches estimate resemblance, containment and the numbers of
distinct shingles.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WIDTH = 5
DIGITS = 16
#: shingles hashed at once, so that memory does not grow with the text
STEP = 1 << 16
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes (of all, if there are fewer)."""
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        x = words[i:len(words) - width + 1 + i] * FACTORS[i % len(FACTORS)] + np.uint64(i)
        out = (out ^ (x ^ (x >> np.uint64(32)))) * FACTORS[0]
    out ^= out >> np.uint64(29)
    out *= FACTORS[1]
    return out ^ (out >> np.uint64(32))


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    hashes = np.unique(hashes)
    return hashes[:k]


def bottom_k(text: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct hashes of a UTF-8 text's shingles of lower-cased words (A-Z only)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_digest
    hashes = np.frombuffer(b"".join(map(digest, words)), dtype=">u8").astype(np.uint64)
    best = np.zeros(0, dtype=np.uint64)
    for at in range(0, max(1, len(hashes) - width + 1), STEP):
        best = smallest(np.concatenate([best, shingle_hashes(hashes[at:at + STEP + width - 1], width)]), k)
    return best


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def from_text(sketch: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(sketch or ""), dtype=">u8").astype(np.uint64)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of each text; null and blank texts have the empty sketch."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([to_text(bottom_k(t.as_buffer().to_pybytes() if t.is_valid else b"", k, width)) for t in texts.cast(pa.binary())], pa.string())

    return of(text.cast("string"))


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of the k smallest hashes of the union that both have (two empty sketches: 1)."""
    union = smallest(np.concatenate([a, b]), k)
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment_of(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: the intersection by resemblance and union, over a's number (empty a: 1)."""
    if not len(a):
        return 1.0
    union = smallest(np.concatenate([a, b]), k)
    both = likeness(a, b, k) * distinct(union, k)
    return min(1.0, both / max(distinct(a, k), 1.0))


def _pairwise(rule) -> object:
    def column(a: Column, b: Column, k: int = K) -> Column:
        @F.pandas_udf("double")
        def of(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([rule(from_text(p), from_text(q), k) for p, q in zip(x, y)], dtype="float64")

        return of(a, b)

    column.__doc__ = (rule.__doc__ or "") + "  Null sketches count as empty."
    return column


resemblance = _pairwise(likeness)
containment = _pairwise(containment_of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of each sketch (null: 0)."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series([distinct(from_text(p), k) for p in x], dtype="float64")

    return of(a)


def merge(parts: DataFrame, by: list[str], sketch_col: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for each group of ``by``: that of the union of its parts' shingles (exact, in any order).

    The hashes are reduced to distinct ones before the shuffle, and a group's
    list is cut to its k smallest by rank, so a hot group moves at most k rows
    from each task.  Groups without hashes have the empty sketch; null groups
    are groups.  Parts cut a text between words; shingles across a cut belong
    to none of them.
    """
    keys = [F.col(f"`{c}`") for c in by]
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("_s") / DIGITS - 1).cast("int"))
    hashes = (parts.select(*keys, F.coalesce(F.col(f"`{sketch_col}`"), F.lit("")).alias("_s"))
              .select(*keys, F.explode(F.transform(at, lambda i: F.substring("_s", i * DIGITS + 1, DIGITS))).alias("_h")).distinct())
    ranked = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_h") == "", "_h"))).where(F.col("_n") <= k)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_h")), "").alias(sketch_col))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = K, width: int = WIDTH, more: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the sketch of each whole text in ``out`` (a column of that name is replaced).

    ``more`` names further text columns and their sketches' columns; one Python
    worker makes all sketches of a task.  One row out for each row in, any id;
    equal texts have equal sketches; null, empty and blank texts have the empty
    sketch; an empty table stays empty.  Rows stay in their partitions; a task
    holds an Arrow batch and the hashes of the words of one text.
    """
    return docs.withColumns({o: sketch(F.col(f"`{t}`"), k, width) for t, o in ({text_col: out} | (more or {})).items()})
