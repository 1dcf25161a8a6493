"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2h`` bits lie within ``h``
bits of a common value.  So every distinct fingerprint emits all its variants
within ``h`` bits, and linked fingerprints meet at a variant.  A variant can
be reached by at most as many fingerprints as its own ball holds (65 for
h = 1), so no group grows with the data, however many copies a text has.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import spread_join, stored, unwrapped, wrapped
from quarry.llm.components import components

BITS = 64
SEED = 42


def simhash(text: bytes, width: int) -> int:
    """Unsigned fingerprint of a UTF-8 text: majority bits of the XXH64 of its word shingles."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[width:]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(BITS, dtype=np.int64), len(ends)
    for at in range(0, n, 1 << 16):
        part = b"".join([digest(joined[s:e - 1], SEED) for s, e in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(part, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """The signed 64-bit image of a text's SimHash (null text: that of an empty one, zero)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        prints = [simhash(t or b"", width) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(prints, dtype=np.uint64).astype(np.int64))

    return of(text.cast("string"))


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) with a < b that join any two of the distinct longs ``fp`` at ``distance`` bits or fewer.

    ``distance`` is even.  All fingerprints at one variant are within
    ``distance`` of each other, so each is tied to the smallest there: a path
    of verified edges joins every linked pair.
    """
    if distance < 0 or distance % 2:
        raise ValueError("the distance must be even: both sides go half the way")
    masks = [sum(1 << b for b in bits) for k in range(distance // 2 + 1) for bits in combinations(range(BITS), k)]
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> 63 else m) for m in masks])
    ball = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = ball.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("low"))
    return (met.where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (long) and ``component_id``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest id that links reach.  Null and blank texts
    have fingerprint zero and link like others.  Null ids never become a
    component's id unless it has no other.  Repeated rows stay, each with its
    row; other columns are ignored.  An empty table gives an empty result.
    """
    rows = stored(docs.select(F.col(f"`{id_col}`").alias(id_col), fingerprint(F.col(f"`{text_col}`"), width).alias("fingerprint")), "simhash")
    return spread_join(rows, "fingerprint", classes_of(rows, id_col, distance), "fp", "n").select(id_col, "fingerprint", "component_id")


def classes_of(rows: DataFrame, id_col: str, distance: int) -> DataFrame:
    """(fp, root, component_id, n) of each distinct ``fingerprint`` of ``rows``: the smallest fingerprint and id that links reach, and its number of rows."""
    classes = stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), distance))
    linked = stored(classes.join(roots, classes.fp == roots.node).select("fp", "root", "first_id"), "linked")
    least = stored(linked.groupBy(F.col("root").alias("least_root")).agg(F.min("first_id").alias("least_id"), F.count("*").alias("members")), "least")
    moved = spread_join(linked.select("fp", "root"), "root", least, "least_root", "members").select(F.col("fp").alias("moved_fp"), "root", "least_id")
    ids = classes.join(moved, classes.fp == moved.moved_fp, "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id"))
    return stored(ids.join(classes.select(F.col("fp").alias("counted"), "n"), F.col("fp") == F.col("counted")).select("fp", "root", "component_id", "n"), "ids")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with one row kept for each component: one with its smallest id.

    All columns stay.  Ids only order the rows of a component: rows of
    different components all stay, also with equal or null ids.  Of several
    rows with a component's smallest id, the one with the smallest fingerprint
    stays, then the first as written.
    """
    row = wrapped(docs).withColumn("id", F.col("row")[id_col]).withColumn("fingerprint", fingerprint(F.col("row")[text_col], width))
    # written with its place: the choice names one row, and a lost task finds the same
    rows = stored(row.withColumn("place", F.monotonically_increasing_id()), "placed")
    classes = classes_of(rows.select("id", "fingerprint"), "id", distance)
    found = spread_join(rows.select("id", "fingerprint", "place"), "fingerprint", classes, "fp", "n")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "fingerprint", "place"))["place"]
    keep = found.groupBy("root").agg(first.alias("keep")).select("keep")
    return unwrapped(rows.join(keep, F.col("place") == F.col("keep"), "left_semi").select("row"))


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
