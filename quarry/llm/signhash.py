"""Embedding near-duplicates by random-hyperplane sign hashing.

The signs of a vector's products with random directions agree with those of a
second vector with probability 1 - angle / pi each.  Several tables of such
signs bring nearly all pairs above the threshold together in some bucket;
every pair of a bucket is then decided by its exact cosine.  Equal vectors are
one class from the start, so copies never meet.  A task gives back, for each
vector of a bucket, the number of its links and edges that join what is
linked, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import spread_join, stored
from quarry.llm.components import components

SEED = 42
#: share of the pairs at exactly the threshold that no table may bring together (closer pairs are missed more rarely)
MISS = 0.001
#: vectors that a bucket holds on average, if they lie at random
OCCUPANCY = 256
#: entries of vectors and directions are whole numbers of this scale for the signs, so that products are exact in any order
GRID = 2.0**20
#: a bucket with more vectors is cut into parts of about so many, and each two parts are compared by themselves
PART = 1024
#: rows of a product that a task holds at once
STEP = 256
#: a cosine this near to the threshold is computed anew, correctly rounded
NEAR = 1e-9
#: buckets of more than PART vectors that are looked up by a broadcast; more of them by a shuffle
BROADCAST_BUCKETS = 100_000


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors: buckets of OCCUPANCY on average, and a pair at the threshold missed with probability ``miss``."""
    bits = min(40, max(4, math.ceil(math.log2(max(n, 1) / OCCUPANCY)) if n > OCCUPANCY else 4))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if meet >= 1 - miss else min(math.ceil(math.log(miss) / math.log1p(-meet)), (1 << 62) >> bits)


def directions(dims: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random directions on the grid, one for each column: ``tables`` times ``bits`` of them."""
    return np.rint(np.random.Generator(np.random.Philox(key=[seed, dims])).standard_normal((dims, bits * tables)) * GRID)


def signatures(units: np.ndarray, ways: np.ndarray, bits: int) -> np.ndarray:
    """For each row its bucket number in every table: the signs of its products."""
    signs = np.rint(units * GRID) @ ways >= 0
    return signs.reshape(len(units), -1, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def unit_rows(packed: list[bytes], code: str) -> np.ndarray:
    """Vectors of one length, packed as floats of the kind ``code``, scaled to length 1 in doubles (by the largest entry first, so that squares stay finite)."""
    rows = np.frombuffer(b"".join(packed), dtype=code).astype(np.float64).reshape(len(packed), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two unit vectors from correctly rounded sums."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def packed(embedding: Column, code: str) -> Column:
    """The vector's entries as bytes, floats of the kind ``code``; null if it is null, empty or zero or holds a null or a non-finite component."""

    @F.arrow_udf("binary")
    def of(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            row = np.array(v.as_py(), dtype=np.float64) if v.is_valid else np.zeros(0)  # None becomes NaN
            # adding zero makes -0.0 and 0.0 equal bytes
            out.append((row + 0.0).astype(code).tobytes() if row.any() and np.isfinite(row).all() else None)
        return pa.array(out, pa.binary())

    return of(embedding)


def hashed(classes: DataFrame, bits: int, tables: int, code: str, carried: tuple = ("node", "copies", "packed")) -> DataFrame:
    """(dims, bucket) and the ``carried`` columns for each class and table; ``bucket`` numbers the table and its signs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [v.as_buffer().to_pybytes() for v in batch.column("packed")]
            sizes = np.array([len(v) // np.dtype(code).itemsize for v in vectors])
            for dims in np.unique(sizes).tolist():
                if dims not in ways:
                    ways[dims] = directions(dims, bits, tables)
                every = np.flatnonzero(sizes == dims)
                for at in range(0, len(every), STEP):
                    mine = every[at:at + STEP]
                    marks = signatures(unit_rows([vectors[i] for i in mine], code), ways[dims], bits)
                    buckets = marks + (np.arange(tables, dtype=np.int64) << bits)
                    rows = batch.take(pa.array(np.repeat(mine, tables)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, dims), pa.int32()), pa.array(buckets.ravel()), *[rows.column(c) for c in carried]], names=["dims", "bucket", *carried])

    kinds = "".join(f", {c} {dict(classes.dtypes)[c]}" for c in carried)
    return classes.select("node", "copies", "packed").mapInArrow(of, f"dims int, bucket long{kinds}")


def dealt(hashes: DataFrame, buckets: DataFrame, part: int = PART) -> DataFrame:
    """Adds to ``hashes``, whose rows are in the buckets that ``buckets`` lists, ``left`` and ``right``, the two parts of the bucket that a row is compared in, and ``part``, its own.

    A bucket of ``part`` vectors or fewer is one part.  A larger one is cut by a
    hash, and a row goes to each pair of parts that its own is in.
    """
    zero = [F.lit(0).alias(c) for c in ("left", "right", "part")]
    sizes = buckets.groupBy("dims", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > part)
    sizes = stored(sizes.select(F.xxhash64("dims", "bucket").alias("key"), F.ceil(F.col("n") / part).cast("int").alias("parts"), "n")
                   # two buckets of one hash are cut alike
                   .groupBy("key").agg(F.max("parts").alias("parts"), F.sum("n").alias("n")), "buckets")
    large = sizes.count()
    if not large:
        return hashes.select("*", *zero)
    keyed = hashes.withColumn("hash", F.xxhash64("dims", "bucket"))
    if large <= BROADCAST_BUCKETS:
        found = keyed.join(F.broadcast(sizes.select("key", "parts")), F.col("hash") == F.col("key"), "left")
        small, cut = found.where("parts IS NULL"), found.where("parts IS NOT NULL")
    else:
        small = keyed.join(sizes, F.col("hash") == F.col("key"), "left_anti")
        cut = spread_join(keyed, "hash", sizes, "key", "n")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cut = cut.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select(*hashes.columns, F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part")
    return small.select(*hashes.columns, *zero).unionByName(cut)


def compared(units: np.ndarray, marks: Callable[[], np.ndarray], part: np.ndarray, within: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) at the threshold or above that no earlier table brought together: in blocks.  ``marks()`` gives the rows' buckets in these tables.

    ``within``: all pairs i < j; else those of the first part with the second.
    """
    left, right = (np.arange(len(units)),) * 2 if within else (np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min()))
    for at in range(0, len(left), STEP):
        rows = left[at:at + STEP]
        others = right[rows[0] + 1:] if within else right
        cosines = units[rows] @ units[others].T
        i, j = np.nonzero(cosines >= threshold - NEAR)
        values, i, j = cosines[i, j], rows[i], others[j]
        keep = (i < j) if within else np.ones(len(i), dtype=bool)
        for at_ in np.flatnonzero(keep & (values < threshold + NEAR)):
            keep[at_] = exact_cosine(units[i[at_]], units[j[at_]]) >= threshold
        i, j = i[keep], j[keep]
        for from_ in range(0, len(i), STEP * STEP):
            a, b = i[from_:from_ + STEP * STEP], j[from_:from_ + STEP * STEP]
            new = ~(marks()[a] == marks()[b]).any(axis=1)
            yield a[new], b[new]


def joined(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that the pairs reach: labels sink along the pairs until they rest."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def verified(groups: DataFrame, bits: int, tables: int, threshold: float, code: str) -> DataFrame:
    """(node, links, root): partial sums of each node's links to other classes' rows, and edges (node, root) that join linked nodes (null: none)."""

    def group(rows: list[tuple]) -> tuple | None:
        dims, bucket, left, right = rows[0][:4]
        if len(rows) < 2:
            return None
        table = bucket >> bits
        units = unit_rows([r[7] for r in rows], code)
        marks = cache(lambda: signatures(units, directions_of(dims)[:, :bits * table], bits))
        copies = np.array([r[6] for r in rows], dtype=np.int64)
        links, label, waiting, held = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), [], 0
        for a, b in compared(units, marks, np.array([r[4] for r in rows]), left == right, threshold):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            waiting.append((label[a], label[b]))
            held += len(a)
            if held > 16 * STEP * STEP:
                label, waiting, held = joined(len(rows), waiting)[label], [], 0
        label = joined(len(rows), waiting)[label]
        some = np.flatnonzero((links > 0) | (label != np.arange(len(rows))))
        nodes = np.array([r[5] for r in rows], dtype=np.int64)
        return nodes[some], links[some], nodes[label[some]]

    made: dict[int, np.ndarray] = {}

    def directions_of(dims: int) -> np.ndarray:
        if dims not in made:
            made[dims] = directions(dims, bits, tables)
        return made[dims]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            node, links, root = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

        rows, found = [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and rows[0][:4] != row[:4]:
                    found.append(group(rows))
                    rows = []
                rows.append(row)
            yield batch_of([f for f in found if f is not None])
            found = []
        if rows:
            found.append(group(rows))
        yield batch_of([f for f in found if f is not None])

    keys = ["dims", "bucket", "left", "right"]
    ordered = groups.repartition(*keys).sortWithinPartitions(*keys, "node")
    return ordered.select(*keys, "part", "node", "copies", "packed").mapInArrow(of, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = MISS) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Two rows are linked if some table brings them together and their cosine, in
    double precision, is ``threshold`` or more; rows with equal vectors always
    are.  ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest id that links reach, ``kept`` whether it is the row's own.

    Vectors that are null, empty or zero, or that hold null or non-finite
    components, link with nothing and are their own component; so do vectors
    of different lengths.  Null ids become a component's id only if it has no
    other, and such rows are not kept; repeated rows stay, each with its row;
    other columns are ignored; an empty table gives an empty result.
    """
    code = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), packed(F.col(f"`{vector_col}`"), code).alias("packed"))
    rows = stored(base, "vectors")
    grouped = rows.where("packed IS NOT NULL").groupBy("packed").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = plan_tables(classes.count(), threshold, miss)
    groups = dealt(hashed(classes, bits, tables, code), hashed(classes, bits, tables, code, ()))
    found = stored(verified(groups, bits, tables, threshold, code), "links")
    links = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    ids = _component_ids(classes.select("node", "first_id"), roots)
    known = stored(classes.join(links, F.col("node") == F.col("linked"), "left").join(ids, F.col("node") == F.col("of_node"), "left")
                   .select(F.col("packed").alias("key"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("least_id", "first_id").alias("component_id")), "vector-links")
    linked = spread_join(rows.where("packed IS NOT NULL"), "packed", known, "key", "copies").select("id", "n_links", "component_id")
    alone = rows.where("packed IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _component_ids(first: DataFrame, roots: DataFrame) -> DataFrame:
    """(of_node, least_id): the smallest id in the component of each node that has a link."""
    held = stored(roots.join(first, "node").select("node", "root", "first_id"), "vector-roots")
    least = stored(held.groupBy(F.col("root").alias("least_root")).agg(F.min("first_id").alias("least_id"), F.count("*").alias("members")), "least")
    return spread_join(held.select(F.col("node").alias("of_node"), "root"), "root", least, "least_root", "members").select("of_node", "least_id")
