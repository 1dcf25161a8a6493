"""Exact top-k inner products by dual cover trees.

Rows are dealt to blocks around pivots; block pairs whose bound lies below the
queries' scores so far are never formed.  Within a pair both sides get a cover
tree, and node pairs are pruned by centre, covering radius and the worst k-th
score of the query node.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, uniform

#: rows of a candidate block and of a query block at most (about), and queries that make a query group worth its own copies of candidates
BLOCK, QUERY_BLOCK, QUERY_GROUP = 8192, 4096, 512
#: pivots at most: the driver keeps them and their inner products
PIVOTS = 256
#: points of a leaf: few on the query side, where a node's worst score decides
LEAF, QUERY_LEAF = 48, 4
#: children of a node; points that need more centres at the next radius are a leaf
FANOUT = 96
SHRINK = 0.6


class Node:
    __slots__ = ("centre", "radius", "norm", "children", "points")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray | None, children: list[Node] | None):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        self.norm = float(np.linalg.norm(centre))


def cover_tree(x: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree over rows ``points`` of x: a node's children cover it at SHRINK times its radius, centres further apart than that."""
    centre = x[points[0]]
    far = np.sqrt(np.maximum(((x[points] - centre) ** 2).sum(axis=1), 0.0))
    radius = float(far.max())
    if len(points) <= leaf or radius == 0.0:
        return Node(centre, radius, points, None)
    groups, rest = [], points
    while len(rest):
        near = ((x[rest] - x[rest[0]]) ** 2).sum(axis=1) <= (SHRINK * radius) ** 2
        groups.append(rest[near])
        rest = rest[~near]
        if len(groups) > FANOUT:
            return Node(centre, radius, points, None)
    if len(groups) == 1:
        return Node(centre, radius, points, None)
    return Node(centre, radius, None, [cover_tree(x, g, leaf) for g in groups])


def bound(q: Node, c: Node) -> float:
    """No inner product of a query below q and a point below c is higher (rounding allowed for)."""
    top = float(q.centre @ c.centre) + q.radius * c.norm + c.radius * q.norm + q.radius * c.radius
    return top + 1e-9 * (abs(top) + q.norm * c.norm) + 1e-6


class Search:
    """The k best of each query so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.query_ids, self.x, self.ids, self.k = queries, query_ids, rows, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        #: what each query's k-th score is known to reach: a lower one can't be in its result
        self.floors = floors.astype(float)
        top = max(float(np.abs(queries).max(initial=0)), 1.0) * max(float(np.abs(rows).max(initial=0)), 1.0)
        self.exact = top * max(queries.shape[1], 1) < 2**53
        self.pairs = 0

    def worst(self, node: Node) -> float:
        if node.points is not None:
            return float(self.floors[node.points].min())
        return min(self.worst(c) for c in node.children)

    def visit(self, q: Node, candidates: list[Node]) -> None:
        least = self.worst(q)
        candidates = [c for c in candidates if bound(q, c) >= least]
        if q.points is None:
            wide = [c for c in candidates if c.children and c.radius > q.radius]
            candidates = [c for c in candidates if not (c.children and c.radius > q.radius)]
            for c in wide:
                candidates.extend(d for d in c.children if bound(q, d) >= least)
            for child in q.children:
                self.visit(child, candidates)
            return
        heap = [(-bound(q, c), i, c) for i, c in enumerate(candidates)]
        heapq.heapify(heap)
        n = len(heap)
        while heap:
            top, _, c = heapq.heappop(heap)
            if -top < self.floors[q.points].min():
                return
            if c.points is not None:
                self.compare(q.points, c.points)
                continue
            for d in c.children:
                n += 1
                heapq.heappush(heap, (-bound(q, d), n, d))

    def compare(self, queries: np.ndarray, points: np.ndarray) -> None:
        self.pairs += len(queries) * len(points)
        if self.exact:
            scores = self.q[queries] @ self.x[points].T
        else:
            scores = (self.q[queries].astype(np.int64) @ self.x[points].T.astype(np.int64)).astype(object)
        ids = np.broadcast_to(self.ids[points], scores.shape)
        own = ids == self.query_ids[queries][:, None]
        scores = np.where(own, -np.inf, scores)
        scores = np.concatenate([self.scores[queries], scores], axis=1).astype(float)
        ids = np.concatenate([self.found[queries], np.where(own, np.iinfo(np.int64).max, ids)], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[queries] = np.take_along_axis(scores, order, axis=1)
        self.found[queries] = np.take_along_axis(ids, order, axis=1)
        self.floors[queries] = np.maximum(self.floors[queries], self.scores[queries, -1])


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def integers(vector: Column) -> Column:
    """floor(256 x) of each component as a double; null for vectors that are null or hold a null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0)))


def pairwise(queries: DataFrame, rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(qkey, query_id, vec_id, score): the k best of each query within each (qblock, block) of ``pairs``."""
    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"qkey": [], "query_id": [], "vec_id": [], "score": []})
        dims = max(q["v"].map(len).max(), c["v"].map(len).max())
        x, y = matrix(q["v"], dims), matrix(c["v"], dims)
        search = Search(x, q["query_id"].to_numpy(), q["floor"].to_numpy(), y, c["vec_id"].to_numpy(), k)
        search.visit(cover_tree(x, np.arange(len(x)), QUERY_LEAF), [cover_tree(y, np.arange(len(y)))])
        at, place = np.nonzero(search.scores > -np.inf)
        out = search.scores[at, place] if search.exact else [int(a) for a in (x[at].astype(np.int64) * matrix_of(y, c, search.found[at, place]).astype(np.int64)).sum(axis=1)]
        return pd.DataFrame({"qkey": q["qkey"].to_numpy()[at], "query_id": q["query_id"].to_numpy()[at], "vec_id": search.found[at, place], "score": np.asarray(out).astype(np.int64)})

    left = queries.join(pairs, "qblock").select(F.concat_ws("/", "qblock", "block").alias("pair"), "qkey", "query_id", "v", "floor").groupBy("pair")
    right = rows.join(pairs, "block").select(F.concat_ws("/", "qblock", "block").alias("with"), "vec_id", "v").groupBy("with")
    return left.cogroup(right).applyInPandas(best, "qkey long, query_id long, vec_id long, score long")


def matrix_of(y: np.ndarray, c: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    first = {v: i for i, v in reversed(list(enumerate(c["vec_id"])))}
    return y[[first[i] for i in ids]]


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query row over all rows with another id.

    Components count as floor(256 x).  Vectors that are null or hold null or
    non-finite components take no part, nor do null ids; shorter vectors end in
    zeros.  Equal scores rank by the smaller id.  Rows that repeat an id are
    candidates each; a repeated query counts once for each distinct vector.
    Fewer than k other rows give fewer results; an empty table gives none;
    other columns are ignored.  Blocks hold a bounded number of rows even if
    all vectors are equal.
    """
    clean = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), integers(F.col(f"`{vector_col}`")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    clean = stored(clean.where("vec_id IS NOT NULL AND v IS NOT NULL"), "vectors")
    counts = clean.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    n_pivots = min(PIVOTS, max(1, ceil(counts["n"] / BLOCK)))
    pivots = clean.select("v").orderBy(uniform(7, F.col("vec_id")), "vec_id", "v").limit(n_pivots).collect()
    if not pivots or not counts["q"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(len(r["v"]) for r in pivots)
    centres = np.zeros((len(pivots), dims))
    for i, r in enumerate(pivots):
        centres[i, :len(r["v"])] = r["v"]
    groups = min(len(pivots), max(1, counts["q"] // QUERY_GROUP))

    def nearest(n: int) -> Column:
        @F.pandas_udf("struct<cell: int, far: double>")
        def of(vectors: pd.Series) -> pd.DataFrame:
            wide = max([dims, *vectors.map(len)])
            x, p = matrix(vectors, wide), np.zeros((n, wide))
            p[:, :dims] = centres[:n]
            far = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)[None, :], 0.0))
            cell = far.argmin(axis=1)
            # the exact distance to the chosen pivot, and a little more
            return pd.DataFrame({"cell": cell.astype(np.int32), "far": np.sqrt(((x - p[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6})

        return of("v")

    def dealt(frame: DataFrame, n: int, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        """Blocks of one cell with about ``size`` rows at most, and their (cell, radius)."""
        placed = stored(frame.withColumn("near", nearest(n)).select("*", "near.cell", "near.far").drop("near"), name)
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        parts = F.element_at(F.array(*[F.lit(max(1, ceil(sizes.get(i, 0) / size))) for i in range(n)]), F.col("cell") + 1)
        blocks = placed.withColumn(name, F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id", "v"), parts)))
        return blocks, blocks.groupBy(name).agg(F.first("cell").alias(f"{name}_cell"), F.max("far").alias(f"{name}_far"))

    asked = clean.where("asks").select("vec_id", "v").distinct()
    queries, query_blocks = dealt(asked, groups, QUERY_BLOCK, "qblock")
    queries = queries.select("qblock", F.xxhash64("vec_id", "v").alias("qkey"), F.col("vec_id").alias("query_id"), "v")
    candidates, blocks = dealt(clean.select("vec_id", "v"), len(pivots), BLOCK, "block")
    candidates = candidates.select("block", "vec_id", "v")

    # a first pass over one block near each query block gives every query a score to beat
    near = blocks.groupBy("block_cell").agg(F.min("block").alias("block")).join(query_blocks, F.col("block_cell") == F.col("qblock_cell")).select("qblock", "block")
    first = stored(pairwise(queries.withColumn("floor", F.lit(float("-inf"))), candidates, near, k), "first")
    floors = first.groupBy(F.col("qkey").alias("fkey")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    known = stored(queries.join(floors, queries.qkey == floors.fkey, "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).drop("fkey"), "known")
    least = known.groupBy("qblock").agg(F.min("floor").alias("least"))

    # cell pairs with their inner products: at most PIVOTS x PIVOTS rows
    dots, norms = centres[:groups] @ centres.T, np.linalg.norm(centres, axis=1)
    cells = rows.sparkSession.createDataFrame([(i, j, float(dots[i, j]), float(norms[i]), float(norms[j])) for i in range(groups) for j in range(len(pivots))], "qblock_cell int, block_cell int, dot double, qnorm double, norm double")
    top = F.expr("dot + qblock_far * norm + block_far * qnorm + qblock_far * block_far")
    pairs = stored(query_blocks.join(least, "qblock").join(F.broadcast(cells), "qblock_cell").join(blocks, "block_cell").where(top * (1 + 1e-9) + 1e-3 + F.abs(top) * 1e-9 >= F.col("least")).select("qblock", "block"), "pairs")
    ranked = pairwise(known, candidates, pairs, k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
