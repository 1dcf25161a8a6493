"""Ranked lexical search by bag deduplication.

Only terms of the stated items can score, so a document is restricted to the
items' vocabulary: its bag of (term, occurrences) and its length class ``m``.
Documents with the same bag and ``m`` score alike for every item.  Their hash
groups them, the whole bag verifies the group, and each class is scored once.
The classes that win an item are expanded to their documents by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import spread_join, stored

#: bytes of text and number of the items that are searched in one scan of the documents; more items take more scans
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 4096
#: cells of a score matrix, and term-item meetings, that a task holds at once
CELLS = 1 << 21
#: parts that the members of one class are dealt to before its smallest ids are taken
SALTS = 64
#: A-Z become a-z, every other ASCII byte that is no digit or letter a blank; bytes of other characters stay
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of all other non-ASCII characters, only A-Z lower-cased."""
    return text.translate(FOLD).split()


class Query:
    """A block of items: the sorted vocabulary, and the items that hold each term."""

    def __init__(self, items: list[tuple[int, str | None]]):
        held = [(i, set(terms((text or "").encode()))) for i, (_, text) in enumerate(items)]
        self.ordinals = np.array([ordinal for ordinal, _ in items], dtype=np.int64)
        self.vocabulary = sorted(set().union(*[words for _, words in held]))
        number = {t: i for i, t in enumerate(self.vocabulary)}
        pairs = sorted((number[t], i) for i, words in held for t in words)
        self.fan = np.bincount([t for t, _ in pairs], minlength=len(number)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.fan)])[:-1].astype(np.int64)
        self.posting = np.array([i for _, i in pairs], dtype=np.int64)


def bags(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, bag) of each row: all its terms with repeats, and (term number, occurrences) of the vocabulary's, by number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column(1):
                words = terms(text.as_buffer().to_pybytes()) if text.is_valid else []
                known = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                sizes.append(len(words))
                packed.append(np.array(known, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["id", "n", "bag"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(of, "id long, n long, bag binary")


def document_counts(classes: DataFrame) -> dict[int, int]:
    """In how many documents each term occurs; a task adds up its classes and sends one row for each term."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            pairs, rows = unpacked(batch.column(0))
            copies = batch.column(1).to_numpy()[rows]
            numbers, where = np.unique(pairs[:, 0], return_inverse=True)
            sums = np.zeros(len(numbers), dtype=np.int64)
            np.add.at(sums, where, copies)
            total.update(dict(zip(numbers.tolist(), sums.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    counted = classes.select("bag", "copies").mapInArrow(of, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (term number, occurrences) pairs of a column of bags, and the row that each pair is from."""
    parts = [b.as_buffer().to_pybytes() for b in column]
    pairs = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int64).reshape(-1, 2)
    return pairs, np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])


class Best:
    """The k best classes of each item so far: highest score, then smallest first id (none: last), then place."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, dtype=np.int64)
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, item, score, first, missing, place) -> None:
        self.found.append(np.stack([item, score, missing, first, place]))
        self.size += len(item)
        if self.size > 4 * self.k * len(self.floor) + CELLS // 4:
            self.prune()

    def prune(self) -> np.ndarray:
        if not self.found:
            return np.zeros((5, 0), dtype=np.int64)
        rows = np.concatenate(self.found, axis=1)
        item, score, missing, first, place = rows
        rows = rows[:, np.lexsort((place, first, missing, -score, item))]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rank = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(np.append(starts, rows.shape[1])))
        full = rank == self.k - 1
        self.floor[rows[0][full]] = rows[1][full]
        rows = rows[:, rank < self.k]
        self.found, self.size = [rows], rows.shape[1]
        return rows


def scored(classes: DataFrame, query: Query, weight: np.ndarray, k: int) -> DataFrame:
    """(item, place, score, first): of each task's classes, the k best for each item (its ordinal)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items = len(query.ordinals)
        best = Best(n_items, k)
        for batch in batches:
            place, m = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first = batch.column(1).fill_null(0).to_numpy()
            pairs, rows = unpacked(batch.column(3))
            term, tf = pairs[:, 0], pairs[:, 1]
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
            # so many rows at once that neither their cells nor their meetings with items exceed CELLS (one row, if it does)
            meetings = np.concatenate([[0], np.cumsum(query.fan[term])])
            ends = np.searchsorted(rows, np.arange(len(place)), side="right")
            low = 0
            while low < len(place):
                begin = ends[low - 1] if low else 0
                high = np.searchsorted(meetings[ends], meetings[begin] + CELLS, side="right")
                high = int(max(low + 1, min(high, low + CELLS // n_items)))
                part = slice(begin, ends[high - 1])
                fan = query.fan[term[part]]
                within = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                item = query.posting[np.repeat(query.start[term[part]], fan) + within]
                score = np.zeros((high - low) * n_items, dtype=np.int64)
                np.add.at(score, np.repeat(rows[part] - low, fan) * n_items + item, np.repeat(impact[part], fan))
                row, item = np.nonzero(score.reshape(-1, n_items) >= best.floor)
                best.add(item, score.reshape(-1, n_items)[row, item], first[low + row], missing[low + row], place[low + row])
                low = high
        item, score, missing, first, place = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(query.ordinals[item]), pa.array(place), pa.array(score), pa.array(first, mask=missing.astype(bool))], names=["item", "place", "score", "first"])

    return classes.select("place", "first", "m", "bag").mapInArrow(of, "item long, place long, score long, first long")


def smallest_members(members: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each place (null ids last), by parts first, so that a class with most rows is not one task's."""
    order = [F.col("id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(SALTS))
    few = (members.select("place", "id", salt.alias("salt"))
           .withColumn("nth", F.row_number().over(Window.partitionBy("place", "salt").orderBy(*order))).where(F.col("nth") <= k))
    return (few.select("place", "id").withColumn("nth", F.row_number().over(Window.partitionBy("place").orderBy(*order)))
            .where(F.col("nth") <= k).select("place", "id"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each row of ``items``: item id, ``rank`` (int, from 1), document id, ``score`` (long).

    All counts are over all documents: N those with a term, L their terms with
    repeats, df those with a term of the items.  A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))); a document with n terms has
    m = 50 + 50 n N div L and scores the sum, over the item's different terms, of
    weight * (10^9 tf div (1000 tf + 20 m)).  Scores of 0 are not listed.
    ``id_col`` is an integer column; equal scores go by ascending id, null ids last.

    Null and empty texts have no terms.  Repeated rows, null ids and repeated
    ids are documents of their own, repeated and null item ids items of their
    own; items without terms, and empty tables, give no rows; other columns
    are ignored.  Items are taken in blocks of BLOCK_ITEMS rows and
    BLOCK_BYTES of text or about so: a block's vocabulary and its winners
    are all that is sent to the tasks.
    """
    queries = stored(items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
                     .withColumn("ordinal", F.monotonically_increasing_id()), "items")
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, math.ceil((size["bytes"] or 0) / BLOCK_BYTES), math.ceil(size["n"] / BLOCK_ITEMS))
    parts = [_block(docs, queries.where(F.pmod(F.xxhash64("ordinal"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    named = reduce(DataFrame.unionByName, parts).join(queries.select("ordinal", "item_id"), F.col("item") == F.col("ordinal"))
    return named.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, id, score) for one block of items."""
    query = Query([(r["ordinal"], r["text"]) for r in items.select("ordinal", "text").collect()])
    rows = stored(bags(docs, query.vocabulary, id_col, text_col), "bags")
    totals = rows.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 1
    m = F.expr(f"50 + (50L * n * {n_docs}L) DIV {n_terms}L")
    able = rows.where(F.length("bag") > 0).select("id", m.alias("m"), "bag").select("id", F.xxhash64("m", "bag").alias("hash"), "m", "bag")
    # equal hash, m and bag: the group itself verifies what the hash brings together
    grouped = able.groupBy("hash", "m", "bag").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stored(grouped.withColumn("place", F.monotonically_increasing_id()), "classes")
    counts = document_counts(classes)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(query.vocabulary))], dtype=np.int64)
    order = [F.col("score").desc(), F.col("first").asc_nulls_last(), "place"]
    nth = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    won = stored(scored(classes, query, weight, k).withColumn("nth", nth).where(F.col("nth") <= k).select("item", "place", "score"), "won")
    # at most k classes of each item of the block: a bounded list of hashes
    winners = stored(classes.join(won.select("place").distinct(), "place", "left_semi").select(F.col("hash").alias("won_hash"), F.col("m").alias("won_m"), F.col("bag").alias("won_bag"), "place", "copies"), "winners")
    near = able.join(F.broadcast(winners.select("won_hash").distinct()), F.col("hash") == F.col("won_hash"), "left_semi")
    members = spread_join(near, "hash", winners, "won_hash", "copies").where("m = won_m AND bag = won_bag")
    expanded = won.join(smallest_members(members, k), "place")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return expanded.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "id", "score")
