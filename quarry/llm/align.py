"""Cross-tokenizer alignment by sparse products of token-byte incidence matrices.

Two tokenizers cut the same bytes.  Each gives a matrix with a row for each
token and a one for each byte that the token covers.  The row products of the
first with the transposed second (Gustavson 1978) list, for each token of the
first, the tokens of the second that share bytes with it.  Positions where
tokens of both end cut the bytes into groups; the same product over
token-group incidence gives the tokens that share a group.

How often a pair of ids is linked is counted over the whole corpus.  The most
frequent pairs are looked up in a table of bounded size that every task has,
the others by a shuffle, in which no pair is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Encoder
from quarry.llm.common import stored

#: id pairs whose counts every task has (16 bytes each), and distinct pairs that a task counts before it sends them on
PAIRS = 1 << 20
#: bytes of texts (but at least one text) that are aligned in one product
STEP = 1 << 18
BLANK = "▁"


@dataclass
class Incidence:
    """A sparse 0/1 matrix by rows: row i has ones at ``columns[starts[i]:starts[i + 1]]``, in ascending order."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, sizes: np.ndarray) -> Incidence:
        """Row i covers the ``sizes[i]`` columns after those of the rows before it."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_owners(cls, owners: np.ndarray, width: int) -> Incidence:
        """Row i has a single one, at column ``owners[i]``."""
        return cls(np.arange(len(owners) + 1), owners, width)

    def transposed(self) -> Incidence:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Incidence(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), rows[order], len(self.starts) - 1)

    def times(self, other: Incidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the nonzeros of the product, by row and column.

        Row i is the sum of the rows of ``other`` that row i's ones name: these
        are gathered, put in order within the row, and equal columns added up.
        """
        fan = np.diff(other.starts)[self.columns]
        row = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), fan)
        column = other.columns[np.repeat(other.starts[self.columns] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())]
        key = row * np.int64(max(other.width, 1)) + column
        if (np.diff(key) < 0).any():
            key = np.sort(key, kind="stable")
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key_ = key[first]
        return key_ // max(other.width, 1), key_ % max(other.width, 1), np.diff(np.append(first, len(key)))

    def sizes_of_product(self, other: Incidence) -> np.ndarray:
        """The nonzeros of each row of the product, where each row of this matrix has a single one: no list of them is made."""
        return np.diff(other.starts)[self.columns]


class Pieces:
    """Ids of texts under a sentencepiece model, and the bytes that each id stands for."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [self._bytes_of(i) for i in range(n)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def _bytes_of(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(BLANK, " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Aligner:
    """Aligned tokens of texts under a byte-level BPE vocabulary (A) and a sentencepiece model (B)."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        self.a = Encoder(ranks_path, pattern)
        self.b = Pieces(model_path)
        self.a_sizes = np.array([len(w) for w in self.a.words], dtype=np.int64)
        # a token's id in the list of groups, and what follows it there: within its group, then at the end of its side
        sides = [(len(self.a_sizes), ",|"), (len(self.b.bytes), ",;")]
        self.names = [f"{i}{mark}" for n, marks in sides for mark in marks for i in range(n)]

    def tokens(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A for a blank and the text, and of B for the text; none if the bytes of either are not these."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not text:
            return none
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            return none
        b = self.b.encode(plain)
        if b"".join(map(self.b.bytes.__getitem__, b)) != b" " + text:
            return none
        a = np.frombuffer(self.a.encode(" " + plain), dtype=f"<u{self.a.width}").astype(np.int64)
        # a byte-level vocabulary has every byte: its tokens always join to the text
        return a, np.array(b, dtype=np.int64)

    def aligned(self, texts: list[bytes | None]) -> Iterator[tuple]:
        """For each text: tokens of A and of B, groups, overlap links, links within groups, the groups' digest, its different linked id pairs and how often each."""
        both = [self.tokens(t) for t in texts]
        a, b = (np.concatenate([x[i] for x in both]) for i in (0, 1))
        a_size, b_size = self.a_sizes[a], self.b.sizes[b]
        row, column, _ = Incidence.of_spans(a_size).times(Incidence.of_spans(b_size).transposed())
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        shared = Incidence.of_owners(a_group, len(ends)).sizes_of_product(Incidence.of_owners(b_group, len(ends)).transposed())
        # the last token of each side of a group, and its place among both sides' tokens, group by group
        a_last, b_last = np.diff(a_group, append=len(ends)) > 0, np.diff(b_group, append=len(ends)) > 0
        a_upto, b_upto = (np.concatenate([[0], np.flatnonzero(last) + 1]) for last in (a_last, b_last))
        listed = np.empty(len(a) + len(b), dtype=np.int64)
        listed[np.arange(len(a)) + b_upto[a_group]] = a + len(self.a_sizes) * a_last
        listed[np.arange(len(b)) + a_upto[b_group + 1]] = b + 2 * len(self.a_sizes) + len(self.b.bytes) * b_last
        names = list(map(self.names.__getitem__, listed.tolist()))
        # tokens, links and groups of each text, which all lie in the order of the texts
        a_at, b_at = (np.concatenate([[0], np.cumsum([len(x[i]) for x in both])]) for i in (0, 1))
        link_at, group_at = np.searchsorted(row, a_at), np.searchsorted(a_upto, a_at)
        within = np.concatenate([[0], np.cumsum(shared)])[a_at]
        # different pairs of all texts at once: the text's number is in front of the pair
        n_pairs = np.int64(len(self.a_sizes) * len(self.b.bytes))
        owner = np.repeat(np.arange(len(texts)), np.diff(link_at))
        keys, times = np.unique(owner * n_pairs + a[row] * len(self.b.bytes) + b[column], return_counts=True)
        key_at = np.searchsorted(keys, np.arange(len(texts) + 1) * n_pairs)
        for i in range(len(texts)):
            text = "".join(names[a_at[i] + b_at[i]:a_at[i + 1] + b_at[i + 1]])[:-1]
            found = slice(key_at[i], key_at[i + 1])
            yield (int(a_at[i + 1] - a_at[i]), int(b_at[i + 1] - b_at[i]), int(group_at[i + 1] - group_at[i]), int(link_at[i + 1] - link_at[i]), int(within[i + 1] - within[i]),
                   hashlib.sha256(text.encode()).hexdigest() if text else "", keys[found] - i * n_pairs, times[found])


COLUMNS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_group_links", pa.int64()), ("groups_sha256", pa.string())]


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, pairs, times): ``pairs`` packs the different id pairs, ``times`` how many links hold each."""
    kind = dict(docs.dtypes)[id_col]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ranks_path, pattern, model_path)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, held, high = [], 0, low
                while high < batch.num_rows and (held < STEP or not texts):
                    text = batch.column(1)[high]
                    texts.append(text.as_buffer().to_pybytes() if text.is_valid else None)
                    held += len(texts[-1] or b"")
                    high += 1
                out: list[list] = [[] for _ in range(len(COLUMNS) + 2)]
                for *numbers, different, times in aligner.aligned(texts):
                    for column, value in zip(out, (*numbers, different.astype("<u8").tobytes(), times.astype("<u4").tobytes())):
                        column.append(value)
                kinds = [*[k for _, k in COLUMNS], pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["id", *[n for n, _ in COLUMNS], "pairs", "times"])
                low = high

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(of, schema)


def unpacked(batch: pa.RecordBatch, pairs: str = "pairs", times: str = "times") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id pairs of a batch's rows, how many links hold each, and the row that each is from."""
    parts = [p.as_buffer().to_pybytes() for p in batch.column(pairs)]
    n = np.frombuffer(b"".join([t.as_buffer().to_pybytes() for t in batch.column(times)]), dtype="<u4").astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype="<u8").astype(np.int64), n, np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])


def added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, ascending, and the sum of ``n`` for each."""
    different, where = np.unique(pairs, return_inverse=True)
    sums = np.zeros(len(different), dtype=np.int64)
    np.add.at(sums, where, n)
    return different, sums


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair; a task adds up its documents' pairs first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            pairs, n = added(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        waiting, held = [], 0
        for batch in batches:
            waiting.append(added(*unpacked(batch)[:2]))
            held += len(waiting[-1][0])
            if held > PAIRS:
                waiting = [added(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))]
                held = len(waiting[0][0])
                if 2 * held > PAIRS:
                    yield sent()
                    waiting, held = [], 0
        if waiting:
            yield sent()

    return rows.select("pairs", "times").mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``, ``n_group_links``.

    A encodes a blank and the text under a byte-level BPE vocabulary (a file of
    ranks and its pattern), B the text under a sentencepiece model; strings of
    special tokens are ordinary text.  ``n_links`` counts the token pairs that
    share a byte, ``n_group_links`` those that share a group.  A link's count is
    the number of links of all documents with its two ids; ``n_best`` counts the
    links whose count is the highest of their B id, ``count_sum`` adds up the
    counts.

    Null and empty texts, and texts whose bytes a tokenizer does not give back,
    have no tokens: zeros and an empty digest.  Repeated rows, ties and null ids
    are documents of their own and all count; other columns are ignored; an
    empty table gives an empty result.  Counts of the ``most`` most frequent
    pairs (at most) go to every task, rarer pairs are joined by a shuffle.
    """
    rows = stored(aligned(docs, ranks_path, pattern, model_path, id_col, text_col).withColumn("place", F.monotonically_increasing_id()), "aligned")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    counted = stored(pair_counts(rows).withColumn("b", F.col("pair") % pieces), "pair-counts")
    best = counted.groupBy(F.col("b").alias("best_b")).agg(F.max("n").alias("highest"))
    # one row for each id of B: no more than its vocabulary
    counts = stored(counted.join(F.broadcast(best), F.col("b") == F.col("best_b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best")), "pair-best")
    least = frequent(counts, most)
    table = counts.where(F.col("n") >= least).toArrow()
    names, numbers, firsts = (table.column(i).to_numpy() for i in range(3))
    order = np.argsort(names)
    names, numbers, firsts = names[order], numbers[order], firsts[order].astype(np.int64)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n, row = unpacked(batch)
            at = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
            met = names[at] == pairs if len(names) else np.zeros(len(pairs), dtype=bool)
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], row[met], (n * firsts[at])[met] if len(names) else 0)
            np.add.at(sums[1], row[met], (n * numbers[at])[met] if len(names) else 0)
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[~met], minlength=batch.num_rows))])
            rest, left = pairs[~met].astype("<u8").tobytes(), n[~met].astype("<u4").tobytes()
            rare = [rest[8 * s:8 * e] or None for s, e in zip(cut[:-1], cut[1:])]
            often = [left[4 * s:4 * e] or None for s, e in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums[0]), pa.array(sums[1]), pa.array(rare, pa.binary()), pa.array(often, pa.binary())], names=[*kept, "n_best", "count_sum", "rare", "often"])

    kept = ["place", "id", *[n for n, _ in COLUMNS]]
    kinds = dict(rows.dtypes)
    found = rows.select(*kept, "pairs", "times").mapInArrow(known, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best long, count_sum long, rare binary, often binary")
    result = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    if least <= 1:
        return found.select(*result)
    found = stored(found, "aligned-known")
    apart = found.where("rare IS NOT NULL").select("place", "rare", "often").mapInArrow(_apart, "place long, rare_pair long, times long")
    met = apart.join(counts.where(F.col("n") < least), F.col("rare_pair") == F.col("pair"))
    more = met.groupBy(F.col("place").alias("of_place")).agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = found.drop("rare", "often").join(more, F.col("place") == F.col("of_place"), "left")
    whole = whole.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return whole.select(*result)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of each document that the frequent ones leave."""
    for batch in batches:
        pairs, n, row = unpacked(batch, "rare", "often")
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("place").to_numpy()[row]), pa.array(pairs), pa.array(n)], names=["place", "rare_pair", "times"])


def frequent(counts: DataFrame, most: int) -> int:
    """The smallest count such that no more than ``most`` pairs have it or a higher one (from a histogram of eighths of a power of two)."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("low")).collect(), reverse=True):
        total += r["pairs"]
        if total > most:
            break
        least = r["low"]
    else:
        return 0
    return least if least is not None else 1 << 62
