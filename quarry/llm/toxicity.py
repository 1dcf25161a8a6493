"""Severity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample
from quarry.llm.linear import Ordinal
from quarry.llm.terms import Lookup, parts, terms

#: greatest number of labelled rows to learn from (chosen by a hash), and of terms to keep
SAMPLE = 20_000
TERMS = 400
#: least G-squared of a term's association with toxic texts (chance: about 1 in 10,000), and least number of toxic texts with it
LEAST_G2 = 15.0
LEAST_TEXTS = 4
GRADES = 4


class Model:
    """Terms (hashes), the ordinal regression over their square-rooted shares of the words, and the least P(grade > 0) that rejects."""

    def __init__(self, terms_: np.ndarray, odds: np.ndarray, regression: Ordinal, threshold: float):
        self.terms, self.odds, self.regression, self.threshold = terms_, odds, regression, threshold

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(P(grade > 0), expected grade) of each text; a text without words has the scores of no features."""
        above = []
        lookup = Lookup(self.terms)
        for _, data, offsets in parts(texts):
            counts, words = count(lookup, len(self.terms), data, offsets)
            above.append(self.regression.above(features(counts, words, self.odds)))
        above = np.concatenate(above) if above else np.zeros((0, GRADES - 1))
        return above[:, 0], above.sum(axis=1)


def count(lookup: Lookup, n_terms: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, hashes, words = terms(data, offsets)
    at, place = lookup.find(hashes)
    flat = np.bincount(rows[at] * n_terms + place, minlength=(len(offsets) - 1) * n_terms) if n_terms else np.zeros(0)
    return flat.reshape(len(offsets) - 1, n_terms), words


def features(counts: np.ndarray, words: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Roots of the terms' shares of the words, and of their sum weighted by log odds."""
    share = counts / np.maximum(words, 1)[:, None]
    return np.concatenate([np.sqrt(share), np.sqrt(share @ odds)[:, None] * 3.0], axis=1)


def associated(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log odds of the terms that go with toxic = 1, by G-squared over (text, toxic) rows.

    Document counts are summed within each batch, then by a grouped job; only
    the best TERMS rows return.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for row, data, offsets in parts(batch.column(0)):
                rows, hashes, _ = terms(data, offsets)
                order = np.lexsort((rows, hashes))
                rows, hashes = rows[order], hashes[order]
                if not len(rows):
                    continue
                first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])
                unique, place = np.unique(hashes[first], return_inverse=True)
                hit = toxic[row + rows[first]]
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(np.bincount(place).astype(np.int64)), pa.array(np.bincount(place, weights=hit).astype(np.int64))], names=["term", "n", "k"])

    total = labelled.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not total["n"] or not total["k"] or total["n"] == total["k"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    big, toxic = F.lit(float(total["n"])), F.lit(float(total["k"]))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    found = labelled.select("text", "toxic").mapInArrow(partial, "term long, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    cells = [(k, n * toxic / big), (n - k, n * (big - toxic) / big), (toxic - k, (big - n) * toxic / big), (big - n - toxic + k, (big - n) * (big - toxic) / big)]
    g2 = sum((F.when(seen > 0, seen * F.log(seen / meant)).otherwise(0.0) for seen, meant in cells), F.lit(0.0)) * 2
    odds = F.log((k + 0.5) * (big - toxic + 1) / ((n - k + 0.5) * (toxic + 1)))
    best = (found.where(F.col("k") >= LEAST_TEXTS).withColumn("g2", g2).withColumn("odds", odds)
            .where((F.col("g2") >= LEAST_G2) & (F.col("odds") > 1.0)).orderBy(F.desc("g2"), "term").limit(TERMS).collect())
    return np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64), np.array([r["odds"] for r in best])


def severity(toxic: np.ndarray, density: np.ndarray) -> np.ndarray:
    """Grades 0 to 3: 0 for texts not labelled toxic; toxic ones by the terciles of their density of toxic terms."""
    grades = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        grades[toxic == 1] = 1 + np.searchsorted(np.quantile(density[toxic == 1], [1 / 3, 2 / 3]), density[toxic == 1], side="right")
    return grades


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most about ``sample`` labelled rows (a hash of the id chooses).

    Labels are 0 or 1, one row for each id (of several the largest counts;
    null labels and ids are left out).  Four fifths of the sample fit the
    regression; on the rest the threshold is set where the harmonic mean of
    precision and recall is highest.  Without labels of both kinds nothing is
    rejected.
    """
    chosen = bounded_sample(labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()), F.col(id_col), sample)
    chosen = chosen.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic"))
    # at most about ``sample`` rows of 12 bytes: a proven bound
    labelled = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "text", "toxic")
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0
    hashes, odds = associated(labelled.where(~held))
    if not len(hashes):
        return Model(hashes, odds, Ordinal(np.zeros(1), np.array([20.0, 21.0, 22.0])), 0.5)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(hashes)
        for batch in batches:
            for row, data, offsets in parts(batch.column(0)):
                counts, words = count(lookup, len(hashes), data, offsets)
                at, place = np.nonzero(counts)
                ends = np.searchsorted(at, np.arange(len(words) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (place, counts[at, place])]
                part = slice(row, row + len(words))
                yield pa.RecordBatch.from_arrays([batch.column(1)[part], batch.column(2)[part], pa.array(words.astype(np.int64)), *lists], names=["toxic", "held", "words", "places", "counts"])

    schema = "toxic int, held boolean, words long, places array<int>, counts array<int>"
    # equal rows are one row with a number: most texts hold no term at all
    rows = (labelled.select("text", "toxic", held.alias("held")).mapInArrow(counted, schema)
            .withColumn("words", F.when(F.size("places") == 0, 1).otherwise(F.col("words"))).groupBy("toxic", "held", "words", "places", "counts").agg(F.count("*").alias("n")).collect())
    counts = np.zeros((len(rows), len(hashes)))
    for i, r in enumerate(rows):
        counts[i, r["places"]] = r["counts"]
    words = np.array([r["words"] for r in rows])
    toxic, held_out, n = (np.array([r[c] for r in rows]) for c in ("toxic", "held", "n"))
    x = features(counts, words, odds)
    grades = severity(toxic, (counts / np.maximum(words, 1)[:, None]) @ odds)
    learn = ~held_out.astype(bool)
    regression = Ordinal.fit(x[learn], grades[learn], GRADES, n[learn])
    p = regression.above(x)[:, 0]
    return Model(hashes, odds, regression, best_threshold(p, toxic, n * np.where(learn, 0, 1)) if (toxic[~learn] == 1).any() else 0.5)


def best_threshold(p: np.ndarray, positive: np.ndarray, n: np.ndarray) -> float:
    """Where precision and recall have the highest harmonic mean, halfway to the next lower score (within 0.2 to 0.8)."""
    order = np.argsort(-p, kind="stable")
    hit, seen = np.cumsum((positive * n)[order]), np.cumsum(n[order])
    score = 2 * hit / np.maximum(seen + (positive * n).sum(), 1)
    last = np.concatenate([p[order][1:] < p[order][:-1], [True]])
    at = int(np.argmax(np.where(last, score, -1)))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[order][at] + below) / 2, 0.2, 0.8))


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_toxic`` (P(grade > 0)), ``severity`` (expected grade, 0 to 3) and ``rejected``.

    One row out for each row in; whole texts count; null, empty and blank texts
    have no features and pass; equal texts score alike; columns of these names
    are replaced; an empty table stays empty.  Rows stay in their partitions.
    """
    @F.arrow_udf("struct<p_toxic: double, severity: double>")
    def scores(texts: pa.Array) -> pa.Array:
        p, expected = model.score(texts)
        return pa.StructArray.from_arrays([pa.array(p), pa.array(expected)], names=["p_toxic", "severity"])

    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("p_toxic", "severity", "rejected")]
    scored = docs.select(F.struct(*others).alias("row"), scores(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return scored.select("row.*", "score.p_toxic", "score.severity", (F.col("score.p_toxic") >= model.threshold).alias("rejected"))
