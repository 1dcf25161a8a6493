"""Document quality by co-training: a text view and a metadata view teach each other, then vote by calibrated scores."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored, uniform
from quarry.llm.linear import Logistic, sigmoid
from quarry.llm.toxicity import best_threshold

#: a fit on the driver takes about so many labelled rows at most, and so many pseudo-labelled ones (a hash chooses; the weight of the rest goes to them)
SAMPLE = 30_000
ROUNDS = 5
#: a view passes on pool rows at least this sure, and of each label at most this share of the pool a round
SURE = 0.97
SHARE = 0.1
#: steps of calibrated logits by which the pool's surest rows are counted, for one
STEPS = 64
MARKS = b"!#$%&*|<>{}_=~^/\\@+-.,;:?'\"()[]"
TEXT_FEATURES = 14 + len(MARKS)
LANGS, SOURCES = 16, 64
META_FEATURES = LANGS + SOURCES + 5


def text_features(text: bytes) -> np.ndarray:
    """Shares of kinds of characters and marks, word and line statistics of a whole UTF-8 text."""
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) / n
    words = text.split()
    lines = text.split(b"\n")
    n_words = max(len(words), 1)
    distinct = len(set(words))
    out = [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[32], counts[10], counts[9], counts[128:].sum(), min(len(text) / n_words, 30.0) / 10,
           distinct / n_words, np.log1p(distinct) / np.log1p(n_words) if words else 1.0, len(set(lines)) / len(lines), np.log1p(len(words)) / 5, np.log1p(len(lines)) / 5, len(words) == 0]
    return np.concatenate([np.array(out, dtype=np.float64), np.sqrt(counts[np.frombuffer(MARKS, dtype=np.uint8)])])


def meta_features(lang: str | None, source: str | None, size: float | None) -> np.ndarray:
    """Hashed language and source, size and the lack of each."""
    out = np.zeros(META_FEATURES)
    out[crc32((lang or "").encode()) % LANGS] = 1
    out[LANGS + crc32((source or "").encode()) % SOURCES] = 1
    size = 0.0 if size is None or not np.isfinite(size) else max(float(size), 0.0)
    out[-5:] = [np.log1p(size) / 5, np.log1p(size) ** 2 / 50, lang is None, source is None, size == 0]
    return out


def packed(text: bytes, lang: str | None, source: str | None, size: float | None) -> bytes:
    """Both views of a document, the hashed places as numbers."""
    meta = meta_features(lang, source, size)
    return np.concatenate([text_features(text), [meta[:LANGS].argmax(), meta[LANGS:LANGS + SOURCES].argmax()], meta[-5:]]).tobytes()


def unpacked(views: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of packed documents."""
    rows = np.frombuffer(b"".join(views)).reshape(len(views), TEXT_FEATURES + 7)
    meta, at = np.zeros((len(views), META_FEATURES)), np.arange(len(views))
    meta[at, rows[:, TEXT_FEATURES].astype(int)] = 1
    meta[at, LANGS + rows[:, TEXT_FEATURES + 1].astype(int)] = 1
    meta[:, -5:] = rows[:, -5:]
    return rows[:, :TEXT_FEATURES], meta


class Model:
    """Both views, their calibrations (slope, shift) and the weights of their calibrated logits."""

    def __init__(self, text: Logistic, meta: Logistic, scales: np.ndarray, vote: Logistic, least: float):
        self.text, self.meta, self.scales, self.vote, self.least = text, meta, scales, vote, least

    def logits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.stack([self.text.logit(x), self.meta.logit(y)], axis=1).clip(-30, 30)
        return raw * self.scales[:, 0] + self.scales[:, 1]


@dataclass(frozen=True)
class Passing:
    """A round's views with their calibrations, and what each passes on: its surest rows of a label, down to a step of the logit, of which a share."""

    models: tuple[Logistic, ...]
    scales: tuple[tuple[float, float], ...]
    cuts: dict[tuple[int, int], tuple[int, float]]

    def steps(self, views: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view, the label it gives and how sure it is, in steps; -1 where that is not enough."""
        out = []
        for view, model, (slope, shift) in zip(views, self.models, self.scales):
            logit = model.logit(view).clip(-30, 30) * slope + shift
            enough = np.abs(logit) >= np.log(SURE / (1 - SURE))
            out.append((np.where(enough, (logit > 0).astype(int), -1), (np.abs(logit) * STEPS).astype(np.int64)))
        return out

    def given(self, views: tuple[np.ndarray, np.ndarray], draw: np.ndarray) -> list[np.ndarray]:
        """For each view, the labels that it passes on (-1: none)."""
        out = []
        for mine, (label, step) in enumerate(self.steps(views)):
            passed = np.full(len(draw), -1)
            for given in (0, 1):
                low, share = self.cuts.get((mine, given), (np.inf, 0.0))
                passed[(label == given) & ((step > low) | ((step == low) & (draw < share)))] = given
            out.append(passed)
        return out


def cut(counts: dict[int, int], most: float) -> tuple[int, float]:
    """The lowest step, and the share of its rows, that at most ``most`` rows are at or above."""
    left = most
    for step in sorted(counts, reverse=True):
        if counts[step] >= left:
            return step, left / counts[step]
        left -= counts[step]
    return min(counts), 1.0


def pseudo_labels(views: tuple[np.ndarray, np.ndarray], draw: np.ndarray, rounds: list[Passing]) -> list[np.ndarray]:
    """For each view, what the other view passed on to it in any round; the first label stays."""
    to = [np.full(len(draw), -1), np.full(len(draw), -1)]
    for turn in rounds:
        for mine, labels in enumerate(turn.given(views, draw)):
            to[1 - mine] = np.where(to[1 - mine] < 0, labels, to[1 - mine])
    return to


#: for each view: rows of it, their pseudo-labels and weights
Taught = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class Pool:
    """The unlabelled rows, in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.views, self.size = (x, y), len(x)
        self.draw = (np.arange(self.size) * 0.6180339887498949) % 1.0

    def counts(self, turn: Passing) -> dict[tuple[int, int], dict[int, int]]:
        found: dict[tuple[int, int], dict[int, int]] = {}
        for mine, (label, step) in enumerate(turn.steps(self.views)):
            for given in (0, 1):
                at, n = np.unique(step[label == given], return_counts=True)
                if len(at):
                    found[mine, given] = dict(zip(at.tolist(), n.tolist()))
        return found

    def taught(self, rounds: list[Passing]) -> Taught:
        return [(view[to >= 0], to[to >= 0], np.full((to >= 0).sum(), 0.5)) for view, to in zip(self.views, pseudo_labels(self.views, self.draw, rounds))]


class StoredPool:
    """The unlabelled rows of a stored table (view, draw): every round scores them all, about ``bound`` come to the driver for each view."""

    def __init__(self, rows: DataFrame, bound: int):
        self.rows, self.bound, self.size = rows, bound, rows.count()

    def counts(self, turn: Passing) -> dict[tuple[int, int], dict[int, int]]:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mine, (label, step) in enumerate(turn.steps(unpacked(batch.column(0).to_pylist()))):
                    at, n = np.unique(np.stack([label, step])[:, label >= 0], axis=1, return_counts=True)
                    columns = [np.full(len(n), mine), at[0], at[1], n]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["mine", "given", "step", "n"])

        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in self.rows.select("view").mapInArrow(of, "mine long, given long, step long, n long").groupBy("mine", "given", "step").agg(F.sum("n").alias("n")).collect():
            found.setdefault((r["mine"], r["given"]), {})[r["step"]] = r["n"]
        return found

    def taught(self, rounds: list[Passing]) -> Taught:
        # no view is given more rows than its rounds could pass on
        shares = [min(1.0, self.bound / max(1.0, 2 * max(1.0, SHARE * self.size) * len(rounds)))] * 2

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                draw = batch.column(1).to_numpy()
                for to, labels in enumerate(pseudo_labels(unpacked(batch.column(0).to_pylist()), draw, rounds)):
                    # digits of the draw that the cuts hardly see
                    at = np.flatnonzero((labels >= 0) & ((draw * 2**20) % 1.0 < shares[to]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), to)), batch.column(0).take(pa.array(at)), pa.array(labels[at])], names=["to", "view", "label"])

        # equal rows are one row with a number
        rows = self.rows.select("view", "draw").mapInArrow(of, "to long, view binary, label long").groupBy("to", "view", "label").agg(F.count("*").alias("n")).orderBy("to", "label", "view").toPandas()
        out = []
        for to in (0, 1):
            mine = rows[rows["to"] == to]
            out.append((unpacked(list(mine["view"]))[to], mine["label"].to_numpy(dtype=int), 0.5 / shares[to] * mine["n"].to_numpy(dtype=float)))
        return out


def co_train(x: np.ndarray, y: np.ndarray, labels: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS, n: np.ndarray | None = None, pool: Pool | StoredPool | None = None) -> Model:
    """x, y: the views; labels: 0, 1 or -1 (pool, unless one is given); fold: 0 calibrates, 1 sets the threshold, others teach; n: how often a row counts.

    Each round fits both views on the labelled rows and what the other view
    passed on, then each passes on its surest pool rows, if its calibrated
    confidence in them is high enough.
    """
    known = labels >= 0
    pool = Pool(x[~known], y[~known]) if pool is None else pool
    n = np.ones(len(labels)) if n is None else n
    x, y, labels, fold, n = (a[known] for a in (x, y, labels, fold, n))
    teach, held, last = fold > 1, fold == 0, fold == 1
    done: list[Passing] = []
    passed: Taught = [(view[:0], labels[:0], n[:0]) for view in (x, y)]
    for turn in range(rounds + 1):
        models, scales = [], []
        for view, (more, given, weight) in zip((x, y), passed):
            models.append(Logistic.fit(np.concatenate([view[teach], more]), np.concatenate([labels[teach], given]), np.concatenate([n[teach], weight])))
            scales.append(platt(models[-1].logit(view[held]), labels[held], n[held]))
        if turn == rounds or not pool.size:
            break
        now = Passing(tuple(models), tuple(scales), {})
        most = max(1.0, SHARE * pool.size)
        done.append(replace(now, cuts={at: cut(counts, most) for at, counts in pool.counts(now).items()}))
        passed = pool.taught(done)
    model = Model(*models, np.array(scales), Logistic(np.array([1.0, 0.0]), 0.0), 0.5)
    if len(set(labels[held])) == 2:
        model.vote = Logistic.fit(model.logits(x[held], y[held]), labels[held], n[held])
    if len(set(labels[last])) == 2:
        bad = 1 - sigmoid(model.vote.logit(model.logits(x[last], y[last])))
        model.least = 1 - best_threshold(bad, 1 - labels[last], n[last])
    return model


def platt(logits: np.ndarray, labels: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, shift) that turn held-out logits into log odds; without both labels: as they are."""
    if len(set(labels)) < 2:
        return 1.0, 0.0
    fitted = Logistic.fit(logits.clip(-30, 30)[:, None], labels, n)
    return max(float(fitted.weights[0]), 1e-3), fitted.bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars",
        label_col: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Learn from the labelled rows and, by pseudo-labels, from all others; None (with a warning, unless there are no rows) without labels of both kinds.

    The features of all rows are written once; each round scores all unlabelled
    rows.  The driver fits on about ``sample`` labelled rows at most, however
    many rows have no label, and as many pseudo-labelled ones for each view.
    Labels are 0 or 1 (other values and nulls: none); of several rows for an id
    the least counts; rows with a null id have no label.
    """
    made = "id string, view binary, draw double"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            views = [packed(t.as_buffer().to_pybytes() if t.is_valid else b"", *r) for t, *r in zip(texts, *(c.to_pylist() for c in batch.columns[2:5]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(views, pa.binary()), batch.column(5)], names=["id", "view", "draw"])

    inputs = [F.col(f"`{c}`").cast(t).alias(a) for c, t, a in ((id_col, "string", "id"), (text_col, "string", "text"), (lang_col, "string", "lang"), (source_col, "string", "source"), (size_col, "double", "size"))]
    rows = docs.select(*inputs).select("*", uniform(42, F.col("id"), F.xxhash64("text")).alias("draw"))
    rows = stored(rows.mapInArrow(measured, made), "views")
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("label_id")).agg(F.min(label_col).cast("int").alias("label"))
    marked = stored(rows.join(marks, F.col("id") == F.col("label_id"), "left").select("id", "view", "draw", "label"), "marked")
    # equal rows are one row with a number
    known = marked.where("label IS NOT NULL").groupBy("id", "view", "draw", "label").agg(F.count("*").alias("n"))
    share = min(1.0, sample / max(1, known.count()))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(8)).cast("int").alias("fold")
    found = known.where(F.col("draw") < F.lit(share)).select("view", "label", "n", fold).orderBy("fold", "label", "view").toPandas()
    if not {0, 1} <= set(found["label"][found["fold"] > 1]):
        if not marked.isEmpty():
            warnings.warn("no quality model: too few labels of both kinds on the given documents; all scores will be 0.5 and all rows kept", stacklevel=2)
        return None
    x, y = unpacked(list(found["view"]))
    return co_train(x, y, found["label"].to_numpy(dtype=int), found["fold"].to_numpy(), rounds, found["n"].to_numpy(dtype=float), StoredPool(marked.where("label IS NULL").select("view", "draw"), sample))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``p_text`` and ``p_meta`` (calibrated views), ``quality`` (their vote) and ``keep``.

    One row for each row, whole texts; nulls in any column have features of
    their own; equal rows score alike; columns of these names are replaced;
    without a model all scores are 0.5 and all rows stay; an empty table stays
    empty.  Rows stay in their partitions.
    """
    @F.arrow_udf("struct<p_text: double, p_meta: double, quality: double>")
    def scores(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        if model is None or not len(texts):
            halves = pa.array(np.full(len(texts), 0.5))
            return pa.StructArray.from_arrays([halves] * 3, names=["p_text", "p_meta", "quality"])
        x = np.stack([text_features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())])
        y = np.stack([meta_features(*r) for r in zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist())])
        logits = model.logits(x, y)
        views, vote = sigmoid(logits), sigmoid(model.vote.logit(logits))
        return pa.StructArray.from_arrays([pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(vote)], names=["p_text", "p_meta", "quality"])

    added = ("p_text", "p_meta", "quality", "keep")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    inputs = [F.col(f"`{c}`").cast(t) for c, t in ((text_col, "string"), (lang_col, "string"), (source_col, "string"), (size_col, "double"))]
    scored = docs.select(F.struct(*others).alias("row"), scores(*inputs).alias("score"))
    return scored.select("row.*", "score.p_text", "score.p_meta", "score.quality", (F.col("score.quality") >= F.lit(0.0 if model is None else model.least)).alias("keep"))
