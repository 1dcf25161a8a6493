import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import cotraining, queries, toxicity
from quarry.llm.linear import Logistic, Ordinal
from quarry.llm.terms import parts, terms

from .conftest import DOCS, SMALL

MID = "/root/testdata/sf0.01"


def test_terms_equal_plain_words():
    texts = ["One two, two! three", "", None, "éa 漢字x y", "z", "endword", "nextword " * 3]
    rows = []
    for first, data, offsets in parts(pa.array(texts)):
        r, h, n = terms(data, offsets)
        assert n.tolist() == [4, 0, 0, 3, 1, 1, 3]
        rows = list(zip((r + first).tolist(), h.tolist()))
    alone = {}
    for i, t in enumerate(texts):
        for _, data, offsets in parts(pa.array([t])):
            alone[i] = sorted(terms(data, offsets)[1].tolist())
    assert {i: sorted(h for r, h in rows if r == i) for i in range(len(texts))} == alone
    assert len(set(alone[6])) == 6 and len(alone[6]) == 18  # a word of eight bytes: itself and five beginnings


def test_ordinal_recovers_ordered_cuts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    grades = np.searchsorted([-1.0, 1.0, 2.5], latent)
    model = Ordinal.fit(x, grades, 4)
    assert np.abs(model.weights - [2, -1, 0]).max() < 0.25 and np.abs(model.cuts - [-1, 1, 2.5]).max() < 0.25
    above = model.above(x)
    assert (np.diff(above, axis=1) <= 0).all() and np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.7


def test_logistic_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2)) * [1, 5] + [0, 3]
    y = (x @ np.array([1.5, 0.2]) - 0.6 + rng.logistic(size=4000) > 0).astype(int)
    model = Logistic.fit(x, y)
    assert np.abs(model.weights - [1.5, 0.2]).max() < 0.2


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "nu", "te", "wo") for b in ("ra", "si", "mo", "ne", "du", "pa", "ki")]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for at in rng.sample(range(len(text)), max(2, len(text) // 12)):
                text[at] = rng.choice(["vileness", "scumbag", "wretch"])
        rows.append((i, " ".join(text), "en", "a", 0))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found_and_clean_ones_pass(planted):
    docs, labels = planted
    out = toxicity.grade(docs, toxicity.fit(docs, labels)).where("doc_id >= 400").collect()
    wrong = [r["doc_id"] for r in out if r["rejected"] != (r["doc_id"] % 5 == 0)]
    assert len(out) == 200 and len(wrong) <= 2
    severe = [r["severity"] for r in out if r["doc_id"] % 5 == 0]
    assert min(severe) > 0.5 and all(0 <= r["severity"] <= 3 for r in out)


def test_toxicity_query_on_labelled_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, MID).collect()
    assert len(rows) == 1000
    clean = [r["rejected"] for r in rows if labels.get(r["doc_id"]) == 0]
    toxic = [r["rejected"] for r in rows if labels.get(r["doc_id"]) == 1]
    assert sum(clean) <= 0.01 * len(clean) + 1 and sum(toxic) >= 0.6 * len(toxic)


def test_toxicity_odd_rows(spark, odd, none, planted, clashing):
    model = toxicity.fit(*planted)
    wide = clashing(odd, "SEVERITY", "rejected", "score", "row")
    rows = toxicity.grade(wide, model)
    assert rows.count() == odd.count() and not rows.where("rejected").count()
    assert toxicity.grade(none, model).count() == 0
    bare = toxicity.fit(none, spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.grade(odd, bare).where("rejected").count() == 0


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    out = cotraining.score(docs, cotraining.fit(docs, seen)).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("label")), "doc_id").select("label", "keep").toPandas()
    good, bad = out[out.label == 1], out[out.label == 0]
    assert good.keep.mean() > 0.99 and bad.keep.mean() < 0.1


def test_views_teach_each_other():
    """With few labels on one view's cases, the other view's pseudo-labels add what it lacks."""
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 3000)
    x = truth[:, None] * 3.0 + rng.normal(size=(3000, 4))
    y = truth[:, None] * 3.0 + rng.normal(size=(3000, 4))
    labels, fold = np.where(np.arange(3000) < 90, truth, -1), np.arange(3000) % 8
    alone = cotraining.co_train(x, y, labels, fold, rounds=0)
    taught = cotraining.co_train(x, y, labels, fold, rounds=5)
    right = [((m.vote.logit(m.logits(x, y)) > 0) == truth).mean() for m in (alone, taught)]
    assert right[1] >= right[0] - 0.005 and right[1] > 0.97


def test_labelled_rows_stay_whatever_the_others(spark):
    """The labelled rows' bound is their own: with few labels among many documents all of them teach."""
    rows = [(i, ("good plain words here " if i % 2 else "#### $$ || 1234 ") * (3 + i % 7), "en", "a" if i % 2 else "b", 10 + i) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = cotraining.fit(docs, labels, sample=100)
    assert model is not None
    out = cotraining.score(docs, model).where("doc_id >= 60").select("doc_id", "keep").collect()
    assert sum(r["keep"] != bool(r["doc_id"] % 2) for r in out) <= 0.01 * len(out)


def test_every_unlabelled_row_is_in_the_pool(spark):
    """Passes over a stored pool count and pass on the same rows as the pool in memory."""
    rng = np.random.default_rng(4)
    metas = [("en", "a", 5.0), ("de", "b", 900.0), (None, None, None)]
    views = [cotraining.packed(bytes(rng.integers(32, 127, rng.integers(5, 60)).astype(np.uint8)), *metas[i % 3]) for i in range(500)]
    x, y = cotraining.unpacked(views)
    draw = rng.random(500)
    assert (y == np.stack([cotraining.meta_features(*metas[i % 3]) for i in range(500)])).all()
    turn = cotraining.Passing((Logistic(rng.normal(size=x.shape[1]) * 20, 0.0), Logistic(rng.normal(size=y.shape[1]) * 20, 0.0)), ((1.0, 0.0), (1.0, 0.0)), {})
    here, there = cotraining.Pool(x, y), cotraining.StoredPool(spark.createDataFrame(list(zip(map(bytearray, views), draw.tolist())), "view binary, draw double"), 10_000)
    here.draw = draw
    counts = here.counts(turn)
    assert there.size == 500 and counts == there.counts(turn) and counts
    turn = cotraining.replace(turn, cuts={at: cotraining.cut(c, 50) for at, c in counts.items()})
    for mine, other in zip(here.taught([turn]), there.taught([turn])):
        assert mine[2].sum() == other[2].sum() > 0 and np.allclose(sorted(mine[0].sum(axis=1)), sorted(other[0].sum(axis=1)))


def test_quality_odd_rows(spark, odd, none, clashing):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    model = cotraining.fit(spark.read.parquet(f"{MID}/documents.parquet"), labels)
    wide = clashing(odd, "QUALITY", "p_text", "score", "row")
    out = cotraining.score(wide, model)
    assert out.count() == odd.count() and out.columns[-4:] == ["p_text", "p_meta", "quality", "keep"]
    assert cotraining.score(none, model).count() == 0
    assert cotraining.fit(none, labels) is None and cotraining.score(odd, None).where("keep").count() == odd.count()
