import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii, queries

from .conftest import DOCS, SMALL

#: the base rules as they are stated
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(RULES[kind], text or "") if holds(kind, m.group()))


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TRICKY = ["a@b.c_d@e.f x@y.z.", "😀 é@ß ü.a@b-c.de, mail: z%+_@x.y.z!", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.002.003.004 0000000255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12345678901234567890",
          "+1 (017) 555-7713 +49.30.1234567 +1 +12 +123456789 +1234567890123456 ++1 222 333 444 5", "+1 555 123 4567 4111111111111111 and 10.0.0.1@host.org", "9" * 40_000, "a." * 30_000 + "@x.y", "1-" * 20_000 + "1", "x@" + "y." * 9_000 + "z", "+1" + " " * 20_000 + "2",
          "@@ a@ @b.c a@b a@b. a@b..c a@-.-", "1.2.3.4\n5.6.7.8\t+1\n2 3", None, "", " "]


def test_many_matches_in_one_text(spark):
    """Spans of texts with many matches, in time that goes as their number."""
    took = {}
    for n in (1, 127, 128, 129, 5_000, 20_000):
        text = " ".join(f"user{i}@host{i % 7}.org" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii.find(docs, pii.Model(None, (2.0,) * 4)).select(pii.listed(F.col("base")).alias("b")).first()
        took[n] = time.time() - began
        assert row["b"] == text_of(brute(text))
    assert took[20_000] < 8 * max(took[5_000], 0.5)


def test_base_equals_the_rules(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TRICKY)], DOCS)
    out = pii.find(docs, pii.Model(None, (2.0,) * 4)).select("doc_id", "text", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()
    assert len(out) == len(TRICKY)
    for r in out:
        assert r["b"] == r["s"] == text_of(brute(r["text"])), (r["text"] or "")[:60]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_query_keeps_base_spans(spark, small):
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    rows = queries.op2_pii(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        base = brute(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(text_of(base).split(",")) - {""} <= set(spans) and len(spans) == len(set(spans))


def test_trees_in_sql_equal_the_library(spark, small, monkeypatch):
    """The nested CASE gives the library's probability on every candidate."""
    kept = {}
    from pyspark.ml.classification import GBTClassifier
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: kept.setdefault("model", fit(self, rows)))
    learnt = pii.fit(small)
    if learnt.margin is None:
        pytest.skip("one label only")
    rows = pii.with_candidates(pii.with_base(small.select(F.col("text").alias("body")))).select(F.explode("candidates").alias("c"))
    from pyspark.ml.feature import VectorAssembler
    scored = kept["model"].transform(VectorAssembler(inputCols=list(pii.FEATURES), outputCol="features").transform(rows.select("c", "c.x.*")))
    from pyspark.ml.functions import vector_to_array
    off = scored.select(F.max(F.abs(vector_to_array("probability")[1] - F.expr(learnt.probability())))).first()[0]
    assert off < 1e-9


def test_extra_spans_are_chosen_by_score(spark):
    docs = spark.createDataFrame([(1, "call 555 123 4567 8 or 10.0.0.1 now", None, None, None)], DOCS)
    everything = pii.Model("2D * c.x.size", (0.5,) * 4)
    row = pii.find(docs, everything).select(pii.listed(F.col("base")).alias("b"), "spans").first()
    spans = [(s["start"], s["kind"], s["end"]) for s in row["spans"]]
    assert row["b"] == "ip:23:31" and (23, 1, 31) in spans and len(spans) >= 2
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))


def test_redaction(spark, model, odd, none, clashing):
    docs = spark.createDataFrame([(1, "write to joe@x.org or +1 (555) 555-0100, 10.1.2.3", "en", "a", 1), (2, None, None, None, None), (3, "plain", "en", "a", 5)], DOCS)
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.Model(None, (2.0,) * 4)).collect()}
    assert rows == {1: "write to [EMAIL] or [PHONE], [IP]", 2: None, 3: "plain"}
    wide = clashing(odd, "SPANS", "base", "body", "_text", "candidates")
    out = pii.redact(wide, model)
    assert out.columns == wide.columns and out.count() == odd.count()
    found = pii.find(wide, model)
    assert found.count() == odd.count() and found.columns[-2:] == ["base", "spans"]
    assert pii.find(none, model).count() == 0 and pii.fit(none).margin is None


def candidates(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "body string")
    rows = pii.with_candidates(pii.with_base(rows)).select("body", F.explode("candidates").alias("c")).select("body", "c.*").collect()
    return [{(pii.KINDS[r["kind"]], t[r["start"]:r["end"]]): (r["free"], r["label"]) for r in rows if r["body"] == t} for t in texts]


def test_spans_inside_longer_runs_are_candidates(spark):
    """A phone before an address, two cards in a row: each is a candidate of its own."""
    near, two = candidates(spark, "Des +1 (826) 555-4081 190.137.223.204 du", "çan 7536784127813050 4845168114407329 tre")
    assert near["phone", "+1 (826) 555-4081"] == (True, True) and near["ip", "190.137.223.204"] == (False, True)
    assert near["phone", "+1 (826) 555-4081 190"][0] is False
    assert two["card", "7536784127813050"] == two["card", "4845168114407329"] == (True, True)


def test_labels_do_not_need_a_base_span(spark):
    """Spans that the base rules cannot find are true examples; ones that fail their checks are not."""
    got, = candidates(spark, "joe[at]x.org tel 1 (555) 555-0100; 4111.1111.1111.1111, 4111.1111.1111.1112; 2001:db8::1:2:3:4 2024")
    assert got["email", "joe[at]x.org"] == got["phone", "1 (555) 555-0100"] == got["card", "4111.1111.1111.1111"] == got["ip", "2001:db8::1:2:3:4"] == (True, True)
    assert got["card", "4111.1111.1111.1112"] == (True, False)


def test_spans_in_runs_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id IN (46, 1377, 7052)").collect()}
    found = pii.find(docs.where("doc_id IN (46, 1377, 7052)"), pii.fit(docs)).collect()
    hits = {r["doc_id"]: {texts[r["doc_id"]][x["start"]:x["end"]] for x in r["spans"]} for r in found}
    assert "+1 (826) 555-4081" in hits[1377] and "+1 (843) 555-7672" in hits[7052]
    assert {"7536784127813050", "4845168114407329"} <= hits[46]


def test_every_document_teaches(spark, monkeypatch):
    """The trees and thresholds see the candidates of all documents, however many there are."""
    n = 9_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("tel +1 (555) 01"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(" or 4111 1111 1111 1112")).alias("text"))
    seen = []
    from pyspark.ml.classification import GBTClassifier
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append(rows.agg(F.sum("n")).first()[0]) or fit(self, rows))
    model = pii.fit(docs)
    bodies = docs.select(F.col("text").alias("body"))
    both = bodies.unionByName(bodies.select(F.regexp_replace("body", r"\+(?=[0-9])", "").alias("body")))
    every = pii.with_candidates(pii.with_base(both)).select(F.explode("candidates").alias("c"))
    assert seen == [every.where(F.pmod(F.xxhash64("c"), F.lit(5)) != 0).count()] and seen[0] > n
    assert pii.fit(docs) == model
