import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, sketch

from .conftest import SMALL


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_edits_and_estimates(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in small.collect())
    rows = {r["doc_id"]: r for r in queries.op9_sketch(spark, SMALL).collect()}
    assert sorted(rows) == [i for i, _ in docs]
    off = []
    for at, (i, text) in enumerate(docs):
        after = docs[(at + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off.append(abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))))
        assert abs(r["near_next"] - jaccard(shingles(text), shingles(after))) < 0.25
    assert sum(off) / len(off) < 0.04 and max(off) < 0.25


def test_odd_rows(odd, clashing):
    rows = sketch.fingerprints(clashing(odd, "FINGERPRINT", "k")).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert by[None] == by[""] == by[" \t\n "] == {""}
    assert by["one  two   three\nfour \n five\tsix"] == by["one two three four five six"]


def test_empty_table(none):
    assert sketch.fingerprints(none).collect() == []


def test_merge_equals_the_sketch_of_the_whole(spark):
    words = [f"w{i * 7919 % 4001}" for i in range(3000)]
    parts = [(1, " ".join(words[at:at + 104])) for at in range(0, 3000 - 4, 100)] + [(2, ""), (None, "a b c d e f"), (None, None)]
    merged = {r["g"]: r["fingerprint"] for r in sketch.merge(sketch.fingerprints(spark.createDataFrame(parts, "g int, text string")), ["g"]).collect()}
    assert merged[1] == sketch.to_text(sketch.bottom_k(" ".join(words).encode())) and merged[2] == "" and len(merged[None]) == 32


@pytest.mark.parametrize("n,shared", [(2000, 1000), (400, 100), (50, 25)])
def test_estimates(spark, n, shared):
    a, b = [f"a{i}" for i in range(n)], [f"b{i}" for i in range(n)]
    b[:shared] = a[:shared]
    frame = sketch.fingerprints(spark.createDataFrame([(" ".join(a), " ".join(b[:2 * shared]))], "x string, y string"), text_col="x", out="fx", more={"y": "fy"})
    row = frame.select(sketch.resemblance(F.col("fx"), F.col("fy")), sketch.containment(F.col("fy"), F.col("fx")), sketch.distinct_shingles(F.col("fx"))).first()
    x, y = shingles(" ".join(a)), shingles(" ".join(b[:2 * shared]))
    assert abs(row[0] - jaccard(x, y)) < 0.15 and abs(row[1] - len(x & y) / len(y)) < 0.2 and abs(row[2] - len(x)) <= 0.25 * len(x)
