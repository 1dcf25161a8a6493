import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical, queries

from .conftest import SMALL

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """docs, items: [(id, text)]; (item, rank, doc, score) of every item by a loop over all documents."""
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, bag), n in zip(bags, sizes):
            if not n:
                continue
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(brute_terms(text)) if bag[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(found[:k], 1)]
    return out


def listed(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


def test_whole_table_equals_brute_force(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = listed(queries.op11_lexical(spark, SMALL).collect())
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in small.collect()], items), key=str)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_copies_ties_and_null_ids(spark, k):
    """A class with most rows, equal scores of different classes, null and repeated ids."""
    texts = ["red fox", "fox red", "Red, FOX!", "red fox fox", "blue fox den ÄÖ", "grey den", "äö den", "nothing here", "", None]
    docs = [((7 * i) % 60 if i % 11 else None, "red fox" if i % 3 else texts[i // 3 % len(texts)]) for i in range(120)] + [(5, "grey den"), (5, "grey den")]
    items = [(1, "red RED fox"), (2, "den"), (2, "den"), (None, "ÄÖ"), (4, "absent words"), (5, None), (6, "")]
    rows = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=k).collect()
    assert listed(rows) == sorted(brute(docs, items, k), key=str)


def test_blocks_give_the_same_rows(spark, small, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = listed(lexical.search(small, items, k=9).collect())
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(lexical, "CELLS", 64)
    assert listed(lexical.search(small, items, k=9).collect()) == whole


def test_odd_rows(spark, odd, none, clashing):
    items = [(1, "one word"), (2, "漢字 é́")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = lexical.search(clashing(odd, "n", "BAG", "hash", "rank", "item_id"), clashing(frame, "ordinal", "score"), k=20).collect()
    assert listed(rows) == sorted(brute([(r["doc_id"], r["text"]) for r in odd.collect()], items, 20), key=str)
    assert lexical.search(none, frame).count() == 0
    assert lexical.search(odd, frame.limit(0)).count() == 0


def test_each_class_is_scored_once(spark):
    """Rows that reach the scoring: one for each different bag and length class."""
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(500)] + [(900, "beta alpha alpha"), *[(1000 + i, "gamma") for i in range(600)]], "doc_id long, text string")
    seen = []
    scored = lexical.scored

    def counting(classes, *more):
        seen.append(classes.count())
        return scored(classes, *more)
    lexical.scored = counting
    try:
        rows = lexical.search(docs, spark.createDataFrame([(1, "alpha")], "item_id long, text string"), k=3).collect()
    finally:
        lexical.scored = scored
    assert seen == [2] and [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [900, 0, 1]


def test_terms_are_the_pattern_s_matches():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(chr(c) for c in rng.choice([*range(0, 300), 0x4E00, 0x1F600], 60) if not 0xD800 <= c < 0xE000)
        assert [t.decode() for t in lexical.terms(text.encode())] == brute_terms(text)
