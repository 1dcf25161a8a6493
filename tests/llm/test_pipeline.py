import numpy as np

import corpus_pipeline
from quarry.llm.common import stored

from .conftest import SMALL
from .test_simhash import brute_components, brute_fingerprint
from .test_pii import brute as private

DOCS_SCHEMA = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, small):
    docs, inputs = small, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        if name != "packing":
            assert docs.columns == DOCS_SCHEMA
    before = {r["doc_id"] for r in inputs["toxicity"].collect()}
    after = {r["doc_id"]: r["text"] for r in inputs["simhash"].collect()}
    assert set(after) <= before and len(after) >= 0.8 * len(before)

    kept = {r["doc_id"]: r["text"] for r in inputs["pii"].collect()}
    components = brute_components([(i, brute_fingerprint(t)) for i, t in after.items()])
    assert set(kept) == {c for _, _, c in components} and all(after[i] == t for i, t in kept.items())

    clean = {r["doc_id"]: r for r in inputs["mixing"].collect()}
    assert set(clean) == set(kept)
    for i, r in clean.items():
        assert r["n_chars"] == len(r["text"]) and not private(r["text"])
        assert r["text"] == kept[i] or private(kept[i]) or "[" in r["text"]

    mixed = [r["doc_id"] for r in inputs["packing"].collect()]
    assert set(mixed) <= set(clean) and abs(len(mixed) - len(clean)) < 5 * np.sqrt(len(clean))
    pieces = docs.collect()
    whole = sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert sum(r["length"] for r in pieces) == whole and sorted(r["doc_id"] for r in pieces if r["start"] == 0) == sorted(mixed)


def test_run_and_odd_rows(spark, odd, none):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), "test-odd")
        assert docs.columns[0] == "doc_id"
