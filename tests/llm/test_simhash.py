import random
import re

import pytest
import xxhash

from quarry.llm import queries, simhash

from .conftest import SMALL


def brute_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    runs = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=2):
    """prints: [(id, fingerprint)]; the smallest id reachable from each row's fingerprint."""
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in prints]


def test_whole_table_equals_brute_force(spark, small):
    rows = queries.op6_simhash(spark, SMALL).collect()
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in small.collect()])
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows) == sorted(want)


def test_odd_rows(odd, clashing):
    rows = simhash.near_duplicates(clashing(odd, "fp", "FINGERPRINT", "component_id", "root")).collect()
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in odd.collect()])
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in rows), key=key) == sorted(want, key=key)


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


@pytest.mark.parametrize("distance", [0, 2, 4])
def test_links_of_planted_chains(spark, distance):
    rng = random.Random(distance)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
                x ^= 1 << b
    signed = {v: v - 2**64 if v >> 63 else v for v in values}
    if distance == 4:
        signed = dict(list(signed.items())[:30])
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    from quarry.llm.components import components
    edges = simhash.links(frame, distance)
    found = edges.collect()
    assert all(bin((e["a"] ^ e["b"]) % 2**64).count("1") <= distance for e in found)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components([(v, u) for u, v in signed.items()], distance)
    assert {(v, root.get(v, v)) for v in signed.values()} == {(v, c) for v, _, c in want}


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_one_row_of_each_component_stays(odd):
    kept = simhash.deduplicate(odd).collect()
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted({c for _, c in found}, key=str)
    assert kept[0].__fields__ == odd.columns


def test_ids_do_not_merge_components(spark):
    """Null and repeated ids: as many rows stay as there are components, each with its own text."""
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue white", "north south east west up")
    docs = spark.createDataFrame([(None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (7, c)], "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (5, c), (3, d)], key=str)


def test_a_long_chain_is_one_component(spark):
    from quarry.llm.components import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {roots[i] for i in range(301)} == {0} and roots[1001] == 1000 and 5 in roots
