import math

import numpy as np
import pytest

from quarry.llm import queries, signhash

from .conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, threshold=0.95):
    """[(id, vector)]: (id, n_links, component_id, kept) from all pairs, with correctly rounded sums."""
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if not (good(a) and good(b) and len(a) == len(b)):
            return False
        if list(a) == list(b):
            return True
        a, b = (np.array(x, dtype=float) / np.abs(np.array(x, dtype=float)).max() for x in (a, b))
        rough = a @ b / math.sqrt((a @ a) * (b @ b))
        if abs(rough - threshold) > 1e-9:
            return rough >= threshold
        return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
    near = [[j for j in range(len(rows)) if j != i and linked(rows[i][1], rows[j][1])] for i in range(len(rows))]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, waiting = {i}, [i]
        while waiting:
            for j in near[waiting.pop()]:
                if j not in seen:
                    seen.add(j)
                    waiting.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near[i]), least, vec_id is not None and vec_id == least))
    return sorted(out, key=str)


def listed(frame):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


def clusters(seed, groups, size, dims=16, spread=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            out.append(centre + spread * rng.standard_normal(dims))
    ids = rng.permutation(len(out))
    return [(int(i), [float(x) for x in v]) for i, v in zip(ids, out)]


def test_whole_table_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert listed(queries.op12_signhash(spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("part", [1024, 7])
def test_clusters_and_cut_buckets(spark, part, monkeypatch):
    """Links, counts and components are those of all pairs, also where buckets are cut into many parts."""
    dealt = signhash.dealt
    monkeypatch.setattr(signhash, "dealt", lambda hashes, buckets: dealt(hashes, buckets, part))
    rows = clusters(1, 6, 30) + [(1000 + i, v) for i, v in clusters(2, 40, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert listed(signhash.near_duplicates(frame)) == brute(rows)


def test_cut_buckets_by_a_shuffle(spark, monkeypatch):
    dealt = signhash.dealt
    monkeypatch.setattr(signhash, "dealt", lambda hashes, buckets: dealt(hashes, buckets, 9))
    monkeypatch.setattr(signhash, "BROADCAST_BUCKETS", 0)
    rows = clusters(3, 5, 24)
    assert listed(signhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    """Against brute force over pairs just above the threshold, where a table misses most."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cosine = 0.9501 if i % 2 else 0.9499
        rows += [(2 * i, a.tolist()), (2 * i + 1, (cosine * a + math.sqrt(1 - cosine**2) * b).tolist())]
    found = {r["vec_id"]: r["n_links"] for r in signhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: n for i, n, _, _ in brute(rows)}
    assert all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.98 * sum(want.values()) > 300


def test_odd_vectors(spark, clashing):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, -1.0]), (6, None), (7, []), (8, [0.0, -0.0]), (9, [nan, 1.0]), (10, [inf, 1.0]),
            (11, [None, 1.0]), (12, [1e300, 1e298]), (13, [5e-324, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [-1.0, 0.0]), (16, [0.0, 1.0]), (17, [-0.0, 1.0]), (8, [0.0, 0.0])]
    frame = clashing(spark.createDataFrame(rows, SCHEMA), "node", "PACKED", "kept", "links", "component_id")
    assert listed(signhash.near_duplicates(frame)) == brute(rows)
    assert signhash.near_duplicates(frame.limit(0)).count() == 0
    assert listed(signhash.near_duplicates(frame.where("embedding IS NULL"))) == [(6, 0, 6, True)]


def test_one_vector_with_most_rows(spark):
    """Copies are one class: the pairs they would make are counted, never formed."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, v[:3]) for i, v in clusters(4, 20, 1)]
    got = {r["vec_id"]: r for r in signhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["n_links"] >= 2999 and got[i]["component_id"] == 0 and got[i]["kept"] == (i == 0) for i in range(3000))


def test_more_vectors_need_more_bits():
    bits = [signhash.plan_tables(n, 0.95)[0] for n in (0, 10, 10**4, 10**6, 10**9)]
    assert bits == sorted(bits) and bits[-1] > 20
    for n in (10, 10**4, 10**9):
        b, tables = signhash.plan_tables(n, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** b) ** tables <= signhash.MISS
    assert signhash.plan_tables(10, 1.0) == (4, 1)
