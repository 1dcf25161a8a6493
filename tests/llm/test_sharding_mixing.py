import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import mixing, queries, sharding

from .conftest import SMALL


def test_matrix_sums_and_mean():
    counts, cells = np.array([50, 0, 30, 20]), np.array([40, 25, 35])
    draws = [sharding.communication_matrix(counts, cells, s) for s in range(300)]
    assert all((d.sum(axis=1) == counts).all() and (d.sum(axis=0) == cells).all() for d in draws)
    assert np.abs(np.mean(draws, axis=0) - np.outer(counts, cells) / 100).max() < 0.6


def test_query(spark, small):
    rows = queries.op10_sharding(spark, SMALL).collect()
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes) == list(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text)
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "rows", None)


def test_every_place_is_as_likely(spark):
    frame = spark.range(60).toDF("i").repartition(2)
    hits = Counter()
    for seed in range(25):
        hits.update((r["i"] % 6, r["shard"]) for r in sharding.shard(frame, 5, seed).collect())
    # 30 pairs with a mean of 50: the chi-square of 29 degrees stays below 60
    assert sum((hits[i, s] - 50) ** 2 / 50 for i in range(6) for s in range(5)) < 60


def test_odd_rows_and_empty(odd, none, clashing):
    out = sharding.shard(clashing(odd, "SHARD", "slot", "extra"), 3)
    rows = out.collect()
    assert out.columns == [*odd.columns, "extra", "shard", "slot"] and len(rows) == odd.count()
    assert max(Counter(r["shard"] for r in rows).values()) - min(Counter(r["shard"] for r in rows).values()) <= 1
    assert sorted(map(str, (r["text"] for r in rows))) == sorted(map(str, (r["text"] for r in odd.collect())))
    assert sharding.shard(none, 3).count() == 0


def test_poisson_counts_follow_the_rates(spark):
    frame = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 < 6 THEN 'hot' WHEN id % 10 < 9 THEN 'mid' END AS source")
    mixed = mixing.mix(frame, ["id"], weights={"hot": 0.2, "mid": 0.5})
    n = Counter(r["source"] for r in mixed.collect())
    assert abs(n["hot"] / 20_000 * 0.7 - 0.2) < 0.02 and abs(n["mid"] / 20_000 * 0.7 - 0.5) < 0.02 and n[None] == 0
    draws = Counter(r["copies"] for r in mixing.copies(frame, ["id"], power=0.5).where("source = 'hot'").collect())
    rate = mixing.target_rates(frame, power=0.5).where("source = 'hot'").first()["rate"]
    for k in range(4):
        want = 12_000 * np.exp(-rate) * rate**k / np.prod(np.arange(1, k + 1))
        assert abs(draws[k] - want) < 5 * np.sqrt(want)


def test_rows_without_an_id_fill_all_partitions(spark):
    """Half the ids null, with texts of their own: no partition of the mixed order stands out."""
    frame = spark.range(20_000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "concat('text ', id) AS text", "'one' AS source")
    sizes = [r["count"] for r in mixing.mix(frame, ["doc_id"], weights={"one": 1.0}).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.3 * np.median(sizes)


def test_more_copies_than_a_step(spark):
    frame = spark.createDataFrame([(1, "a"), *[(i, "b") for i in range(2, 12_000)]], "doc_id long, source string")
    copies = [r["copy"] for r in mixing.mix(frame, ["doc_id"], weights={"a": 0.5, "b": 0.5}).where("source = 'a'").collect()]
    assert len(copies) > 2 * mixing.COPIES and sorted(copies) == list(range(len(copies)))


def test_large_and_zero_rates(spark):
    rates = spark.createDataFrame([("a", 1, 0.5, 3e6), ("b", 1, 0.5, 900.0), ("c", 1, 0.0, 0.0)], "source string, n long, weight double, rate double")
    for r in mixing.poisson_table(rates).collect():
        steps = np.array(r["steps"])
        assert abs(steps[-1] - 1) < 1e-6 and (np.diff(steps) >= 0).all()
        median = r["low"] + int((steps <= 0.5).sum())
        assert abs(median - r["rate"]) <= 1


def test_mix_odd_rows_and_empty(odd, none, clashing):
    out = mixing.mix(clashing(odd, "COPY", "place", "rate", "steps"), ["doc_id", "text"])
    rows = out.collect()
    assert [c for c in out.columns if c != "steps"] == [*odd.columns, "rate", "copy", "place"]
    assert {r["text"] for r in rows} <= {r["text"] for r in odd.collect()}
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    assert mixing.mix(none, ["doc_id"]).count() == 0
