"""Plans for large tables give the results of the plain ones, and spread what is skewed."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from quarry.operators import model, relationships, summary
from quarry.operators import types as ty


@pytest.fixture
def fixed_partitions(spark):
    """Shuffles keep their partitions, joins their shuffles: skew shows."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# ---------------------------------------------------------------- star join

def parts(frame):
    return sorted(r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect())


@pytest.mark.parametrize("shape", ["null", "hot", "both"])
def test_null_and_hot_keys_are_spread(spark, fixed_partitions, shape):
    n = 64_000
    key = {"null": "IF(id % 10 < 6, NULL, id % 5000)", "hot": "IF(id % 10 < 4, 77, id % 5000)", "both": "CASE WHEN id % 10 < 3 THEN NULL WHEN id % 10 < 6 THEN 77 ELSE id % 5000 END"}[shape]
    fact = spark.range(n).selectExpr(f"{key} AS part_key", "id * 1.0 AS amount", "id * 2.0 AS other")
    dim = spark.range(5000).selectExpr("id AS part_key", "CAST(id AS string) AS label")
    tables = {"fact": fact, "dim": dim}
    rels, stats = relationships.infer_relationships(tables)
    built = model.build_model(tables, rels, stats=stats, hot_share=0.05)
    sizes = parts(built.frame)
    assert sum(sizes) == n and sizes[-1] <= 2 * median(sizes), sizes
    assert built.frame.where("label <=> CAST(CAST(part_key AS bigint) AS string)").count() == n
    assert built.frame.columns == ["part_key", "amount", "other", "label"]


def test_hot_keys_are_measured(spark):
    frame = spark.range(20_000).selectExpr("CASE WHEN id % 4 = 0 THEN 5 WHEN id % 10 = 1 THEN 6 WHEN id % 7 = 2 THEN NULL ELSE id + 100 END AS a", "CAST(NULL AS string) AS b")
    found = model.hot_keys(frame, ["a", "b"], 0.05)
    assert set(found["a"]) == {"5", "6"} and found["a"]["5"] == pytest.approx(0.25, abs=0.01) and found["b"] == {}


# ---------------------------------------------------------------- top-k by candidates

def topk(frame, method, k=8):
    return sorted(tuple(r) for r in summary.category_topk(frame, k=k, method=method).collect())


def test_candidates_equal_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcdefgh") if i % 3 else f"id{i}", f"key{i}", rng.choice(["x", " x ", "", None, "y"]), f"v{int(rng.paretovariate(0.6)) % 4000}") for i in range(30_000)]
    frame = spark.createDataFrame(rows, "mixed string, ident string, few string, tail string").repartition(6)
    for k in (1, 8, 40):
        assert topk(frame, "candidates", k) == topk(frame, "counts", k)


def test_only_candidates_move(spark):
    """A column of ids with a few frequent values among them is proven by its candidates."""
    frame = spark.range(60_000).selectExpr("CASE WHEN id % 5 = 0 THEN concat('hot', id % 40) ELSE concat('id', id) END AS s")
    calls = []
    whole = summary.category_topk

    def counted(df, k=8, max_cols=None, cols=None, method="auto"):
        calls.append(method)
        return whole(df, k, max_cols, cols, method)
    summary.category_topk = counted
    try:
        got = topk(frame, "candidates")
    finally:
        summary.category_topk = whole
    assert calls == ["candidates"] and got == topk(frame, "counts")


def test_candidates_of_nothing(spark):
    frame = spark.createDataFrame([(None, " "), (None, "")], "a string, b string")
    assert summary.category_topk(frame, method="candidates").count() == 0
    with pytest.raises(ValueError):
        summary.category_topk(frame, method="guess")


# ---------------------------------------------------------------- relationships by sketches

def star(spark, n=30_000):
    return {
        "orders": spark.range(n).selectExpr("id AS order_id", "id % 3000 AS customer_id", "concat('n', id) AS name", "id % 50 AS size", "id * 3 AS total"),
        "customers": spark.range(3000).selectExpr("id AS customer_id", "concat('c', id) AS name", "id % 50 AS size", "id + 10000000 AS total"),
        "notes": spark.range(20_000).selectExpr("id + 10000 AS order_id", "concat('n', id * 2) AS name", "id AS total"),
        "empty": spark.createDataFrame([], "order_id long, name string")}


def test_screening_keeps_all_relationships(spark):
    tables = star(spark)
    exact, _ = relationships.infer_relationships(tables)
    assert len(exact) == 3
    screened, _ = relationships.infer_relationships(tables, screen=True)
    assert screened == exact


def test_screening_rules_out_pairs(spark):
    """Pairs that share nothing or too little, or are unique on neither side, are not counted."""
    tables = star(spark)
    pairs = [(a, b, c, relationships.common_key_type(tables[a].schema[c].dataType, tables[b].schema[c].dataType)) for a, b, c in relationships.candidate_pairs(tables)]
    left = {p[:3] for p in relationships.screened_pairs(tables, pairs)}
    assert ("orders", "customers", "customer_id") in left and ("orders", "notes", "order_id") in left and ("orders", "notes", "name") in left
    assert not {("orders", "customers", "name"), ("orders", "customers", "size"), ("orders", "customers", "total"), ("orders", "empty", "order_id")} & left


@pytest.mark.parametrize("seed", range(3))
def test_screening_near_the_limit(spark, seed):
    """Overlaps around one half, of sets much larger than a sketch: none that counts is lost."""
    tables, rng = {"base": spark.range(20_000).selectExpr(*[f"id * 31 + {i} AS c{i}" for i in range(12)])}, random.Random(seed)
    shares = [0.3, 0.45, 0.49, 0.499, 0.5, 0.5, 0.501, 0.51, 0.55, 0.7, 0.9, 1.0]
    shift = [int(20_000 * (1 - s)) for s in shares]
    tables["other"] = spark.range(20_000).selectExpr(*[f"(id + {shift[i]}) * 31 + {i} AS c{i}" for i in range(12)])
    exact, _ = relationships.infer_relationships(tables)
    screened, _ = relationships.infer_relationships(tables, screen=True)
    assert screened == exact and len(exact) == sum(s >= 0.5 for s in shares)


# ---------------------------------------------------------------- categorical or text

def kinds(frame):
    return {t.column: t.semantic_type for t in ty.infer_types(frame)}


def test_categorical_rule_in_two_stages(spark, monkeypatch):
    """Ids are settled by the sketch; columns near the limit are counted exactly."""
    n = 30_000
    frame = spark.range(n).selectExpr("concat('id', id) AS ident", "concat('x', id % 3000) AS at_limit", "concat('x', id % 3001) AS above", "concat('y', id % 40) AS few", "concat('z', id % 2700) AS below")
    counted = []
    dealt = ty.F.explode
    monkeypatch.setattr(ty.F, "explode", lambda c: counted.append(1) or dealt(c))
    found = kinds(frame)
    assert found == {"ident": "text", "at_limit": "categorical", "above": "text", "few": "categorical", "below": "categorical"}
    assert counted == [1]
    counted.clear()
    assert kinds(frame.select("ident", "few")) == {"ident": "text", "few": "categorical"} and not counted
