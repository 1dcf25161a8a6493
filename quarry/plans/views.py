"""Analysis views over the driver's TPC-H-like tables.

The tables carry prefixed column names and no column that matches the KPI
name patterns, so these views rename and derive the business columns the
library's rules look for.  Each builder reads only the columns it needs
(Catalyst prunes the Parquet scan further) and leaves join strategy to Spark:
no size is assumed, so no broadcast is forced here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import read_table

STAR_TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region")
PREFIXES = {"lineitem": "l_", "orders": "o_", "customer": "c_", "part": "p_",
            "supplier": "s_", "nation": "n_", "region": "r_"}


# Which dimension tables each sales column needs (left joins to unique keys
# never change the row count, so unused ones are simply not built; Catalyst
# cannot drop them itself as it does not know the keys are unique).
SALES_NEEDS = {
    "customer_id": ("orders",), "payment_method": ("orders",),
    "region": ("orders", "customer", "nation", "region"),
    "category": ("part",), "brand": ("part",), "price": ("part",), "stock_quantity": ("part",),
}
SALES_COLUMNS = ("order_id", "product_id", "customer_id", "ship_date", "quantity", "unit_price",
                 "revenue", "cost", "payment_method", "category", "brand", "region", "price",
                 "stock_quantity")


def v_sales(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """One row per line item with order, part, customer and region context.

    ``columns`` limits the view to those columns and builds only the joins
    they need (the dimension keys are unique, so each join is a lookup)."""
    wanted = list(SALES_COLUMNS if columns is None else columns)
    dims = {d for c in wanted for d in SALES_NEEDS.get(c, ())}
    j = read_table(spark, sf_dir, "lineitem")
    if "orders" in dims:
        o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        j = j.join(o, j.l_orderkey == o.o_orderkey, "left")
    if "part" in dims:
        p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand",
                                                      "p_retailprice", "p_size")
        j = j.join(p, j.l_partkey == p.p_partkey, "left")
    if "customer" in dims:
        c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        j = (j.join(c, j.o_custkey == c.c_custkey, "left")
             .join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, n.n_regionkey == r.r_regionkey, "left"))
    exprs = {
        "order_id": F.col("l_orderkey"), "product_id": F.col("l_partkey"),
        "customer_id": F.col("o_custkey"), "ship_date": F.col("l_shipdate"),
        "quantity": F.col("l_quantity"),
        "unit_price": F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        "revenue": F.col("l_extendedprice"),
        "cost": F.col("l_extendedprice") * (F.lit(0.55) + F.col("l_discount")),
        "payment_method": F.col("o_orderpriority"), "category": F.col("p_type"),
        "brand": F.col("p_brand"), "region": F.col("r_name"),
        "price": F.col("p_retailprice"), "stock_quantity": F.col("p_size"),
    }
    return j.select(*[exprs[c].alias(c) for c in wanted])


def v_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with nulls injected (the fixtures have none)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        F.when(F.col("event_id") % 5 < 2, F.lit(None).cast("double"))
        .otherwise(F.col("value")).alias("value"),
        "props")


def v_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` amounts with an infinity and nulls injected (the fixtures have none)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_orderkey") % 997 == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"))


def v_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", F.col("lang").alias("category"),
                                        F.col("quality").alias("rating"))


def v_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-level inventory view (no fan-out from a star join)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
                    F.col("p_size").alias("stock_quantity"))


def v_star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven star tables with column prefixes removed, in a fixed order."""
    out = {}
    for name in STAR_TABLES:
        df = read_table(spark, sf_dir, name)
        pre = PREFIXES[name]
        out[name] = df.toDF(*[c[len(pre):] if c.startswith(pre) else c for c in df.columns])
    return out


# The same views as SQL text (DuckDB oracles).
V_SALES_SQL = """
SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id, o.o_custkey AS customer_id,
       l.l_shipdate AS ship_date, l.l_quantity AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price, l.l_extendedprice AS revenue,
       l.l_extendedprice * (0.55 + l.l_discount) AS cost,
       o.o_orderpriority AS payment_method, p.p_type AS category, p.p_brand AS brand,
       r.r_name AS region, p.p_retailprice AS price, p.p_size AS stock_quantity
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
"""

V_DIRTY_SQL = """
SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
       CASE WHEN event_id % 5 < 2 THEN NULL ELSE value END AS value, props
FROM events
"""

V_INFINITE_SQL = """
SELECT l_quantity AS quantity, CASE WHEN l_orderkey % 997 = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice END AS price,
       CASE WHEN l_linenumber <> 1 THEN l_discount END AS discount, l_tax AS tax FROM lineitem
"""

V_RATING_SQL = """
SELECT d.doc_id, d.lang AS category, lb.quality AS rating
FROM documents d JOIN labels lb ON lb.doc_id = d.doc_id
"""

V_INVENTORY_SQL = "SELECT p_type AS category, p_brand AS brand, p_size AS stock_quantity FROM part"
