"""DuckDB SQL oracles, one per registered query.

Written independently of the Spark code: plain SQL over the pre-registered
views.  Repetitive per-column parts (profiles, correlation pairs) are
generated from the fixed schemas below.
"""

from __future__ import annotations

from quarry.plans.views import V_DIRTY_SQL, V_INFINITE_SQL, V_INVENTORY_SQL, V_RATING_SQL, V_SALES_SQL

# Schemas of the fixture tables and views the oracles use.
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NUMERIC = ["event_id", "user_id", "value"]
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")]
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
DIRTY_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
              ("event_type", "string"), ("value", "double"), ("props", "string")]
SALES_M_COLS = [("order_id", "bigint"), ("product_id", "bigint"), ("customer_id", "bigint"),
                ("ship_date", "timestamp_ntz"), ("quantity", "double"), ("unit_price", "double"),
                ("revenue", "double"), ("cost", "double"), ("payment_method", "string"),
                ("category", "string"), ("brand", "string"), ("region", "string"),
                ("price", "double"), ("stock_quantity", "int"), ("gross_profit", "double"),
                ("gross_margin_pct", "double"), ("line_item_revenue", "double"),
                ("inventory_value", "double"), ("avg_revenue_per_unit", "double"),
                ("cost_per_unit", "double"), ("revenue_per_customer_record", "double")]
SALES_STRINGS = ["payment_method", "category", "brand", "region"]
STAR = {
    "lineitem": ("l_", ["orderkey", "partkey", "suppkey", "linenumber", "quantity",
                        "extendedprice", "discount", "tax", "returnflag", "linestatus",
                        "shipdate"]),
    "orders": ("o_", ["orderkey", "custkey", "orderstatus", "totalprice", "orderdate",
                      "orderpriority"]),
    "customer": ("c_", ["custkey", "name", "nationkey", "acctbal", "mktsegment"]),
    "part": ("p_", ["partkey", "name", "brand", "type", "size", "retailprice"]),
    "supplier": ("s_", ["suppkey", "name", "nationkey", "acctbal"]),
    "nation": ("n_", ["nationkey", "name", "regionkey"]),
    "region": ("r_", ["regionkey", "name"]),
}
MANIFEST_TYPES = {"orderkey": "bigint", "custkey": "bigint", "totalprice": "double", "orderdate": "timestamp_ntz",
                  "nationkey": "int", "acctbal": "double"}
ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")

SALES = f"({V_SALES_SQL})"
SALES_M = f"""(SELECT *, revenue - cost AS gross_profit,
    (revenue - cost) / nullif(revenue, 0) AS gross_margin_pct,
    quantity * unit_price AS line_item_revenue, price * stock_quantity AS inventory_value,
    revenue / nullif(quantity, 0) AS avg_revenue_per_unit,
    cost / nullif(quantity, 0) AS cost_per_unit, revenue AS revenue_per_customer_record
  FROM {SALES})"""
SALES_UNITS = f"""(SELECT *, quantity - 1 AS units_sold, revenue - cost AS gross_profit,
    cost / nullif(quantity - 1, 0) AS cost_per_unit FROM {SALES})"""
DIRTY = f"({V_DIRTY_SQL})"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


HINT_SQL = """CASE
  WHEN {n} LIKE '%revenue%' OR {n} LIKE '%sales%' OR {n} LIKE '%amount%' OR {n} LIKE '%price%'
    OR {n} LIKE '%cost%' OR {n} LIKE '%profit%' THEN 'Likely monetary value. Confirm currency with the user.'
  WHEN {n} LIKE '%date%' OR {n} LIKE '%\\_at' ESCAPE '\\' THEN 'Likely date/time field.'
  WHEN {n} LIKE '%customer%' OR {n} LIKE '%client%' OR {n} LIKE '%account%'
    THEN 'Likely customer/account identifier or segment.'
  WHEN {n} LIKE '%region%' OR {n} LIKE '%country%' OR {n} LIKE '%city%' OR {n} LIKE '%state%'
    THEN 'Likely geographic dimension.'
  ELSE NULL END"""


def _outlier_sql(src: str, c: str) -> str:
    v = f"CAST({q(c)} AS DOUBLE)"
    return f"""(SELECT CASE WHEN s.n < 4 OR s.q3 - s.q1 = 0 THEN 0 ELSE
      (SELECT count(*) FROM {src} t WHERE {v} < s.q1 - 1.5 * (s.q3 - s.q1)
                                       OR {v} > s.q3 + 1.5 * (s.q3 - s.q1)) END
     FROM (SELECT count({v}) AS n, quantile_cont({v}, 0.25) AS q1,
                  quantile_cont({v}, 0.75) AS q3 FROM {src} t) s)"""


def profile_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for c, spark_type in cols:
        numeric = spark_type in ("bigint", "int", "double", "smallint", "tinyint", "float")
        if numeric:
            kind, outliers = "'numeric'", f"CAST({_outlier_sql(src, c)} AS BIGINT)"
        elif spark_type.startswith("timestamp"):
            kind, outliers = "'datetime'", "CAST(NULL AS BIGINT)"
        else:
            kind = (f"CASE WHEN count({q(c)}) = 0 THEN 'text' "
                    f"WHEN count(DISTINCT {q(c)}) <= greatest(20, count({q(c)}) * 0.1) "
                    f"THEN 'categorical' ELSE 'text' END")
            outliers = "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT {lit(c)} AS "column", {kind} AS type, {lit(spark_type)} AS spark_type,
  CAST(count(*) - count({q(c)}) AS BIGINT) AS null_count,
  round((count(*) - count({q(c)})) / greatest(count(*), 1), 4) AS null_ratio,
  CAST(count(DISTINCT {q(c)}) AS BIGINT) AS unique_count,
  {outliers} AS outlier_count,
  {HINT_SQL.format(n=lit(c))} AS semantic_hint
FROM {src} t""")
    return "\nUNION ALL\n".join(parts)


def corr_matrix_sql(src: str, cols: list[str]) -> str:
    """Full Pearson matrix with pairwise-complete rows; diagonal 1 when the
    column varies; constant columns give NULL."""
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            x, y = f"CAST({q(a)} AS DOUBLE)", f"CAST({q(b)} AS DOUBLE)"
            if i == j:
                r = f"CASE WHEN var_pop({x}) > 0 THEN 1.0 END"
            else:
                r = (f"CASE WHEN isnan(corr({x}, {y})) OR var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) = 0 "
                     f"OR var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) = 0 "
                     f"THEN NULL ELSE round(greatest(-1.0, least(1.0, corr({x}, {y}))), 4) END")
            parts.append(f"SELECT {lit(a)} AS \"left\", {lit(b)} AS \"right\", {i} AS li, {j} AS ri, "
                         f"CAST({r} AS DOUBLE) AS r FROM {src} t")
    return "\nUNION ALL\n".join(parts)


def summary_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"""SELECT {lit(c)} AS "column", count({v}) AS count, round(avg({v}), 4) AS mean,
  round(quantile_cont({v}, 0.5), 4) AS median, round(min({v}), 4) AS min, round(max({v}), 4) AS max,
  round(stddev_samp({v}), 4) AS std FROM {src} t""")
    return "\nUNION ALL\n".join(parts)


def topk_sql(src: str, cols: list[str], k: int) -> str:
    pairs = "\nUNION ALL\n".join(
        f"SELECT {lit(c)} AS \"column\", nullif(trim(CAST({q(c)} AS VARCHAR)), '') AS value FROM {src} t"
        for c in cols)
    return f"""SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT "column", value, count(*) AS n,
         row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value ASC) AS rank
  FROM ({pairs}) p WHERE value IS NOT NULL GROUP BY "column", value) x WHERE rank <= {k}"""


def star_view(name: str) -> str:
    prefix, cols = STAR[name]
    return f"(SELECT {', '.join(f'{prefix}{c} AS {c}' for c in cols)} FROM {name})"


def relationships_sql() -> str:
    """Candidate pairs from the fixed star schemas; the rules in SQL."""
    names = list(STAR)
    parts = []
    for i, left in enumerate(names):
        for right in names[i + 1:]:
            shared = sorted(set(STAR[left][1]) & set(STAR[right][1]))
            for c in shared:
                key_like = c.endswith("id") or "key" in c
                lv, rv = star_view(left), star_view(right)
                parts.append(f"""SELECT {lit(left)} AS left_table, {lit(right)} AS right_table,
  {lit(c)} AS left_column, {lit(c)} AS right_column,
  (SELECT count(*) FROM (SELECT {c} FROM {lv} WHERE {c} IS NOT NULL
                         INTERSECT SELECT {c} FROM {rv} WHERE {c} IS NOT NULL)) AS shared,
  (SELECT count(DISTINCT {c}) FROM {lv}) AS ld, (SELECT count(DISTINCT {c}) FROM {rv}) AS rd,
  (SELECT count({c}) = count(DISTINCT {c}) FROM {lv}) AS lu,
  (SELECT count({c}) = count(DISTINCT {c}) FROM {rv}) AS ru,
  {'TRUE' if key_like else 'FALSE'} AS key_like, {i} AS li, {len(parts)} AS ord""")
    cand = "\nUNION ALL\n".join(parts)
    return f"""SELECT left_table, right_table, left_column, right_column,
  round(shared / least(ld, rd), 4) AS overlap_ratio,
  CASE WHEN lu AND ru THEN 'one_to_one' WHEN lu THEN 'one_to_many' WHEN ru THEN 'many_to_one'
       ELSE 'many_to_many_candidate' END AS relationship_type
FROM ({cand}) c
WHERE shared > 0 AND (key_like OR ((lu OR ru) AND shared / least(ld, rd) >= 0.5))"""


STAR_JOIN = """(SELECT l.l_orderkey, l.l_quantity AS quantity, l.l_extendedprice AS extendedprice,
       l.l_returnflag AS returnflag, o.o_orderkey, p.p_partkey, s.s_suppkey, c.c_custkey,
       n.n_nationkey, r.r_regionkey, r.r_name AS region
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def bar_sql(src: str, x: str, value: str, order_limit: bool = True) -> str:
    """``value`` ranks as it is; its rounding, ``round(raw, n)``, is for show only."""
    raw, digits = value.removeprefix("round(").removesuffix(")").rsplit(", ", 1)
    return f"""SELECT x, round(raw, {digits}) AS y FROM (
  SELECT CAST({x} AS VARCHAR) AS x, {raw} AS raw FROM {src} t GROUP BY {x}
  ORDER BY raw DESC NULLS LAST, x ASC NULLS FIRST LIMIT 12)"""


def sum2(c: str) -> str:
    return f"round(coalesce(sum(CAST({c} AS DOUBLE)), 0), 4)"


def preset_bar(x, y, agg, src=SALES_M):
    if agg == "sum":
        value = sum2(y)
    else:
        value = f"round(avg(CAST({y} AS DOUBLE)), 4)"
    return f"""SELECT {lit(x)} AS x_column, {lit(y)} AS y_column, x AS label, y AS value FROM ({bar_sql(src, x, value)})"""


def preset_line(x, y):
    return f"""SELECT {lit(x)} AS x_column, {lit(y)} AS y_column,
  strftime({x}, '%Y-%m-%d %H:%M:%S') AS label, {sum2(y)} AS value
FROM {SALES_M} t GROUP BY {x}"""


def by_category(measure_expr: str, name: str, digits: int, src: str = SALES_M) -> str:
    return f"""SELECT category, round(sum({measure_expr}), {digits}) AS {name}_sum,
  count({measure_expr}) AS n FROM {src} t GROUP BY category"""


HIST = f"""WITH v AS (SELECT CAST(revenue AS DOUBLE) AS v FROM {SALES} s WHERE revenue IS NOT NULL),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1,
              quantile_cont(v, 0.75) AS q3 FROM v),
w AS (SELECT n, lo, hi, (hi - lo) / (log2(n) + 1.0) AS sturges,
             2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM st),
b AS (SELECT lo, hi, CAST(ceil((hi - lo) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)) AS INTEGER) AS bins FROM w),
c AS (SELECT CAST(least(floor((v - lo) * CAST(bins AS DOUBLE) / (hi - lo)), bins - 1) AS BIGINT) AS bin,
             count(*) AS n FROM v, b GROUP BY 1)
SELECT c.bin, round(b.lo + c.bin * ((b.hi - b.lo) / b.bins), 6) AS lo,
  round(CASE WHEN c.bin = b.bins - 1 THEN b.hi ELSE b.lo + (c.bin + 1) * ((b.hi - b.lo) / b.bins) END, 6) AS hi,
  c.n
FROM c, b"""

DENSITY = """WITH d AS (SELECT CAST(l_discount AS DOUBLE) AS v FROM lineitem WHERE l_discount IS NOT NULL),
s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi,
             round(stddev_samp(v) * pow(count(*), -0.2), 10) AS h FROM d),
g AS (SELECT CAST(k AS INTEGER) AS k, lo + k * (hi - lo) / 199 AS gx FROM s, range(200) t(k))
SELECT g.k AS point, round(g.gx, 6) AS x,
  round(sum(exp(-0.5 * pow((g.gx - d.v) / s.h, 2))) / (s.n * s.h * sqrt(2 * pi())), 6) AS density
FROM g, d, s GROUP BY g.k, g.gx, s.n, s.h"""

SCATTER = f"""WITH p AS (SELECT CAST(quantity AS DOUBLE) AS x, CAST(unit_price AS DOUBLE) AS y FROM {SALES} s
           WHERE quantity IS NOT NULL AND unit_price IS NOT NULL),
m AS (SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM p)
SELECT least(CAST(floor((x - xlo) * 50.0 / (xhi - xlo)) AS INTEGER), 49) AS x_bin,
       least(CAST(floor((y - ylo) * 50.0 / (yhi - ylo)) AS INTEGER), 49) AS y_bin,
       count(*) AS n
FROM p, m GROUP BY 1, 2"""

SALES_CHART_NUMERIC = ["quantity", "unit_price", "revenue", "cost", "price", "stock_quantity",
                       "gross_profit", "gross_margin_pct"]


def corr_infinities_sql() -> str:
    """Pairs without the infinite column as ever; the others, and that column itself, NULL."""
    cols, finite = ["quantity", "price", "discount", "tax"], ["quantity", "discount", "tax"]
    known = f"SELECT \"left\", \"right\", r FROM ({corr_matrix_sql(f'({V_INFINITE_SQL})', finite)})"
    none = " UNION ALL ".join(f"SELECT {lit(a)}, {lit(b)}, NULL::DOUBLE" for a in cols for b in cols if "price" in (a, b))
    return f"{known} UNION ALL {none}"


#: the finite prices, and histogram and density over them
FINITE = f"(SELECT price FROM ({V_INFINITE_SQL}) i WHERE NOT isinf(price))"
HIST_INFINITE = HIST.replace(f"CAST(revenue AS DOUBLE) AS v FROM {SALES} s WHERE revenue IS NOT NULL", f"price AS v FROM {FINITE} s")
DENSITY_INFINITE = (DENSITY.replace("CAST(l_discount AS DOUBLE) AS v FROM lineitem WHERE l_discount IS NOT NULL", f"price AS v FROM {FINITE} s")
                    .replace("sqrt(2 * pi())), 6) AS density", "sqrt(2 * pi())), 10) AS density"))


def iqr_sql() -> str:
    parts = []
    for table, cols in (("lineitem", LINEITEM_NUMERIC), ("events", EVENTS_NUMERIC)):
        for c in cols:
            v = f"CAST({c} AS DOUBLE)"
            parts.append(f"""SELECT {lit(table)} AS table_name, {lit(c)} AS "column",
  round(s.q1, 4) AS q1, round(s.q3, 4) AS q3,
  CAST(CASE WHEN s.n < 4 OR s.q3 - s.q1 = 0 THEN 0 ELSE
    (SELECT count(*) FROM {table} WHERE {v} < s.q1 - 1.5 * (s.q3 - s.q1) OR {v} > s.q3 + 1.5 * (s.q3 - s.q1))
  END AS BIGINT) AS outlier_count
FROM (SELECT count({v}) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {table}) s""")
    return "\nUNION ALL\n".join(parts)


def insight_sql() -> str:
    nums = ["o_orderkey", "o_custkey", "o_totalprice"]
    parts = []
    rank = 0
    for c in nums:
        rank += 1
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT {rank} AS rank, 'range' AS kind, {lit(c)} AS subject, NULL AS other, "
                     f"round(min({v}), 4) AS v1, round(max({v}), 4) AS v2, round(avg({v}), 4) AS v3 FROM orders")
    for c in ["o_orderstatus", "o_orderpriority"]:
        rank += 1
        parts.append(f"SELECT {rank}, 'leader', {lit(c)}, (SELECT {c} FROM orders WHERE {c} IS NOT NULL "
                     f"GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1), NULL, NULL, NULL")
    rank += 1
    parts.append(f"""SELECT {rank}, 'correlation', "left", "right", r, NULL, NULL FROM (
  SELECT * FROM ({corr_matrix_sql('orders', nums)}) m WHERE li <> ri AND r IS NOT NULL
  ORDER BY abs(r) DESC, li, ri LIMIT 1)""")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT CAST(rank AS INTEGER) AS rank, kind, subject, CAST(other AS VARCHAR) AS other,
  CAST(v1 AS DOUBLE) AS v1, CAST(v2 AS DOUBLE) AS v2, CAST(v3 AS DOUBLE) AS v3 FROM ({body})"""


def star_counts_sql() -> str:
    parts = [f"SELECT {lit(t)} AS entry, count(*) AS rows, {len(STAR[t][1])} AS columns FROM {t}"
             for t in STAR]
    # analysis table: base lineitem plus each joined table without its key column
    model_cols = len(STAR["lineitem"][1]) + sum(len(STAR[t][1]) - 1 for t in STAR if t != "lineitem")
    parts.append(f"SELECT 'analysis', count(*), {model_cols} FROM {STAR_JOIN}")
    parts.append("SELECT 'all_tables', (SELECT " + " + ".join(f"(SELECT count(*) FROM {t})" for t in STAR)
                 + f"), {sum(len(v[1]) for v in STAR.values())}")
    parts.append(f"SELECT 'dataset_count', {len(STAR)}, NULL")
    return ("SELECT entry, CAST(rows AS BIGINT) AS rows, CAST(columns AS INTEGER) AS columns FROM ("
            + "\nUNION ALL\n".join(parts) + ")")


def manifest_sql() -> str:
    """Profiles of two star tables, the schema of orders with customer's columns, and how they relate."""
    bare = {t: f"(SELECT {', '.join(f'{STAR[t][0]}{c} AS {q(c)}' for c in STAR[t][1])} FROM {t})" for t in ("orders", "customer")}
    kinds = {t: [(c, MANIFEST_TYPES.get(c, "string")) for c in STAR[t][1]] for t in bare}
    parts = [f"""SELECT 'column' AS kind, {lit(t)} AS table_name, "column", type, spark_type, semantic_hint AS hint, null_count, null_ratio,
  null_count > 0.3 * (SELECT count(*) FROM {t}) AS missing_warning, outlier_count, coalesce(outlier_count, 0) > 0 AS outlier_warning,
  NULL AS detail FROM ({profile_sql(bare[t], kinds[t])})""" for t in bare]
    none = "NULL, NULL, NULL, NULL, NULL"
    parts += [f"SELECT 'analysis', 'analysis', {lit(c)}, NULL, {lit(kind)}, {HINT_SQL.format(n=lit(c))}, {none}, NULL"
              for c, kind in kinds["orders"] + [x for x in kinds["customer"] if x[0] != "custkey"]]
    parts.append(f"SELECT 'base', 'orders', NULL, NULL, NULL, NULL, {none}, NULL")
    parts.append(f"""SELECT 'relationship', 'orders', 'custkey',
  (SELECT CASE WHEN count(o_custkey) = count(DISTINCT o_custkey) THEN 'one' ELSE 'many' END FROM orders) || '_to_' ||
  (SELECT CASE WHEN count(c_custkey) = count(DISTINCT c_custkey) THEN 'one' ELSE 'many' END FROM customer),
  NULL, NULL, {none}, 'customer.custkey'""")
    return "\nUNION ALL\n".join(parts)


def inferred_types_sql() -> str:
    """The type rule on the text of every column of events: shares of values that cast, then distinct values."""
    one = """SELECT {name} AS "column", CASE WHEN n = 0 THEN 'text' WHEN bools = n THEN 'boolean'
  WHEN numbers >= 0.9 * n THEN 'numeric' WHEN dates >= 0.9 * n THEN 'datetime'
  WHEN kinds <= greatest(20, n * 0.1) THEN 'categorical' ELSE 'text' END AS type
FROM (SELECT count(v) AS n, count(*) FILTER (WHERE lower(v) IN ('true', 'false')) AS bools,
        count(TRY_CAST(v AS DOUBLE)) AS numbers, count(TRY_CAST(v AS TIMESTAMP)) AS dates, count(DISTINCT v) AS kinds
      FROM (SELECT nullif(trim(CAST({col} AS VARCHAR)), '') AS v FROM events))"""
    return "\nUNION ALL\n".join(one.format(name=lit(c), col=q(c)) for c, _ in DIRTY_COLS)


def oracle_sql() -> dict[str, str]:
    out = {
        "csv_roundtrip": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
        "csv_parts": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderstatus END AS o_orderstatus,
  o_totalprice, o_orderpriority FROM orders""",
        "table_counts": "\nUNION ALL\n".join(
            f"SELECT {lit(t)} AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES),
        "scan_stats": """SELECT count(*) AS total_rows, CAST(least(count(*), 50000) AS BIGINT) AS sample_rows,
  CAST(ceil(count(*) / 100000) AS BIGINT) AS chunks FROM lineitem""",
        "export_clean": f"""SELECT order_id, product_id, customer_id,
  strftime(ship_date, '%Y-%m-%dT%H:%M:%S') AS ship_date, quantity, unit_price, revenue, cost,
  payment_method, category, brand, region, price, stock_quantity FROM {SALES} s""",
        "export_summary": summary_sql("lineitem", LINEITEM_NUMERIC),
        "head_sample": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 50000""",
        "column_roles": "\nUNION ALL\n".join(
            f"""SELECT CASE WHEN any_value(typeof({c})) LIKE 'TIMESTAMP%' OR any_value(typeof({c})) = 'DATE' THEN 'datetime'
  WHEN any_value(typeof({c})) = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS role,
  {lit(c)} AS "column", count({c}) AS non_null FROM orders""" for c, _ in ORDERS_COLS),
        "normalized_columns": """SELECT l_orderkey AS order_key, l_linenumber AS line_number,
  l_quantity AS quantity, l_extendedprice AS extended_price, l_returnflag AS return_flag,
  l_linestatus AS line_status FROM lineitem""",
        "inferred_types": inferred_types_sql(),
        "coerce_values": """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 20 IN (0, 1) THEN NULL ELSE l_quantity END AS quantity FROM lineitem""",
        "pair_projection": f"SELECT event_type, value FROM {DIRTY} d WHERE event_type IS NOT NULL AND value IS NOT NULL",
        "blank_to_null": """SELECT count(*) AS rows, count(*) FILTER (WHERE l_orderkey % 20 <> 1) AS non_blank
  FROM lineitem""",
        "null_profile": f"SELECT \"column\", null_count, null_ratio FROM ({profile_sql(DIRTY, DIRTY_COLS)})",
        "distinct_profile": "\nUNION ALL\n".join(
            f"SELECT {lit(c)} AS \"column\", count(DISTINCT {c}) AS unique_count FROM orders"
            for c, _ in ORDERS_COLS),
        "missing_warnings": f"""SELECT "column", null_ratio FROM ({profile_sql(DIRTY, DIRTY_COLS)})
  WHERE (null_count * 1.0 / (SELECT count(*) FROM {DIRTY} d)) > 0.3""",
        "iqr_outliers": iqr_sql(),
        "table_profile": profile_sql("orders", ORDERS_COLS),
        "model_profile": profile_sql(SALES_M, SALES_M_COLS),
        "profile_increment": profile_sql("(SELECT *, o_totalprice / 1000 AS o_total_thousands FROM orders)",
                                         ORDERS_COLS + [("o_total_thousands", "double")]),
        "combined_profile": star_counts_sql(),
        "manifest": manifest_sql(),
        "key_uniqueness": "\nUNION ALL\n".join(
            [f"SELECT 'orders' AS table_name, {lit(c)} AS \"column\", count({c}) = count(DISTINCT {c}) AS is_unique FROM orders"
             for c, _ in ORDERS_COLS] +
            [f"SELECT 'customer', {lit(c)}, count({c}) = count(DISTINCT {c}) FROM customer"
             for c in CUSTOMER_COLS]),
        "key_overlap": """SELECT s.shared, l.left_distinct, r.right_distinct,
  round(coalesce(s.shared / least(l.left_distinct, r.right_distinct), 0.0), 4) AS overlap_ratio
FROM (SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL
        INTERSECT SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)) s,
     (SELECT count(DISTINCT o_custkey) AS left_distinct FROM orders) l,
     (SELECT count(DISTINCT c_custkey) AS right_distinct FROM customer) r""",
        "relationships": relationships_sql(),
        "relationships_screened": relationships_sql(),
        "star_join": f"""SELECT region, count(*) AS n, round(sum(extendedprice), 4) AS revenue
  FROM {STAR_JOIN} j GROUP BY region""",
        "m_gross_profit": by_category("gross_profit", "gross_profit", 4),
        "m_gross_margin": by_category("gross_margin_pct", "gross_margin_pct", 4),
        "m_line_revenue": by_category("line_item_revenue", "line_item_revenue", 4),
        "m_inventory_value": by_category("inventory_value", "inventory_value", 4),
        "m_revenue_per_unit": by_category("avg_revenue_per_unit", "avg_revenue_per_unit", 4),
        "m_cost_per_unit": by_category("cost_per_unit", "cost_per_unit", 4, SALES_UNITS),
        "m_revenue_per_customer": f"""SELECT customer_id, round(sum(revenue), 4) AS revenue,
  count(*) AS records FROM {SALES} s GROUP BY customer_id""",
        "m_formula": by_category("(revenue - cost) / nullif(pow(quantity, 2), 0)", "profit_per_sq_unit", 4),
        "formula_statuses": "\nUNION ALL\n".join(
            f"SELECT {lit(n)} AS measure, {lit(f)} AS formula, 'created' AS status, round(sum({x}), 4) AS total FROM {SALES} s"
            for n, f, x in (("profit", "revenue - cost", "revenue - cost"), ("ratio", "(revenue - cost) / quantity", "(revenue - cost) / nullif(quantity, 0)"),
                            ("deep", "-(revenue / (quantity * quantity)) + 1.5", "-(revenue / nullif(quantity * quantity, 0)) + 1.5"))),
        "numeric_summary": summary_sql("lineitem", LINEITEM_NUMERIC),
        "category_topk": topk_sql(SALES, SALES_STRINGS, 8),
        "category_topk_candidates": topk_sql(SALES, SALES_STRINGS, 8),
        "corr_infinities": corr_infinities_sql(),
        "correlation_matrix": f"SELECT \"left\", \"right\", r FROM ({corr_matrix_sql('lineitem', LINEITEM_NUMERIC)})",
        "strongest_correlation": f"""SELECT "left", "right", r FROM ({corr_matrix_sql('lineitem', LINEITEM_NUMERIC)}) m
  WHERE li <> ri AND r IS NOT NULL ORDER BY abs(r) DESC, li, ri LIMIT 1""",
        "insight_facts": insight_sql(),
        "bar_sum_top12": bar_sql(SALES_M, "category", sum2("gross_profit")),
        "bar_mean_top12": bar_sql(SALES_M, "brand", "round(avg(gross_margin_pct), 4)"),
        "bar_count_top12": bar_sql(SALES_UNITS, "brand", "round(CAST(count(cost_per_unit) AS DOUBLE), 0)"),
        "line_trend_month": f"""SELECT strftime(date_trunc('month', ship_date), '%Y-%m-%d') AS x,
  {sum2('revenue')} AS y FROM {SALES} s GROUP BY date_trunc('month', ship_date)""",
        "scatter_grid": SCATTER,
        "scatter_sample": """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders
  WHERE (SELECT count(*) FROM orders) <= 2000
     OR ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12))::BIGINT < (SELECT (2000 * 281474976710656::HUGEINT // count(*))::BIGINT FROM orders)""",
        "histogram_infinities": HIST_INFINITE,
        "density_infinities": DENSITY_INFINITE,
        "histogram_bins": HIST,
        "density_curve": DENSITY,
        "heatmap_corr": f"SELECT \"left\", \"right\", r FROM ({corr_matrix_sql(SALES_M, SALES_CHART_NUMERIC)})",
        "chart_trend": preset_line("ship_date", "gross_profit"),
        "chart_segment": preset_bar("payment_method", "gross_profit", "sum"),
        "chart_category_mix": preset_bar("category", "gross_profit", "sum"),
        "chart_geography": preset_bar("region", "gross_profit", "sum"),
        "chart_payment": preset_bar("payment_method", "gross_profit", "sum"),
        "chart_inventory": preset_bar("category", "stock_quantity", "mean", f"({V_INVENTORY_SQL})"),
        "chart_rating": preset_bar("category", "rating", "mean", f"({V_RATING_SQL})"),
        "chart_margin": preset_bar("payment_method", "gross_margin_pct", "mean"),
        "ans_ranges_outliers": f"""SELECT s."column", s.count, s.mean, s.min, s.max, o.outlier_count
FROM ({summary_sql(SALES, ['quantity', 'unit_price', 'revenue', 'cost'])}) s JOIN (
  {' UNION ALL '.join(f"SELECT {lit(c)} AS col, {_outlier_sql(SALES, c)} AS outlier_count" for c in ['quantity', 'unit_price', 'revenue', 'cost'])}
) o ON o.col = s."column\"""",
        "ans_by_category": f"""SELECT CAST(category AS VARCHAR) AS category, count(revenue) AS n,
  round(avg(revenue), 4) AS mean, round(min(revenue), 4) AS min, round(max(revenue), 4) AS max,
  round(stddev_samp(revenue), 4) AS std, round(quantile_cont(revenue, 0.5), 4) AS median
FROM {SALES} s GROUP BY category""",
        "ans_trend_change": f"""SELECT strftime(t, '%Y-%m-%d') AS period, value,
  lag(value) OVER (ORDER BY t) AS previous, round(value - lag(value) OVER (ORDER BY t), 4) AS change,
  round((value - lag(value) OVER (ORDER BY t)) / nullif(lag(value) OVER (ORDER BY t), 0), 4) AS pct_change
FROM (SELECT date_trunc('month', ship_date) AS t, {sum2('revenue')} AS value FROM {SALES} s
      WHERE ship_date IS NOT NULL GROUP BY 1)""",
        "trend_seconds": """SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS period, value,
  lag(value) OVER (ORDER BY t) AS previous, round(value - lag(value) OVER (ORDER BY t), 4) AS change,
  round((value - lag(value) OVER (ORDER BY t)) / nullif(lag(value) OVER (ORDER BY t), 0), 4) AS pct_change
FROM (SELECT date_trunc('second', ts) AS t, round(coalesce(sum(value), 0), 4) AS value FROM events
      WHERE ts IS NOT NULL GROUP BY 1)""",
        "answers_by_roles": """SELECT 'ranges_outliers' AS answer, 5::BIGINT AS n
UNION ALL SELECT 'by_category', count(*) FROM (SELECT DISTINCT o_orderstatus FROM orders)
UNION ALL SELECT 'strongest_correlation', count(*) FROM (SELECT 1 FROM orders LIMIT 1)
UNION ALL SELECT 'trend_change', count(DISTINCT date_trunc('month', o_orderdate)) FROM orders
UNION ALL SELECT 'join_coverage', count(*) FROM (SELECT 1 FROM customer LIMIT 1)""",
        "ans_top_profit": f"""SELECT subject, round(total, 4) AS value, round(total / (SELECT sum(gross_profit) FROM {SALES_M} a), 4) AS share
FROM (SELECT CAST(category AS VARCHAR) AS subject, sum(gross_profit) AS total FROM {SALES_M} t GROUP BY category)
ORDER BY total DESC NULLS LAST, subject ASC NULLS FIRST LIMIT 1""",
        "ans_top_margin": f"""SELECT CAST(category AS VARCHAR) AS subject,
  round(sum(gross_profit) / nullif(sum(revenue), 0), 4) AS value FROM {SALES_M} t GROUP BY category
ORDER BY sum(gross_profit) / nullif(sum(revenue), 0) DESC NULLS LAST, subject ASC NULLS FIRST LIMIT 1""",
        "ans_top_revenue_per_unit": f"""SELECT CAST(category AS VARCHAR) AS subject,
  round(sum(revenue) / nullif(sum(quantity), 0), 4) AS value FROM {SALES_M} t GROUP BY category
ORDER BY sum(revenue) / nullif(sum(quantity), 0) DESC NULLS LAST, subject ASC NULLS FIRST LIMIT 1""",
        "ans_margin_direction": f"""SELECT count(margin) AS periods, round(regr_slope(margin, idx), 8) AS slope,
  CASE WHEN regr_slope(margin, idx) IS NULL THEN 'unknown'
       WHEN regr_slope(margin, idx) > 1e-9 THEN 'improving'
       WHEN regr_slope(margin, idx) < -1e-9 THEN 'declining' ELSE 'flat' END AS direction
FROM (SELECT CAST(year(t) * 12 + month(t) AS DOUBLE) AS idx, sum(gross_profit) / nullif(sum(revenue), 0) AS margin
      FROM (SELECT date_trunc('month', ship_date) AS t, gross_profit, revenue FROM {SALES_M} x
            WHERE ship_date IS NOT NULL) GROUP BY t)""",
        "ans_quality_fallback": f"""SELECT 'frequent' AS kind, "column" AS subject, value, CAST(n AS DOUBLE) AS measure
FROM ({topk_sql(DIRTY, ['event_type', 'props'], 3)})
UNION ALL
SELECT 'missing', "column", NULL, null_ratio FROM ({profile_sql(DIRTY, DIRTY_COLS)})
  WHERE (null_count * 1.0 / (SELECT count(*) FROM {DIRTY} d)) > 0.3""",
        "ans_join_coverage": """SELECT table_name, key, rows, matched, round(matched / rows, 4) AS coverage FROM (
  SELECT 'orders' AS table_name, 'orderkey' AS key, count(*) AS rows, count(o.o_orderkey) AS matched, 1 AS o
    FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
  UNION ALL SELECT 'part', 'partkey', count(*), count(p.p_partkey), 2
    FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
  UNION ALL SELECT 'supplier', 'suppkey', count(*), count(s.s_suppkey), 3
    FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
  UNION ALL SELECT 'customer', 'custkey', count(*), count(c.c_custkey), 4
    FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  UNION ALL SELECT 'nation', 'nationkey', count(*), count(n.n_nationkey), 5
    FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  UNION ALL SELECT 'region', 'regionkey', count(*), count(r.r_regionkey), 6
    FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN region r ON r.r_regionkey = n.n_regionkey)""",
        "audit_rows": f"""SELECT 'summary_rows_match_model' AS "check", (SELECT count(*) FROM {SALES} s) AS left_n,
  (SELECT count(*) FROM {STAR_JOIN} j) AS right_n,
  (SELECT count(*) FROM {SALES} s) = (SELECT count(*) FROM {STAR_JOIN} j) AS ok""",
        "audit_kpis": f"""WITH a AS (SELECT l_returnflag AS key, sum(l_quantity) AS quantity, sum(l_extendedprice) AS extendedprice
           FROM lineitem GROUP BY 1),
b AS (SELECT returnflag AS key, sum(quantity) AS quantity, sum(extendedprice) AS extendedprice
      FROM {STAR_JOIN} j GROUP BY 1),
la AS (SELECT key, 'quantity' AS kpi, quantity AS v FROM a UNION ALL SELECT key, 'extendedprice', extendedprice FROM a),
lb AS (SELECT key, 'quantity' AS kpi, quantity AS v FROM b UNION ALL SELECT key, 'extendedprice', extendedprice FROM b)
SELECT coalesce(la.key, lb.key) AS key, coalesce(la.kpi, lb.kpi) AS kpi, round(la.v, 4) AS "left",
  round(lb.v, 4) AS "right", round(abs(la.v - lb.v), 6) AS diff, coalesce(abs(la.v - lb.v) <= 0.01, FALSE) AS ok
FROM la FULL OUTER JOIN lb ON la.key = lb.key AND la.kpi = lb.kpi""",
    }
    bundle = [
        (1, "line", "trend", "ship_date", "gross_profit", "sum", preset_line("ship_date", "gross_profit")),
        (2, "bar", "driver", "category", "gross_profit", "sum", preset_bar("category", "gross_profit", "sum")),
        (3, "bar", "segment_compare", "payment_method", "gross_profit", "sum",
         preset_bar("payment_method", "gross_profit", "sum")),
        (4, "bar", "behavior", "region", "gross_profit", "sum", preset_bar("region", "gross_profit", "sum")),
        (5, "bar", "risk", "category", "stock_quantity", "mean",
         preset_bar("category", "stock_quantity", "mean")),
    ]
    out["export_profile"] = out["table_profile"]
    out["chart_bundle"] = "\nUNION ALL\n".join(
        f"SELECT {i} AS chart_id, {lit(t)} AS chart_type, {lit(role)} AS role, {lit(x)} AS x_column, "
        f"{lit(y)} AS y_column, {lit(agg)} AS aggregation, label, value FROM ({sql})"
        for i, t, role, x, y, agg, sql in bundle)
    out["csv_to_charts"] = out["chart_bundle"]
    drawn = [("line", "trend", "ship_date", "revenue", "sum", preset_line("ship_date", "revenue")),
             ("bar", "driver", "payment_method", "revenue", "sum", preset_bar("payment_method", "revenue", "sum")),
             ("bar", "efficiency", "brand", "cost", "mean", preset_bar("brand", "cost", "mean"))]
    out["chart_specs"] = "\nUNION ALL\n".join(
        f"SELECT {i} AS chart_id, {lit(t)} AS chart_type, {lit(role)} AS role, {lit(x)} AS x_column, "
        f"{lit(y)} AS y_column, {lit(agg)} AS aggregation, label, value FROM ({sql})"
        for i, (t, role, x, y, agg, sql) in enumerate(drawn, 1))
    return out
