"""Registered queries: one per operator of the inventory.

Every query reads the driver's tables (or views Spark derives from them) in
full and runs the library's operators; ``oracles.py`` holds the matching
DuckDB SQL.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exact import exact_sum
from quarry.operators import answers, audit, charts, measures, profile, summary
from quarry.operators import types as ty
from quarry.operators.model import build_model
from quarry.operators.relationships import (infer_relationships, key_overlap,
                                            key_uniqueness, relationships_frame)
from quarry.plans import analysis, chart_plan, views
from quarry.session import reused, scratch_path
from quarry.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def sales(spark, sf, columns=None) -> DataFrame:
    """Sales view plus KPI measures; ``columns`` limits the view (and so the
    joins built) to what the query reads."""
    return measures.add_measures(views.v_sales(spark, sf, columns))[0]


# view columns behind each measure a query may read
MEASURE_INPUTS = {"gross_profit": ("revenue", "cost"), "gross_margin_pct": ("revenue", "cost"),
                  "line_item_revenue": ("quantity", "unit_price"),
                  "inventory_value": ("price", "stock_quantity"),
                  "avg_revenue_per_unit": ("revenue", "quantity"),
                  "cost_per_unit": ("cost", "quantity")}


def needs(*cols) -> list[str]:
    out = []
    for c in cols:
        for v in MEASURE_INPUTS.get(c, (c,)):
            if v not in out:
                out.append(v)
    return out


def sales_units(spark, sf, columns=None) -> DataFrame:
    """V_SALES with a unit column that is 0 on some rows (quantity - 1), so
    the zero-denominator path of the per-unit measures is exercised."""
    base = views.v_sales(spark, sf, columns).withColumn("units_sold", F.col("quantity") - 1)
    return measures.add_measures(base)[0]


def star_model(spark, sf, match_flags=False):
    tabs = views.v_star(spark, sf)
    rels, stats = infer_relationships(tabs)
    # exact row counts (metadata-only on Parquet) for the choice of the base table
    rows = {name: df.count() for name, df in tabs.items()}
    return tabs, rels, build_model(tabs, rels, stats=stats, rows=rows, match_flags=match_flags)


# ---------------------------------------------------------------- sources / sinks

@query
def csv_roundtrip(spark, sf):
    """SRC-1: orders -> CSV on shared storage -> all-string read -> infer,
    coerce.  Output with the date as text."""
    path = scratch_path(spark, "orders-csv") + ".csv"
    orders = tables.read_table(spark, sf, "orders")
    (orders.write.mode("overwrite").option("header", True)
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    typed, _ = ty.infer_and_coerce(tables.read_dataset(spark, path))
    return typed.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                        "o_orderpriority")


@query
def csv_parts(spark, sf):
    """SRC-1: orders in part files whose headers differ in their order of columns (and one column that a part lacks)."""
    path = scratch_path(spark, "orders-parts") + ".csv"
    orders = tables.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    for i, cols in enumerate((orders.columns, orders.columns[::-1], orders.columns[1:] + orders.columns[:1], [c for c in orders.columns if c != "o_orderstatus"])):
        orders.where(F.col("o_orderkey") % 4 == i).select(*cols).write.mode("append").option("header", True).csv(path)
    typed, _ = ty.infer_and_coerce(tables.read_dataset(spark, path))
    return typed.select(*orders.columns)


@query
def table_counts(spark, sf):
    """SRC-2: named table set and row count per table."""
    paths = [f"{sf.rstrip('/')}/{t}.parquet" for t in ALL_TABLES]
    return tables.table_counts(tables.read_tables(spark, paths))


@query
def scan_stats(spark, sf):
    """SRC-3: chunked-scan statistics of lineitem."""
    return tables.scan_stats(tables.read_table(spark, sf, "lineitem"))


@query
def export_clean(spark, sf):
    """SNK-1: the clean sales table written with ISO timestamps, read back."""
    path = scratch_path(spark, "clean") + ".parquet"
    sinks.export_clean(views.v_sales(spark, sf), path)
    return spark.read.parquet(path)


@query
def export_summary(spark, sf):
    """SNK-2: numeric summary written as JSON lines, read back."""
    path = scratch_path(spark, "summary") + ".json"
    sinks.export_summary(summary.numeric_summary(tables.read_table(spark, sf, "lineitem")), path)
    return spark.read.schema(summary.SUMMARY_SCHEMA).json(path)


@query
def export_profile(spark, sf):
    """SNK-2: the profile of orders written as JSON lines, read back."""
    path = scratch_path(spark, "profile") + ".json"
    sinks.export_summary(table_profile(spark, sf), path)
    return spark.read.schema(profile.PROFILE_SCHEMA).json(path)


@query
def head_sample(spark, sf):
    """SRC-3: the first 50,000 line items in the order of their columns."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return tables.head_sample(tables.read_table(spark, sf, "lineitem").select(*cols), cols)


# ---------------------------------------------------------------- projections

MESSY = {"l_orderkey": " Order Key ", "l_linenumber": "Line#Number", "l_quantity": "QUANTITY",
         "l_extendedprice": "Extended--Price ($)", "l_returnflag": "return flag",
         "l_linestatus": "__Line Status__"}


@query
def normalized_columns_q(spark, sf):
    """PRJ-1: messy column names normalised."""
    li = tables.read_table(spark, sf, "lineitem")
    messy = li.select(*[F.col(c).alias(a) for c, a in MESSY.items()])
    return profile.normalize_columns(messy)


def _events_as_text(spark, sf):
    e = tables.read_table(spark, sf, "events")
    return e.select(*[F.col(c).cast("string").alias(c) for c in e.columns])


@query
def inferred_types(spark, sf):
    """PRJ-2: semantic types of an all-string copy of events."""
    return ty.types_frame(spark, ty.infer_types(_events_as_text(spark, sf)))


def _junk_quantity(spark, sf):
    li = tables.read_table(spark, sf, "lineitem")
    raw = (F.when(F.col("l_orderkey") % 20 == 0, F.lit("n/a"))
           .when(F.col("l_orderkey") % 20 == 1, F.lit(" "))
           .otherwise(F.col("l_quantity").cast("string")))
    return li.select("l_orderkey", "l_linenumber", raw.alias("quantity"))


@query
def coerce_values(spark, sf):
    """PRJ-3: numbers with injected junk, inferred and coerced."""
    typed, _ = ty.infer_and_coerce(_junk_quantity(spark, sf))
    return typed


@query
def pair_projection(spark, sf):
    """PRJ-4: (event_type, value) points with both present."""
    return charts.pair_projection(views.v_dirty(spark, sf), "event_type", "value")


@query
def blank_to_null(spark, sf):
    """PRJ-5: blanks become NULL; counts of values kept per column."""
    junk = _junk_quantity(spark, sf)
    clean = junk.select(ty.blank_to_null("quantity").alias("quantity"))
    return clean.agg(F.count(F.lit(1)).alias("rows"), F.count("quantity").alias("non_blank"))


# ---------------------------------------------------------------- profiling

@query
def null_profile(spark, sf):
    """PRF-1: null count and ratio per column of V_DIRTY."""
    rows, nulls = profile.null_counts(views.v_dirty(spark, sf))
    return spark.createDataFrame([(c, n, ty_round(n / max(rows, 1))) for c, n in nulls.items()],
                                 "column string, null_count long, null_ratio double")


@query
def distinct_profile(spark, sf):
    """PRF-2: exact distinct count per column of orders."""
    df = tables.read_table(spark, sf, "orders")
    counts = profile.distinct_counts(df)
    return spark.createDataFrame(list(counts.items()), "column string, unique_count long")


@query
def missing_warnings(spark, sf):
    """PRF-3: columns of V_DIRTY with more than 30% nulls."""
    return profile.missing_warnings(views.v_dirty(spark, sf))


@query
def iqr_outliers(spark, sf):
    """PRF-4: IQR outliers of every numeric column of lineitem and events."""
    rows = []
    for name in ("lineitem", "events"):
        df = tables.read_table(spark, sf, name)
        res = profile.iqr_outliers(df, summary.numeric_columns(df), with_bounds=True)
        for c, r in res.items():
            rows.append((name, c, ty_round(r["q1"]), ty_round(r["q3"]), r["outliers"]))
    return spark.createDataFrame(
        rows, "table_name string, column string, q1 double, q3 double, outlier_count long")


def ty_round(v):
    from quarry.functions.numeric import round_half_up
    return round_half_up(v, 4)


@query
def table_profile(spark, sf):
    """PRF-5: full profile of orders."""
    return profile.profile(tables.read_table(spark, sf, "orders")).to_frame(spark)


@query
def model_profile(spark, sf):
    """PRF-6: profile of the sales analysis table with its measures."""
    return profile.profile(sales(spark, sf)).to_frame(spark)


@query
def profile_increment(spark, sf):
    """PRF-5: a profile of orders taken further to a column that came later."""
    orders = tables.read_table(spark, sf, "orders")
    known = profile.profile(orders)
    return profile.profile_new_columns(orders.withColumn("o_total_thousands", F.col("o_totalprice") / 1000), known).to_frame(spark)


@query
def combined_profile(spark, sf):
    """PRF-7: manifest over the star tables and their analysis table."""
    tabs, _rels, model = star_model(spark, sf)
    return profile.combined_profile(tabs, model.frame)


@query
def manifest(spark, sf):
    """PRF-7: the long manifest of orders and customer and their analysis table."""
    star = views.v_star(spark, sf)
    return analysis.manifest(analysis.build_semantic_model({t: star[t] for t in ("orders", "customer")}))


@query
def column_roles(spark, sf):
    """AGG-6: role of every column of orders with its number of values."""
    df = tables.read_table(spark, sf, "orders")
    rows, nulls = profile.null_counts(df)
    return spark.createDataFrame([(role, c, rows - nulls[c]) for role, cols in summary.column_roles(df).items() for c in cols],
                                 "role string, column string, non_null long")


# ---------------------------------------------------------------- joins

@query
def key_uniqueness_q(spark, sf):
    """JON-1: uniqueness of every column of orders and customer."""
    parts = []
    for name in ("orders", "customer"):
        df = tables.read_table(spark, sf, name)
        parts.append(key_uniqueness(df, df.columns)
                     .select(F.lit(name).alias("table_name"), "column", "is_unique"))
    return parts[0].unionByName(parts[1])


@query
def key_overlap_q(spark, sf):
    """JON-2: overlap of orders.o_custkey with customer.c_custkey."""
    o = tables.read_table(spark, sf, "orders")
    c = tables.read_table(spark, sf, "customer")
    return key_overlap(o, c, "o_custkey", "c_custkey")


@query
def relationships(spark, sf):
    """JON-3: inferred relationships between the prefix-free star tables."""
    rels, _ = infer_relationships(views.v_star(spark, sf))
    return relationships_frame(spark, rels)


@query
def relationships_screened(spark, sf):
    """JON-3: the same relationships, pairs that theta sketches rule out not counted."""
    rels, _ = infer_relationships(views.v_star(spark, sf), screen=True)
    return relationships_frame(spark, rels)


@query
def star_join(spark, sf):
    """JON-4: star-join model; rows and revenue per region name."""
    _tabs, _rels, model = star_model(spark, sf)
    region = model.provenance[("region", "name")]
    return (model.frame.groupBy(F.col(region).alias("region"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(exact_sum(F.col("extendedprice")), 4).alias("revenue")))


# ---------------------------------------------------------------- measures

def _by_category(df, measure, digits):
    return df.groupBy("category").agg(
        F.round(exact_sum(F.col(measure)), digits).alias(f"{measure}_sum"),
        F.count(measure).alias("n"))


@query
def m_gross_profit(spark, sf):
    return _by_category(sales(spark, sf, needs("category", "gross_profit")), "gross_profit", 4)


@query
def m_gross_margin(spark, sf):
    return _by_category(sales(spark, sf, needs("category", "gross_margin_pct")), "gross_margin_pct", 4)


@query
def m_line_revenue(spark, sf):
    return _by_category(sales(spark, sf, needs("category", "line_item_revenue")),
                        "line_item_revenue", 4)


@query
def m_inventory_value(spark, sf):
    return _by_category(sales(spark, sf, needs("category", "inventory_value")), "inventory_value", 4)


@query
def m_revenue_per_unit(spark, sf):
    return _by_category(sales(spark, sf, needs("category", "avg_revenue_per_unit")),
                        "avg_revenue_per_unit", 4)


@query
def m_cost_per_unit(spark, sf):
    """Per-unit cost with units = quantity - 1: zero denominators give NULL."""
    return _by_category(sales_units(spark, sf, needs("category", "cost_per_unit")),
                        "cost_per_unit", 4)


@query
def m_revenue_per_customer(spark, sf):
    out = measures.revenue_per_customer(views.v_sales(spark, sf, ["customer_id", "revenue"]))
    return out.select("customer_id", F.round("revenue", 4).alias("revenue"), "records")


FORMULA = {"name": "profit_per_sq_unit", "formula": "(revenue - cost) / quantity ** 2"}


@query
def m_formula(spark, sf):
    df, status = measures.add_formulas(
        views.v_sales(spark, sf, ["category", "revenue", "cost", "quantity"]), [FORMULA])
    assert status and status[0]["status"] == "created", status
    return _by_category(df, "profit_per_sq_unit", 4)


FORMULAS = [{"name": "profit", "formula": "revenue - cost"}, {"name": "ratio", "formula": "(revenue - cost) / quantity"},
            {"name": "Revenue", "formula": "cost * 2"}, {"name": "bad_name", "formula": "revenue - unknown"}, {"name": "call", "formula": "abs(revenue)"},
            {"name": "deep", "formula": "-(revenue / (quantity * quantity)) + 1.5"}, {"name": "text", "formula": "category + 1"}]


@query
def formula_statuses(spark, sf):
    """MSR-8: several formulas, some of which are not allowed: the status of each that is, and its total."""
    df, status = measures.add_formulas(views.v_sales(spark, sf, ["category", "revenue", "cost", "quantity"]), FORMULAS)
    made = [s["name"] for s in status if s["status"] == "created"]
    totals = df.agg(*[F.round(exact_sum(F.col(m)), 4).alias(m) for m in made]).unpivot([], made, "name", "total")
    named = spark.createDataFrame([(s["name"], s["formula"], s["status"]) for s in status], "measure string, formula string, status string")
    return named.join(totals, F.col("measure") == F.col("name"), "left").select("measure", "formula", "status", "total")


# ---------------------------------------------------------------- summaries

@query
def numeric_summary(spark, sf):
    return summary.numeric_summary(tables.read_table(spark, sf, "lineitem"))


@query
def category_topk(spark, sf):
    return summary.category_topk(views.v_sales(spark, sf))


@query
def category_topk_candidates(spark, sf):
    """AGG-2 by frequent-items sketches and an exact recount of their candidates."""
    return summary.category_topk(views.v_sales(spark, sf), method="candidates")


@query
def corr_infinities(spark, sf):
    """AGG-3 over amounts with an infinity among them, and nulls."""
    return summary.correlations(views.v_infinite(spark, sf))


@query
def correlation_matrix(spark, sf):
    return summary.correlations(tables.read_table(spark, sf, "lineitem"))


@query
def strongest_correlation(spark, sf):
    return summary.strongest_correlation(tables.read_table(spark, sf, "lineitem"))


@query
def insight_facts(spark, sf):
    return summary.insight_facts(tables.read_table(spark, sf, "orders"))


# ---------------------------------------------------------------- charts

@query
def bar_sum_top12(spark, sf):
    """Gross profit by category, top 12 (the flagship slice)."""
    df = sales(spark, sf, needs("category", "gross_profit"))
    return charts.bar_data(df, "category", "gross_profit", "sum", digits=4)


@query
def bar_mean_top12(spark, sf):
    df = sales(spark, sf, needs("brand", "gross_margin_pct"))
    return charts.bar_data(df, "brand", "gross_margin_pct", "mean", digits=4)


@query
def bar_count_top12(spark, sf):
    df = sales_units(spark, sf, needs("brand", "cost_per_unit"))
    return charts.bar_data(df, "brand", "cost_per_unit", "count", digits=0)


@query
def line_trend_month(spark, sf):
    return charts.line_data(views.v_sales(spark, sf, ["ship_date", "revenue"]), "ship_date",
                            "revenue", "sum", grain="month", digits=4)


@query
def scatter_grid(spark, sf):
    df = views.v_sales(spark, sf, ["quantity", "unit_price"])
    return charts.scatter_grid(df, "quantity", "unit_price", bins=50)


@query
def histogram_bins(spark, sf):
    h = charts.histogram(views.v_sales(spark, sf, ["revenue"]), "revenue")
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query
def scatter_sample(spark, sf):
    """CHT-5: the raw points that a hash of their key selects."""
    return charts.scatter_sample(tables.read_table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 2000)


@query
def histogram_infinities(spark, sf):
    """CHT-6 over amounts with infinities: only finite values have a bin."""
    h = charts.histogram(views.v_infinite(spark, sf), "price")
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query
def density_infinities(spark, sf):
    """CHT-7 over continuous amounts with infinities."""
    d = charts.density(views.v_infinite(spark, sf), "price")
    return d.select("point", F.round("x", 6).alias("x"), F.round("density", 10).alias("density"))


@query
def density_curve(spark, sf):
    d = charts.density(tables.read_table(spark, sf, "lineitem"), "l_discount")
    return d.select("point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query
def heatmap_corr(spark, sf):
    cols = ["quantity", "unit_price", "revenue", "cost", "price", "stock_quantity"]
    with reused(sales(spark, sf, cols)) as df:
        return charts.heatmap(df, chart_plan.chart_numeric(df)[:chart_plan.HEATMAP_MAX_COLUMNS])


def _preset(spark, sf, role=None, angle=None) -> DataFrame:
    """The preset chart of a role or angle over the sales view.  It is chosen
    from the whole view's schema; its data come from a view with only the
    spec's columns, so only the joins behind them are built."""
    whole, ms = measures.add_measures(views.v_sales(spark, sf))
    spec = _preset_spec(whole, ms, role, angle)
    return _preset_data(sales(spark, sf, needs(spec.x, spec.y)), spec)


def _preset_spec(df, ms, role=None, angle=None):
    return next(s for s in chart_plan.candidate_specs(df, ms)
                if (role is None or s.role == role) and (angle is None or s.angle == angle))


def _preset_data(df, spec) -> DataFrame:
    return chart_plan.chart_data(df, spec).select(
        F.lit(spec.x).alias("x_column"), F.lit(spec.y).alias("y_column"), "label", "value")


@query
def chart_trend(spark, sf):
    return _preset(spark, sf, role="trend")


@query
def chart_segment(spark, sf):
    return _preset(spark, sf, role="segment_compare")


@query
def chart_category_mix(spark, sf):
    return _preset(spark, sf, role="driver")


@query
def chart_geography(spark, sf):
    return _preset(spark, sf, angle="geography")


@query
def chart_payment(spark, sf):
    return _preset(spark, sf, angle="payment_behavior")


@query
def chart_inventory(spark, sf):
    df = views.v_inventory(spark, sf)
    return _preset_data(df, _preset_spec(df, [], role="risk"))


@query
def chart_rating(spark, sf):
    df = views.v_rating(spark, sf)
    return _preset_data(df, _preset_spec(df, [], role="opportunity"))


@query
def chart_margin(spark, sf):
    return _preset(spark, sf, role="efficiency")


@query
def chart_bundle(spark, sf):
    df, ms = measures.add_measures(views.v_sales(spark, sf))
    return chart_plan.chart_bundle(df, ms, persist=True)


USER_CHARTS = [{"chart_type": "pie", "x": "category", "y": "revenue"}, {"chart_type": "bar", "x": "category", "y": "no_such_column"},
               {"chart_type": "Bar", "x": "payment_method", "y": "revenue", "aggregation": "SUM", "story_role": "driver"},
               {"chart_type": "bar", "x": "payment_method", "y": "revenue", "aggregation": "sum", "story_role": "again"},
               {"chart_type": "line", "x": "ship_date", "y": "revenue", "story_role": "trend"}, {"chart_type": "heatmap", "columns": ["revenue", "nothing"]},
               {"chart_type": "bar", "x": "brand", "y": "cost", "aggregation": "mean", "story_role": "efficiency"}]


@query
def chart_specs(spark, sf):
    """CHT-9: charts that a user proposes, as far as they can be drawn."""
    df = views.v_sales(spark, sf, ["category", "brand", "payment_method", "ship_date", "revenue", "cost"])
    return chart_plan.chart_bundle(df, [], specs=chart_plan.validate_specs(df, USER_CHARTS), persist=True)


@query
def csv_to_charts(spark, sf):
    """The whole path: the sales view as a CSV file, read, cleaned, typed, modelled, measured and charted."""
    path = scratch_path(spark, "sales-csv") + ".csv"
    sinks.export_clean(views.v_sales(spark, sf), path, "csv")
    return analysis.charts(analysis.analyze_files(spark, [path]))


# ---------------------------------------------------------------- answers

@query
def ans_ranges_outliers(spark, sf):
    cols = ["quantity", "unit_price", "revenue", "cost"]
    return answers.ranges_outliers(views.v_sales(spark, sf, cols), cols, persist=True)


@query
def ans_by_category(spark, sf):
    return answers.by_category(views.v_sales(spark, sf, ["category", "revenue"]), "revenue", "category")


@query
def ans_trend_change(spark, sf):
    return answers.trend_change(views.v_sales(spark, sf, ["ship_date", "revenue"]), "ship_date",
                                "revenue")


@query
def trend_seconds(spark, sf):
    """ANS-3 at the grain of seconds: a long series, in ranges of time."""
    return answers.trend_change(tables.read_table(spark, sf, "events"), "ts", "value", grain="second")


@query
def answers_by_roles(spark, sf):
    """ANS: which answers the roles of orders joined with customer allow, and the rows of each."""
    star = views.v_star(spark, sf)
    semantic = analysis.build_semantic_model({t: star[t] for t in ("orders", "customer")}, prepared=True)
    return spark.createDataFrame([(name, job().count()) for name, job in analysis.applicable_answers(semantic).items()], "answer string, n long")


@query
def ans_top_profit(spark, sf):
    return answers.top_contributor(sales(spark, sf, needs("category", "gross_profit")), "category",
                                   "gross_profit")


@query
def ans_top_margin(spark, sf):
    return answers.top_margin(sales(spark, sf, needs("category", "gross_profit")), "category")


@query
def ans_top_revenue_per_unit(spark, sf):
    return answers.top_revenue_per_unit(sales(spark, sf, needs("category", "revenue", "quantity")),
                                        "category", "quantity")


@query
def ans_margin_direction(spark, sf):
    return answers.margin_direction(sales(spark, sf, needs("ship_date", "gross_profit")), "ship_date")


@query
def ans_quality_fallback(spark, sf):
    return answers.quality_fallback(views.v_dirty(spark, sf))


@query
def ans_join_coverage(spark, sf):
    _tabs, _rels, model = star_model(spark, sf, match_flags=True)
    return answers.join_coverage(model)


# ---------------------------------------------------------------- audit

@query
def audit_rows(spark, sf):
    """AUD-1: the sales view and the star-join model have the same rows."""
    _tabs, _rels, model = star_model(spark, sf)
    return audit.audit_rows(views.v_sales(spark, sf), model.frame)


@query
def audit_kpis(spark, sf):
    """AUD-2: base-table totals per return flag against star-join totals."""
    _tabs, _rels, model = star_model(spark, sf)
    base = tables.read_table(spark, sf, "lineitem").toDF(
        *[c[2:] for c in tables.read_table(spark, sf, "lineitem").columns])
    return audit.audit_kpis(base, model.frame, "returnflag", ["quantity", "extendedprice"])


def queries() -> dict[str, Query]:
    renamed = {"normalized_columns_q": "normalized_columns", "key_uniqueness_q": "key_uniqueness",
               "key_overlap_q": "key_overlap"}
    return {renamed.get(k, k): v for k, v in REGISTRY.items()}
