from quarry.plans import analysis


def _tables(df):
    orders = df([("1", "10", "2026-01-05", "100", "60", "4"), ("2", "10", "2026-02-05", "200", "80", "5"),
                 ("3", "11", "2026-03-05", "50", "60", "0"), ("4", None, "2026-04-05", None, "10", "2")],
                "`Order ID` string, `Customer ID` string, `Order Date` string, Revenue string, Cost string, Quantity string")
    customers = df([("10", "North"), ("11", "South")], "`Customer ID` string, Region string")
    return {"orders": orders, "customers": customers}


def test_semantic_model_manifest_and_answers(df):
    semantic = analysis.build_semantic_model(_tables(df))
    assert semantic.model.base_table == "orders" and semantic.frame.count() == 4
    assert "region" in semantic.frame.columns and not any(c in semantic.frame.columns for c in semantic.model.flags.values())
    rows = analysis.manifest(semantic).collect()
    by_kind = {k: [r for r in rows if r.kind == k] for k in ("column", "analysis", "base", "relationship", "measure")}
    assert len(by_kind["column"]) == 8 and [r.table_name for r in by_kind["base"]] == ["orders"]
    assert [(r.column, r.type, r.detail) for r in by_kind["relationship"]] == [("customer_id", "many_to_one", "customers.customer_id")]
    assert {r.column: r.detail for r in by_kind["measure"]}["gross_profit"] == "revenue - cost"
    revenue = next(r for r in by_kind["column"] if r.column == "revenue")
    assert (revenue.null_count, revenue.null_ratio, revenue.missing_warning, revenue.outlier_warning) == (1, 0.25, False, False)
    assert [r.column for r in by_kind["analysis"]] == semantic.frame.columns
    jobs = analysis.applicable_answers(semantic)
    assert set(jobs) == {"ranges_outliers", "by_category", "strongest_correlation", "trend_change", "top_contributor", "top_margin",
                         "top_revenue_per_unit", "margin_direction", "join_coverage"}
    best = jobs["top_contributor"]().first()
    assert (best.subject, best.value) == ("North", 160.0)
    assert jobs["join_coverage"]().first().matched == 3


def test_answers_and_summaries_without_numbers(df):
    semantic = analysis.build_semantic_model({"t": df([("a",), ("a",), (None,)], "kind string")})
    assert list(analysis.applicable_answers(semantic)) == ["quality_fallback"]
    made = analysis.summarize(semantic.frame)
    assert [(r.value, r.n) for r in made["categories"].collect()] == [("a", 2)]
    assert made["numeric"].count() == made["correlations"].count() == 0
    assert [r.kind for r in made["facts"].collect()] == ["leader"]


def test_files_to_charts(spark, df, tmp_path):
    for name, table in _tables(df).items():
        table.coalesce(1).write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    semantic = analysis.analyze_files(spark, [f"{tmp_path}/orders.csv", f"{tmp_path}/customers.csv"])
    rows = analysis.charts(semantic).collect()
    bars = {(r.label, r.value) for r in rows if r.chart_type == "bar" and r.x_column == "region" and r.y_column == "gross_profit"}
    assert bars == {("North", 160.0), ("South", -10.0), (None, 0.0)}
