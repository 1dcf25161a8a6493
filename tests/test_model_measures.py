import pytest

from quarry.functions.formula import FormulaError, add_formula_measures, compile_formula
from quarry.operators.measures import add_measures
from quarry.operators.model import build_model
from quarry.operators.profile import prepare
from quarry.operators.relationships import infer_relationships, key_overlap


def _sales_products(df):
    sales = df([("2026-01-01", 1, 1000, 600, 10), ("2026-01-02", 2, 1400, 900, 14),
                ("2026-01-03", 1, 700, 300, 7)],
               "date string, product_id long, revenue long, cost long, units_sold long")
    products = df([(1, "Atlas", "Platform"), (2, "Nova", "Insight")],
                  "product_id long, product_name string, category string")
    return {"sales": prepare(sales), "products": prepare(products)}


def test_reference_multi_file_model(df):
    tables = _sales_products(df)
    rels, stats = infer_relationships(tables)
    assert [(r.left_table, r.right_table, r.left_column, r.relationship_type) for r in rels] == [
        ("sales", "products", "product_id", "many_to_one")]
    model = build_model(tables, rels, stats=stats)
    assert model.base_table == "sales" and model.frame.count() == 3
    frame, measures = add_measures(model.frame)
    names = {m["name"] for m in measures}
    assert {"gross_profit", "gross_margin_pct", "avg_revenue_per_unit", "cost_per_unit"} <= names
    row = frame.where("date = '2026-01-01'").first()
    assert row.gross_profit == 400 and row.gross_margin_pct == pytest.approx(0.4)
    assert row.category == "Platform"


def test_wrong_key_is_resolved_through_provenance(df):
    # supplier joins before customer and brings its own nationkey; the
    # customer-nation link (earlier in table order) must use customer's key
    fact = df([(1, 500, 100), (2, 501, 101)], "id long, orderkey long, suppkey long")
    orders = df([(500, 10), (501, 11)], "orderkey long, custkey long")
    customer = df([(10, 1), (11, 2)], "custkey long, nationkey long")
    supplier = df([(100, 2), (101, 1)], "suppkey long, nationkey long")
    nation = df([(1, "ONE"), (2, "TWO")], "nationkey long, nname string")
    tables = {"fact": fact, "orders": orders, "customer": customer, "supplier": supplier,
              "nation": nation}
    rels, stats = infer_relationships(tables)
    model = build_model(tables, rels, stats=stats)
    assert [j["table"] for j in model.joins] == ["orders", "supplier", "customer", "nation"]
    assert model.provenance[("customer", "nationkey")] == "nationkey_customer"
    got = {r.id: r.nname for r in model.frame.collect()}
    assert got == {1: "ONE", 2: "TWO"}


def test_overlap_int_vs_string_and_nulls(df):
    a = df([(1,), (2,), (None,), (3,)], "k long")
    b = df([("1",), ("2",), (None,), ("9",), ("10",)], "k string")
    r = key_overlap(a, b, "k").first()
    assert (r.shared, r.left_distinct, r.right_distinct, r.overlap_ratio) == (2, 3, 4, 0.6667)
    r2 = key_overlap(b, a, "k").first()
    assert r2.overlap_ratio == r.overlap_ratio  # symmetric


def test_left_join_never_multiplies_rows(df):
    fact = df([(1,), (1,), (2,), (None,)], "k long")
    dim_dup = df([(1, "a"), (1, "b")], "k long, v string")
    tables = {"fact": fact, "dim": dim_dup}
    rels, stats = infer_relationships(tables)
    model = build_model(tables, rels, stats=stats)
    assert model.frame.count() == 4 and "v" not in model.frame.columns


def test_zero_denominators_give_null(df):
    frame = df([(10.0, 0.0, 0.0), (10.0, 5.0, 2.0)], "revenue double, cost double, quantity double")
    out, _ = add_measures(frame)
    rows = out.orderBy("cost").collect()
    assert rows[0].cost_per_unit is None and rows[0].avg_revenue_per_unit is None
    assert rows[1].cost_per_unit == 2.5
    zero_rev, _ = add_measures(df([(0.0, 1.0)], "revenue double, cost double"))
    assert zero_rev.first().gross_margin_pct is None


def test_formula_whitelist_and_semantics(df):
    assert compile_formula("(revenue - cost) / quantity ** 2")[1] == {"revenue", "cost", "quantity"}
    for bad in ("__import__('os')", "revenue if cost else 1", "1 + 2", "revenue + True", "revenue +", "revenue // 2", "a.b", "'x'", "+revenue"):
        with pytest.raises(FormulaError):
            compile_formula(bad)
    frame = df([(-7.0, 3.0, 0.0)], "a double, b double, z double")
    out, status = add_formula_measures(frame, [
        {"name": "m", "formula": "a % b"}, {"name": "d", "formula": "a / z"},
        {"name": "a", "formula": "b * 2"}, {"name": "bad", "formula": "a + missing"},
        {"name": "neg", "formula": "-a ** 2"}])
    row = out.first()
    assert row.m == 2.0 and row.d is None and row.a == -7.0 and row.neg == -49.0
    assert [s["name"] for s in status] == ["m", "d", "neg"]


def test_every_formula_is_kept(df):
    frame = df([(1.0,)], "a double")
    _, status = add_formula_measures(frame, [{"name": f"f{i}", "formula": "a + 1"} for i in range(9)])
    assert len(status) == 9


def test_approx_overlap_close_to_exact(spark):
    a = spark.range(0, 3000).withColumnRenamed("id", "k")
    b = spark.range(1500, 6000).withColumnRenamed("id", "k")
    exact = key_overlap(a, b, "k").first()
    approx = key_overlap(a, b, "k", approx=True).first()
    assert exact.shared == 1500 and exact.overlap_ratio == 0.5
    assert abs(approx.shared - 1500) < 150 and abs(approx.overlap_ratio - 0.5) < 0.05
