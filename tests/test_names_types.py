import datetime as dt

from quarry.functions.names import dataset_name, normalize_name, semantic_hint, unique_names
from quarry.operators import types as ty
from quarry.operators.profile import prepare


def test_normalize_name_rules():
    assert normalize_name("Sale Date") == "sale_date"
    assert normalize_name("Revenue ($)") == "revenue"
    assert normalize_name("  __Line--Status__ ") == "line_status"
    assert normalize_name("$$$") == "unnamed_column"
    assert normalize_name("Größe m²") == "größe_m²"


def test_unique_names_after_clash():
    assert unique_names(["a_b", "a_b", "a_b_2", "c"]) == ["a_b", "a_b_2", "a_b_2_2", "c"]


def test_dataset_name():
    assert dataset_name("/x/Sales Q1 (2026).csv") == "sales_q1_2026"
    assert dataset_name("/x/___.csv") == "dataset"


def test_semantic_hints_first_rule_wins():
    assert semantic_hint("total_revenue").startswith("Likely monetary")
    assert semantic_hint("updated_at") == "Likely date/time field."
    assert semantic_hint("customer_segment").startswith("Likely customer")
    assert semantic_hint("ship_country") == "Likely geographic dimension."
    assert semantic_hint("price_date").startswith("Likely monetary")
    assert semantic_hint("quantity") is None


def test_reference_messy_names(df):
    # the reference's first test: names cleaned, "100"-style strings numeric
    raw = df([("2026-01-01", "100", "North"), ("2026-01-02", "250", "South")],
             "`Sale Date` string, `Revenue ($)` string, Region string")
    clean = prepare(raw)
    assert clean.columns == ["sale_date", "revenue", "region"]
    kinds = {f.name: f.metadata["semantic_type"] for f in clean.schema.fields}
    assert kinds == {"sale_date": "datetime", "revenue": "numeric", "region": "categorical"}
    assert [r.revenue for r in clean.orderBy("sale_date").collect()] == [100, 250]
    assert clean.count() == 2


def _types(df, values):
    frame = df([(v,) for v in values], "x string")
    return ty.infer_types(frame)[0]


def test_numeric_threshold_90_percent(df):
    ninety = [str(i) for i in range(9)] + ["oops"]
    assert _types(df, ninety).semantic_type == "numeric"
    eighty_nine = [str(i) for i in range(89)] + ["bad"] * 11
    assert _types(df, eighty_nine).semantic_type != "numeric"


def test_integral_vs_double_storage(df):
    assert _types(df, ["1", "2", "3.0"]).storage == "bigint"
    assert _types(df, ["1", "2.5"]).storage == "double"


def test_date_threshold_and_mixed_formats(df):
    iso = ["2026-01-%02d" % d for d in range(1, 10)] + ["junk"]
    t = _types(df, iso)
    assert t.semantic_type == "datetime" and t.date_pattern == "iso"
    us = ["01/%02d/2026" % d for d in range(1, 10)] + ["2026-01-01"]
    t = _types(df, us)
    assert t.semantic_type == "datetime" and t.date_pattern == "MM/dd/yyyy"
    mixed = ["01/%02d/2026" % d for d in range(1, 6)] + ["2026-01-%02d" % d for d in range(1, 6)]
    assert _types(df, mixed).semantic_type != "datetime"


def test_junk_numbers_and_blanks_coerce_to_null(df):
    frame = df([("5",), ("$5",), ("1_0",), ("  ",), (None,), ("7",), ("8",), ("9",), ("10",),
                ("11",), ("12",), ("13",), ("14",), ("15",), ("16",), ("17",), ("18",),
                ("19",), ("20",), ("21",), ("22",), ("23",)], "x string")
    typed, types = ty.infer_and_coerce(frame)
    assert types[0].semantic_type == "numeric"
    vals = [r.x for r in typed.collect()]
    assert vals.count(None) == 4 and 5 in vals and 23 in vals


def test_all_null_is_text_and_boolean_detected(df):
    frame = df([(None, "true"), (None, "False"), (None, None)], "a string, b string")
    kinds = [t.semantic_type for t in ty.infer_types(frame)]
    assert kinds == ["text", "boolean"]


def test_categorical_vs_text(df):
    few = df([(f"v{i % 20}",) for i in range(100)], "x string")
    many = df([(f"v{i}",) for i in range(100)], "x string")
    assert ty.infer_types(few)[0].semantic_type == "categorical"
    assert ty.infer_types(many)[0].semantic_type == "text"


def test_typed_columns_keep_their_type(df):
    frame = df([(1, 2.5, True, dt.datetime(2026, 1, 1))], "a long, b double, c boolean, d timestamp")
    kinds = [t.semantic_type for t in ty.infer_types(frame)]
    assert kinds == ["numeric", "numeric", "boolean", "datetime"]


def test_day_first_and_month_name_dates(df):
    from quarry.operators import types as ty
    rows = [("25/12/2026", "Jan 5 2026", "5 Jan 2026", "14 February 2026"),
            ("03/01/2026", "Mar 31 2026", "31 Mar 2026", "1 May 2026")]
    frame = df(rows, "day_first string, month_first string, short string, long string")
    typed, types = ty.infer_and_coerce(frame)
    assert {t.column: t.semantic_type for t in types} == dict.fromkeys(frame.columns, "datetime")
    got = [[v.strftime("%Y-%m-%d") for v in r] for r in typed.collect()]
    assert got == [["2026-12-25", "2026-01-05", "2026-01-05", "2026-02-14"],
                   ["2026-01-03", "2026-03-31", "2026-03-31", "2026-05-01"]]


def test_every_date_pattern_is_found_in_one_scan(spark):
    """Each pattern's dates, also a pattern without a shape, and texts that only look like dates or numbers."""
    texts = {"iso": ["2024-01-05", "2024-01-05T10:11:12", "2024-1-5 10:11:12.5"], "MM/dd/yyyy": ["01/25/2024", "12/31/2023", "02/28/2024"], "yyyy/MM/dd": ["2024/01/05"] * 3,
             "dd.MM.yyyy": ["05.01.2024"] * 3, "dd-MMM-yyyy": ["05-Jan-2024"] * 3, "MMM d, yyyy": ["Jan 5, 2024"] * 3, "yyyyMMdd'T'HHmmss": ["20240105T101112"] * 3, "dd/MM/yyyy": ["25/01/2024"] * 3}
    frame = spark.createDataFrame(list(zip(*texts.values(), ["1234-x", "+1e3", "inf"], ["true", "FALSE", " "], ["1", "2.5", "Infinity"], ["12", "7.0", None])),
                                  [*[f"c{i}" for i in range(len(texts))], "text", "flag", "number", "whole"])
    found = ty.infer_types(frame)
    assert [t.date_pattern for t in found[:len(texts)]] == list(texts) and {t.semantic_type for t in found[:len(texts)]} == {"datetime"}
    assert [(t.semantic_type, t.storage) for t in found[len(texts):]] == [("categorical", "string"), ("boolean", "boolean"), ("numeric", "double"), ("numeric", "bigint")]
    days = spark.createDataFrame([("2024~01~05",)] * 3, "day string")
    assert ty.infer_types(days, patterns=("yyyy~MM~dd",))[0].date_pattern == "yyyy~MM~dd"


def test_charts_write_only_the_columns_they_draw(spark, monkeypatch):
    from quarry.plans import chart_plan
    written = []
    kept = chart_plan.reused
    monkeypatch.setattr(chart_plan, "reused", lambda df, enabled: written.append(df.columns) or kept(df, enabled))
    frame = spark.createDataFrame([("a", 1.0, "z", 3.0), ("b", 2.0, "z", 4.0)], "g string, m double, unused string, other double")
    out = chart_plan.chart_bundle(frame, [], specs=[chart_plan.ChartSpec("bar", "g", "m", "sum", "driver", "general")], persist=True)
    assert written == [["g", "m"]] and {(r["label"], r["value"]) for r in out.collect()} == {("a", 1.0), ("b", 2.0)}
