import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from quarry.plans import catalog, oracles  # noqa: E402


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    out = entry.entry(spark)
    rows = out.collect()
    assert out.columns == ["x", "y"] and 0 < len(rows) <= 12


def test_pruned_sales_view_equals_full_view(spark):
    from quarry.plans.views import v_sales
    sf = "/root/testdata/sf0.001"
    for cols in (["category", "revenue"], ["customer_id", "revenue"], ["region", "cost"], ["ship_date"]):
        pruned = sorted(v_sales(spark, sf, cols).collect())
        full = sorted(v_sales(spark, sf).select(*cols).collect())
        assert pruned == full
