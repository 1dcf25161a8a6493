"""Derived KPI measures (MSR-1..8).

Every measure is a column expression added with ``withColumn`` (codegen,
no UDF); each is added only when the columns it needs exist.  Divisions use
``try_divide`` so a zero or null denominator gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exact import exact_sum
from quarry.functions.formula import add_formula_measures
from quarry.functions.numeric import safe_divide

# Names of the unit-count column, in order of preference.
UNIT_COLUMNS = ("units_sold", "quantity", "qty", "units")


@dataclass(frozen=True)
class Kpi:
    """A standard measure: the columns it needs, and its text and expression given the unit column's name."""

    name: str
    needs: tuple[str, ...]
    text: str
    build: Callable[[str | None], Column]
    per_unit: bool = False
    replaces: bool = False


# Names and formulas of the standard measures, in the order in which they may build on each other.
KPIS = (
    Kpi("gross_profit", ("revenue", "cost"), "revenue - cost", lambda u: F.col("revenue") - F.col("cost"), replaces=True),
    Kpi("gross_margin_pct", ("gross_profit", "revenue"), "gross_profit / revenue", lambda u: safe_divide("gross_profit", "revenue"), replaces=True),
    Kpi("line_item_revenue", ("quantity", "unit_price"), "quantity * unit_price", lambda u: F.col("quantity") * F.col("unit_price")),
    Kpi("inventory_value", ("price", "stock_quantity"), "price * stock_quantity", lambda u: F.col("price") * F.col("stock_quantity")),
    Kpi("avg_revenue_per_unit", ("revenue",), "revenue / {units}", lambda u: safe_divide("revenue", u), per_unit=True, replaces=True),
    Kpi("cost_per_unit", ("cost",), "cost / {units}", lambda u: safe_divide("cost", u), per_unit=True, replaces=True),
    Kpi("revenue_per_customer_record", ("revenue", "customer_id"), "revenue grouped by customer_id", lambda u: F.col("revenue"), replaces=True),
)


def add_measures(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Add every standard KPI whose columns exist; returns the frame and the measure list."""
    units = next((c for c in UNIT_COLUMNS if c in df.columns), None)
    made = []
    for kpi in KPIS:
        ready = set(kpi.needs) <= set(df.columns) and (units is not None or not kpi.per_unit)
        if ready and (kpi.replaces or kpi.name not in df.columns):
            df = df.withColumn(kpi.name, kpi.build(units))
            made.append({"name": kpi.name, "formula": kpi.text.format(units=units), "source": "inferred"})
    return df, made


def revenue_per_customer(df: DataFrame, customer: str = "customer_id",
                         revenue: str = "revenue") -> DataFrame:
    """Revenue summed per customer (the aggregate MSR-7 describes).
    A partial aggregate per task keeps a hot customer from skewing the shuffle."""
    return df.groupBy(customer).agg(exact_sum(F.col(revenue)).alias("revenue"),
                                    F.count(F.lit(1)).alias("records"))


def add_formulas(df: DataFrame, measures: list[dict]) -> tuple[DataFrame, list[dict]]:
    """User formula measures (MSR-8); see :mod:`quarry.functions.formula`."""
    return add_formula_measures(df, measures)
