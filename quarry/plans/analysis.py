"""From tables to finished analysis in one call: model, manifest, summaries, answers, charts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.names import semantic_hint
from quarry.operators import answers, summary
from quarry.operators.measures import UNIT_COLUMNS, add_measures
from quarry.operators.model import Model, build_model
from quarry.operators.profile import MISSING_RATIO_WARN, TableProfile, prepare, profile
from quarry.operators.relationships import Relationship, infer_relationships
from quarry.plans import chart_plan
from quarry.session import reused
from quarry.sources.tables import read_tables

MANIFEST_SCHEMA = ("kind string, table_name string, column string, type string, spark_type string, hint string, "
                   "null_count long, null_ratio double, missing_warning boolean, outlier_count long, "
                   "outlier_warning boolean, detail string")


@dataclass
class SemanticModel:
    """Prepared tables, how they relate, and the analysis table with its measures."""

    tables: dict[str, DataFrame]
    relationships: list[Relationship]
    model: Model
    frame: DataFrame
    measures: list[dict]

    def profiles(self, approx: bool = False) -> dict[str, TableProfile]:
        return {name: profile(df, approx=approx) for name, df in self.tables.items()}


def build_semantic_model(tables: dict[str, DataFrame], prepared: bool = False) -> SemanticModel:
    """Clean and type the tables (unless ``prepared``), relate and join them, and add the measures."""
    clean = tables if prepared else {name: prepare(df) for name, df in tables.items()}
    found, stats = infer_relationships(clean)
    model = build_model(clean, found, stats=stats, match_flags=True)
    visible = [c for c in model.frame.columns if c not in model.flags.values()]
    frame, measures = add_measures(model.frame.select(*visible))
    return SemanticModel(clean, found, model, frame, measures)


def manifest(semantic: SemanticModel, approx: bool = False) -> DataFrame:
    """PRF-7 as one long table; ``kind`` says what a row is about.

    column: type, hint, nulls, outliers and both warnings of every column of
    every table; analysis: the joined table's schema with hints; base: its base
    table; relationship: its type, with the partner in ``detail``; measure: its
    formula in ``detail``.
    """
    def row(kind: str, **known) -> tuple:
        return (kind, *(known.get(c.split()[0]) for c in MANIFEST_SCHEMA.split(", ")[1:]))

    rows = [row("column", table_name=name, column=c.column, type=c.type, spark_type=c.spark_type, hint=c.semantic_hint,
                null_count=c.null_count, null_ratio=c.null_ratio, outlier_count=c.outlier_count,
                missing_warning=c.null_count > MISSING_RATIO_WARN * max(table.rows, 1), outlier_warning=(c.outlier_count or 0) > 0)
            for name, table in semantic.profiles(approx).items() for c in table.columns]
    rows += [row("analysis", table_name="analysis", column=f.name, spark_type=f.dataType.simpleString(), hint=semantic_hint(f.name))
             for f in semantic.frame.schema.fields]
    rows.append(row("base", table_name=semantic.model.base_table))
    rows += [row("relationship", table_name=r.left_table, column=r.left_column, type=r.relationship_type,
                 detail=f"{r.right_table}.{r.right_column}") for r in semantic.relationships]
    rows += [row("measure", table_name="analysis", column=m["name"], detail=m["formula"]) for m in semantic.measures]
    return semantic.frame.sparkSession.createDataFrame(rows, MANIFEST_SCHEMA)


def summarize(df: DataFrame, quantiles: str = "exact") -> dict[str, DataFrame]:
    """Numeric summary, category top-k, correlations and facts of one table."""
    with reused(df.select(*summary.numeric_columns(df), *summary.categorical_columns(df)), "auto") as kept:
        return {"numeric": summary.numeric_summary(kept, quantiles=quantiles, persist=False),
                "categories": summary.category_topk(df),
                "correlations": summary.correlations(kept, persist=False),
                "facts": summary.insight_facts(kept, quantiles=quantiles, persist=False)}


def applicable_answers(semantic: SemanticModel) -> dict[str, Callable[[], DataFrame]]:
    """The answers that the analysis table's roles and measures allow, by name; each runs when called."""
    df, roles = semantic.frame, summary.column_roles(semantic.frame)
    numeric, category, date = (roles[r] for r in ("numeric", "categorical", "datetime"))
    made = {m["name"] for m in semantic.measures}
    units = next((c for c in UNIT_COLUMNS if c in df.columns), None)
    table: list[tuple[str, bool, Callable[[], DataFrame]]] = [
        ("ranges_outliers", bool(numeric), lambda: answers.ranges_outliers(df, numeric)),
        ("by_category", bool(numeric and category), lambda: answers.by_category(df, numeric[0], category[0])),
        ("strongest_correlation", len(numeric) > 1, lambda: summary.strongest_correlation(df)),
        ("trend_change", bool(numeric and date), lambda: answers.trend_change(df, date[0], numeric[0])),
        ("top_contributor", bool("gross_profit" in made and category), lambda: answers.top_contributor(df, category[0])),
        ("top_margin", bool("gross_margin_pct" in made and category), lambda: answers.top_margin(df, category[0])),
        ("top_revenue_per_unit", bool("avg_revenue_per_unit" in made and category), lambda: answers.top_revenue_per_unit(df, category[0], units)),
        ("margin_direction", bool("gross_margin_pct" in made and date), lambda: answers.margin_direction(df, date[0])),
        ("join_coverage", bool(semantic.model.joins), lambda: answers.join_coverage(semantic.model)),
    ]
    chosen = {name: job for name, applies, job in table if applies}
    return chosen or {"quality_fallback": lambda: answers.quality_fallback(df)}


def charts(semantic: SemanticModel) -> DataFrame:
    """The chart bundle of the analysis table."""
    return chart_plan.chart_bundle(semantic.frame, semantic.measures, persist=True)


def analyze_files(spark: SparkSession, paths: list[str]) -> SemanticModel:
    """Files of any supported kind to a semantic model, ready for manifest, summaries, answers and charts."""
    return build_semantic_model(read_tables(spark, paths))
