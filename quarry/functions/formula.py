"""User formula measures compiled to Spark ``Column`` expressions.

A formula such as ``(revenue - cost) / quantity ** 2`` is parsed with Python's
own ``ast`` module; only arithmetic on numeric columns and numeric constants is
accepted.  The result is a plain ``Column``, so Catalyst folds constants,
prunes columns and codegens it like any built-in expression (no UDF).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarry.functions.numeric import floor_mod, is_numeric_type, safe_divide

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: safe_divide,
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.Mod: floor_mod,
}


class FormulaError(ValueError):
    pass


def compile_formula(formula: str) -> tuple[Column, frozenset[str]]:
    """An allowed formula as a ``Column``, and the columns it uses; FormulaError
    for any other text, and for one without a column.  A result that is no
    finite number is NULL."""
    used: set[str] = set()

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Name(id=name):
                used.add(name)
                return F.col(name).cast("double")
            case ast.Constant(value=int() | float() as number) if number is not True and number is not False:
                return F.lit(float(number))
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -build(inner)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](build(left), build(right))
        raise FormulaError(f"not allowed in a formula: {ast.unparse(node)}")

    try:
        value = build(ast.parse(formula, mode="eval").body)
    except (SyntaxError, RecursionError, OverflowError) as bad:
        raise FormulaError(f"no formula: {formula!r}") from bad
    if not used:
        raise FormulaError(f"a formula without a column: {formula!r}")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value), frozenset(used)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def _requests(df: DataFrame, measures: list[dict]) -> Iterator[tuple[str, str, str]]:
    """(name, formula, description) of the requests that have a name and use numeric columns of ``df`` only."""
    allowed = set(numeric_columns(df))
    for request in measures:
        name, formula, text = (str(request.get(k, "")) for k in ("name", "formula", "description"))
        try:
            usable = compile_formula(formula)[1] <= allowed
        except FormulaError:
            continue
        if name.strip() and usable:
            yield name.strip(), formula, text.strip()


def validate_measures(df: DataFrame, measures: list[dict]) -> list[dict]:
    """Every request that passes, in order; none is cut off."""
    return [dict(zip(("name", "formula", "description"), r)) for r in _requests(df, measures)]


def add_formula_measures(df: DataFrame, measures: list[dict]) -> tuple[DataFrame, list[dict]]:
    """Add each passing request as a column, with one status each.  A name
    that the frame already has, by the session's rule on upper and lower case,
    is skipped; a formula that does not resolve gets
    ``formula_execution_failed`` instead of raising."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = (lambda s: s) if exact else str.lower
    taken, statuses = {fold(c) for c in df.columns}, []
    for name, formula, text in _requests(df, measures):
        if fold(name) in taken:
            continue
        status = {"name": name, "formula": formula, "description": text, "status": "created"}
        try:
            wider = df.withColumn(name, compile_formula(formula)[0])
            wider.schema  # resolves now, so that a bad reference fails here
        except (AnalysisException, FormulaError):
            status["status"] = "formula_execution_failed"
        else:
            df = wider
            taken.add(fold(name))
        statuses.append(status)
    return df, statuses
