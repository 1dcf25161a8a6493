"""Numeric summary, category top-k, correlations and insight facts (AGG-1..6).

* numeric summary: one aggregate for count/mean/min/max/std of every numeric
  column, plus the exact-quantile passes for the medians;
* top-k: all string columns are unpivoted into (column, value) and counted in
  one grouped job; ``row_number`` over the small per-value counts is planned
  with a partial ``WindowGroupLimit`` before its shuffle, so at most k rows per
  column and partition move;
* correlations: two passes of plain sums over mean-shifted values (fixed-size
  partial state per task); of many columns, masked matrix products of batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import (MAX_AGG_FIELDS, aggregate_row, is_datetime_type, is_numeric_type,
                                      no_nan, round_half_up)
from quarry.operators.quantiles import column_quantiles
from quarry.session import KEEP_BYTES, plan_bytes, reused, stored

# Fixed values of the summary step.
TOP_K = 8
DIGITS = 4
#: rows of a masked product, columns that a task sends at once, and shares of the tasks whose blocks are added first
GRAM_ROWS = 4096
GRAM_SENT = 64
GRAM_PARTS = 64
#: candidates for the most frequent values of a column, values that a sketch tracks,
#: and the sketch's error as a share of the rows, times the values tracked
CANDIDATES = 1000
TRACKED = 10_000
SKETCH_ERROR = 2.625
#: what rounding may leave of a sum of squares
ROUNDING = 1e-12


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime_type(f.dataType)]


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """AGG-6: numeric, categorical (string) and datetime column lists, from
    the schema alone."""
    return {"numeric": numeric_columns(df), "categorical": categorical_columns(df),
            "datetime": datetime_columns(df)}


def _num(c: str) -> Column:
    return no_nan(F.col(c).cast("double"))


SUMMARY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
])


def _r(v):
    return round_half_up(v, DIGITS)


def numeric_summary_rows(df: DataFrame, cols: list[str] | None = None,
                         quantiles: str = "exact", medians: dict | None = None) -> list[tuple]:
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        v = _num(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}"), F.stddev_samp(v).alias(f"s{i}")]
    row = aggregate_row(df, aggs)
    if medians is None:
        medians = {c: m[0] for c, m in column_quantiles(df, cols, [0.5], method=quantiles).items()}
    return [(c, row[f"n{i}"], _r(row[f"a{i}"]), _r(medians[c]), _r(row[f"lo{i}"]),
             _r(row[f"hi{i}"]), _r(row[f"s{i}"])) for i, c in enumerate(cols)]


def numeric_summary(df: DataFrame, cols: list[str] | None = None,
                    quantiles: str = "exact", persist="auto") -> DataFrame:
    """column, count, mean, median, min, max, std (sample), rounded to 4."""
    cols = numeric_columns(df) if cols is None else cols
    with reused(df.select(*cols), persist) as kept:
        rows = numeric_summary_rows(kept, cols, quantiles)
    return df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)


def category_topk(df: DataFrame, k: int = TOP_K, max_cols: int | None = None,
                  cols: list[str] | None = None, method: str = "auto") -> DataFrame:
    """Most frequent values of all string columns (of the first ``max_cols``, if given).

    Values are trimmed and blanks dropped; ties are broken by value.
    Result: column, value, n, rank; the same, exactly, by either method:
    ``"counts"`` counts every value of every column in one grouped job;
    ``"candidates"`` lets only candidates move (see :func:`_candidate_topk`).
    ``"auto"`` counts where Catalyst takes the columns to be small.
    """
    cols = (categorical_columns(df) if cols is None else cols)[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int")
    if method not in ("auto", "counts", "candidates"):
        raise ValueError(f"unknown top-k method {method!r}")
    if method == "auto":
        method = "counts" if plan_bytes(df.select(*cols)) <= KEEP_BYTES else "candidates"
    return _candidate_topk(df, cols, k) if method == "candidates" else _ranked(_column_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), k)


def _column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) of every cell with a value."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value"))
        for c in cols])).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _candidate_topk(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """Top-k by frequent-items sketches, proven by an exact recount.

    A scan sketches the values' hashes (bounded state for each column and
    task): a value that is not among a sketch's candidates has at most as many
    rows as the sketch's error or its last candidate's estimate.  A second scan
    counts the candidates' values exactly; only these are shuffled.  Where the
    k-th of them has more rows than that bound, or they cover all rows, no other
    value can enter.  Only columns without that proof (an id, in which no value
    is frequent) are counted in full.
    """
    candidates = max(CANDIDATES, 4 * k)
    sketch = F.expr(f"approx_top_k(h, {candidates}, {max(TRACKED, candidates)})")
    cells = _column_values(df, cols).withColumn("h", F.xxhash64("value"))
    found = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).collect()
    if not found:
        return _ranked(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), k)
    bound = {r["column"]: max(SKETCH_ERROR * r["n"] / max(TRACKED, candidates), r["top"][-1]["count"] if len(r["top"]) == candidates else 0) for r in found}
    listed = df.sparkSession.createDataFrame([(r["column"], t["item"]) for r in found for t in r["top"]], "of string, item long")
    # candidates times the columns: a bounded list of hashes
    near = cells.join(F.broadcast(listed), (F.col("column") == F.col("of")) & (F.col("h") == F.col("item")), "left_semi")
    counts = stored(near.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "candidates")
    ranked = _ranked(counts, k)
    last = {r["column"]: r for r in ranked.groupBy("column").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).collect()}
    covered = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}

    def proven(column: str, n: int) -> bool:
        if column not in covered:
            return False
        return covered[column] == n or (last[column]["m"] == k and last[column]["least"] > bound[column])

    open_ = [r["column"] for r in found if not proven(r["column"], r["n"])]
    if not open_:
        return ranked
    return ranked.where(~F.col("column").isin(open_)).unionByName(category_topk(df, k, cols=open_, method="counts"))


CORR_SCHEMA = "left string, right string, r double"


def _column_moments(df: DataFrame, v: list[Column]) -> dict:
    """rows, and n, a (mean), lo, hi of each column, in one scan at any width."""
    aggs = lambda x, i="": [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                            F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    flat = [F.count(F.lit(1)).alias("rows")] + [e for i, x in enumerate(v) for e in aggs(x, i)]
    if len(flat) <= MAX_AGG_FIELDS:
        return aggregate_row(df, flat)
    cells = df.select(F.posexplode(F.array(*v)).alias("i", "x"))
    found = cells.groupBy("i").agg(F.count(F.lit(1)).alias("rows"), *aggs(F.col("x"))).collect()
    return {"rows": found[0]["rows"] if found else 0} | {
        f"{k}{i}": None for i in range(len(v)) for k in ("a", "lo", "hi")} | {f"n{i}": 0 for i in range(len(v))} | {
        f"{k}{r['i']}": r[k] for r in found for k in ("n", "a", "lo", "hi")}


def _gram(df: DataFrame, x: list[Column], shift: list[float]) -> DataFrame:
    """(i, n, s, ss, p): for column i, arrays over all columns j of sums over the rows where both have a value.

    n counts these rows, s and ss sum the shifted value of i and its square, p
    the products.  A task adds one masked matrix product for each batch of rows
    to its own blocks and sends one row for each column; rows of a column are
    added where they meet, a batch at a time.  No row is dealt to its pairs.
    """
    k, middle = len(x), np.array(shift)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)], axis=1)
            for at in range(0, len(values), GRAM_ROWS):
                sums = _masked_products(values[at:at + GRAM_ROWS], middle)
                total = sums if total is None else [a + b for a, b in zip(total, sums)]
        if total is not None:
            for i in range(0, k, GRAM_SENT):
                yield _gram_rows(range(i, min(i + GRAM_SENT, k)), [m[i:i + GRAM_SENT] for m in total])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, i in enumerate(batch.column(0).to_pylist()):
                mine = np.stack([np.frombuffer(batch.column(c)[at].as_buffer(), dtype=np.float64) for c in range(1, 5)])
                held[i] = held[i] + mine if i in held else mine
        if held:
            yield _gram_rows(held, [np.stack([held[i][m] for i in held]) for m in range(4)])

    schema = "i int, n binary, s binary, ss binary, p binary"
    cells = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)])
    # two rounds of adding: the first meets a share of the tasks, the second what is left of them
    first = cells.mapInArrow(blocks, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GRAM_PARTS)))
    once = first.repartition("i", "part").drop("part").mapInArrow(added, schema)
    return once.repartition("i").mapInArrow(added, schema)


def _masked_products(values: np.ndarray, middle: np.ndarray) -> list[np.ndarray]:
    """n, s, ss and p of a block of rows (NaN: no value).  An infinity makes NaN of the sums of each pair whose two values its row has."""
    mask = ~np.isnan(values)
    ones, x = mask.astype(np.float64), np.where(mask, values - middle, 0.0)
    endless = ~np.isfinite(x)
    if endless.any():
        x = np.where(endless, 0.0, x)
        spoilt = endless.astype(np.float64).T @ ones > 0
        spoilt |= spoilt.T
    sums = [x.T @ ones, (x * x).T @ ones, x.T @ x]
    return [ones.T @ ones, *([np.where(spoilt, np.nan, m) for m in sums] if endless.any() else sums)]


def _gram_rows(numbers, matrices: list[np.ndarray]) -> pa.RecordBatch:
    packed = [pa.array([np.ascontiguousarray(row).tobytes() for row in m], pa.binary()) for m in matrices]
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), *packed], names=["i", "n", "s", "ss", "p"])


def _pair_sums(df: DataFrame, v: list[Column], shift: list[float], pairs: list[tuple[int, int]]) -> dict:
    """Masked sums of every pair of columns in one scan, from :func:`_gram`.

    A side does not vary (vx, vy) where no more of its squares is left, once the
    pair's own mean is taken off, than the rounding of their sum.
    """
    found = {r["i"]: {m: np.frombuffer(r[m], dtype=np.float64) for m in ("n", "s", "ss", "p")} for r in _gram(df, v, shift).collect()}
    # an empty table has no sums
    out: dict = {f"{s}{i}_{j}": 0 if s == "n" else None for i, j in pairs for s in ("n", "p", "sx", "sy", "sxx", "syy", "vx", "vy")}
    for i, j in pairs if found else []:
        n, t = found[i]["n"][j], f"{i}_{j}"
        out[f"n{t}"], out[f"p{t}"] = int(n), float(found[i]["p"][j])
        for side, a, b in (("x", i, j), ("y", j, i)):
            s, ss = float(found[a]["s"][b]), float(found[a]["ss"][b])
            out |= {f"s{side}{t}": s, f"s{side}{side}{t}": ss, f"v{side}{t}": n > 0 and ss - s * s / n > ROUNDING * ss}
    return out


def correlation_rows(df: DataFrame, cols: list[str] | None = None) -> list[tuple]:
    """Full Pearson matrix as (left, right, r) over pairwise-complete rows.

    Two passes of plain sums (codegen-friendly, fixed-size state per task):
    pass 1 gives count, mean, min and max per column; pass 2 sums products
    of mean-shifted values, which keeps the co-moments free of cancellation.
    Pairs of columns without nulls share per-column sums; only pairs that
    touch a column with nulls need masked sums.  Where these sums are more
    than one aggregate holds, pass 1 groups by column and pass 2 adds masked
    matrix products of batches of rows, so any width takes two scans.  A side
    without variation gives NULL (as does a 0/0 correlation), and so does one
    with an infinity among the pair's rows; the diagonal is 1.0 for a varying
    column of finite values.  Rounded to 4 digits.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    if len(cols) < 2:
        return []
    k = len(cols)
    v = [_num(c) for c in cols]
    first = _column_moments(df, v)
    rows = first["rows"]
    complete = [first[f"n{i}"] == rows for i in range(k)]
    shift = [m if m is not None and math.isfinite(m) else 0.0 for m in (first[f"a{i}"] for i in range(k))]
    x = [v[i] - F.lit(float(shift[i])) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    whole = sum(complete)
    sums = 2 * whole + whole * (whole - 1) // 2 + 8 * (len(pairs) - whole * (whole - 1) // 2)
    exprs = []
    for i in range(k) if sums <= MAX_AGG_FIELDS else ():
        if complete[i]:
            exprs += [F.sum(x[i]).alias(f"s{i}"), F.sum(x[i] * x[i]).alias(f"ss{i}")]
    for i, j in pairs if sums <= MAX_AGG_FIELDS else ():
        if complete[i] and complete[j]:
            exprs.append(F.sum(x[i] * x[j]).alias(f"p{i}_{j}"))
        else:
            both = v[i].isNotNull() & v[j].isNotNull()
            mx, my = F.when(both, x[i]), F.when(both, x[j])
            exprs += [F.count(mx).alias(f"n{i}_{j}"), F.sum(mx).alias(f"sx{i}_{j}"),
                      F.sum(my).alias(f"sy{i}_{j}"), F.sum(mx * mx).alias(f"sxx{i}_{j}"),
                      F.sum(my * my).alias(f"syy{i}_{j}"), F.sum(mx * my).alias(f"p{i}_{j}"),
                      (F.min(mx) < F.max(mx)).alias(f"vx{i}_{j}"),
                      (F.min(my) < F.max(my)).alias(f"vy{i}_{j}")]
    if exprs:
        second = aggregate_row(df, exprs)
    else:
        second, complete = _pair_sums(df, v, shift, pairs), [False] * k

    def varies(i):
        lo, hi = first[f"lo{i}"], first[f"hi{i}"]
        return lo is not None and lo < hi and math.isfinite(lo) and math.isfinite(hi)

    def pearson(i, j):
        if complete[i] and complete[j]:
            n, sx, sy = rows, second[f"s{i}"], second[f"s{j}"]
            sxx, syy, vx, vy = second[f"ss{i}"], second[f"ss{j}"], varies(i), varies(j)
        else:
            t = f"{i}_{j}"
            n, sx, sy = second[f"n{t}"], second[f"sx{t}"], second[f"sy{t}"]
            sxx, syy, vx, vy = second[f"sxx{t}"], second[f"syy{t}"], second[f"vx{t}"], second[f"vy{t}"]
        if not n or n < 2 or not vx or not vy:
            return None
        sxy = second[f"p{i}_{j}"]
        cxy, cxx, cyy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
        if not (cxx > 0 and cyy > 0 and math.isfinite(cxy) and math.isfinite(cxx) and math.isfinite(cyy)):
            return None
        return round_half_up(max(-1.0, min(1.0, cxy / (math.sqrt(cxx) * math.sqrt(cyy)))), DIGITS)

    r = {(i, j): pearson(i, j) for i, j in pairs}
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                out.append((a, b, 1.0 if varies(i) else None))
            else:
                out.append((a, b, r[(min(i, j), max(i, j))]))
    return out


def correlations(df: DataFrame, cols: list[str] | None = None, persist="auto") -> DataFrame:
    cols = numeric_columns(df) if cols is None else cols
    with reused(df.select(*cols), persist) as kept:
        rows = correlation_rows(kept, cols)
    return df.sparkSession.createDataFrame(rows, CORR_SCHEMA)


def strongest_correlation_row(rows: list[tuple]) -> tuple | None:
    """Largest |r| off the diagonal; the first in matrix order wins ties."""
    best = None
    for a, b, r in rows:
        if a == b or r is None:
            continue
        if best is None or abs(r) > abs(best[2]):
            best = (a, b, r)
    return best


def strongest_correlation(df: DataFrame, cols: list[str] | None = None,
                          persist="auto") -> DataFrame:
    cols = numeric_columns(df) if cols is None else cols
    with reused(df.select(*cols), persist) as kept:
        best = strongest_correlation_row(correlation_rows(kept, cols))
    return df.sparkSession.createDataFrame([best] if best else [], CORR_SCHEMA)


INSIGHT_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("other", T.StringType()),
    T.StructField("v1", T.DoubleType()),
    T.StructField("v2", T.DoubleType()),
    T.StructField("v3", T.DoubleType()),
])


def insight_facts(df: DataFrame, quantiles: str = "exact", persist="auto",
                  limit: int | None = None) -> DataFrame:
    needed = numeric_columns(df) + categorical_columns(df)
    with reused(df.select(*needed), persist) as kept:
        return _insight_facts(kept, quantiles, limit)


def _insight_facts(df: DataFrame, quantiles: str, limit: int | None) -> DataFrame:
    """All facts (the first ``limit``, if given): range and mean per numeric column, leading value per
    categorical column, strongest correlation.  Facts are columns (kind,
    subject, other, v1..v3), not prose."""
    facts = []
    for c, n, mean, _med, lo, hi, _std in numeric_summary_rows(df, quantiles=quantiles):
        if n:
            facts.append(("range", c, None, lo, hi, mean))
    leaders = (category_topk(df, k=1).where(F.col("rank") == 1)
               .select("column", "value").collect())
    lead = {r["column"]: r["value"] for r in leaders}
    for c in categorical_columns(df):
        if c in lead:
            facts.append(("leader", c, lead[c], None, None, None))
    best = strongest_correlation_row(correlation_rows(df))
    if best:
        facts.append(("correlation", best[0], best[1], best[2], None, None))
    rows = [(i + 1,) + f for i, f in enumerate(facts[:limit])]
    return df.sparkSession.createDataFrame(rows, INSIGHT_SCHEMA)
