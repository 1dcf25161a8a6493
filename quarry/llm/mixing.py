"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import shuffle_partitions, stored, uniform, unwrapped, wrapped

#: a Poisson variable lies outside its mean by this many deviations (and as many counts) with probability below 1e-15
SPREAD = 9.0
#: copies that one step of the explosion makes
COPIES = 1024
#: the table of all sources is broadcast if it has no more numbers than this (8 MB); else it is joined by a shuffle
BROADCAST_ENTRIES = 1_000_000


def target_rates(docs: DataFrame, source_col: str = "source", power: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n, weight, rate) of each source; the null source is one of its own.

    ``weights`` gives the target shares (sources not named: 0); without it the
    share of a source goes as ``n ** power``.  ``rate`` is the mean number of
    repetitions that gives each source its share of as many rows as there are.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(pairs[F.col("source")], F.lit(0.0)).cast("double")
    # one row: the numbers of rows and of shares in all
    total = counts.select("n", share.alias("share")).agg(F.sum("n").alias("total"), F.sum("share").alias("shares"))
    total = total.first()
    rows, shares = float(total["total"] or 0), float(total["shares"] or 0) or 1.0
    return (counts.withColumn("weight", share / F.lit(shares))
            .withColumn("rate", F.col("weight") * F.lit(rows) / F.col("n")))


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` with ``low`` and ``steps``: P(X <= low + i) for the counts i that matter.

    A count is ``low`` plus the number of steps at or below a uniform draw, the
    inverse of the distribution function.  The table of a source has a number
    of entries in the order of the root of its rate.
    """
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low, steps = [], []
            for rate in frame["rate"]:
                wide = SPREAD * np.sqrt(rate) + SPREAD
                first, last = max(0, int(rate - wide)), int(rate + 2 * wide) + 2
                k = np.arange(1, last + 1, dtype=np.float64)
                logs = np.concatenate([[0.0], np.cumsum(np.log(k))])[first:] if rate < 1e6 else _log_factorials(first, last)
                k = np.arange(first, last + 1, dtype=np.float64)
                mass = np.exp(k * np.log(rate) - rate - logs) if rate > 0 else (k == 0).astype(float)
                low.append(first)
                steps.append(np.cumsum(mass).tolist())
            yield frame.assign(low=low, steps=steps)

    return rates.mapInPandas(of, "source string, n long, weight double, rate double, low long, steps array<double>")


def _log_factorials(first: int, last: int) -> np.ndarray:
    """log k! for k from first to last, by Stirling's series (first is large)."""
    k = np.arange(first, last + 1, dtype=np.float64)
    return k * np.log(k) - k + 0.5 * np.log(2 * np.pi * k) + 1 / (12 * k) - 1 / (360 * k**3)


def copies(docs: DataFrame, key: list[str], source_col: str = "source", seed: int = 42, **target) -> DataFrame:
    """``docs`` with ``rate``, ``copies`` (hash-seeded Poisson draw of the row) and no row left out.

    The draw hashes the seed and the key's columns: it does not depend on the
    partitions, and a lost task draws alike.  Rows equal in the key draw alike.
    """
    table = stored(poisson_table(target_rates(docs, source_col, **target)), "poisson")
    entries = table.agg(F.sum(F.size("steps") + 2)).first()[0] or 0
    table = table.select(F.col("source").alias("named"), "rate", "low", "steps")
    if entries <= BROADCAST_ENTRIES:
        table = F.broadcast(table)
    draw = uniform(seed, *[F.col("row")[k] for k in key])
    # without a broadcast, a hot source is the side of the join that can be split: the other has one row for each source
    joined = wrapped(docs).withColumn("draw", draw).join(table, F.col("row")[source_col].cast("string").eqNullSafe(F.col("named")))
    above = F.size(F.filter("steps", lambda s: s <= F.col("draw")))
    return unwrapped(joined.select("row", "rate", (F.col("low") + above).cast("long").alias("copies")), "rate", "copies")


def mix(docs: DataFrame, key: list[str], source_col: str = "source", seed: int = 42, **target) -> DataFrame:
    """Each row of ``docs`` as often as its Poisson draw says, in a globally shuffled order.

    Adds ``copy`` (from 0), ``rate`` and ``place`` (a hash that orders the
    whole output; partitions are ranges of it, sorted within).  ``target``
    is that of :func:`target_rates`.  Rows with a null source are a source of
    their own; null keys hash as empty; repeated rows repeat alike; columns
    named like the added ones are replaced; an empty table gives an empty
    result.  A row is copied within its task, so a hot source needs no group.
    """
    drawn = copies(docs, key, source_col, seed, **target)
    plain = [c for c in drawn.columns if c not in ("rate", "copies")]
    drawn = drawn.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), "rate", F.col("copies").alias("n")).where("n > 0")
    # in two steps, so that no row holds the list of all its copies
    step = F.lit(COPIES).cast("long")
    blocks = drawn.select("row", "rate", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {COPIES}"))).alias("block"))
    spread = blocks.select("row", "rate", F.explode(F.sequence(F.col("block") * step, F.least(F.col("block") * step + step, F.col("n")) - 1)).alias("copy"))
    # the whole row is hashed: rows of one key, or without one, spread like others
    hashable = [F.col("row")[f.name] for f in drawn.schema["row"].dataType.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    place = F.xxhash64(F.lit(f"place-{seed}"), "copy", *[F.coalesce(F.col("row")[k].cast("string"), F.lit("")) for k in key], *hashable)
    parts = shuffle_partitions(docs.sparkSession)
    # the hash is uniform over the 64-bit range: equal ranges of it are equal parts, and no sampling job runs
    part = F.floor((F.col("place").cast("double") / F.lit(float(2**64)) + 0.5) * parts)
    dealt = spread.withColumn("place", place).withColumn("part", F.least(part, F.lit(parts - 1)).cast("int"))
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "place")
    return unwrapped(ordered, "rate", "copy", "place")
