"""Star-join analysis table (JON-4) with key provenance.

The base table is the one with most numeric columns, then most datetime
columns, then most rows (first on ties).  Relationships are walked once; a
table is left-joined when its partner is already in the model and its own
key is unique, so the base row count never grows.

Two fixes over a by-name merge: keys are resolved through a provenance map
``(table, column) -> physical column`` (a clash-renamed key such as
``nationkey_customer`` is still found), and both key sides are cast to one
common type.

The join strategy is left to Spark: it broadcasts a dimension only below its
own size threshold, from file sizes or the sizes seen at run time; otherwise
it sort-merges.  Rows whose key is null find nothing wherever they are, so they
are dealt out over all partitions instead of meeting in one; rows of a frequent
key (measured in a large table) are dealt to several partitions, and the one
dimension row of that key is copied to each of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import is_datetime_type, is_numeric_type
from quarry.operators.relationships import KeyStats, Relationship, common_key_type, key_stats
from quarry.session import KEEP_BYTES, plan_bytes

#: share of a large table's rows from which on a key is spread, and values that its sketch tracks at least
HOT_SHARE = 0.01
HOT_TRACKED = 10_000
#: salts for each partition that a key's rows fill: enough for the hash to fill partitions evenly
SALTS = 16


@dataclass
class Model:
    frame: DataFrame
    base_table: str
    joins: list[dict] = field(default_factory=list)
    provenance: dict[tuple[str, str], str] = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)


def hot_keys(df: DataFrame, cols: list[str], share: float) -> dict[str, dict[str, float]]:
    """For each key column the values (as text) with about ``share`` of the rows or more, and their share.

    One scan; frequent-items sketches have a bounded state and overstate a
    value by their error at most, so no hot key is missed."""
    tracked = max(HOT_TRACKED, math.ceil(4 * 2.625 / share))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {math.ceil(1 / share) + 1}, {tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"t{i}")
        for i, c in enumerate(cols)]).first()
    return {c: {t["item"]: t["count"] / row["rows"] for t in row[f"t{i}"] or [] if t["count"] >= share * row["rows"]} for i, c in enumerate(cols)}


def spread_left_join(frame: DataFrame, branch: DataFrame, left_key: str, key_alias: str, hot: dict[str, float]) -> DataFrame:
    """``frame`` left-joined to the rows of ``branch`` (unique in ``key_alias``, which is dropped) with its ``left_key``.

    A row's salt is part of the join key: for a null key a hash over SALTS
    values for each partition, for a hot one over as many as its share of the
    partitions has, else 0.  Hashes of
    the row, not of its place, so that a lost task deals its rows alike again.
    """
    as_type = common_key_type(frame.schema[left_key].dataType, branch.schema[key_alias].dataType)
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = {key: max(2, math.ceil(SALTS * s * partitions)) for key, s in hot.items()}

    def parts_of(key: Column) -> Column:
        if not parts:
            return F.lit(1)
        table = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        return F.coalesce(F.try_element_at(table, key.cast("string")), F.lit(1))

    key, dim_key = F.col(f"`{left_key}`"), F.col(f"`{key_alias}`")
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in frame.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    # an absent key has a salt of its own kind; the dimension has none such
    salt = F.when(key.isNull(), F.pmod(row, F.lit(SALTS * partitions))).otherwise(F.pmod(row, parts_of(key).cast("bigint")) if parts else F.lit(0).cast("bigint"))
    # a generated column also where all are 0: a literal would be folded out of the key, and null rows would meet again
    salted = branch.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts_of(dim_key).cast("bigint") - 1)))
    left = frame.withColumn("__row_salt", salt)
    joined = left.join(salted, (left[f"`{left_key}`"].cast(as_type) == salted[f"`{key_alias}`"].cast(as_type)) & (left["__row_salt"] == salted["__salt"]), "left")
    return joined.drop(key_alias, "__salt", "__row_salt")


def select_base_table(tables: dict[str, DataFrame], rows: dict[str, int]) -> str:
    def score(name: str):
        schema = tables[name].schema
        numeric = sum(is_numeric_type(f.dataType) for f in schema.fields)
        dates = sum(is_datetime_type(f.dataType) for f in schema.fields)
        return (numeric, dates, rows[name])
    best = None
    for name in tables:          # first wins on ties
        if best is None or score(name) > score(best):
            best = name
    return best


def _free_name(name: str, taken: set[str]) -> str:
    candidate, k = name, 1
    while candidate in taken:
        k += 1
        candidate = f"{name}_{k}"
    return candidate


def build_model(tables: dict[str, DataFrame], relationships: list[Relationship],
                stats: dict[str, dict[str, KeyStats]] | None = None,
                rows: dict[str, int] | None = None,
                match_flags: bool = False, hot_share: float | None = None) -> Model:
    """Left-join the unique side of each relationship onto the base table.

    The walk over the relationships (which tables join, through which
    column, under which output names) is decided on the driver from the
    schemas.  The joins are then built as a tree: every dimension branch
    (e.g. orders -> customer -> nation -> region) is joined bottom-up on its
    own, small side first, and the base table joins each of its direct
    branches once.  The wide base table is thus shuffled at most once per
    direct dimension instead of once per hop, and the result equals the
    sequential left-join chain because every joined key is unique.

    ``hot_share``: a key with this share of a table's rows or more is spread
    (default: HOT_SHARE where Catalyst takes the base table to be large, else none).
    """
    stats = {k: dict(v) for k, v in (stats or {}).items()}
    rows = dict(rows or {})
    for name, df in tables.items():
        if name not in rows:
            rows[name] = df.count()
    base = select_base_table(tables, rows)
    model = Model(frame=tables[base], base_table=base,
                  provenance={(base, c): c for c in tables[base].columns})
    share = hot_share or (HOT_SHARE if plan_bytes(tables[base]) > KEEP_BYTES else None)
    owner = {c: base for c in tables[base].columns}      # physical column -> table
    order = list(tables[base].columns)                    # sequential column order
    used = {base}

    def unique(table: str, col: str) -> bool:
        if col not in stats.get(table, {}):
            stats.setdefault(table, {}).update(key_stats(tables[table], [col]))
        return stats[table][col].unique

    renames: dict[str, list[tuple[str, str]]] = {}
    for rel in relationships:
        if rel.left_table in used and rel.right_table not in used:
            inner, inner_col, dim, dim_col = rel.left_table, rel.left_column, rel.right_table, rel.right_column
        elif rel.right_table in used and rel.left_table not in used:
            inner, inner_col, dim, dim_col = rel.right_table, rel.right_column, rel.left_table, rel.left_column
        else:
            continue
        if not unique(dim, dim_col):
            continue
        left_key = model.provenance[(inner, inner_col)]
        taken = set(order)
        renames[dim] = []
        for c in tables[dim].columns:
            if c == dim_col:
                model.provenance[(dim, c)] = left_key
                continue
            out = c if c not in taken else _free_name(f"{c}_{dim}", taken)
            taken.add(out)
            order.append(out)
            owner[out] = dim
            model.provenance[(dim, c)] = out
            renames[dim].append((c, out))
        if match_flags:
            flag = _free_name(f"__in_{dim}", taken)
            order.append(flag)
            owner[flag] = dim
            model.flags[dim] = flag
        used.add(dim)
        model.joins.append({"table": dim, "left_key": left_key, "right_key": dim_col,
                            "via": inner, "parent": owner[left_key]})

    children: dict[str, list[dict]] = {}
    for j in model.joins:
        children.setdefault(j["parent"], []).append(j)

    def attach(frame: DataFrame, table: str) -> DataFrame:
        mine = children.get(table, [])
        measured = hot_keys(frame, [j["left_key"] for j in mine], share) if mine and share else {}
        for j in mine:
            branch, key_alias = build_branch(j)
            frame = spread_left_join(frame, branch, j["left_key"], key_alias, measured.get(j["left_key"], {}))
        return frame

    def build_branch(j: dict) -> tuple[DataFrame, str]:
        dim = j["table"]
        key_alias = f"__key_{dim}"
        cols = [F.col(j["right_key"]).alias(key_alias)]
        cols += [F.col(c).alias(out) for c, out in renames[dim]]
        if match_flags:
            cols.append(F.lit(True).alias(model.flags[dim]))
        return attach(tables[dim].select(*cols), dim), key_alias

    model.frame = attach(tables[base], base).select(*order)
    return model
