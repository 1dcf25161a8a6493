"""URL filtering by association rules: Spark's FP-growth mines combinations of URL tokens, matched by an inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, stored, unwrapped, wrapped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("block", "allow")
#: greatest number of labelled urls to mine (a hash chooses), and the rules' least support and confidence
SAMPLE = 200_000
SUPPORT = 0.005
CONFIDENCE = 0.9
#: index entries up to which the index is broadcast (some MB); a larger one is joined by a shuffle
BROADCAST_ENTRIES = 50_000


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def site_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, rule) list that fits; null if none does.

    A rule is a host and a path, like ``example.com/de/``; it fits its host and
    the hosts under it, where the url's path starts with the rule's.
    """
    name = verdict = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.find("/") if "/" in rule else len(rule)
        fits = ((host_ == rule[:cut]) | host_.endswith("." + rule[:cut])) & path_.startswith(rule[cut:])
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, the host's last one and two labels, its other labels, path parts (digits as #), query keys, fragment; null or no ``://``: none."""
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.")
    labels = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: x != "")
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    mark = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind + ":"), x))
    some = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^(?s:(.*?))://", 1))), mark("host", labels),
        mark("end", F.array(F.substring_index(host(url), ".", -1), F.substring_index(host(url), ".", -2))),
        mark("path", F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "#"))), mark("key", keys),
        F.when(F.contains(url, F.lit("#")), F.array(F.concat(F.lit("mark:"), F.substring_index(url, "#", -1)))).otherwise(F.array().cast("array<string>"))))
    return F.when(F.contains(url, F.lit("://")), some).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Rules:
    """``table``: rule_id, items (tokens), verdict, confidence, support, key (the rarest token, by which a rule is found)."""

    table: DataFrame
    entries: int


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE, support: float = SUPPORT, confidence: float = CONFIDENCE) -> Rules:
    """Rules from at most about ``sample`` labelled urls (labels: block or allow; others and nulls are left out).

    A token set is a rule if at least ``support`` of the urls hold it with the
    label, at least ``confidence`` of those with the set have the label, and it is commoner there than
    among all; rules that contain a rule of the same verdict and at least their
    confidence are pruned.
    """
    rows = labelled.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isin(*VERDICTS))
    rows = bounded_sample(rows, F.col("url"), sample).select(tokens(F.col("url")).alias("items"), "label").where(F.size("items") > 0)
    baskets = stored(rows.select(F.array_append("items", F.concat(F.lit("="), F.col("label"))).alias("items")), "baskets")
    spark = labelled.sparkSession
    if baskets.isEmpty():
        return Rules(spark.createDataFrame([], "rule_id long, items array<string>, verdict string, confidence double, support double, key string"), 0)
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = found.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")) & (F.col("lift") > 1.0))
    often = found.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = stored(rules.select(F.xxhash64(F.array_sort("antecedent"), "consequent").alias("rule_id"), F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 10).alias("verdict"), "confidence", "support"), "rules")
    rarest = (rules.select("rule_id", F.explode("items").alias("token")).join(often, "token").groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("key")))
    keyed = stored(rules.join(rarest, "rule_id"), "keyed")
    narrower = keyed.select(F.col("rule_id").alias("wide_id"), F.col("items").alias("wide_items"), F.col("verdict").alias("wide_verdict"), F.col("confidence").alias("wide_confidence"), F.explode("items").alias("token"))
    # the same index finds the rules inside a rule
    inside = (narrower.join(keyed, narrower.token == keyed.key).where((F.size("items") < F.size("wide_items")) & (F.col("verdict") == F.col("wide_verdict"))
              & (F.col("confidence") >= F.col("wide_confidence")) & (F.size(F.array_except("items", "wide_items")) == 0)).select("wide_id").distinct())
    kept = stored(keyed.join(inside, keyed.rule_id == inside.wide_id, "left_anti"), "kept")
    return Rules(kept, int(kept.agg(F.sum(F.size("items"))).first()[0] or 0))


def judge(pages: DataFrame, rules: Rules, sites: list[tuple[str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the listed site rule, or null) and ``verdict``.

    The verdict is the site rule's; else that of the matching mined rule with
    the highest confidence (ties: higher support, then more tokens, then
    allow, then the rule's id); else ``default``.  One row for each row; null urls and urls without
    ``://`` have empty hosts and no tokens; columns of these names are
    replaced; an empty table stays empty.  Each distinct url is matched once,
    found by its rules' rarest tokens, so common tokens draw no candidates.
    """
    rows = wrapped(pages).withColumn("url", F.coalesce(F.col("row")[url_col].cast("string"), F.lit("")))
    urls = rows.select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    index = rules.table.select("rule_id", "items", F.col("verdict").alias("mined"), "confidence", "support", "key")
    if rules.entries <= BROADCAST_ENTRIES:
        index = F.broadcast(index)
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, F.col("token") == F.col("key")).where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("items").alias("n"), (F.col("mined") == "allow").alias("mild"), "rule_id", "mined"))["mined"]
    found = met.groupBy("url").agg(best.alias("mined")).withColumnRenamed("url", "found")
    # a url that many pages share is on the side of this join that can be split
    joined = rows.join(found, F.col("url") == F.col("found"), "left")
    joined = joined.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, listed = site_rule(F.col("host"), F.col("path"), sites)
    judged = joined.withColumn("rule", rule).withColumn("verdict", F.coalesce(listed, F.col("mined"), F.lit(default)))
    return unwrapped(judged, "host", "path", "rule", "verdict")
