"""Corpus pipeline: toxicity, near-duplicates, personal data, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, pii, simhash, toxicity
from quarry.llm.common import read_table, stored
from quarry.llm.queries import BYTE_BPE_PATTERN, specials, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal regression, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).where("NOT rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked at two bits or fewer."""
    return simhash.deduplicate(docs, width=3, distance=2).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks; the length is that of the new text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their Poisson draw, sources at shares that go as the root of their size, shuffled globally."""
    return mixing.mix(docs, key=["doc_id"], power=0.5, seed=42).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids along the Hilbert curve."""
    return packing.pack(docs, vocabulary(), BYTE_BPE_PATTERN, specials=specials())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("pii", redact_personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]

#: trees, regressions and hashes that SQL cannot express decide: tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
