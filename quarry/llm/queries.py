"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quarry.llm import align, cotraining, covertree, lexical, mixing, packing, pii, sharding, signhash, simhash, sketch, toxicity, urls
from quarry.llm.bpe import added_tokens
from quarry.llm.common import read_table, small_batches
from quarry.llm.following import beside_next, in_order

TOKENIZERS = "/opt/tokenizers"
#: the pattern of the byte-level vocabularies there, as their description gives it
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(folder: str = TOKENIZERS) -> str:
    """The ranks of the byte-level BPE vocabulary (the same ids as its tokenizer file)."""
    return str(Path(folder) / "byte_bpe_50k.tiktoken")


def specials(folder: str = TOKENIZERS) -> dict[str, int]:
    """The special tokens that the tokenizer file, as loaded, finds in texts."""
    return added_tokens(str(Path(folder) / "byte_bpe_50k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids, along the Hilbert curve."""
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, vocabulary(), BYTE_BPE_PATTERN, specials=specials())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: the base rules' spans, and those that the trees add."""
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", *[pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the two views' vote, and whether it stays."""
    docs = read_table(spark, sf_dir, "documents")
    scored = cotraining.score(docs, cotraining.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_text", "p_meta", "quality", "keep")


def op4_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every row whose id is divisible by 50, over all other rows."""
    return covertree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


#: the listed site rules: verdict, then host and path
SITE_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; pages that the listed rules judge are the labels from which the others' rules are mined."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    labelled = pages.select("url", urls.site_rule(urls.host(url), urls.path(url), SITE_RULES)[1].alias("label"))
    return urls.judge(pages, urls.mine(labelled), SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at two bits or fewer over three-word shingles."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity grade of every document, and whether it is rejected."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    graded = toxicity.grade(docs, model)
    return graded.select("doc_id", "p_toxic", "severity", F.round("severity").cast("int").alias("grade"), "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its Poisson draw, sources at shares that go as the root of their size."""
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, key=["doc_id"], power=0.5, seed=42)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return mixed.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), size.cast("long").alias("n_bytes"))


@F.arrow_udf(BinaryType())
def squeezed(texts: pa.Array) -> pa.Array:
    """Each text compressed, to move fewer bytes (text shrinks little in Spark's own shuffle blocks); null stays null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(t.as_buffer()) if t.is_valid else None for t in texts.cast(pa.large_binary())], pa.binary())


def _edited(row: tuple, after: tuple | None) -> tuple:
    open_ = zstandard.ZstdDecompressor().decompress
    doc_id, text = row[0], open_(row[1]).decode() if row[1] is not None else ""
    cut = len(text) // 4
    following = open_(after[1]).decode() if after is not None and after[1] is not None else ""
    return doc_id, text, text[:len(text) - cut] + following[:cut] if after is not None else ""


def _compared(row: tuple, after: tuple | None) -> tuple:
    mine = sketch.from_text(row[3])
    near = sketch.likeness(mine, sketch.from_text(after[3])) if after is not None else None
    return *row, sketch.likeness(mine, sketch.from_text(row[4])), near


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text, with estimated likeness to it and to the next document."""
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", squeezed("text").alias("packed"))
    paired = beside_next(in_order(docs, "doc_id", ["packed"]), "doc_id long, text string, edited string", _edited, lambda r: len(r[3]) + len(r[4]))
    marked = sketch.fingerprints(paired, more={"edited": "edited_fingerprint"})
    digests = marked.select("_range", "_ghost", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    # rows are still in order: the next row has the next document's sketch
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    beside = beside_next(digests, schema, _compared, lambda r: 2 * len(r[5]) + 200)
    return beside.where("NOT _ghost").drop("_range", "_ghost")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts are at most one apart."""
    out = sharding.shard(read_table(spark, sf_dir, "documents"), 40)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of each benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op12_signhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings at a cosine of 0.95 or more."""
    return signhash.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap links and common groups of every document's tokens under two tokenizers."""
    small_batches(spark)
    return align.align(read_table(spark, sf_dir, "documents"), vocabulary(), BYTE_BPE_PATTERN, str(Path(TOKENIZERS) / "piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op4_covertree": OP4_SQL, "op8_mixing": OP8_SQL, "op11_lexical": OP11_SQL, "op12_signhash": OP12_SQL}


OP4_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND coalesce(list_bool_and([coalesce(isfinite(x), false) for x in embedding]), true)),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: a document's count is the number of k whose distribution function is at or below its draw
OP8_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, n, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
masses AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass FROM rates, generate_series(0, (SELECT (max(rate) + 27 * sqrt(max(rate)) + 27)::BIGINT FROM rates)) s(k)),
steps AS (SELECT source, rate, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS step FROM masses),
draws AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '42', doc_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM documents),
drawn AS (SELECT d.doc_id, d.source, s.rate, d.text, count(*) FILTER (WHERE s.step <= d.draw) AS copies
          FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
SELECT doc_id, source, c.copy AS copy, round(rate, 6) AS rate, strlen(coalesce(text, ''))::BIGINT AS n_bytes
FROM drawn, generate_series(0, drawn.copies - 1) c(copy)
"""

OP11_SQL = r"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc, doc_id, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
wanted AS (SELECT DISTINCT item, item_id, term FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS item FROM benchmark))),
held AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals t GROUP BY term, t.docs),
impacts AS (SELECT h.doc, d.doc_id, h.term, w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * d.n * t.docs) // t.terms))) AS impact
            FROM held h JOIN docs d USING (doc) JOIN weights w USING (term), totals t),
scores AS (SELECT item, item_id, doc, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP12_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
           embedding IS NOT NULL AND coalesce(list_bool_and([coalesce(isfinite(x), false) for x in embedding]), false) AND coalesce(list_bool_or([x <> 0 for x in embedding]), false) AS ok
    FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.r <> b.r AND len(a.e) = len(b.e)
          WHERE CASE WHEN a.ok AND b.ok AND len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least ON v.r = least.a LEFT JOIN counts ON v.r = counts.a
"""
