import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing, queries
from quarry.llm.bpe import Encoder

from .conftest import SMALL


def pieces_of(docs, **options):
    return [r.asDict() for r in packing.pack(docs, queries.vocabulary(), queries.BYTE_BPE_PATTERN, specials=queries.specials(), **options).collect()]


def gapless(pieces, length):
    at = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * length + p["offset"] == at
        assert 0 < p["length"] == len(p["ids"]) // 4 and p["offset"] + p["length"] <= length
        at += p["length"]
    return at


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pattern_and_ids_equal_the_tokenizer_file(tokenizer):
    assert queries.BYTE_BPE_PATTERN == public_tokenizers.PATTERN
    assert queries.specials() == {"<|endoftext|>": 50256}
    encoder = Encoder(queries.vocabulary(), queries.BYTE_BPE_PATTERN, queries.specials())
    for text in ["", " ", "  ", " a", "a  b", "a   b ", "a \n b\n  c\t d", "x　 　y z", "\x1c \x1d a", " \n\n ", "I'll  'twas", "é ñ", "a\x85 b  \x0b c", "<|endoftext|> b", "a<|endoftext|>b", "a  <|endoftext|>  <|endoftext|><|endoftext|", "<|endoftext|>", "9" * 5000, "😀😀 漢字"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("dims,depth", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_once_by_single_steps(dims, depth):
    cells = np.stack(np.meshgrid(*[np.arange(1 << depth)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(cells, depth)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_round_trip_of_odd_rows(odd, tokenizer, clashing):
    pieces = pieces_of(clashing(odd, "ids", "START", "order", "_id", "slice"), length=64)
    gapless(pieces, 64)
    rows = {}
    for p in sorted(pieces, key=lambda p: (str(p["doc_id"]), p["sequence_id"], p["offset"])):
        rows.setdefault(p["doc_id"], []).append(p)
    for doc_id, text in {(r["doc_id"], r["text"]) for r in odd.collect()}:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        got = rows[doc_id]
        assert {p["doc_tokens"] for p in got} == {len(want)}
        assert sum(p["length"] for p in got) == len(want) * (2 if doc_id == 5 else 1)
        if doc_id != 5:
            assert [p["start"] for p in got] == list(np.cumsum([0] + [p["length"] for p in got])[:-1])
            assert np.frombuffer(b"".join(p["ids"] for p in got), "<u4").tolist() == want


def test_special_tokens_are_plain_text_unless_given():
    plain = Encoder(queries.vocabulary(), queries.BYTE_BPE_PATTERN).encode("a<|endoftext|>b")
    assert len(plain) // 2 == 9


def test_rows_of_one_id_spread_over_slices(spark):
    """Copies with one id and text, as mixing makes them, fill several slices."""
    docs = spark.range(3000).selectExpr("CAST(7 AS long) AS doc_id", "'the same words in each of the copies' AS text")
    pieces = packing.pack(docs, queries.vocabulary(), queries.BYTE_BPE_PATTERN, length=128)
    sizes = [r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 0.4 * sum(sizes)
    gapless([r.asDict() for r in pieces.collect()], 128)


def test_empty_table(none):
    assert pieces_of(none) == []


def test_query_covers_the_table_with_one_padded_sequence(spark, small, tokenizer):
    out = queries.op1_packing(spark, SMALL).collect()
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    assert {r["doc_id"] for r in out} == set(text)
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sorted(fill) == list(range(len(fill))) and sum(v < 2048 for v in fill.values()) <= 1
    for r in out:
        ids = np.array(tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids + [1], dtype="<u4")
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(ids) == r["doc_tokens"]


def test_copies_are_neighbours(spark, small):
    twin = small.where("doc_id < 40").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    pieces = pieces_of(small.where("doc_id < 40").unionByName(twin))
    first = {p["doc_id"]: p["sequence_id"] * 2048 + p["offset"] for p in pieces if p["start"] == 0}
    size = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    order = sorted(first, key=first.get)
    near = sum(abs(order.index(i) - order.index(i + 100000)) <= 6 for i in range(40) if i in first)
    assert near >= 36 and size
