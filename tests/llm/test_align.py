import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import align, queries

from .conftest import SMALL

A_FILE, B_FILE = (str(Path(queries.TOKENIZERS) / n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = ["a<|endoftext|>b <s> </s> <unk> <0x41>", "漢字とかな 😀👍🏽 ÄÖ é́", " \t two  blanks\n\n\nand   lines ", "ﬁ ½ ①", "▁ already a bar", "x" * 3000, "\x00\x01 control", "ab" * 40 + "漢" * 200, "​ "]


@pytest.fixture(scope="module")
def files():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True  # the contract: their strings inside texts are plain text
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def byte_of():
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def brute(texts, files):
    """All results by loops over the token pairs of each group."""
    a_file, b_file = files
    alphabet = byte_of()
    parts = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = [(i, bytes(alphabet[c] for c in a_file.id_to_token(i))) for i in a_file.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in b_file.encode(text) if text else []:
            p = b_file.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_file.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []

        def spans(tokens):
            at = 0
            for i, x in tokens:
                yield i, at, at + len(x)
                at += len(x)
        a, b = list(spans(a)), list(spans(b))
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        links, groups, low, behind = [], [], 0, (0, 0)
        for end in sorted(ends):
            # tokens of a group are those within its bytes; links never leave a group
            x, y = ([t for t in tokens[at:at + end - low + 1] if low <= t[1] and t[2] <= end] for tokens, at in zip((a, b), behind))
            behind = behind[0] + len(x), behind[1] + len(y)
            links += [(i, j) for i, s, e in x for j, t, f in y if max(s, t) < min(e, f)]
            groups.append(([i for i, _, _ in x], [j for j, _, _ in y]))
            low = end
        parts.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in parts for p in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for n_a, n_b, groups, links in parts:
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(listed.encode()).hexdigest() if listed else "", sum(len(x) * len(y) for x, y in groups)))
    return out


def result(rows):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], r["n_group_links"]) for r in rows]


def run(docs, **more):
    return align.align(docs, queries.vocabulary(), queries.BYTE_BPE_PATTERN, B_FILE, **more)


def test_whole_table_equals_brute_force(spark, small, files):
    docs = sorted(small.collect(), key=lambda r: r["doc_id"])
    rows = sorted(queries.op13_align(spark, SMALL).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    assert result(rows) == brute([d["text"] for d in docs], files)


@pytest.mark.parametrize("most", [1 << 20, 5, 0])
def test_strange_texts_and_rare_pairs(spark, files, most):
    """Whatever share of the pairs goes by the table, the rest by the shuffle, results are the same."""
    texts = [*STRANGE, *STRANGE, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(run(docs, most=most).collect(), key=lambda r: r["doc_id"])
    want = brute(texts, files)
    assert result(rows) == want
    assert any(w[0] for w in want) and want[-1] == (0, 0, 0, 0, 0, 0, "", 0)


def test_odd_rows(odd, none, clashing, files):
    rows = run(clashing(odd, "place", "PAIRS", "n_a", "id", "b")).collect()
    texts = [r["text"] for r in odd.collect()]
    want = Counter(zip([r["doc_id"] for r in odd.collect()], brute(texts, files)))
    assert Counter(zip([r["doc_id"] for r in rows], result(rows))) == want
    assert run(none).count() == 0


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(5)
    for shape in ((1, 1, 1), (7, 5, 9), (20, 30, 4)):
        x, y = rng.random(shape[:2]) < 0.3, rng.random(shape[1:]) < 0.3

        def csr(m):
            return align.Incidence(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
        row, column, value = csr(x).times(csr(y))
        dense = np.zeros((shape[0], shape[2]), dtype=int)
        dense[row, column] = value
        assert (dense == x.astype(int) @ y.astype(int)).all() and (value > 0).all()
        t = csr(y).transposed()
        assert (t.starts == csr(y.T).starts).all() and (t.columns == csr(y.T).columns).all()


def test_table_of_frequent_pairs_is_bounded(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [3] * 10 + [40, 900])], "pair long, n long")
    assert align.frequent(counts, 100) == 0
    for most, least in ((61, 3), (12, 3), (11, 40), (1, 900)):
        assert align.frequent(counts, most) == least
    assert align.frequent(counts, 0) > 900
