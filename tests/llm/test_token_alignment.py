"""Token alignment against a brute-force version that compares every token of one side with every token of the other."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from auditlake.llm import token_alignment as ta
from auditlake.llm.common import table

ODD = [
    (None, "a b"), (1, None), (2, ""), (3, " "), (4, "x▁y"), (5, "a  b   c\n d\t e"), (6, "ﬁ \xbd é 漢字 \U0001f600\x00 <|endoftext|> <s>"),
    (7, "don't  \n\n  stop 　x"), (8, "a b"), (8, "a b"), (9, "ab" * 300), (10, " lead trail  "), (11, "\n"), (12, "  "), (13, "a\xa0b \xa0c"), (14, "\r\n x\r"),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters():
    """Letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def tools():
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_letters()


def brute(rows, tools):
    tokenizer, pieces, letters = tools
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            full = (" " + text).encode()
            a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
            for i in pieces.encode(text):
                name = pieces.id_to_piece(i)
                b.append((i, bytes([int(name[3:-1], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != full or b"".join(x for _, x in b) != full:
                a, b = [], []

        def spans(tokens):
            at, out = 0, []
            for i, data in tokens:
                out.append((i, at, at + len(data)))
                at += len(data)
            return out

        a, b = spans(a), spans(b)
        links = [(i, j) for i, x, y in a for j, v, w in b if x < w and v < y]
        counts.update(links)
        start, groups = 0, []
        for end in sorted({y for _, _, y in a} & {w for _, _, w in b}):
            groups.append("|".join(",".join(str(i) for i, x, y in side if start <= x and y <= end) for side in (a, b)))
            start = end
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        ((d, a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, a, b, g, ls, sha in found), key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in ta.align_documents(df, **options).select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(50).collect()
    return ODD + [(r.doc_id + 100, r.text and r.text[:1200]) for r in docs]


def test_against_brute_force(spark, rows, tools):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, links string, row int")
    want = brute(rows, tools)
    for hot in (ta.HOT_PAIRS, 100, 0):  # all pairs travel, some, none
        assert result(df, hot_pairs=hot) == want


def test_blocks_and_memory_bounds_change_nothing(spark, rows, tools, monkeypatch):
    for name, value in (("ALIGN_BLOCK", 300), ("HELD_PARTS", 20), ("HELD_CODES", 50)):
        monkeypatch.setattr(ta, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert result(df) == brute(rows, tools)


def test_equal_hashes_do_not_merge_parts(monkeypatch):
    parts = ta.Parts()
    parts.letters = np.zeros(256, np.uint64)
    distinct, part, before = parts.split(np.array([0, 8, 12]), np.frombuffer(b" one two one", np.uint8))
    assert distinct == [b" one", b" two"] and part.tolist() == [0, 1, 0] and before.tolist() == [0, 2, 3]


def test_long_text_and_empty_table(spark):
    text = "alpha beta  gamma\n" * 30_000 + "ß" * 5_000
    one, two = (ta.align_documents(spark.createDataFrame([(1, t)], "doc_id long, text string")).first() for t in (text, "alpha beta  gamma\n"))
    assert one.n_a >= 30_000 * two.n_a and one.n_links >= max(one.n_a, one.n_b) and one.count_sum > 30_000**2
    assert ta.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_threshold_is_a_bound(spark):
    pairs = spark.createDataFrame([(i, 1 + i % 9 * i) for i in range(500)], "code long, n long")
    for most in (0, 10, 100, 499, 500, 1000):
        assert pairs.where(f"n >= {ta.hot_threshold(pairs, most)}").count() <= most
    assert pairs.where(f"n >= {ta.hot_threshold(pairs, 500)}").count() == 500
