"""Byte-level BPE: words of any length against the vocabulary's own library."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from triplewright.llm import bpe_sql

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def words():
    rng = np.random.default_rng(0)
    pick = lambda parts, n: "".join(rng.choice(parts, n))
    yield from ("a" * 100_001, "ab" * 3000 + "aaaa" * 100, "thequickbrownfoxjumpsoverthelazydog" * 500, "é" * 5001 + "ü" * 77, "日本語テキスト" * 400)
    yield from (" " * 70_000, "-" * 3333 + "=" * 1000 + "-=" * 444, "\n" * 999 + " " * 65, "0123456789" * 77)
    for n in range(60, 70):  # about the bound between both paths
        yield pick(["the", "ing", "a", "e", "zz"], 40)[:n]
    for _ in range(20):
        yield pick(["the", "ing", "a", "e", "tion", "s", "qu", "zz", "aaaa", "er"], 400)
    yield pick(list("etaoinshr"), 50_000)
    yield pick(list("abcdefghijklmnopqrstuvwxyz"), 1 << 20)


def test_long_words_equal_the_library_in_bounded_memory(library):
    bpe = bpe_sql.SqlBpe(RANKS, P.PATTERN, memory_mb=150)
    for w in words():
        ids, decoded = bpe.encode_decode([w])
        assert np.frombuffer(ids[0], "<u4").tolist() == library(w), w[:40]
        assert decoded == [w.encode()]


def test_both_paths_agree(monkeypatch, library):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aabcdeorstnié 日0- "), 60)) for _ in range(200)]
    short = bpe_sql.SqlBpe(RANKS, P.PATTERN).encode(texts)
    monkeypatch.setattr(bpe_sql, "LONG_WORD", 1)
    assert bpe_sql.SqlBpe(RANKS, P.PATTERN).encode(texts) == short
    assert [np.frombuffer(x, "<u4").tolist() for x in short] == [library(t) for t in texts]


def test_forgotten_words_and_any_ids_decode():
    bpe = bpe_sql.SqlBpe(RANKS, P.PATTERN, max_words=3)
    texts = [f"some words {i} and again {i % 3}" for i in range(30)]
    for _ in range(2):
        for t in texts:
            assert bpe.encode_decode([t])[1] == [t.encode()]
    ids = np.array([50_000, 220, 0, 255, 198], "<u4").tobytes()  # not an encoding of any text
    assert bpe.decode([b"", ids, b""]) == [b"", b"".join({v: k for k, v in bpe.table.ranks.items()}[i] for i in (50_000, 220, 0, 255, 198)), b""]


def test_query_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 3000), (3, "x" * 3000), (None, "<|endoftext|> ok")]
    got = bpe_sql.digests(bpe_sql.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "ids"), RANKS, P.PATTERN)).collect()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in got) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
