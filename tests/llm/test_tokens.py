"""Token counts against whole texts encoded one by one."""

from __future__ import annotations

import random

import duckdb
import pytest

from shopgauge.llm import queries, tokens

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS, PIECES, ENDS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"
#: Letters, digits, marks and spaces of several kinds, contractions, and the special string.
PARTS = ["a", "B", "é", "文", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "²", ".", "<|endoftext|>", "🙂"]
PARTS += [chr(c) for c in (0x1C, 0x85, 0xA0, 0x301, 0x663, 0x180E, 0x2003, 0x200B, 0x2028, 0x2167, 0x3000, 0xFEFF)]


def known(name):
    with open(public_tokenizers.path(name), "rb") as handle:
        return tokens.encoder(name, handle.read(), public_tokenizers.PATTERN)


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(JSON))
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", [JSON, RANKS])
def test_parts_have_the_tokens_of_the_whole(name):
    rng = random.Random(1)
    encode, boundary = known(name)
    texts = ["".join(rng.choices(PARTS, k=40)) for _ in range(20_000)]
    for size, batch in ((1, 50), (3, 5000), (17, 1)):
        assert tokens.lengths(iter(texts), encode, boundary, batch, size).tolist() == encode(texts)
    assert sum(len(list(tokens.cut(t, boundary, 1))) for t in texts) > 3 * len(texts)  # many were split


def test_unknown_rules_are_not_split():
    assert known(PIECES)[1] is None and known(ENDS)[1] is None
    assert list(tokens.cut("a b c", None, 1)) == ["a b c"]
    assert tokens.json_boundary({"pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [{"content": "a b", "single_word": False, "lstrip": False, "rstrip": False}]}) is None
    with pytest.raises(ValueError, match="no library"):
        tokens.encoder("x.txt", b"")


@pytest.mark.parametrize("name", [JSON, RANKS, PIECES, ENDS])
def test_each_library(spark, name):
    encode, _ = known(name)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdé", k=5)) for _ in range(rng.randrange(60))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokens.token_counts(docs, public_tokenizers.path(name), limit=50, batch_bytes=100, part_chars=20)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()} == {
        i: (len(t.encode()), n, n > 50) for i, (t, n) in enumerate(zip(texts, encode(texts)))
    }


def test_query_on_the_given_documents(spark):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_token_lengths(spark, SF).collect()}
    counts = whole([t or "" for _, t in given])
    assert got == {i: (len((t or "").encode()), n, n > 512) for (i, t), n in zip(given, counts)}


def test_awkward_texts(spark):
    texts = [None, "", " ", "<|endoftext|>", "x" * 50_000, "文" * 20_000, "a b " * 30_000, " " * 5000, "\n" * 70_000, "end <|endoftext|> of"]
    rows = [(None if i == 3 else i % 7, t, "clash", 1) for i, t in enumerate(texts)] + [(9, "same", "clash", 1)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int").repartition(3)
    got = tokens.token_counts(docs, public_tokenizers.path(JSON), part_chars=1000, batch_bytes=4000).collect()
    plain = [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, whole([r[1] or "" for r in rows]))]
    order = lambda r: (r[0] is None, tuple(r)[1:], r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(plain, key=order)
    assert tokens.token_counts(docs.where("false"), public_tokenizers.path(JSON)).count() == 0
