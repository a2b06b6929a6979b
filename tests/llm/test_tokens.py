"""BPE and token counts against the tokenizers library."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from conftest import DATA

from pixelframe.llm import bpe, token_counts
from pixelframe.llm.queries import tokenizer_path

TEXTS = [
    None, "", "a  b\n\n c \n", "Hello<|endoftext|> World's  don't\tx\x0by z　 q", "\n", " x", "é é ẞ ΣΑΣ İ", "x" * 3000 + " " + "ab " * 500,
    "a\x1cb \x1f c", "<|startoftext|>hi", "tab\t word\r\n\r\n next.", " trailing ", "foo.\nbar,\nBaz", " \n a", "a, b.c 'll we'll I'M  1234 ½ ٣",
    "\x00 nul\x00 b\x85c", "foo.bar, A. B.. É. x’s. don't. 'S. 1. <|ENDOFTEXT|>. <|endoftext|>, Foo<|endoftext|>Bar. text|>.", "a a a", "a a a",
    "The  quick   brown fox. New", "é É. Å,", "日本語 テスト。 한국어.", "😀😀. 👩‍👩‍👧 ok.",
]


@pytest.fixture(scope="module")
def rows(spark):
    path = f"{DATA}/sf0.001/documents.parquet"
    more = [r["text"] for r in spark.read.parquet(path).collect()] if os.path.exists(path) else []
    return list(enumerate(TEXTS + more))


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names clash with the results
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)


def library(name, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return t, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)


def test_counts(docs, rows):
    _, want = library("byte_bpe_50k.json", rows)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert len(got) == len(rows)
    for (i, text), e in zip(rows, want, strict=True):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), len(e), len(e) > 512), repr(text[:50])


def test_counts_with_a_full_table_of_pieces(monkeypatch, rows):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 50)
    held = token_counts.PieceLengths(tokenizer_path("byte_bpe_50k.json"))
    _, want = library("byte_bpe_50k.json", rows)
    assert [held.count([t])[0] for _, t in rows] == [len(e) for e in want]


def test_counts_with_long_pieces_hold_few_characters(monkeypatch, rows):
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 4000)
    held = token_counts.PieceLengths(tokenizer_path("byte_bpe_50k.json"))
    more = [(0, "x" * n + " y" * 3) for n in (900, 2000, 3000, 5000)] + rows
    _, want = library("byte_bpe_50k.json", more)
    for (_, text), e in zip(more, want, strict=True):
        assert held.count([text])[0] == len(e)
    assert held.chars < 4000 + max(len(t or "") for _, t in more)


@pytest.mark.parametrize("block", [2000, 48 << 20])
def test_digests(docs, rows, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    t, want = library("word_bpe_49k.json", rows)
    got = {r["doc_id"]: r for r in bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), digests=True).collect()}
    assert len(got) == len(rows)
    for (i, _), e in zip(rows, want, strict=True):
        assert got[i]["n_tokens"] == len(e.ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode(docs, rows):
    t, want = library("word_bpe_49k.json", rows)
    path = tokenizer_path("word_bpe_49k.json")
    encoded = bpe.encode(docs, path)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: e.ids for (i, _), e in zip(rows, want, strict=True)}
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, path).collect()}
    assert decoded == {i: t.decode(e.ids, skip_special_tokens=False) for (i, _), e in zip(rows, want, strict=True)}


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = tokenizer_path("word_bpe_49k.json")
    assert bpe.encode(none, path, digests=True).count() == 0 and bpe.decode(bpe.encode(none, path), path).count() == 0
    assert token_counts.token_counts(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.encode(nulls, path, digests=True).collect()) == [(0, 2), (0, 2), (1, 0)]


def test_a_block_without_its_words_encodes_them(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    real = bpe.block_words
    monkeypatch.setattr(bpe, "block_words", lambda src, buckets: real(src, buckets).where("words is null"))
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    t, want = library("word_bpe_49k.json", [(1, "some words here")])
    assert bpe.encode(df, path).first()["ids"] == want[0].ids
    assert bpe.encode(df, path, digests=True).first()["decoded_sha256"] == hashlib.sha256(t.decode(want[0].ids).encode()).hexdigest()


def test_decoded_text_comes_through_the_piece_table(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    real = bpe.piece_table
    monkeypatch.setattr(bpe, "piece_table", lambda *a: real(*a).selectExpr("token_id", "concat('<', piece, '>') AS piece"))
    t, want = library("word_bpe_49k.json", [(1, "some words here, some")])
    got = bpe.encode(spark.createDataFrame([(1, "some words here, some")], "doc_id long, text string"), path, digests=True).first()
    assert got["decoded_sha256"] == hashlib.sha256(" ".join(f"<{t.id_to_token(i)}>" for i in want[0].ids).encode()).hexdigest()


def test_words_beyond_a_task_s_table(docs, rows, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_HELD", 20)
    _, want = library("word_bpe_49k.json", rows)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, tokenizer_path("word_bpe_49k.json")).collect()} == {i: e.ids for (i, _), e in zip(rows, want, strict=True)}
