import hashlib

import public_tokenizers as tok
import pytest

from netloom.llm import bpe

RANKS = tok.path(bpe.RANKS)
TEXTS = [None, "", " ", "\n\n", "Hello world's  end\n", "naïve ça où 12345 x9", "日本語テキスト", "a" * 40_000, "ab " * 60_000,
         "word" + " " * 20_000 + "next", "x" + "\n" * 20_000, " " * 30_000 + "\n" * 30_000 + "!", "tab\t\tend   nbsp",
         "<|endoftext|> is plain text", "é" * 70_000 + " tail　wide"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(RANKS, tok.PATTERN)


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x", [7]) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", [7])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>")


def test_ids_are_those_of_the_library(spark, enc, docs):
    got = bpe.encode(docs, RANKS, tok.PATTERN).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == enc.encode_ordinary(TEXTS[r.doc_id] or ""), r.doc_id


def test_decoding_gives_the_bytes_back(spark, docs):
    both = bpe.decode(bpe.encode(docs, RANKS, tok.PATTERN), RANKS, tok.PATTERN)
    assert all(bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode() for r in both.collect())


def test_ids_may_end_inside_a_character(spark, enc):
    ids = enc.encode_ordinary("語" * 3)
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS, tok.PATTERN).collect()}
    assert got == {1: enc.decode_bytes(ids[:1]), 2: b"", 3: b""}


def test_pieces_cut_only_before_white_space(enc):
    text = "one two\n\n  three " * 500
    parts = list(bpe.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert sum((enc.encode_ordinary(p) for p in parts), []) == enc.encode_ordinary(text)


def test_a_run_too_long_for_the_pattern_engine(enc):
    # The library itself fails on such a run in one call.
    for text in (" " * 3_000_000, "a" + " " * 2_000_000 + "b"):
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids.tolist()) == text.encode()
    short, long = enc.encode_ordinary("a" + " " * 20_001 + "b"), bpe.encode_text(enc, "a" + " " * 20_001 + "b").tolist()
    assert short == long


def test_digests_and_empty_table(spark, enc, docs):
    got = {r.doc_id: r for r in bpe.token_digests(docs, RANKS, tok.PATTERN).collect()}
    ids = enc.encode_ordinary(TEXTS[4])
    assert got[4].n_tokens == len(ids)
    assert got[4].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0].n_tokens == 0 and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(docs.limit(0), RANKS, tok.PATTERN).count() == 0
