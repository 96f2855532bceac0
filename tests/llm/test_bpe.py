from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest

from caravel.llm import bpe, queries
from llm.conftest import words

PATH = public_tokenizers.path(bpe.RANKS)


def whole(text):
    """The library's own answer for a whole text."""
    return bpe.encoder(PATH, public_tokenizers.PATTERN).encode_ordinary(text or "")


TEXTS = [
    None, "", " ", "\n\n  a", "don't  stop\t\n x", "<|endoftext|> is text", "日本語 und Straße 123456", "a" * 3000, "  " * 500 + "z", "😀🏽 é",
    words(2000), "x \n\n y", " .  .\n", "it's 3.14!?", "   wide", "tab\tend ",
]


@pytest.mark.parametrize("most", [1, 3, 50, 10**6])
def test_cutting_at_safe_boundaries_changes_nothing(most):
    encoding = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for text in filter(None, TEXTS):
        assert "".join(bpe.pieces(text, most)) == text
        assert bpe.token_ids(encoding, text, most).tolist() == whole(text)


def test_encode_and_decode(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    coded = bpe.encode(docs_of(*rows, clashing=True))
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], bytes(r["decoded"])) for r in coded.collect())
    want = sorted((str(d), whole(t), len(whole(t)), (t or "").encode()) for d, t in rows)
    assert got == want
    back = bpe.decode(coded.select("doc_id", "ids")).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in rows)


def test_decoded_bytes_need_not_be_text(spark):
    ids = np.array(whole("é")[:1] + [188], "<u4").tobytes()
    frame = spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id bigint, ids binary")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(frame).collect()}
    assert got[2] == b"" and got[1] == bpe.encoder(PATH, public_tokenizers.PATTERN).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def test_empty_table(docs_of):
    assert bpe.encode(docs_of((1, "x")).where("false")).collect() == []


def test_query_equals_the_library(spark, small):
    want = {}
    for r in small("documents").collect():
        ids = np.array(whole(r["text"]), "<u4")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
