from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from caravel.llm import pieces
from caravel.llm.queries import op12_piece_bpe
from conftest import SMALL

PATH = public_tokenizers.path(pieces.MODEL)
ODD = list("ab cd  \n\té語𓀀▁\0.,éﬁｈ½ ก　") + ["the", " ", "<s>", "</s>", "<0x41>", "<unk>", "​", "\r\n", "하", "é"]


def model_bytes():
    with open(PATH, "rb") as model:
        return model.read()


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_rules(model, character_map=None, suffix=None, fallback=None, **flags):
    """The model with other rules: later fields override earlier ones."""
    rules = b"" if character_map is None else bytes([pieces.CHARACTER_MAP << 3 | 2]) + number(len(character_map)) + character_map
    for name, value in flags.items():
        rules += bytes([{"prefix": pieces.DUMMY_PREFIX, "squeeze": pieces.SQUEEZE_BLANKS, "escape": pieces.ESCAPE_BLANKS}[name] << 3, value])
    trainer = b""
    for field, value in ((pieces.BLANK_AS_SUFFIX, suffix), (pieces.BYTE_FALLBACK, fallback)):
        trainer += b"" if value is None else number(field << 3) + bytes([value])
    return model + bytes([pieces.NORMALIZER << 3 | 2]) + number(len(rules)) + rules + bytes([pieces.TRAINER << 3 | 2]) + number(len(trainer)) + trainer


def character_map(rule):
    for field, value in pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()):
        if field == pieces.NORMALIZER:
            return dict(pieces.fields(value))[pieces.CHARACTER_MAP]


def expected(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def compare(model, rounds, part_bytes=pieces.PART_BYTES, seed=1):
    library, mine, draw = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(model, part_bytes), random.Random(seed)
    for _ in range(rounds):
        text = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 40)))
        ids, starts, ends = mine.encode(text)
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == expected(library, text), text
        assert mine.decode(ids) == library.decode(library.encode(text))


@pytest.mark.parametrize("part_bytes", [5, pieces.PART_BYTES])
def test_ids_spans_and_decoded_text_are_those_of_the_library(part_bytes):
    compare(model_bytes(), 3000, part_bytes)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
@pytest.mark.parametrize("flags", [{}, {"squeeze": 1}, {"prefix": 0}, {"squeeze": 1, "suffix": 1}, {"squeeze": 1, "prefix": 0}, {"squeeze": 1, "escape": 0}])
def test_other_normalisers(rule, flags):
    compare(with_rules(model_bytes(), character_map(rule), **flags), 150, 9)


def test_model_without_byte_pieces():
    unused = re.sub(rb"(<0x[0-9A-F]{2}>\x15\0\0\0\0\x18)\x06", lambda m: m[1] + b"\x05", model_bytes())
    compare(with_rules(unused, character_map("nfkc"), squeeze=1, fallback=0), 300, 9)


def test_longest_source_string_wins():
    found = pieces.CharacterMap(character_map("nfkc"))
    assert found.longest("éx".encode(), 0) == (3, "é".encode())
    assert found.longest("ex".encode(), 0) is None
    text, source = found.replaced("aﬁ½éz".encode())
    assert text.decode() == "afi1⁄2éz"
    assert source.tolist() == [0, 1, 1, 4, 4, 4, 4, 4, 6, 6, 9]


def test_symbols_of_the_users_own_are_refused():
    piece = b"\x0a\x03abc\x15\0\0\0\0\x18\x04"
    with pytest.raises(ValueError, match="own"):
        pieces.Encoder(model_bytes() + b"\x0a" + bytes([len(piece)]) + piece)


def plain_row(library, doc_id, text):
    text = text or ""
    told = expected(library, text)
    ids = [i for i, _, _ in told]
    spans = ",".join(str(a) for _, a, _ in told) + ";" + ",".join(str(b) for _, _, b in told)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, library.encode(text))), library.decode(ids), spans)]
    return (doc_id, len(ids), *digest)


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_query_equals_the_library(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in op12_piece_bpe(spark, folder).collect()), key=str) == sorted((plain_row(library, *r) for r in rows), key=str)


def test_nulls_empty_and_long_texts_and_other_columns(spark, docs_of):
    long = "Ein langes Wort und " * 30000 + "ü" * 250000
    rows = [(1, None), (2, ""), (3, "  a "), (3, "  a "), (None, "b"), (4, long), (5, " ")]
    coded = pieces.encode(docs_of(*rows, clashing=True))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in coded.collect()), key=str)
    assert found == sorted(((i, len(library.encode(t or "")), library.encode(t or ""), t or "") for i, t in rows), key=str)
    assert all(r["starts"][1:] == r["ends"][:-1] for r in coded.where("doc_id = 3").collect())
    again = {r["doc_id"]: r["decoded"] for r in pieces.decode(coded.where("doc_id <= 2 OR doc_id = 4")).collect()}
    assert again == {1: "", 2: "", 4: long}
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).collect()[0]["decoded"] == ""
    assert pieces.encode(docs_of((1, "a")).limit(0)).collect() == []
