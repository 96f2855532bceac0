from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from caravel.llm import bpe, language
from llm import test_decontaminate, test_lines, test_simhash

SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["language", "line", "SimHash", "benchmark", "byte-level"]


def test_run_equals_brute_force(spark, small):
    """Every stage again by plain Python; the language models, which have tests of their own, are shared."""
    docs = small("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = language.train(docs).predict([t for _, t in rows])
    rows = [r for r, gone in zip(rows, judged["rejected"]) if not gone]
    left = {int(r[0]): r for r in test_lines.brute(rows)}
    rows = [(d, left[d][4]) for d, _ in rows if not (left[d][2] and not left[d][4].strip())]
    component = {int(r[0]): r[2] for r in test_simhash.brute(rows)}
    rows = [r for r in rows if component[r[0]] == r[0]]
    items = {r["item_id"]: test_decontaminate.templates(r["text"])[1] for r in small("benchmark").collect()}
    size = 13  # six windows of eight
    runs = {tuple(t[i : i + size]) for t in items.values() for i in range(len(t) - size + 1)}

    def leaked(text):
        tokens = test_decontaminate.templates(text)[1]
        return any(tuple(tokens[i : i + size]) in runs for i in range(len(tokens) - size + 1))

    rows = [r for r in rows if not leaked(r[1])]
    encoding = bpe.encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = set()
    for d, text in rows:
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        want.add((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


ODD = [
    (1, "the cat and the dog are in the house with the other things that were there", "en"), (2, None, "en"), (3, "", None), (4, "12 34 -- 56", "en"),
    (5, "the cat and the dog are in the house with the other things that were there", "en"), (5, "the same id with other words that are in english too", "en"),
    (None, "a text without an id that is in the house with the other things", "en"), (6, "the " * 5000, "en"),
]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_rows_and_empty_tables(spark, docs_of, stage):
    name, function = corpus_pipeline.STAGES[stage]
    docs = docs_of(*ODD, clashing=True)
    out = function(spark, docs, SF)
    kept = out.collect()
    assert function(spark, docs.where("false"), SF).collect() == []
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert 1 in [r["doc_id"] for r in kept] and None in [r["doc_id"] for r in kept]
    if name == "language ID":
        assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 5, 5, 6]
    if name == "line dedup":
        assert [r["text"] for r in kept if r["doc_id"] == 5] == ["the same id with other words that are in english too"]
        assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in kept)
    if name == "SimHash near-dedup":
        assert sum(r["text"] in (None, "") for r in kept) == 1
        assert sorted(r["text"] for r in kept if r["doc_id"] == 5) == ["the same id with other words that are in english too"]


def test_near_dedup_judges_rows_not_ids(spark, docs_of):
    near = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    rows = [(7, "one text of its own"), (7, "quite another text under that id"), (7, "one text of its own"), (None, "one text of its own"), (None, "a third"), (3, "a third")]
    kept = [(r["doc_id"], r["text"]) for r in near(spark, docs_of(*rows, clashing=True), SF).collect()]
    assert sorted(kept, key=str) == [(3, "a third"), (7, "one text of its own"), (7, "quite another text under that id")]


def test_decontamination_judges_rows_not_ids(spark, docs_of, small):
    clean = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    item = small("benchmark").orderBy("item_id").first()["text"]
    rows = [(7, "a text that has nothing to do with it"), (7, "see " + item), (None, item), (None, "a text that has nothing to do with it")]
    kept = [(r["doc_id"], r["text"]) for r in clean(spark, docs_of(*rows, clashing=True), SF).collect()]
    assert sorted(kept, key=str) == [(7, rows[0][1]), (None, rows[0][1])]
