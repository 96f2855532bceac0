from __future__ import annotations

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from caravel.llm import language, queries

EN = ["the cat sat on the mat and the dog ran", "this is the house that jack built", "we went to the shop and bought bread", "what is that thing over there then"]
DE = ["der hund lief über die straße und bellte", "das ist ein schönes haus im garten", "wir gehen heute nicht in die schule", "ich weiß nicht was das sein soll"]


def kneser_ney(texts, alphabet):
    """Interpolated Kneser-Ney of order 4 by nested dictionaries, as the textbook has it."""
    keep = []
    for text in texts:
        symbols = [language.FIRST_LETTER + alphabet.index(c) if c in alphabet else (language.UNKNOWN if c.isalpha() else 0) for c in text.lower()]
        run = [0, 0, 0]
        for i, s in enumerate(symbols):
            if s or (i and symbols[i - 1]):
                run.append(s)
        keep.append(run)
    counts = {4: Counter(tuple(r[i - 3 : i + 1]) for r in keep for i in range(3, len(r)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, totals, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for n, grams in counts.items():
        ones, twos = (sum(1 for c in grams.values() if c == k) for k in (1, 2))
        discount[n] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        for g, c in grams.items():
            totals[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def probability(gram):
        n = len(gram)
        if n == 0:
            return 1 / (language.FIRST_LETTER + len(alphabet))
        lower, total = probability(gram[1:]), totals[n][gram[:-1]]
        if not total:
            return lower
        return max(counts[n][gram] - discount[n], 0) / total + discount[n] * kinds[n][gram[:-1]] / total * lower

    return keep, probability


def codes_of(gram):
    return sum(s << 16 * i for i, s in enumerate(reversed(gram)))


def test_models_equal_textbook_kneser_ney():
    alphabet = np.array(sorted({ord(c) for t in EN + DE for c in t if c.isalpha()} - {ord("q")}))
    letters = [chr(c) for c in alphabet]
    symbols = language.symbol_table(alphabet)
    counts = [np.unique(language.symbol_rows(texts, symbols)[1], return_counts=True) for texts in (EN, DE)]
    model = language.fit(["en", "de"], alphabet, counts)
    tables = [kneser_ney(texts, letters) for texts in (EN, DE)]
    grams = {tuple(r[i - 3 : i + 1]) for keep, _ in tables for r in keep for i in range(3, len(r))}
    grams |= {(5, 6, 7, s) for s in range(0, 20)} | {(0, 0, 0, s) for s in range(0, 20)} | {(0, 0, 1, 1)}
    logs = model.log_probabilities(np.array([codes_of(g) for g in grams], np.uint64))
    for row, gram in zip(logs, grams):
        for value, (_, probability) in zip(row, tables):
            assert value == pytest.approx(math.log(probability(gram)), abs=1e-4)
    # all symbols after one context share one probability
    context = (5, 6, 7)
    every = np.array([codes_of(context + (s,)) for s in range(language.FIRST_LETTER + len(alphabet))], np.uint64)
    assert np.exp(model.log_probabilities(every).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train(docs, learn=queries.remainder("doc_id", 3) != 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.99
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_odd_texts(model, docs_of):
    rows = [(1, None), (2, ""), (3, "12 -- 34\n"), (4, "the"), (5, "日本語の文章です" * 30), (6, "xqzj wvkq zzxq qqjx vwxk " * 40), (None, "the and of that with"), (4, "the")]
    judged = language.predict(docs_of(*rows, clashing=True), model, into="judged").select("doc_id", "text", "judged.*").collect()
    got = {(r["doc_id"], r["text"]): r for r in judged}
    assert len(judged) == 8
    for key in rows[:3]:
        assert (got[key]["lang_pred"], got[key]["score"], got[key]["rejected"]) == ("und", 0.0, True)
    assert got[(None, "the and of that with")]["lang_pred"] == "en" and not got[(None, "the and of that with")]["rejected"]
    assert got[rows[4]]["rejected"] and got[rows[5]]["rejected"] and got[rows[5]]["lang_pred"] != "und"


def test_long_texts_give_the_average_of_their_parts(model):
    text = "of the and that with " * 20_000
    one = model.predict([text, text[:2100]])
    assert one["cross_entropy"][0] == pytest.approx(one["cross_entropy"][1], abs=0.02)


def test_without_labels_or_rows(spark, docs_of):
    none = language.train(docs_of((1, "text", None), (None, "text", "en"), (2, None, "en")))
    assert none.languages == []
    judged = language.predict(docs_of((1, "text")), none).select("language.lang_pred", "language.rejected").collect()
    assert [tuple(r) for r in judged] == [("und", True)]
    empty = docs_of((1, "x")).where("false")
    assert language.train(empty).languages == [] and language.predict(empty, none).collect() == []


def test_sample_is_bounded_and_has_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    seen = {r["lang"]: r["count"] for r in language.sample(docs, "doc_id", "text", "lang", None, 200).groupBy("lang").count().collect()}
    assert set(seen) == {"en", "de", "fr", "es"} and all(120 < n < 280 for n in seen.values())
