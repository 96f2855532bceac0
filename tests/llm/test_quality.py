from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest

from caravel.llm import quality, queries
from llm.conftest import words

LABELS = "doc_id bigint, quality int, toxic int"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / ones.sum() / (~ones).sum()


def test_held_out_ranking_and_calibration(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    y, p = (np.array(x) for x in zip(*held))
    assert len(y) > 500 and auc(y, p) > 0.98 and ((p - y) ** 2).mean() < 0.03


def test_word_vectors_are_sums_over_all_neighbours(docs_of):
    texts = ["a b c a", "b", None, "", "c c"]
    places, signs = quality.index_vectors()
    table = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for text in texts:
        ws = [crc32(w.encode()) % quality.BUCKETS for w in (text or "").split()]
        for i, w in enumerate(ws):
            for j in range(max(0, i - quality.REACH), min(len(ws), i + quality.REACH + 1)):
                if j != i:
                    np.add.at(table[w], places[ws[j]], signs[ws[j]])
    some = table.any(axis=1)
    table[some] -= table[some].mean(axis=0)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(docs_of(*enumerate(texts), clashing=True))
    assert np.allclose(got, table, atol=1e-6)


def test_pooling():
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    texts = [None, "one two one", "", words(5000)]
    x = quality.pool(texts, vectors, quality.Words())
    assert not x[0].any() and not x[2].any()
    picked = vectors[[crc32(w.encode()) % quality.BUCKETS for w in texts[1].split()]]
    assert np.allclose(x[1, : quality.DIMENSIONS], picked.mean(axis=0), atol=1e-6)
    assert np.allclose(x[1, quality.DIMENSIONS : -2], picked.std(axis=0), atol=1e-3) and x[1, -1] == pytest.approx(2 / 3)
    assert np.allclose(quality.pool(texts[3:], vectors, quality.Words()), x[3:], atol=1e-9)


def test_network_learns_what_one_layer_cannot():
    random = np.random.default_rng(4)
    x = np.zeros((1200, quality.FEATURES))
    x[:, :2] = random.normal(size=(1200, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.fit(x, y, np.arange(1200) % 5 == 0)
    assert auc(y, net.probabilities(x)) > 0.95 and 0.5 <= net.temperature <= 8


def test_rows_labels_and_odd_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "good text"), (3, "good text"), (None, "no id"), (4, words(2000))]
    docs = docs_of(*rows, clashing=True)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, None, 0), (None, 0, 0), (2, 1, None)], LABELS).selectExpr("*", "'x' AS key", "1 AS y")
    got = quality.score_documents(docs, one).collect()
    assert len(got) == 6 and {round(r["score"], 6) for r in got} == {0.8}  # ids 2 and 3 (twice in docs): three rows of label 1
    assert quality.score_documents(docs.where("false"), one).collect() == []
