from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from caravel.llm import periods
from caravel.llm.queries import op11_periodic_runs
from conftest import SMALL


def plain_runs(words, repeats=4, least=6):
    """Every period by itself: stretches that equal themselves a period before."""
    found = {}
    for period in range(1, len(words) // repeats + 1):
        i = period
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - period]:
                i += 1
            start, length = first - period, i - first + period
            if length >= max(least, repeats * period):
                found.setdefault((start, length), period)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 5)])
def test_runs_equal_every_period_by_itself(repeats, least):
    draw = random.Random(repeats)
    for _ in range(3000):
        words = [str(draw.randrange(draw.choice([1, 2, 3, 9]))) for _ in range(draw.randint(0, 70))]
        if words and draw.random() < 0.6:
            a = draw.randrange(len(words))
            p = draw.randint(1, max(1, (len(words) - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            words += [str(draw.randrange(3)) for _ in range(draw.randint(0, 20))]
        assert periods.periodic_runs(" ".join(words), repeats, least)[1] == plain_runs(words, repeats, least)


def test_words_may_come_in_any_portions(monkeypatch):
    text = "x " + "a b c " * 30 + "y" + "\n\tz" * 9
    whole = periods.periodic_runs(text)
    monkeypatch.setattr(periods, "PIECE_BYTES", 7)
    assert periods.periodic_runs(text) == whole
    assert whole[1] == [(1, 90, 3), (92, 9, 1)]
    assert whole[2] == "x a b c y z"


def test_equal_hashes_of_different_blocks_are_told_apart(monkeypatch):
    monkeypatch.setattr(periods, "MODULUS", 2)
    draw = random.Random(5)
    for _ in range(300):
        words = [draw.choice("ab") for _ in range(60)]
        assert periods.periodic_runs(" ".join(words), 2, 2)[1] == plain_runs(words, 2, 2)


def test_query_equals_a_plain_version(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in expected) > 10
    assert sorted((tuple(r) for r in op11_periodic_runs(spark, SMALL).collect()), key=str) == expected


def test_nulls_blank_and_long_texts_and_other_columns(spark, docs_of, tmp_path):
    long = "w " + "a b " * 400
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 5, "a " * 6, long, "é é é é é é é é é é é é", "A a " * 6, "x\0 " * 7]
    rows = [(i, t) for i in range(40) for t in (texts[i % len(texts)],)] + [(None, "b " * 9), (1, "b " * 9), (1, "b " * 9)]
    docs = docs_of(*rows, clashing=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted((plain_row(*r) for r in rows), key=str)


def test_a_very_long_text():
    n, runs, left = periods.periodic_runs("w " + "a b c " * 70000 + "z")
    assert (n, runs, left) == (210002, [(1, 210000, 3)], "w a b c z")


def test_empty_table_and_bad_setting(spark, docs_of):
    assert periods.find_runs(docs_of((1, "a")).limit(0)).collect() == []
    with pytest.raises(ValueError):
        periods.find_runs(docs_of((1, "a")), repeats=1)
