from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caravel.llm import licenses, queries
from llm.conftest import words

INDEX = licenses.Index(licenses.TEMPLATES)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_whole_and_with_its_span(name):
    text = f"{words(50)}.\n{licenses.TEMPLATES[name]}\n{words(40, 100)}"
    hits = {m[0]: m for m in licenses.matches(INDEX, text)}
    assert hits[name][2] == 1.0
    start, end = hits[name][3:]
    assert licenses.WORD.findall(text[start:end]) == licenses.WORD.findall(licenses.TEMPLATES[name])


def test_edited_notices_report_their_coverage():
    parts = licenses.TEMPLATES["MIT"].split()
    parts[10], parts[50:50] = "changed", ["put", "in"]
    del parts[30]
    (hit,) = licenses.matches(INDEX, words(30) + " " + " ".join(parts) + " " + words(30))
    assert hit[0] == "MIT" and hit[1] == len(licenses.WORD.findall(licenses.TEMPLATES["MIT"])) - 2 and hit[2] < 1
    assert licenses.matches(INDEX, " ".join(parts[: len(parts) // 2])) == []


def common(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@given(st.lists(st.integers(1, 6), min_size=1, max_size=12), st.lists(st.integers(1, 6), max_size=14))
@settings(max_examples=300, deadline=None)
def test_a_band_over_everything_gives_the_longest_common_subsequence(a, b):
    matched, first, end = licenses.align(np.array(a), np.array(b, np.int64), -len(a), len(b))
    assert matched == common(a, b)
    if matched:
        assert 0 <= first < end <= len(b) and common(a, b[first:end]) == matched


def test_winnowing_keeps_one_of_every_window():
    random = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 40):
        hashes = random.integers(0, 9, n).tolist()
        kept = licenses.winnow(hashes)
        assert all(any(j in kept for j in range(i, i + licenses.WINDOW)) for i in range(n - licenses.WINDOW + 1))
        assert bool(kept) == bool(n)


LINE = "Released under the MIT License."
ROWS = [(1, None), (2, ""), (3, LINE), (3, LINE), (4, f"{LINE} {LINE}\n" + words(3000) + " " + LINE), (None, LINE), (5, words(100)), (6, "ALL RIGHTS RESERVED")]


def test_rows(docs_of):
    got = licenses.scan(docs_of(*ROWS, clashing=True)).collect()
    lines = sorted(str(r["doc_id"]) for r in got if r["template"] == "MIT line")
    assert lines == ["3", "3", "4", "4", "4", "None"]
    assert [r["doc_id"] for r in got if r["template"] == "Proprietary line"] == [6] and len(got) == 7
    assert licenses.scan(docs_of(*ROWS).where("false")).collect() == []
    assert licenses.scan(docs_of(*ROWS), templates={"own": "w0 w7919 w15838 w23757"}).count() == 2


def test_query_finds_every_verbatim_line(spark, small):
    got = {(r["doc_id"], r["template"]) for r in queries.op8_license_scan(spark, "/root/testdata/sf0.001").collect()}
    want = {
        (r["doc_id"], name)
        for r in small("documents").collect()
        for name, text in licenses.TEMPLATES.items()
        if " ".join(licenses.WORD.findall(text.lower())) in " ".join(licenses.WORD.findall(r["text"].lower()))
    }
    assert want and want == got
