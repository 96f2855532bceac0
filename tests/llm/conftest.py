from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Columns that the operators use inside; a caller's table may have any of them.
CLASHING = "_language _dedup key doc at mark hash lines gone fingerprint component_id tokens words ids n_tokens label y x rep root node score".split()


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang), with clashing extra columns if asked for."""

    def build(*rows, clashing=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS).repartition(3)
        return frame.selectExpr("*", *[f"'other' AS {name}" for name in CLASHING]) if clashing else frame

    return build


@pytest.fixture
def small(spark):
    return lambda name, sf="sf0.001": spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def words(n: int, start: int = 0) -> str:
    """Text without repeats: n different words."""
    return " ".join(f"w{(start + i) * 7919 % 1000003}" for i in range(n))
