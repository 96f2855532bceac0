from __future__ import annotations

import os

import numpy as np
import pytest

from caravel.llm import cells, vectors
from caravel.workspace import shared_folder

FAR = np.iinfo(np.int32).max


def units(n, seed=0, size=64):
    found = np.random.default_rng(seed).normal(size=(n, size)).astype(np.float32)
    return cells.units_of(found).astype(np.float32)


def with_partners(n, cosine, seed=0, size=64):
    """Each vector is followed by one at the given cosine."""
    a, b = units(n // 2, seed, size).astype(float), units(n // 2, seed + 1, size).astype(float)
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    return np.stack([a, cosine * a + np.sqrt(1 - cosine**2) * b], axis=1).reshape(n, size).astype(np.float32)


@pytest.fixture
def frame(spark):
    def build(rows):
        named = [(i, v.tolist(), 0) for i, v in enumerate(rows)]
        return spark.createDataFrame(named, "vec_id bigint, embedding array<float>, label int").repartition(4)

    return build


def written_bytes(spark):
    top = shared_folder(spark).removeprefix("file:")
    return {f"{d}/{name}": os.path.getsize(f"{d}/{name}") for d, _, names in os.walk(top) for name in names}


def test_vectors_are_not_written_in_many_copies(spark, frame):
    """Small leaves, as many as a large table has: what is written stays below four times the vectors."""
    rows = units(6000)
    before = written_bytes(spark)
    vectors.near_duplicates(frame(rows), leaf=100).collect()
    assert sum(size for name, size in written_bytes(spark).items() if name not in before) <= 4 * rows.nbytes


def test_copies_are_bounded_and_few_partners_lost():
    rows = with_partners(20_000, 0.905)
    forest = vectors.fit(rows, len(rows), 0.9, 1, 400, vectors.SPILL)
    row, cell = forest.descend(rows)
    assert len(forest.blocks) > 100 and max(forest.blocks) == 1 and len(row) <= 1.1 * vectors.COPIES * len(rows)
    held = np.zeros((len(rows), len(forest.blocks)), bool)
    held[row, cell] = True
    assert (held[::2] & held[1::2]).any(axis=1).mean() >= 0.95


def brute(rows, count, homes, cell, block):
    meet = rows.astype(float) @ rows.T.astype(float) >= 0.9
    np.fill_diagonal(meet, False)
    for i, mine in enumerate(homes):
        early = set(mine[mine < cell].tolist())
        for j in np.flatnonzero(meet[i]):
            meet[i, j] = not early & set(homes[j].tolist()) and (block is None or block[i] != block[j])
    return meet, meet @ count


@pytest.mark.parametrize("blocked", [False, True])
def test_a_cell_counts_pairs_once_and_only_its_own(blocked):
    """Split within the cell; a dense group, close pairs, pairs of earlier cells, blocks and classes of several keys."""
    random = np.random.default_rng(4)
    rows = with_partners(6000, 0.95)
    rows[:700] = cells.units_of(rows[0] + 0.03 * random.normal(size=(700, 64)))
    homes = np.full((len(rows), 3), FAR, np.int32)
    homes[:, 0] = random.integers(0, 4, len(rows))
    homes[:, 1] = np.where(random.random(len(rows)) < 0.5, 7, FAR)
    homes[homes[:, 0] == 3, 0] = 7
    homes.sort(axis=1)
    count = random.integers(1, 4, len(rows))
    block = random.integers(0, 2, len(rows)) if blocked else None
    found = cells.Cell(rows, count, homes, 7, 0.9, block).search()
    assert found.at.shape[1] > 1  # it was split
    meet, degree = brute(rows, count, homes, 7, block)
    assert (found.degree <= degree).all() and (found.degree == degree).mean() >= 0.999
    linked = np.argwhere(meet & (found.degree == degree)[:, None] & (found.degree == degree))
    assert len(linked) and (found.label[linked[:, 0]] == found.label[linked[:, 1]]).all()


def test_turns_change_nothing_and_settings_stay(spark, frame, monkeypatch):
    rows = with_partners(1200, 0.97)
    rows[:200] = cells.units_of(rows[0] + 0.02 * np.random.default_rng(2).normal(size=(200, 64)))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    once = sorted(vectors.near_duplicates(frame(rows), leaf=60).collect())
    monkeypatch.setattr(vectors, "TURN_BYTES", 1)
    monkeypatch.setattr(vectors, "AT_ONCE", 0.5)
    asked = []
    monkeypatch.setattr(vectors, "_turns", lambda *a, f=vectors._turns: asked.append(f(*a)) or asked[-1])
    assert sorted(vectors.near_duplicates(frame(rows), leaf=60).collect()) == once
    assert asked[0] > 3 and spark.conf.get(name, None) == before


def test_shared_vectors_count_by_key(frame, monkeypatch):
    """Repeated vectors under other keys, joined with and without a broadcast."""
    rows = with_partners(400, 0.97)
    rows = np.concatenate([rows, rows[:100], rows[:50]])
    for most in (vectors.BROADCAST, 0):
        monkeypatch.setattr(vectors, "BROADCAST", most)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame(rows)).collect()}
        near = rows.astype(float) @ rows.T.astype(float) >= 0.9
        assert got == {i: (int(near[i].sum()) - 1, int(near[i].argmax())) for i in range(len(rows))}
