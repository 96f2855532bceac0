from __future__ import annotations

import numpy as np
import pytest

from caravel.llm import queries, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least=0.9):
    """All pairs of distinct (id, vector), in double precision."""
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen.setdefault((i, tuple(np.float32(v).tolist())), np.float32(v).astype(float))
    names, units = list(seen), [v / np.linalg.norm(v) for v in seen.values()]
    links = {i: set() for i, _ in rows}
    for a in range(len(names)):
        for b in range(a):
            if len(units[a]) == len(units[b]) and names[a][0] != names[b][0] and units[a] @ units[b] >= least:
                links[names[a][0]].add(names[b][0])
                links[names[b][0]].add(names[a][0])
    out = {}
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        out[i] = (len(links[i]), None if i is None else min(reach))
    return out


def found(frame, **options):
    rows = vectors.near_duplicates(frame, **options).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}, len(rows)


def clustered(n, groups, size, spread, seed, dense=0):
    random = np.random.default_rng(seed)
    rows = random.normal(size=(n, size))
    centers = random.normal(size=(groups, size))
    near = centers[random.integers(0, groups, n // 2)] + spread * random.normal(size=(n // 2, size))
    rows[: n // 2] = near
    if dense:
        rows[:dense] = centers[0] + 0.05 * random.normal(size=(dense, size))
    return [(i, v.tolist()) for i, v in enumerate(rows.astype(np.float32))]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS rep", "2 AS node", "3 AS mark").repartition(4)


def test_leaves_and_dense_blocks_equal_brute_force(table):
    rows = clustered(900, 40, 64, 0.15, 1, dense=300)
    rows += [(5000 + i, rows[0][1]) for i in range(3)] + [(6000, [2 * x for x in rows[0][1]])]
    want = brute(rows)
    for sample in (1 << 14, 200, 0):  # all levels fitted, the upper ones, none
        got, n = found(table(rows), leaf=60, sample=sample)
        assert n == len(rows) and got == want


def test_odd_vectors_link_with_nothing(table):
    good = [0.5, 0.25, -1.0]
    rows = [
        (1, good), (2, good), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]),
        (8, []), (9, [0.5, 0.25]), (10, [1e30, 5e29, -2e30]), (None, good), (12, [-0.5, -0.25, 1.0]), (2, good),
    ]
    got, n = found(table(rows))
    assert n == len(rows)
    assert got == {
        1: (2, 1), 2: (2, 1), 10: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9), None: (0, None), 12: (0, 12)
    }


def test_the_bound_itself_counts(table):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    got, _ = found(table(rows), least=0.5)
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 1)}


def test_recall_near_the_bound(table):
    """Pairs at a cosine of just over 0.9, the hardest to keep together, in many small leaves."""
    random = np.random.default_rng(8)
    rows = []
    for i in range(700):
        a, b = random.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.905 * a + np.sqrt(1 - 0.905**2) * b).tolist())]
    got, _ = found(table(rows), leaf=40)
    want = brute(rows)
    linked = [i for i, (n, _) in want.items() if n]
    assert len(linked) == 1400 and sum(got[i] == want[i] for i in linked) / len(linked) >= 0.9
    assert all(got[i][0] <= want[i][0] for i in want)


def test_empty_table(table, spark):
    assert found(spark.createDataFrame([], SCHEMA)) == ({}, 0)
    assert found(table([(1, None)])) == ({1: (0, 1)}, 1)


def test_query_equals_brute_force(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in small("embeddings").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op10_embeddings(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}


def test_most_links_of_a_crowded_table_are_found(spark):
    """Held against brute force on a table with copies, near copies and one large group."""
    path = "/root/testdata/check_h/embeddings.parquet"
    rows = spark.read.parquet(path).orderBy("vec_id").collect()
    units = np.array([r["embedding"] for r in rows], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    degree = np.concatenate([(units[i : i + 1000] @ units.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(units), 1000)])
    got = vectors.near_duplicates(spark.read.parquet(path)).orderBy("vec_id").collect()
    links = np.array([r["n_links"] for r in got])
    assert (links <= degree).all() and links.sum() >= 0.99 * degree.sum()
