from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from caravel.llm import centroids
from caravel.llm.queries import op13_centroids
from conftest import SMALL


def plain_clusters(rows, k=16, size=64, scale=64, rounds=3, seed="1"):
    """Every distance to every centroid, in Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in drawn[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        of = [place(v)[1] for _, v in kept]
        for n in range(len(middle)):
            mine = [v for (_, v), m in zip(kept, of) if m == n]
            if mine:
                middle[n] = [sum(c) // len(mine) for c in zip(*mine)]
    told = [(i, *place(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in told if m == n) for n in range(len(middle))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), text[n]) for i, d, n in told), key=str)


def told(frame, key="vec_id"):
    found = frame.select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("high", [3, 40])
def test_nearest_is_the_nearest_with_ties_to_the_smaller_number(high):
    random = np.random.default_rng(high)
    for k, size in ((1, 1), (2, 3), (16, 4), (16, 64)):
        points, middle = random.integers(-high, high, (3000, size)), random.integers(-high, high, (k, size))
        distance = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2)
        number, best = centroids.nearest(points, middle)
        assert (number == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_query_equals_plain_integers(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert told(op13_centroids(spark, SMALL)) == plain_clusters([tuple(r) for r in rows])


def test_unusable_vectors_ties_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), -0.5, i / 7]) for i in range(20)]
    rows += [(3, [0.0, -0.5, 3 / 7]), (4, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(30, None), (31, []), (32, [1.0, None, 1.0]), (33, [nan, 0.0, 0.0]), (34, [inf, 0.0, 0.0]), (35, [1.0, 2.0]), (36, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3).selectExpr("*", "'x' AS key", "'y' AS cluster", "7 AS grid")
    found = centroids.cluster(frame, k=5, size=3)
    assert told(found) == plain_clusters(rows, k=5, size=3)


def test_fewer_vectors_than_centroids_one_value_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = [(i, [i / 4, 1.0]) for i in range(3)]
    assert told(centroids.cluster(spark.createDataFrame(few, schema), size=2)) == plain_clusters(few, size=2)
    same = [(i, [1.0, 1.0]) for i in range(50)]
    assert told(centroids.cluster(spark.createDataFrame(same, schema), size=2)) == plain_clusters(same, size=2)
    assert centroids.cluster(spark.createDataFrame([], schema), size=2).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None)], schema), size=2).collect() == []


def test_components_too_large_for_exact_distances_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(frame, size=2).collect()
