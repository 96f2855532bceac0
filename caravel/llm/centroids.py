"""Centroid clustering of vectors on an integer grid, nearest centroids found by the threshold algorithm.

A vector of exactly ``size`` components, none of them null or non-finite, becomes integers floor(scale * x);
other vectors are not kept. All distances, sums and means are integers, so results do not depend on the
order of rows or on the number of tasks.

Nearest centroid: every dimension has its centroids sorted by their value there. Each vector walks these
lists outward from its own value, one entry in every dimension at a time. Centroids met are compared in
full; whatever was not met yet is in every dimension at least as far as the entry last read there. The walk
stops when the sum of these squared frontier distances strictly exceeds the best exact distance, so ties are still
met and go to the smaller number.

A round is one pass over the vectors: each batch of rows yields the sums of its clusters, Spark adds them,
and the driver receives ``k`` centroids. Starts are the ``k`` kept vectors whose SHA-256 of ``<seed>:<key>`` is
smallest; rows that share a key are ordered by their vector, rows without a key come last (each is
still assigned). With fewer than ``k`` vectors there are fewer centroids; an empty table gives no rows.
Repeated rows count each. Components beyond 2**27 on the grid raise an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.frames import pick, written

K, SIZE, SCALE, ROUNDS, SEED = 16, 64, 64, 3, "1"
ROWS = 1024
MOST = 1 << 27


def on_grid(column: pa.Array, size: int = SIZE, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept, and their vectors as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
    finite = np.isfinite(values).all(axis=1)  # nulls have become NaN
    grid = np.floor(values[finite] * scale)
    if np.abs(grid).max(initial=0) > MOST:
        raise ValueError(f"a component lies beyond {MOST} on the grid")
    return rows[finite], grid.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector, ties to the smaller number."""
    k, size = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    ends = np.full((1, size), 1 << 40)
    values = np.concatenate([-ends, values, ends])  # walks that run off a list read an entry that is never the nearer one
    order = np.concatenate([order[:1], order, order[-1:]])
    dims = np.arange(size)
    number, best = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.iinfo(np.int64).max)
    for first in range(0, len(vectors), ROWS):
        x = vectors[first : first + ROWS]
        rows = np.arange(first, first + len(x))
        high = 1 + sum((values[i + 1] < x).astype(np.int64) for i in range(k))
        low = high - 1
        seen = np.zeros((len(x), k), bool)
        for _ in range(k):
            below, above = x - values[low, dims], values[high, dims] - x
            down = below <= above
            met = order[np.where(down, low, high), dims]
            now = seen.copy()
            now[np.arange(len(x))[:, None], met] = True
            for c in range(k):  # in ascending order, so that an equal distance keeps the smaller number
                at = np.flatnonzero(now[:, c] & ~seen[:, c])
                exact = np.square(x[at] - centroids[c]).sum(axis=1)
                mine = rows[at]
                better = (exact < best[mine]) | ((exact == best[mine]) & (c < number[mine]))
                best[mine[better]], number[mine[better]] = exact[better], c
            frontier = np.square(np.where(down, below, above)).sum(axis=1)
            on = (frontier <= best[rows]) & ~now.all(axis=1)
            if not on.any():
                break
            low, high = (low - down)[on], (high + ~down)[on]
            x, rows, seen = x[on], rows[on], now[on]
    return number, best


def _sums(centroids: np.ndarray, scale: int):
    """For every cluster that a batch has rows of: their number and their sum in each dimension."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, grid = on_grid(batch.column(0), size, scale)
            number, _ = nearest(grid, centroids)
            total = np.zeros((k, size), np.int64)
            np.add.at(total, number, grid)
            count = np.bincount(number, minlength=k)
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(count[held], pa.int64()), pa.array(list(total[held]), pa.list_(pa.int64()))],
                names=["cluster", "n", "total"],
            )

    return run


def _assign(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grid = on_grid(batch.column(1), centroids.shape[1], scale)
            number, distance = nearest(grid, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["key", "cluster", "distance"]
            )

    return run


def starts(rows: DataFrame, k: int, size: int, scale: int, seed: str) -> np.ndarray:
    """The first centroids, in the order of their hash; ``k`` rows at most reach the driver."""
    parts = F.col("embedding")
    kept = (F.size(parts) == size) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    grid = F.transform(parts, lambda x: F.floor(x.cast("double") * scale))
    first = rows.where(kept).select(drawn.alias("drawn"), grid.alias("grid")).orderBy(F.col("drawn").asc_nulls_last(), "grid").limit(k)
    return np.array([r["grid"] for r in first.collect()], np.int64).reshape(-1, size)


def fit(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, size: int = SIZE, scale: int = SCALE, rounds: int = ROUNDS, seed: str = SEED
) -> np.ndarray:
    """The centroids after so many rounds; a cluster without vectors keeps its centroid."""
    rows = pick(df, key=key, embedding=vector)
    centroids = starts(rows, k, size, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        sums = rows.select("embedding").mapInArrow(_sums(centroids, scale), "cluster int, n bigint, total array<bigint>")
        added = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]
        for cluster, n, *total in sums.groupBy("cluster").agg(F.sum("n"), *added).collect():
            centroids[cluster] = [int(t) // n for t in total]  # exact, and downward also below zero
    return centroids


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, size: int = SIZE, scale: int = SCALE, rounds: int = ROUNDS, seed: str = SEED
) -> DataFrame:
    """Key, cluster, distance (squared), cluster_inertia, inertia, centroid (array) and centroid_sha256: a row for each kept vector."""
    rows = pick(df, key=key, embedding=vector)
    kind = rows.schema["key"].dataType.simpleString()
    centroids = fit(df, key, vector, k, size, scale, rounds, seed)
    if not len(centroids):
        centroids, rows = np.zeros((1, size), np.int64), rows.limit(0)
    near = written(rows.mapInArrow(_assign(centroids, scale), f"key {kind}, cluster int, distance bigint"), "assigned")
    per = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    texts = [",".join(map(str, c.tolist())) for c in centroids]
    told = [
        (r["cluster"], r["cluster_inertia"], sum(p["cluster_inertia"] for p in per), centroids[r["cluster"]].tolist(), hashlib.sha256(texts[r["cluster"]].encode()).hexdigest())
        for r in per
    ]
    named = df.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string")
    joined = near.join(F.broadcast(named), "cluster")  # k rows
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
