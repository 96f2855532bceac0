"""Connected components of an undirected graph given as edges of long node numbers.

Edges are first contracted within each partition, then large-star and small-star steps alternate
until nothing changes. Each step is a minimum per node and a join, both written to the shared
folder: a join of two read tables lets Spark split a node that a third of all edges meet in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.frames import tidy, written

BATCH_EDGES = 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and, for each, the smallest node it reaches by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


@tidy
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a star per component: no more rows, and the same reachability."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        nodes, low = roots(a, b)
        keep = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["u", "v"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= BATCH_EDGES:
            yield star(held)
            held, count = [], 0
    if held:
        yield star(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node that has an edge.

    Repeated edges and loops change nothing, edges with a null end are ignored, no edges give no rows.
    """
    ends = [F.col(a).cast("bigint"), F.col(b).cast("bigint")]
    pairs = edges.select(ends[0].alias("u"), ends[1].alias("v")).where("u <> v")
    now = written(pairs.mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges")
    mark = None
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = written(ways.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "lows")
        large = ways.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = written(large.distinct(), "edges")
        lows = written(now.groupBy("u").agg(F.min("v").alias("low")), "lows")
        small = now.join(lows, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = written(small.unionByName(lows.withColumnRenamed("low", "v")).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = seen
