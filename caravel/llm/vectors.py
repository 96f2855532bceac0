"""Near-duplicate vectors by a forest of projection trees over cells that fit in a task's memory.

Equal vectors are one class. A node of a tree splits by pivots, some of its vectors: a vector goes to the pivot it
projects on furthest and to those whose boundary it is near to (``cells.margins``). Trees are fitted on a sample of
``SAMPLE`` classes at most (expected, chosen by hash) until a cell is expected to hold at most ``leaf`` classes. The
margin is as wide as ``COPIES`` copies of each vector allow and ``spill`` deviations of linked vectors at least.
Vectors travel packed by cell, in as many turns as keep the copies under way within ``AT_ONCE`` per vector; the shuffle
files of a turn go with it. A cell that splitting cannot make smaller, because it holds a dense group, is
compared block against block, so no vector loses a partner. Within a cell vectors are split again and compared in
memory (``cells.Cell``): candidates in single, links in double precision. A pair that shares several cells counts
in the first of them only; cells therefore return a number of links and a label per vector, never pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows without
an id. Vectors of different lengths are never compared. Rows with the same id and vector are one vector,
each with a row in the result; an id with several vectors has the links of all of them. Vectors are equal if two
64-bit hashes are.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm.cells import Cell, apart, held, margins, units_of
from caravel.llm.components import connected_components
from caravel.llm.frames import give_back, pick, tidy, written

TREES, LEAF, SPILL, SEED = 1, 1 << 18, 0.8, 7
SAMPLE, SAMPLED = 1 << 16, 16  # classes of the sample, and how many of them a pivot stands for at least
COPIES, WIDEST = 4.6, 2.0
AT_ONCE, TURN_BYTES = 2.0, 1 << 29  # copies of each vector in a turn, and bytes that need no second turn
BROADCAST = 1 << 18  # classes of several keys that are sent to every task
SAMPLE_BYTES, CELL_BYTES = 1 << 25, 1 << 26  # long vectors make the sample and the cells smaller
FINER, AT_LEAST, SMALL = 6, 32, 1024  # pivots for each leaf-full of classes, pivots where classes are few, classes for each of those
MOST_SHRINK = 0.75  # a node with a child that holds more than this part of it is not split

PACKED = "cell int, low int, high int, size int, keys binary, counts binary, lengths binary, homes binary, flat binary"


def usable(vector: str) -> Column:
    """Finite components, at least one of them other than zero."""
    parts = F.col(vector)
    whole = ~F.array_contains(parts, F.lit(float("nan")))  # null if a component is
    low, high = F.array_min(parts), F.array_max(parts)
    return F.coalesce(whole & (high < float("inf")) & (low > -float("inf")) & ((low != 0) | (high != 0)), F.lit(False))


@dataclass
class Forest:
    """Nodes as (pivots, margins, children); a child or root below 0 is the cell -1 - child. Classes expected in each cell, and its blocks."""

    roots: list[int] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    expected: list[float] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    first: int = 0  # number of the first cell

    def descend(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells, ordered by both; a row for each cell that a vector is held in."""
        rows, cells = [], []
        todo = [(root, np.arange(len(vectors))) for root in self.roots]
        while todo:
            at, members = todo.pop()
            if at < 0:
                rows.append(members)
                cells.append(np.full(len(members), self.first - 1 - at))
                continue
            pivots, within, children = self.nodes[at]
            child, row = np.nonzero(held(vectors[members], pivots, within)[1].T)
            ends = np.searchsorted(child, np.arange(len(children) + 1))
            todo += [(int(c), members[row[a:b]]) for c, a, b in zip(children, ends, ends[1:]) if b > a]
        row, cell = (np.concatenate(x) for x in (rows, cells))
        order = np.lexsort((cell, row))
        return row[order], cell[order]


def fit(sample: np.ndarray, total: float, least: float, trees: int, leaf: int, spill: float, first: int = 0) -> Forest:
    """A forest for ``total`` classes, from unit vectors of some of them."""

    def grow(forest: Forest, rows: np.ndarray, expected: float, spill: float, random: np.random.Generator, top: bool = False) -> int:
        """The node or cell of these rows of the sample."""
        wanted = min(max(math.ceil(FINER * expected / leaf), min(AT_LEAST, int(expected / SMALL))), len(rows) // SAMPLED)
        if wanted > 1 and (top or expected > leaf):
            pivots = apart(sample[random.permutation(rows)[: 2 * wanted]], least, wanted)
            if len(pivots) > 1:
                within = margins(pivots, least, spill)
                there = np.concatenate([held(sample[rows[at : at + 4096]], pivots, within)[1] for at in range(0, len(rows), 4096)])
                if there.sum(axis=0).max() <= MOST_SHRINK * len(rows):
                    each = [rows[there[:, k]] for k in range(len(pivots))]
                    children = [grow(forest, part, expected * len(part) / len(rows), spill, random) for part in each]
                    forest.nodes.append((pivots, within, np.array(children)))
                    return len(forest.nodes) - 1
        forest.expected.append(expected)
        forest.blocks.append(max(1, math.ceil(expected / leaf)))
        return -len(forest.blocks)

    for wider in np.linspace(WIDEST, 1, 11):
        forest = Forest(first=first)
        for tree in range(trees):
            random = np.random.default_rng([SEED, tree, sample.shape[1]])
            forest.roots.append(grow(forest, np.arange(len(sample)), total, spill * wider, random, True))
        if sum(forest.expected) <= COPIES * trees * total:
            break
    return forest


def _lists(column: pa.Array, of: np.ndarray, size: int) -> np.ndarray:
    """Rows of a list column, all of one length."""
    return np.asarray(column.take(pa.array(of)).flatten()).reshape(-1, size)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(blocks)).astype(np.int64)


def _pack(forests: dict[int, Forest], turn: int, turns: int):
    """Rows (key, count, v) packed by cell and pair of blocks, those of one turn."""

    @tidy
    def run(batches):
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for size in np.unique(lengths).tolist():
                of_size = np.flatnonzero(lengths == size)
                keys, counts = (batch.column(i).to_numpy()[of_size] for i in (0, 1))
                flat = _lists(batch.column(2), of_size, size)
                forest = forests[size]
                row, cell = forest.descend(units_of(flat).astype(np.float32))
                held_in = np.bincount(row, minlength=len(keys)).astype(np.int32)
                starts = np.cumsum(held_in) - held_in
                order = np.argsort(cell, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(cell[order])) + 1, len(order))
                out = []
                for start, end in zip(np.append(0, ends[:-1]), ends):
                    members, at = row[order[start:end]], int(cell[order[start]])
                    blocks = forest.blocks[at - forest.first]
                    mine = _block(keys[members], blocks)
                    for low in range(blocks):
                        for high in range(low, blocks):
                            if (at + low + high) % turns != turn:
                                continue
                            some = members[(mine == low) | (mine == high)] if blocks > 1 else members
                            if not len(some):
                                continue
                            n = held_in[some]
                            homes = cell[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                            out.append((at, low, high, size, *(x.tobytes() for x in (keys[some], counts[some], n, homes.astype(np.int32), flat[some]))))
                if not out:
                    continue
                kinds = [pa.int32()] * 4 + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

    return run


def _compare(least: float, kind: type, blocks_of: dict[int, int]):
    """Links among the members of a cell, or of two blocks of a large one."""

    def run(key, packed):
        cell, low, high = (k.as_py() for k in key)
        size = packed["size"][0].as_py()
        keys, count, lengths, homes, flat = (
            np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in packed[name]])
            for name, kind in (("keys", np.int64), ("counts", np.int64), ("lengths", np.int32), ("homes", np.int32), ("flat", kind))
        )
        packed, flat = None, flat.reshape(-1, size)
        padded = np.full((len(keys), lengths.max()), np.iinfo(np.int32).max, np.int32)
        padded[np.arange(padded.shape[1]) < lengths[:, None]] = homes
        again = _again(keys, flat)
        if again.any():
            keys, count, padded, flat = (x[~again] for x in (keys, count, padded, flat))
        block = _block(keys, blocks_of[cell]) if low != high else None
        found = Cell(flat, count, padded, cell, least, block).search()
        linked = found.degree > 0
        table = pa.table({"rep": keys[linked], "root": keys[found.label[linked]], "n": found.degree[linked]})
        found = flat = padded = None
        give_back()
        return table

    return run


def _again(keys: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Members whose key and vector an earlier one has."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if same.any():
        some = np.sort(order[np.append(same, False) | np.append(False, same)])
        whole = np.column_stack([keys[some].view(np.uint8).reshape(len(some), -1), np.ascontiguousarray(flat[some] + 0).view(np.uint8)])
        out[some] = True
        out[some[np.unique(whole, axis=0, return_index=True)[1]]] = False
    return out


@contextmanager
def _tidy_shuffles(spark: SparkSession):
    """Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _forests(good: DataFrame, classes: DataFrame, width: int, least: float, trees: int, leaf: int, spill: float, sample: int) -> tuple[dict[int, Forest], dict[int, int]]:
    """A forest for each length of vectors, and the number of classes of that length."""
    totals = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()}
    part = min(1, sample / max(1, sum(totals.values())), SAMPLE_BYTES / max(1, sum(width * size * n for size, n in totals.items())))
    few = classes.where(F.pmod("mark", F.lit(1 << 30)) < int(part * (1 << 30))).select("mark", "second", F.col("rep").alias("key"))
    chosen = good.join(F.broadcast(few), ["mark", "second", "key"]).dropDuplicates(["mark", "second"]).orderBy("mark", "second")
    vectors = chosen.select("embedding").toArrow().combine_chunks()["embedding"].combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pa.compute.list_value_length(vectors).to_numpy()
    forests, first = {}, 0
    for size, total in totals.items():
        some = _lists(vectors, np.flatnonzero(lengths == size), size)
        forests[size] = fit(units_of(some).astype(np.float32), total, least, trees, max(1, min(leaf, CELL_BYTES // (width * size))), spill, first)
        first += len(forests[size].blocks)
    return forests, totals


def _turns(forests: dict[int, Forest], totals: dict[int, int], width: int) -> int:
    """Turns for vectors with components of some width, keys, counts and cells beside them."""
    once = sum(totals[size] * (width * size + 32) for size in forests)
    moved = sum((width * size + 32) * e * b for size, forest in forests.items() for e, b in zip(forest.expected, forest.blocks))
    return max(1, math.ceil(moved / max(TURN_BYTES, AT_ONCE * once)))


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9,
    trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE,
) -> DataFrame:
    """Key, n_links (other vectors linked directly) and component_id (smallest key that links reach), a row per input row."""
    rows = pick(df, key=key, embedding=vector)
    if dict(rows.dtypes)["embedding"] != "array<float>":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64
    width = np.dtype(kind).itemsize
    rows = rows.withColumn("usable", usable("embedding") & F.col("key").isNotNull())
    mark = [F.xxhash64("embedding").alias("mark"), F.xxhash64(F.lit(SEED), "embedding").alias("second")]
    good = rows.where("usable").select(F.col("key").cast("bigint").alias("key"), "embedding", F.size("embedding").alias("size"), *mark)
    with _tidy_shuffles(df.sparkSession):
        keyed = good.select("mark", "second", "size", "key").distinct()
        classes = written(keyed.groupBy("mark", "second", "size").agg(F.min("key").alias("rep"), F.count("*").alias("count")), "classes")
        shared = written(classes.where("count > 1").drop("size"), "shared")
        shared = F.broadcast(shared) if shared.count() <= BROADCAST else shared
        forests, totals = _forests(good, classes, width, least, trees, leaf, spill, sample)
        blocks_of = {forest.first + i: n for forest in forests.values() for i, n in enumerate(forest.blocks)}
        kept = good.join(shared, ["mark", "second"], "left").where("rep IS NULL OR rep = key")
        kept = kept.select("key", F.coalesce("count", F.lit(1)).alias("count"), "embedding")
        turns = _turns(forests, totals, width)
        links = None
        for turn in range(turns):
            groups = kept.mapInArrow(_pack(forests, turn, turns), PACKED).groupBy("cell", "low", "high")
            compared = groups.applyInArrow(_compare(least, kind, blocks_of), "rep bigint, root bigint, n bigint")
            found = written(compared, "links")
            links = found if links is None else links.unionByName(found)
        degrees = written(links.groupBy("rep").agg(F.sum("n").alias("linked")), "degrees")
        grouped = connected_components(links, "rep", "root").select(F.col("node").alias("rep"), "root")
        named = classes.join(degrees, "rep", "left").join(grouped, "rep", "left").select(
            "mark", "second", (F.coalesce("linked", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
        )
        named = written(named, "named")
    marked = rows.select("key", *[F.when(F.col("usable"), m).alias(name) for m, name in zip(mark, ("mark", "second"))])
    joined = marked.join(named, ["mark", "second"], "left")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", F.col("key").cast("bigint")).alias("component_id"))
