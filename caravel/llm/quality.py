"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words fall into ``BUCKETS`` hash buckets; each bucket has a fixed sparse random index vector. A bucket's
word vector is the sum of the index vectors of its neighbours within two words, over all documents of the
corpus. Pooling takes mean and spread of the word vectors of a text, its length, and how much its words
repeat. The network is fitted on a bounded sample of labelled documents (about ``LABELLED`` expected, chosen by a
hash of the id); a fifth of them is held back to fit the temperature of the probabilities.

Empty and null texts pool to zeros and get the score that the network gives those. Documents that are
labelled twice count with the mean of their labels, one half and above as 1; null labels and ids teach
nothing. Without labels the score is 0.5, with labels of one kind it is that label's share, smoothed.
Repeated rows are scored one by one; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.frames import pick, slices, written

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 13, 32, 4, 2
LABELLED, HIDDEN, EPOCHS, BATCH, SEED = 20_000, 32, 60, 256, 11
FEATURES = 2 * DIMENSIONS + 2
KNOWN_WORDS = 200_000
SLICE_BYTES = 1 << 20


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For every bucket the places and signs of its index vector."""
    random = np.random.default_rng(SEED)
    places = np.argsort(random.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, random.choice([-1.0, 1.0], (BUCKETS, NONZERO))


class Words(dict):
    """Bucket of each word; forgets all when it holds many, so that it stays small."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = crc32(word.encode()) % BUCKETS
        return found


def buckets(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of some texts, and the text number of each."""
    lists = [(t or "").split() for t in texts]
    flat = np.fromiter((words[w] for ws in lists for w in ws), np.int64, sum(map(len, lists)))
    return flat, np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vector of every bucket from the neighbours in all texts; the result is BUCKETS x DIMENSIONS."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, words = np.zeros(BUCKETS * DIMENSIONS), Words()
        for part in slices(batches, 0, SLICE_BYTES):
            flat, owner = buckets(part.column(0).to_pylist(), words)
            for reach in range(1, REACH + 1):
                together = np.flatnonzero(owner[reach:] == owner[:-reach])
                left, right = flat[together], flat[together + reach]
                for word, near in ((left, right), (right, left)):
                    cells = (word[:, None] * DIMENSIONS + places[near]).ravel()
                    total += np.bincount(cells, signs[near].ravel(), minlength=BUCKETS * DIMENSIONS)
        table = total.reshape(BUCKETS, DIMENSIONS)
        some = np.flatnonzero(table.any(axis=1))
        names = ["bucket", *(f"c{i}" for i in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, i]) for i in range(DIMENSIONS))], names=names)

    schema = "bucket bigint, " + ", ".join(f"c{i} double" for i in range(DIMENSIONS))
    parts = pick(df, text=text).mapInArrow(gather, schema)
    summed = parts.groupBy("bucket").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(DIMENSIONS)]).toPandas()
    table = np.zeros((BUCKETS, DIMENSIONS))
    table[summed["bucket"]] = summed.drop(columns="bucket").to_numpy()
    table -= table.sum(axis=0) / max(len(summed), 1) * (table.any(axis=1, keepdims=True))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray, words: Words) -> np.ndarray:
    """One row of FEATURES numbers per text; zeros for a text without words."""
    flat, owner = buckets(texts, words)
    out = np.zeros((len(texts), FEATURES))
    if len(flat):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.concatenate([first, [len(flat)]]))
        picked = vectors[flat]
        mean = np.add.reduceat(picked, first, axis=0, dtype=np.float64) / count[:, None]
        square = np.add.reduceat(picked * picked, first, axis=0, dtype=np.float64) / count[:, None]
        different = np.unique(owner * BUCKETS + flat) // BUCKETS
        rows = owner[first]
        out[rows, :DIMENSIONS] = mean
        out[rows, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean**2, 0))
        out[rows, -2] = np.log1p(count) / 10
        out[rows, -1] = np.bincount(different, minlength=len(texts))[rows] / count
    return out


@dataclass
class Network:
    """Scaled inputs, one hidden layer, and a temperature that calibrates the probabilities."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float) -> Network:
    zero = np.zeros
    return Network(zero(FEATURES), np.ones(FEATURES), zero((FEATURES, 1)), zero(1), zero(1), float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Network:
    """Adam on the logistic loss over the rows that do not calibrate, then the temperature of least loss on the others."""
    if not len(y) or y.min() == y.max():
        return constant((y.sum() + 1) / (len(y) + 2))
    use = ~calibrate if calibrate.any() and np.ptp(y[~calibrate]) else np.ones(len(y), bool)
    random = np.random.default_rng(SEED)
    net = Network(
        x[use].mean(axis=0), x[use].std(axis=0) + 1e-3, random.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log((y.mean()) / (1 - y.mean()))),
    )
    z, t = (x[use] - net.center) / net.scale, y[use]
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(t))
        for at in range(0, len(t), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3][0], -30, 30))) - t[rows]) / len(rows)
            inner = np.outer(error, values[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ inner + 1e-4 * values[0], inner.sum(axis=0), hidden.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for v, m, s, g in zip(values, first, second, slopes):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if (~use).any():
        logits, held = net.logits(x[~use]), y[~use]
        loss = {t: np.logaddexp(0, np.where(held > 0, -logits, logits) / t).mean() for t in np.geomspace(0.5, 8, 41)}
        net.temperature = float(min(loss, key=loss.get))
    return net


def features(df: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key and x (array of FEATURES numbers), a row per input row."""
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS, one megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches, 1, SLICE_BYTES):
            x = pool(part.column(1).to_pylist(), shared.value, words).astype(np.float32)
            column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), column], names=["key", "x"])

    return rows.mapInArrow(run, f"key {kind}, x array<float>")


def train(told: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", learn: Column | None = None, labelled: int = LABELLED) -> Network:
    """Fit on about ``labelled`` of the labelled documents of ``told`` (key, x) for which ``learn`` holds."""
    chosen = labels.withColumn("_learn", F.lit(True) if learn is None else learn)
    marks = pick(chosen, key=key, y=label, learn="_learn").where("learn and key is not null and y is not null")
    marks = marks.groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    share = labelled / max(marks.count(), 1)
    marks = marks.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30))
    seen = told.join(marks, "key").select("x", "y", (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)) == 0).alias("held"), "key")
    rows = seen.toPandas().sort_values("key")
    x = np.stack(rows["x"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, FEATURES))
    return fit(x, rows["y"].to_numpy(float), rows["held"].to_numpy(bool))


def score(told: DataFrame, net: Network) -> DataFrame:
    """Columns key and score, the calibrated probability of label 1."""
    kind = told.schema["key"].dataType.simpleString()
    shared = told.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.stack(part["x"].to_list()).astype(np.float64) if len(part) else np.zeros((0, FEATURES))
            yield pd.DataFrame({"key": part["key"], "score": shared.value.probabilities(x)})

    return told.select("key", "x").mapInPandas(run, f"key {kind}, score double")


def score_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, labelled: int = LABELLED
) -> DataFrame:
    """Columns key and score for every document; labels teach where ``learn``, a condition on labels, holds."""
    told = written(features(docs, word_vectors(docs, text), key, text), "features")
    return score(told, train(told, labels, key, label, learn, labelled)).withColumnRenamed("key", key)
