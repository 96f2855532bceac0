"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

Two fingerprints that differ in at most ``bits`` bits agree in at least ``8 - bits`` of their eight
positional bytes. The inverted index therefore has one posting for each set of that many positions and
the bytes found there: a pair that reaches the guaranteed number of matches meets in a posting, one
that does not never meets. Members of a posting agree in all but ``bits`` bytes, so it holds at most
``256 ** bits`` different fingerprints, however many documents there are. Copies share a fingerprint and
enter the index once.

Words are what stands between ASCII white space, A-Z are lower-cased, shingles keep repeats. Fewer
words than a shingle: the whole sequence is one. No words (null, empty or blank text): fingerprint zero,
linked like any other. Repeated rows are documents of their own; an empty table gives no rows; a
document without an id takes part in links and is reported, but names no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.components import connected_components, roots
from caravel.llm.frames import pick, slices, tidy, written

SEED = 42
TALLY_CHUNK = 1 << 15
PAIRWISE = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set where more than half of the shingles' hashes have it set; as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    last = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)) :] - 1
    tally = np.zeros(64, np.int64)
    for at in range(0, last, TALLY_CHUNK):
        spans = zip(starts[at : min(at + TALLY_CHUNK, last)].tolist(), ends[at : at + TALLY_CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(tally * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Columns key and fingerprint (bigint), one row per input row."""
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = [fingerprint(t, shingle) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["key", "fingerprint"])

    return rows.mapInArrow(run, f"key {kind}, fingerprint bigint")


def byte_masks(bits: int) -> list[int]:
    """For each set of ``8 - bits`` byte positions, the 64-bit mask of these bytes (signed)."""
    sets = combinations(range(8), 8 - bits)
    return [int.from_bytes(bytes(255 * (i in chosen) for i in range(8)), "little", signed=True) for chosen in sets]


def posting_links(members: np.ndarray, mask: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one posting that reach the byte count and then differ in at most ``bits`` bits.

    A small posting tallies its pairs; a large one looks up each fingerprint with every pattern of so few
    bits in the bytes that the posting leaves open, which are all that could be partners.
    """
    members = np.unique(members.astype(np.uint64))
    if len(members) <= PAIRWISE:
        i, j = np.triu_indices(len(members), 1)
        apart = members[i] ^ members[j]
        shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        i, j, apart = (x[shared >= 8 - bits] for x in (i, j, apart))
        near = np.bitwise_count(apart) <= bits
        return members[i[near]], members[j[near]]
    open_bits = [i for i in range(64) if not mask >> i & 1]
    patterns = [sum(1 << i for i in chosen) for n in range(1, bits + 1) for chosen in combinations(open_bits, n)]
    left, right = [], []
    for pattern in patterns:
        other = members ^ np.uint64(pattern)
        there = members[np.minimum(np.searchsorted(members, other), len(members) - 1)] == other
        there &= members < other
        left.append(members[there])
        right.append(other[there])
    return np.concatenate(left), np.concatenate(right)


def links(different: DataFrame, bits: int = 2) -> DataFrame:
    """Links a, b that connect all fingerprints (column fingerprint, each once) within ``bits`` bits.

    From each posting comes a star per connected group of its members, not every pair.
    """
    masks = byte_masks(bits)
    posted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(masks)])
    )
    postings = (
        different.select("fingerprint", posted.alias("p"))
        .groupBy("p.part", "p.shared")
        .agg(F.collect_list("fingerprint").alias("members"))
        .where(F.size("members") > 1)
        .select("part", "members")
    )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = []
            for i, members in zip(part.column(0).to_pylist(), part.column(1)):
                left, right = posting_links(members.values.to_numpy(), masks[i], bits)
                if len(left):
                    nodes, low = roots(left.view(np.int64), right.view(np.int64))
                    found.append((nodes[nodes != low], low[nodes != low]))
            a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return postings.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """Key, fingerprint (bigint) and component_id, the smallest key that links reach, one row per input row."""
    prints = written(fingerprints(df, key, text, shingle), "fingerprints")
    first = written(prints.groupBy("fingerprint").agg(F.min("key").alias("first")), "first")
    grouped = connected_components(links(first.select("fingerprint"), bits))
    joined = first.join(grouped, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(joined.join(named, "root").select("fingerprint", "component_id"), "classes")
    return prints.join(classes, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")
