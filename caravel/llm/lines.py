"""Line deduplication by pairwise alignment of overlapping documents.

What can be deleted is a block of lines of at least ``least`` characters, so documents are indexed by runs: from
every line on, and up to every line, the shortest block that is long enough (often the line itself). Every
line of a longer common block lies in such a run inside the block. A run that a document holds several times is
counted, and its k-th occurrence meets documents that hold it k times.

Each run's first holder is the smallest id that has it. A document is paired with the first holders of its runs, the
rarest run ordering the partners; a run that a third of all documents share makes one pair per document and
no list of holders is ever built. Only the places of shared runs travel, at most two a line. A pair is aligned by
patience diff (the longest increasing sequence of runs, which by their count stand once on either side); runs off
this sequence are blocks that moved. All of them are deleted from the later document, which is what an
alignment with every earlier document would delete. Blocks are judged on the input, not on what other pairs leave.

Lines end at line feeds and are compared without white space around them, by 128 bits of their hashes; blank lines go only inside a
run. A null or empty text has no lines. Documents without an id stay as they are. Rows that share an
id are never compared with each other; each loses what it shares with smaller ids. Empty tables give
empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caravel.llm.frames import pick, slices, tidy, written

LEAST_CHARS = 25
BLANKS = " \t\r\x0b\x0c"


def runs(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """Start and end of the shortest blocks of ``least`` characters from each line on and up to each line, each block once."""
    total = [0]
    for size in sizes:
        total.append(total[-1] + size)
    found, last = [], 0
    for first, size in enumerate(sizes):
        if size:
            last = max(last, first)
            while last < len(sizes) and total[last] - total[first] < least:
                last += 1
            if total[last] - total[first] < least:
                break
            found.append((first, last))
    first, seen = 0, set(found)
    for last, size in enumerate(sizes, 1):
        if size and total[last] >= least:
            while total[last] - total[first + 1] >= least:
                first += 1
            if (first, last) not in seen:
                found.append((first, last))
    return found


def posted_runs(text: str, least: int) -> Iterator[tuple[bytes, int, int]]:
    """Key (hash of the run and the number of its occurrence), first line and end of every run."""
    lines = [line.strip(BLANKS) for line in text.split("\n")]
    marks, count = [xxhash.xxh3_128_digest(line) for line in lines], {}
    for first, last in sorted(runs([len(line) for line in lines], least)):
        run = marks[first] if last - first == 1 else xxhash.xxh3_128_digest(b"".join(marks[first:last]))
        count[run] = k = count.get(run, 0) + 1
        yield run if k == 1 else xxhash.xxh3_128_digest(run + k.to_bytes(8)), first, last


def postings(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Columns doc, mark (hash of the text), high and low (key of the run), first and last (its lines)."""
    rows = pick(df, doc=key, text=text).where("doc is not null and text is not null")
    rows = rows.select("doc", F.xxhash64("text").alias("mark"), "text")
    kind = rows.schema["doc"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            row, keys, places = [], [], []
            for i, t in enumerate(part.column(2)):
                for code, first, last in posted_runs(t.as_py(), least):
                    row.append(i)
                    keys.append(code)
                    places.append((first, last))
            halves = [pa.array([int.from_bytes(k[at : at + 8], "little", signed=True) for k in keys], pa.int64()) for at in (0, 8)]
            ends = [pa.array([p[i] for p in places], pa.int32()) for i in (0, 1)]
            held = [part.column(i).take(pa.array(row, pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*held, *halves, *ends], names=["doc", "mark", "high", "low", "first", "last"])

    return rows.mapInArrow(run, f"doc {kind}, mark bigint, high bigint, low bigint, first int, last int")


def aligned(shared: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Blocks (first line, end) of the later document that align in order, and those that moved.

    ``shared`` has the first line of a run in the earlier document, and its first line and end in the later one. No run stands
    twice on one side, so patience diff is the longest sequence that increases on both.
    """
    shared = sorted(shared, key=lambda r: (r[1], r[2]))
    ends, tips, back = [], [], []
    for n, (place, first, last) in enumerate(shared):
        at = bisect_left(ends, (place, last - first))
        back.append(tips[at - 1] if at else -1)
        ends[at : at + 1], tips[at : at + 1] = [(place, last - first)], [n]
    chain, n = set(), tips[-1] if tips else -1
    while n >= 0:
        chain.add(n)
        n = back[n]
    parts = ([r for n, r in enumerate(shared) if n in chain], [r for n, r in enumerate(shared) if n not in chain])
    return tuple(blocks([(first, last) for _, first, last in part]) for part in parts)


def blocks(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet or overlap, put together."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """Columns doc, mark, gone (line numbers to delete, from 0), moved (how many of them moved) and partners (rarest shared run first), where there are any."""
    posted = written(postings(df, key, text, least), "postings").distinct()
    kind = dict(posted.dtypes)["doc"]
    holders = posted.groupBy("high", "low").agg(F.min(F.struct("doc", "first")).alias("holder"), F.max("doc").alias("newest"), F.count("*").alias("holders"))
    shared = holders.where("holder.doc < newest").select("high", "low", "holder", "holders")
    met = posted.join(written(shared, "shared"), ["high", "low"]).where("holder.doc < doc")
    told = F.struct(F.col("holder.doc").alias("by"), "holders", F.col("holder.first").alias("place"), "first", "last")
    pairs = met.groupBy("doc", "mark").agg(F.collect_list(told).alias("shared"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, moved, partners = [], [], []
            for row in batch.column(2).to_pylist():
                with_each: dict = {}
                for r in row:
                    with_each.setdefault(r["by"], []).append(r)
                inside, outside = set(), set()
                for runs_of in with_each.values():
                    in_order, out_of_order = aligned([(r["place"], r["first"], r["last"]) for r in runs_of])
                    inside.update(i for a, b in in_order for i in range(a, b))
                    outside.update(i for a, b in out_of_order for i in range(a, b))
                gone.append(sorted(inside | outside))
                moved.append(len(outside - inside))
                partners.append(sorted(with_each, key=lambda p: (min(r["holders"] for r in with_each[p]), p)))
            kinds = pa.list_(pa.int32()), pa.int64(), pa.list_(batch.schema.field(0).type)
            columns = [pa.array(*x) for x in zip((gone, moved, partners), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc", "mark", "gone", "moved", "partners"])

    return pairs.mapInArrow(run, f"doc {kind}, mark bigint, gone array<int>, moved bigint, partners array<{kind}>")


@F.arrow_udf(StringType())
def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The text without the given lines; null lists leave it as it is."""

    def cut(text, lines):
        if not lines or text is None:
            return text
        drop = set(lines)
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)

    parts = slices([pa.record_batch([texts, gone], ["text", "gone"])], 0)
    done = [pa.array([cut(*row) for row in zip(p.column(0).to_pylist(), p.column(1).to_pylist())], pa.string()) for p in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS, into: str = "dedup") -> DataFrame:
    """All rows and columns with a struct column: text (what is left), n_lines, n_removed, n_moved and partners."""
    removals = repeated_lines(df, key, text, least)
    names = df.columns
    apart = df.toDF(*[f"_{i}" for i in range(len(names))])
    row_key, row_text = F.col(f"_{names.index(key)}"), F.col(f"_{names.index(text)}")
    joined = apart.join(removals, (row_key == F.col("doc")) & (F.xxhash64(row_text) == F.col("mark")), "left")
    line_count = F.when(row_text.isNull(), 0).otherwise(F.length(row_text) - F.length(F.replace(row_text, F.lit("\n"), F.lit(""))) + 1)
    told = F.struct(
        without_lines(row_text, "gone").alias("text"), line_count.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("moved", F.lit(0).cast("bigint")).alias("n_moved"),
        F.coalesce("partners", F.array().cast(f"array<{dict(df.dtypes)[key]}>")).alias("partners"),
    )
    return joined.select(*apart.columns, told.alias("_told")).toDF(*names, into)
