"""WARC archives of pages, a two-level capture index over them, and reading back through it.

Every task writes one archive in the shared folder, each record a gzip member of its own, and returns where
the records stand. Captures are sorted by URL key (host name reversed, then path) into compressed
blocks; a sparse directory holds the first key and the place of each block. A lookup bisects the
directory, reads one range of the block file, bisects the block, and reads one range per record.
A task that runs twice writes two files; only the places that the successful run returned are used.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is a response with the
payload, the others are revisits that name it; smaller payloads are always responses. A null
payload counts as empty, a null URL as an empty one. Repeated ids are records of their own; the largest id
then belongs to several responses. A row without an id is a response and is not referred to. An
empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm.frames import pick, slices, written
from caravel.workspace import scratch_folder

LEAST_REVISIT = 0
BLOCK_LINES = 1000
BLOCKS_PER_TASK = 16
TASK_BYTES = 32 << 20  # compressed records that a reading task gets
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"  # a fixed value: pages carry no capture time
CAPTURES = "urlkey string, page_id bigint, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host labels, then port, path and query; what cannot be split stays as it is."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    labels = ",".join(reversed(host.split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{query}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record as its own gzip member; a revisit has no block and names the page that has it."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(size))]
        payload = b""
    fields.append(("Content-Length", str(len(payload))))
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return gzip.compress(head + b"\r\n\r\n" + payload + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a gzipped record; a broken record raises ValueError."""
    head, found, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not found:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().partition(": ")[::2] for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("WARC record of another length than stated")
    return fields, block


def decisions(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, sha1 and refers_to (the page that holds the payload) of every revisit, from digests alone."""
    marks = written(pages.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("size")).where(F.length("payload") >= least), "digests")
    holders = marks.groupBy("sha1", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null")
    held = written(holders.drop("n"), "holders")
    pairs = marks.join(held, ["sha1", "size"]).where("page_id <> holder")
    return pairs.select("page_id", "sha1", F.col("holder").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write one archive per task below ``folder``; where each record stands, as a written table of captures."""
    revisits = written(decisions(pages, least), "revisits")
    marked = pages.withColumn("sha1", F.sha1("payload"))
    ready = marked.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "refers_to", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for part in slices(batches, 3):
                rows = []
                for page_id, url, refers_to, payload in zip(*(c.to_pylist() for c in part.columns)):
                    member = record(page_id, url, payload, digest(payload), len(payload), refers_to, refers_to is not None)
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((clean(url_key(url)), page_id, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=["urlkey", "page_id", "file", "offset", "length"],
                )
        finally:
            if out:
                out.close()

    return written(ready.mapInArrow(run, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by URL key into compressed blocks; the sparse directory (first_key, file, offset, length, lines)."""
    ordered = captures.repartitionByRange("urlkey", "page_id", "file", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        name, at, out, held = f"{uuid.uuid4().hex}.idx", 0, None, []

        def block(lines):
            nonlocal at, out
            packed = zlib.compress("\n".join(lines).encode())
            out = out or store.open_output_stream(f"{base}/{name}", compression=None)
            out.write(packed)
            row = (lines[0].partition("\t")[0], name, at, len(packed), len(lines))
            at += len(packed)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["first_key", "file", "offset", "length", "lines"])

        try:
            for batch in batches:
                for key, *place in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append("\t".join([key, *("" if x is None else str(x) for x in place)]))
                    if len(held) == block_lines:
                        yield block(held)
                        held = []
            if held:
                yield block(held)
        finally:
            if out:
                out.close()

    return written(ordered.mapInArrow(run, "first_key string, file string, offset bigint, length bigint, lines bigint"), "directory")


def clean(key: str) -> str:
    """A key on one line: white space inside it is written as the URL escape of a space."""
    return "%20".join(key.split()) if key.split() else ""


def block_lines(store, base: str, file: str, offset: int, length: int) -> list[tuple[str, int | None, str, int, int]]:
    """The captures of one index block, in key order, by one range read."""
    with store.open_input_file(f"{base}/{file}") as source:
        source.seek(offset)
        text = zlib.decompress(source.read(length)).decode()
    rows = (line.split("\t") for line in text.split("\n"))
    return [(key, int(page) if page else None, name, int(at), int(size)) for key, page, name, at, size in rows]


def read_records(store, base: str, places: list[tuple]) -> Iterator[tuple[tuple, dict[str, str], bytes]]:
    """Range reads of records, file by file in order of their place."""
    opened, source = None, None
    try:
        for place in sorted(places, key=lambda p: (p[2], p[3])):
            if place[2] != opened:
                if source:
                    source.close()
                opened, source = place[2], store.open_input_file(f"{base}/{place[2]}")
            source.seek(place[3])
            yield place, *parse(source.read(place[4]))
    finally:
        if source:
            source.close()


RECORDS = "page_id bigint, urlkey string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _record_rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = list(zip(*found)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])


def _row(place: tuple, fields: dict[str, str], block: bytes) -> tuple:
    revisit = fields["WARC-Type"] == "revisit"
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest(block) != sha1:
        raise ValueError(f"payload of page {fields['X-Page-ID']} does not match its digest")
    size = int(fields["X-Payload-Length"]) if revisit else len(block)
    page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
    refers_to = int(fields["X-Refers-To-Page"]) if revisit else None
    return (page, place[0], None if revisit else block, size, sha1, fields["WARC-Type"], refers_to)


def read_archives(directory: DataFrame, folder: str, read_bytes: int = 4 << 20) -> DataFrame:
    """All records, block by block of the index; payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                found, held = [], 0
                for one in read_records(store, base, block_lines(store, base, file, offset, length)):
                    found.append(_row(*one))
                    held += len(one[2])
                    if held > read_bytes:
                        yield _record_rows(found)
                        found, held = [], 0
                yield _record_rows(found)

    # A directory row is a few bytes that stand for a thousand records: a stated number of partitions is not merged by size.
    blocks = directory.select("file", "offset", "length")
    tasks = max(directory.sparkSession.sparkContext.defaultParallelism, directory.count() // BLOCKS_PER_TASK)
    return blocks.repartition(tasks, "file", "offset").mapInArrow(run, RECORDS)


def find_captures(directory: DataFrame, folder: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """Captures of the given URLs: bisect to the index files, in a file's directory to the blocks, in a block to the lines.

    Only the first key of each index file goes to every task, one per partition of the index. Blocks in which no key
    can lie are not read. Repeated URLs are looked up once, null URLs as the empty one.
    """

    @F.pandas_udf("string")
    def key_of(some: pd.Series) -> pd.Series:
        return some.map(lambda u: clean(url_key(u)))

    keys = pick(urls, url=url).select(F.coalesce("url", F.lit("")).alias("url")).distinct().select(key_of("url").alias("key")).distinct()
    firsts = directory.groupBy("file").agg(F.min("first_key").alias("first_key")).collect()
    files = sorted((r["first_key"], r["file"]) for r in firsts)
    starts = [first for first, _ in files]

    @F.pandas_udf("array<string>")
    def may_hold(some: pd.Series) -> pd.Series:
        return some.map(lambda k: [name for _, name in files[_span(starts, k)]])

    def run(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        store, base = pafs.FileSystem.from_uri(folder)
        blocks = blocks.sort_values(["first_key", "offset"], kind="stable")
        heads, by_block = blocks["first_key"].tolist(), {}
        for key in wanted["key"]:
            span = _span(heads, key)
            for i in range(span.start, span.stop):
                by_block.setdefault(i, []).append(key)
        found = []
        for i, some in sorted(by_block.items()):
            lines = block_lines(store, base, *blocks.iloc[i][["file", "offset", "length"]])
            names = [line[0] for line in lines]
            found += [lines[j] for key in some for j in range(bisect.bisect_left(names, key), bisect.bisect_right(names, key))]
        columns = list(zip(*found)) or [()] * 5
        kinds = ("object", "Int64", "object", "int64", "int64")
        return pd.DataFrame({f.split()[0]: pd.Series(c, dtype=k) for f, c, k in zip(CAPTURES.split(", "), columns, kinds)})

    routed = keys.select("key", F.explode(may_hold("key")).alias("file"))
    return routed.groupBy("file").cogroup(directory.groupBy("file")).applyInPandas(run, CAPTURES)


def _span(starts: list[str], key: str) -> slice:
    """Which of the parts with these first keys, in order, can hold a key: those that start with it and the one before."""
    return slice(max(bisect.bisect_left(starts, key) - 1, 0), bisect.bisect_right(starts, key))


def read_captures(captures: DataFrame, folder: str, read_bytes: int = 4 << 20) -> DataFrame:
    """The records of captures, by range reads in order of their place; about ``TASK_BYTES`` of an archive per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            found, held = [], 0
            for one in read_records(store, base, list(zip(*(c.to_pylist() for c in batch.columns)))):
                found.append(_row(*one))
                held += len(one[2])
                if held > read_bytes:
                    yield _record_rows(found)
                    found, held = [], 0
            yield _record_rows(found)

    placed = written(captures, "places")
    total = placed.agg(F.sum("length")).first()[0] or 0
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
    ordered = placed.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORDS)


def lookup(directory: DataFrame, folder: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """Records of the given URLs, found by bisection and read by ranges."""
    return read_captures(find_captures(directory, folder, urls, url), folder)


def pages_of(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    rows = pick(df, page_id=key, url=url, html=html)
    return rows.select(F.col("page_id").cast("bigint"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))


def archive(spark: SparkSession, df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> tuple[str, DataFrame]:
    """Write archives and index; the folder they are in, and the index directory."""
    folder = scratch_folder(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    captures = write_archives(pages_of(df, key, url, html), folder, least)
    return folder, write_index(captures, folder)
