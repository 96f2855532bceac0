"""Small helpers of the corpus operators: picking columns, slicing batches, written intermediate tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.workspace import scratch_folder

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, by position, so that other columns may be called anything."""
    names = df.columns
    apart = df.toDF(*[f"_{i}" for i in range(len(names))])
    return apart.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the frame has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later steps start from the files, whoever is lost."""
    path = scratch_folder(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The frame written with a number for every row, which stays the same however often it is read, and that column's name."""
    name = unused(df, "_row")
    return written(df.withColumn(name, F.monotonically_increasing_id()), label), name


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for a minute after its task and counts towards the executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` after whose last batch freed memory goes back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``most`` bytes of the given column, one row at least."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
        batch = None  # free before the next one comes
        give_back()
