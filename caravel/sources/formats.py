"""Named file formats and the readers that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions.text import blank_to_null, strict_cast, tolerant_cast
from caravel.sources import ranges

# The delimited format (header skipped, optional quotes, doubled quote inside quotes).
CSV_FORMAT = {
    "sep": ",",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "enforceSchema": "true",
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# A line that is part of a record with a line break inside quotes; only in a frame that is to be validated.
BROKEN = "_broken_line"


def read_csv_text(
    spark: SparkSession, path: str, table: str, multi_line: bool = False, keep_broken: bool = False
) -> DataFrame:
    """All columns of a delimited file as text, by position, null tokens turned into NULL.

    A short row gets NULL for what it lacks and the extra fields of a long row are dropped.
    Reading text first keeps a value that does not fit its type visible instead of losing it.

    A line break inside quotes leaves lines with an odd number of quotes, the last of them too short. They
    stop the job; ``keep_broken`` shows them in a column of their own instead, and ``multi_line`` reads
    such records whole: byte ranges in parallel, at the price of moving the text once.
    """
    columns = schemas.names(schemas.RAW[table])
    if multi_line:
        text = schemas.ddl(dict.fromkeys(columns, "string"))
        options = {k: v for k, v in CSV_FORMAT.items() if k not in ("header", "enforceSchema")}
        parsed = ranges.csv_records(spark, path).select(F.from_csv("record", text, options).alias("r"))
        return parsed.select(*[blank_to_null(F.col(f"r.{c}")).alias(c) for c in columns], *([F.lit(None).cast("string").alias(BROKEN)] if keep_broken else []))
    # Only a line that is parsed whole can be found broken.
    options = CSV_FORMAT | {"columnNameOfCorruptRecord": BROKEN, "columnPruning": "false"}
    text = spark.read.options(**options).schema(schemas.ddl(dict.fromkeys([*columns, BROKEN], "string"))).csv(path)
    odd = F.length(F.col(BROKEN)) - F.length(F.replace(F.col(BROKEN), F.lit('"'), F.lit("")))
    line = F.when(odd % 2 == 1, F.col(BROKEN))
    fields = [blank_to_null(F.col(c)).alias(c) for c in columns]
    if keep_broken:
        return text.select(*fields, line.alias(BROKEN))
    stop = F.raise_error(F.concat(F.lit("line break inside quotes, read with multi_line: "), line)).cast("string")
    first = F.when(line.isNotNull(), stop).otherwise(blank_to_null(F.col(columns[0]))).alias(columns[0])
    return text.select(first, *fields[1:])


def typed_csv(text: DataFrame, table: str) -> DataFrame:
    """Declared types for :func:`read_csv_text`; the first bad value stops the job."""
    return text.select(*[strict_cast(F.col(c), c, kind).alias(c) for c, kind in schemas.RAW[table].items()])


def _cast_fault(column: str, kind: str) -> Column:
    failed = F.col(column).isNotNull() & tolerant_cast(F.col(column), kind).isNull()
    found = F.struct(
        F.lit(column).alias("column_name"),
        F.col(column).alias("value"),
        F.concat(F.lit("not a "), F.lit(kind)).alias("error"),
    )
    return F.when(failed, found)


def csv_faults(text: DataFrame, table: str) -> DataFrame:
    """Dry run of a delimited load: one row per value that would stop it, nothing is written."""
    kinds = schemas.RAW[table]
    key = next(iter(kinds))
    found = [_cast_fault(c, k) for c, k in kinds.items() if k != "string"]
    if BROKEN in text.columns:
        cut = F.struct(F.lit(None).cast("string").alias("column_name"), F.col(BROKEN).alias("value"), F.lit("line break inside quotes").alias("error"))
        found.append(F.when(F.col(BROKEN).isNotNull(), cut))
    faults = F.filter(F.array(*found), lambda f: f.isNotNull())
    return text.select(F.col(key).alias("row_key"), F.inline(faults))


def read_json_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One document per line, as a VARIANT column ``data``.  Splittable; a broken line fails the job."""
    return spark.read.options(singleVariantColumn="data", mode="FAILFAST", **options).json(path)


def read_json_array(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Files that each hold one JSON array: one row per element, as VARIANT ``data``.

    A file of any size and layout is read by byte ranges in parallel; only one element has to fit a VARIANT and a string.
    A file that is no array stops the job.
    """
    return ranges.json_elements(spark, path, **options)


def read_json_external(spark: SparkSession, folders: str, name_pattern: str = "*.json") -> DataFrame:
    """Every matching file below every matching folder, queried in place; re-listed on each call."""
    return read_json_lines(spark, folders, pathGlobFilter=name_pattern, recursiveFileLookup="true")


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Declared columns of a Parquet file, cast to the declared types."""
    found = spark.read.parquet(path)
    return found.select(*[F.col(c).cast(kind).alias(c) for c, kind in schemas.RAW[table].items()])


def preview(frame: DataFrame, rows: int = 10) -> DataFrame:
    """A look at a few rows before a load; which ones is not defined."""
    return frame.limit(rows)
