"""The landing area: what has arrived, and writers for the file shapes it receives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.lake import Lake
from caravel.sources.formats import CSV_FORMAT


def list_files(lake: Lake, prefix: str = "") -> DataFrame:
    """Files below a prefix: path inside the landing area, size, time.  Contents are not read."""
    found = lake.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(lake.landing(prefix))
    inside = F.substring_index("path", "/landing/", -1)
    return found.select(inside.alias("path"), F.col("length").alias("bytes"), "modificationTime")


def put_csv(lake: Lake, rows: DataFrame, name: str, null_token: str = "NULL") -> str:
    """Delimited text with a header; every value written as it prints, NULL as a token."""
    options = {k: v for k, v in CSV_FORMAT.items() if k not in ("enforceSchema", "mode")}
    as_text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    as_text.write.mode("overwrite").options(**options, nullValue=null_token).csv(lake.landing(name))
    return name


def put_parquet(lake: Lake, rows: DataFrame, name: str) -> str:
    rows.write.mode("overwrite").option("compression", "snappy").parquet(lake.landing(name))
    return name


def put_json_lines(lake: Lake, documents: DataFrame, name: str) -> str:
    """One document per line; a NULL column is left out, a variant null is written as ``null``."""
    documents.write.mode("overwrite").json(lake.landing(name))
    return name


def put_json_arrays(lake: Lake, documents: DataFrame, name: str, per_file: int = 5000) -> str:
    """JSON text of column ``value`` as array files of at most ``per_file`` documents each.

    Rows are numbered consecutively within each task, so a chunk never holds more than that,
    whatever the documents look like.
    """
    chunk = F.floor(F.monotonically_increasing_id() / per_file).alias("part")
    body = F.concat_ws(",\n", F.collect_list("value"))
    arrays = documents.select("value", chunk).groupBy("part")
    whole = arrays.agg(F.concat(F.lit("["), body, F.lit("]")).alias("value"))
    whole.write.mode("overwrite").partitionBy("part").text(lake.landing(name))
    return name
