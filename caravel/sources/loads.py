"""Loads from landing files into RAW, with a history that makes a repeated load a no-op."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.lake import Lake, ago
from caravel.sources import formats, versions


def _read_landed(lake: Lake, table: str, path: str) -> DataFrame:
    """The landed file as typed RAW rows; the format follows from the table."""
    spark = lake.spark
    if table in ("orders", "order_items"):
        return formats.typed_csv(formats.read_csv_text(spark, path, table), table)
    if table == "customers":
        return formats.read_parquet(spark, path, table)
    if table == "products":
        return formats.read_json_array(spark, path)
    return formats.read_json_lines(spark, path)


def history(lake: Lake, table: str | None = None, hours: int | None = None, since: datetime | None = None) -> DataFrame:
    """Load history: file, outcome, rows, first error; optionally of one table, the last hours or since a moment.

    A replaced table starts a new history.
    """
    log = lake.log("commits")
    if table is not None:
        log = log.where(F.col("table_name") == table)
    resets = log.where(F.col("action") == versions.RESET)
    resets = resets.groupBy("table_name").agg(F.max("version").alias("reset_version"))
    kept = log.join(resets, "table_name", "left").where(
        (F.col("action") == versions.INSERT) & (F.col("version") > F.coalesce("reset_version", F.lit(0)))
    )
    if hours is not None:
        kept = kept.where(F.col("committed_at") >= ago(hours, "HOURS"))
    if since is not None:
        kept = kept.where(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    return kept.select(
        "table_name", "file_name", "status", "row_count", "row_parsed", "first_error_message", "committed_at"
    )


def already_loaded(lake: Lake, table: str, source_file: str) -> bool:
    seen = history(lake, table).where((F.col("file_name") == source_file) & (F.col("status") == "LOADED"))
    return not seen.isEmpty()


def load(lake: Lake, table: str, source_file: str, force: bool = False) -> int | None:
    """Load one landed file (or folder of part files) into RAW; ``None`` when it is in already."""
    if not force and already_loaded(lake, table, source_file):
        return None
    return versions.append(lake, table, _read_landed(lake, table, lake.landing(source_file)), source_file)
