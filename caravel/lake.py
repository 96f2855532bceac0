"""Folder layout of one lake and its small append-only logs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel import schemas
from caravel.operators import late
from caravel.workspace import names_in, path_exists


def now() -> Column:
    """Zone-less time of the running query, for stamps and logs."""
    return F.current_timestamp().cast("timestamp_ntz")


def ago(n: int, unit: str) -> Column:
    """The time ``n`` seconds or hours before the running query."""
    return (F.current_timestamp() - F.expr(f"INTERVAL {int(n)} {unit}")).cast("timestamp_ntz")


def error_text(error: BaseException) -> str:
    """Class and whole message of an error, whatever its message does."""
    try:
        message = str(error)
    except Exception:
        message = ""
    return f"{type(error).__name__}: {message}" if message else type(error).__name__


@dataclass(frozen=True)
class LogPointer:
    """What readers of a merged log follow: the number of the merge, its folders, and the log's files that are in them."""

    number: int
    folders: list[str]
    files: list[str]


@dataclass(frozen=True)
class Lake:
    """RAW, STAGING and MARTS as Parquet folders below ``root``."""

    spark: SparkSession
    root: str

    def landing(self, name: str = "") -> str:
        return f"{self.root}/landing/{name}".rstrip("/")

    def raw(self, table: str) -> str:
        return f"{self.root}/raw/{table}"

    def removed(self, table: str) -> str:
        return f"{self.root}/raw_removed/{table}"

    def staging(self, table: str) -> str:
        return f"{self.root}/staging/{table}"

    def mart(self, name: str, refresh: int) -> str:
        return f"{self.root}/marts/{name}/_refresh={refresh}"

    def checkpoint(self, feed: str, generation: int) -> str:
        return f"{self.root}/checkpoints/{feed}/generation={generation}"

    def log_path(self, name: str) -> str:
        return f"{self.root}/logs/{name}"

    def clock(self) -> datetime:
        """Current time as a value, on the same clock as the logs."""
        return self.spark.sql("SELECT CAST(current_timestamp() AS TIMESTAMP_NTZ)").first()[0]

    def read_or_empty(self, path: str, ddl: str) -> DataFrame:
        """The Parquet folder, or no rows when nothing has been written to it yet."""
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def merged_log(self, name: str, *more: str) -> str:
        return "/".join([f"{self.root}/logs_merged/{name}", *more])

    def log_pointer(self, name: str) -> LogPointer:
        """The newest published merge of a log; a merge that did not finish is not seen."""
        folder = self.merged_log(name, "pointers")
        for number in reversed(names_in(self.spark, folder)):
            if path_exists(self.spark, f"{folder}/{number}/_SUCCESS"):
                rows = self.spark.read.schema("kind string, name string").parquet(f"{folder}/{number}").collect()
                named = {kind: [r["name"] for r in rows if r["kind"] == kind] for kind in ("folder", "file")}
                return LogPointer(int(number), named["folder"], named["file"])
        return LogPointer(0, [], [])

    def log_tail(self, name: str, pointer: LogPointer) -> DataFrame:
        """Rows of a log that no merge holds yet, with the name of their file."""
        rows = self.spark.read.schema(schemas.ddl(schemas.LOGS[name])).option("ignoreMissingFiles", True).parquet(self.log_path(name))
        told = rows.select("*", F.col("_metadata.file_name").alias("_file"))
        return told.where(~F.col("_file").isin(pointer.files)) if pointer.files else told

    def log(self, name: str) -> DataFrame:
        """A log: one short row per load, run, batch or refresh, from the merges that the pointer names and the files since then."""
        ddl, pointer = schemas.ddl(schemas.LOGS[name]), self.log_pointer(name)
        if not pointer.number:
            return self.read_or_empty(self.log_path(name), ddl)
        merged = self.spark.read.schema(ddl).parquet(*[self.merged_log(name, f) for f in pointer.folders])
        return merged.unionByName(self.log_tail(name, pointer).drop("_file"))

    def append_log(self, name: str, **values: Any) -> None:
        """Add one row to a log; columns not given stay NULL."""
        columns = [F.lit(values.get(column)).cast(kind).alias(column) for column, kind in schemas.LOGS[name].items()]
        one_row = self.spark.range(0, 1, 1, 1).select(*columns)
        one_row.write.mode("append").parquet(self.log_path(name))

    def current_load(self, table: str) -> str | None:
        """Name of the folder that holds a reference table's rows; the log says which, so readers never see half a load."""
        newest = self.log("batches").where(F.col("table_name") == table).agg(F.max("src_batch"))
        return newest.first()[0]

    def finished_batches(self, table: str) -> Column:
        """Condition on the folder column of a fed table: the batch is logged, so its rows are whole.

        Batches of a generation are logged one after the other, so a bound for each generation, one per start of the
        feed, names them all; what a failed or running batch wrote lies beyond it.
        """
        named = self.log("batches").where((F.col("table_name") == table) & F.col("src_batch").isNotNull())
        bounds = named.groupBy("generation").agg(F.min("src_batch"), F.max("src_batch")).collect()
        known = F.lit(False)
        for _, low, high in bounds:
            known = known | F.col("_src_batch").between(low, high)
        return known

    def labels(self) -> DataFrame:
        """Labels of products that came after lines of theirs, with the folder column."""
        rows = self.read_or_empty(self.staging("labels"), schemas.ddl(schemas.LABELS, {"_src_batch": "string"}))
        return rows.where(self.finished_batches("labels"))

    def staged_lines(self) -> DataFrame:
        """STAGING lines of the logged batches as they were written, with the folder columns."""
        folders = schemas.LATE | {"_src_batch": "string"}
        rows = self.read_or_empty(self.staging("order_items"), schemas.ddl(schemas.STAGING["order_items"], folders))
        return rows.where(self.finished_batches("order_items"))

    def completed_lines(self, labels: DataFrame | None = None) -> DataFrame:
        """STAGING lines with batch and the details of products that came later (by default, all that the log names)."""
        rows = self.staged_lines()
        if not self.has_batch("labels"):
            return rows.drop("_late")
        other, late_rows = rows.where("coalesce(_late, 0) = 0").drop("_late"), rows.where("_late = 1").drop("_late")
        return other.unionByName(late.completed(late_rows, self.labels() if labels is None else labels))

    def has_batch(self, table: str) -> bool:
        return not self.log("batches").where((F.col("table_name") == table) & F.col("src_batch").isNotNull()).isEmpty()

    def staged(self, table: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """A STAGING table without its load stamp and folder columns.

        Orders and events lie in month folders: with a first or last day only the months of the period are
        listed and read, and the rows are cut to the period. Only batches that the log names are read.
        Lines that came before their product have its details as soon as these are labels.
        """
        columns, path = schemas.STAGING[table], self.staging(table)
        if table in schemas.REFERENCE:
            name = self.current_load(table)
            path = f"{path}/_load={name}"
            return self.read_or_empty(path, schemas.ddl(columns)).select(*columns)
        if table not in schemas.BY_MONTH:
            return self.completed_lines().select(*columns)
        folder, day = schemas.BY_MONTH[table]
        folders = {"_src_batch": "string", folder: "string"}
        rows = self.read_or_empty(path, schemas.ddl(columns, folders)).where(self.finished_batches(table))
        if first is not None:
            rows = rows.where((F.col(folder) >= f"{first:%Y-%m}") & (F.col(day) >= F.lit(first)))
        if last is not None:
            rows = rows.where((F.col(folder) <= f"{last:%Y-%m}") & (F.col(day) <= F.lit(last)))
        return rows.select(*columns)
