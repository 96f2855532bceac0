"""RAW tables as an append-only record of writes, and what they looked like at any write.

Each write goes to its own ``_version=N/_change=K`` folder and is listed in the ``commits`` log;
a delete writes the removed keys instead of touching rows.  A table at version ``v`` is then its
rows up to ``v`` anti-joined with the keys removed after the row came and up to ``v``: an equi
join with a residual, never a scan of old copies.  One writer per table; a write that failed
before it was logged is not read, and is overwritten by the next write, because that gets the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from caravel import schemas
from caravel.lake import Lake, ago, error_text, now
from caravel.operators.joins import split_join

INSERT, RESTORE, DELETE, RESET = "insert", "restore", "delete", "reset"

# Business key that deletes are expressed in.
KEYS = {"orders": "order_id", "order_items": "order_id", "customers": "customer_id"}


def commits(lake: Lake, table: str) -> DataFrame:
    done = (F.col("table_name") == table) & (F.col("status") == "LOADED")
    return lake.log("commits").where(done)


def current_version(lake: Lake, table: str) -> int:
    """Number of the last committed write, 0 before the first."""
    return commits(lake, table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def version_at(lake: Lake, table: str, moment) -> int:
    """Last write committed at or before ``moment`` (a zone-less timestamp column)."""
    past = commits(lake, table).where(F.col("committed_at") <= moment)
    return past.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def seconds_ago(lake: Lake, table: str, seconds: int) -> int:
    """Version that was current a number of seconds ago."""
    return version_at(lake, table, ago(seconds, "SECONDS"))


def _with_audit(rows: DataFrame, source_file: str) -> DataFrame:
    """Load stamp and source file, unless the rows bring their own (a restore does)."""
    if "_loaded_at" in rows.columns:
        return rows
    return rows.withColumn("_loaded_at", now()).withColumn("_source_file", F.lit(source_file))


def append(lake: Lake, table: str, rows: DataFrame, source_file: str, change: str = INSERT) -> int:
    """Add rows as one write and return its version.  A failed load is logged, then raised."""
    version = current_version(lake, table) + 1
    counted = Observation()
    stamped = _with_audit(rows, source_file).observe(counted, F.count(F.lit(1)).alias("n"))
    entry = {"table_name": table, "version": version, "action": change, "file_name": source_file}
    try:
        stamped.write.mode("overwrite").parquet(f"{lake.raw(table)}/_version={version}/_change={change}")
    except Exception as error:
        lake.append_log(
            "commits", **entry, status="LOAD_FAILED", committed_at=now(), row_count=0, first_error_message=error_text(error)
        )
        raise
    n = counted.get["n"]
    lake.append_log("commits", **entry, status="LOADED", committed_at=now(), row_count=n, row_parsed=n)
    return version


def remove(lake: Lake, table: str, keys: DataFrame) -> int:
    """Delete every row whose key is in the one-column frame ``keys``; returns the version."""
    version = current_version(lake, table) + 1
    key = KEYS[table]
    gone = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    gone.write.mode("overwrite").parquet(f"{lake.removed(table)}/_version={version}")
    lake.append_log(
        "commits", table_name=table, version=version, action=DELETE, status="LOADED", committed_at=now()
    )
    return version


def replace_table(lake: Lake, table: str) -> int:
    """Empty the table and forget its load history, so that its files can be loaded again.

    ``streaming.feeds.replace_table`` does this and starts the table's feed again.
    """
    version = current_version(lake, table) + 1
    nothing = lake.spark.createDataFrame([], schemas.ddl(schemas.RAW[table], schemas.AUDIT, schemas.VERSIONED))
    nothing.write.mode("overwrite").partitionBy(*schemas.VERSIONED).parquet(lake.raw(table))
    lake.append_log(
        "commits", table_name=table, version=version, action=RESET, status="LOADED", committed_at=now()
    )
    return version


def writes(lake: Lake, table: str, kinds: tuple[str, ...] = (INSERT, RESTORE), after: int = 0, through: int | None = None) -> list[tuple[int, str]]:
    """Version and kind of the committed writes that added rows, since the table was last replaced.

    One short entry per write.  A folder that no entry names is what a failed write left, and is not read.
    """
    found = commits(lake, table).select("version", "action").distinct().collect()
    start = max([after, *(r["version"] for r in found if r["action"] == RESET)])
    return sorted(
        (r["version"], r["action"])
        for r in found
        if r["action"] in kinds and r["version"] > start and (through is None or r["version"] <= through)
    )


def rows_of(lake: Lake, table: str, chosen: list[tuple[int, str]]) -> DataFrame:
    """Rows of the given writes with version and kind of change; only their folders are listed."""
    columns = schemas.ddl(schemas.RAW[table], schemas.AUDIT, schemas.VERSIONED)
    if not chosen:
        return lake.spark.createDataFrame([], columns)
    paths = [f"{lake.raw(table)}/_version={version}/_change={kind}" for version, kind in chosen]
    return lake.spark.read.schema(columns).option("basePath", lake.raw(table)).parquet(*paths)


def recorded(lake: Lake, table: str, through: int | None = None) -> DataFrame:
    """Every committed row (up to a version), with its version and kind of change."""
    return rows_of(lake, table, writes(lake, table, through=through))


def changes(lake: Lake, table: str, kind: str = INSERT, after: int = 0) -> DataFrame:
    """Committed rows of one kind of change."""
    return rows_of(lake, table, writes(lake, table, (kind,), after))


def removals(lake: Lake, table: str) -> DataFrame:
    key = KEYS[table]
    found = lake.read_or_empty(lake.removed(table), f"{key} string, _version int")
    return found.select(F.col(key).alias("_gone_key"), F.col("_version").alias("_gone_version"))


def _surviving(rows: DataFrame, gone: DataFrame, key: str, version: int) -> DataFrame:
    met = (F.col(key) == F.col("_gone_key")) & (F.col("_version") < F.col("_gone_version"))
    return rows.join(gone.where(F.col("_gone_version") <= version), met, "left_anti")


def as_of(lake: Lake, table: str, version: int | None = None, audit: bool = False) -> DataFrame:
    """The table as it was right after ``version`` (default: now)."""
    version = current_version(lake, table) if version is None else version
    rows = recorded(lake, table, version)
    if table in KEYS:
        rows = _surviving(rows, removals(lake, table), KEYS[table], version)
    columns = schemas.names(schemas.RAW[table]) + (schemas.names(schemas.AUDIT) if audit else [])
    return rows.select(*columns)


def before(lake: Lake, table: str, version: int, audit: bool = False) -> DataFrame:
    """The table as it was just before the write ``version``."""
    return as_of(lake, table, version - 1, audit)


def lost_rows(lake: Lake, table: str, past: int, bag: bool = False, audit: bool = True) -> DataFrame:
    """Rows of version ``past`` that the table no longer has.

    Set difference over whole rows: copies count once, NULLs are equal, and a row with an
    identical survivor is not lost.  ``bag=True`` keeps the number of copies instead.  Only a key
    removed since ``past`` can be lost, so both sides are cut to those keys before they shuffle.
    """
    now = current_version(lake, table)
    key = KEYS[table]
    touched = removals(lake, table).where((F.col("_gone_version") > past) & (F.col("_gone_version") <= now))
    touched = touched.select(F.col("_gone_key").alias(key)).distinct()
    then_rows = split_join(as_of(lake, table, past, audit), touched, key, "left_semi")
    now_rows = split_join(as_of(lake, table, now, audit), touched, key, "left_semi")
    return then_rows.exceptAll(now_rows) if bag else then_rows.subtract(now_rows)


def restore(lake: Lake, table: str, past: int, bag: bool = False) -> int:
    """Put the lost rows back as a write of its own; they keep their first load stamp and file."""
    return append(lake, table, lost_rows(lake, table, past, bag), f"restore of version {past}", RESTORE)


def snapshot(lake: Lake, table: str, path: str, version: int | None = None) -> DataFrame:
    """An independent copy of the table at a version."""
    as_of(lake, table, version, audit=True).write.mode("overwrite").parquet(path)
    columns = schemas.ddl(schemas.RAW[table], schemas.AUDIT)
    return lake.spark.read.schema(columns).parquet(path)
