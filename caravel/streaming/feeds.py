"""Change feeds: new RAW rows flow into STAGING exactly once.

A feed is a file stream over the log of commits; its checkpoint is its position.  Each micro-batch reads
the RAW folders that its commits name, so rows of a write that was never committed are not seen, and
no old folder is listed.  Rows go through the same STAGING transform as a batch load and are written to a
folder named after the feed's generation and the batch number, so a batch that is retried after a
failure replaces its own output instead of adding to it.  Every batch logs the version it reached.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions.calendar import month_label
from caravel.lake import Lake, now
from caravel.operators import late
from caravel.plans import staging
from caravel.sources import versions
from caravel.workspace import path_exists, setting

FEEDS = ("orders", "order_items", "web_events")

# STAGING orders and events are laid out by month; this is the folder of rows without a date.
NO_MONTH = "none"


@dataclass(frozen=True)
class FeedRun:
    """What one run of a feed did."""

    feed: str
    generation: int
    through_version: int
    rows_staged: int
    batches: int


@dataclass(frozen=True)
class Position:
    """Where a feed stands: its generation, the RAW version it started after, the last one it took
    in, the newest one, and the newest that added rows."""

    generation: int
    start_version: int
    consumed: int
    newest: int
    newest_rows: int

    @property
    def has_data(self) -> bool:
        """Whether rows were added that the feed has not seen; known from the logs alone."""
        return self.newest_rows > self.consumed


def position(lake: Lake, feed: str) -> Position:
    """Read a feed's position from the logs.  Looking does not move it."""
    started = lake.log("feeds").where(F.col("feed") == feed)
    begin = started.agg(F.max(F.struct("generation", "start_version"))).first()[0]
    number, start = tuple(begin) if begin else (0, 0)
    batches = lake.log("batches").where((F.col("table_name") == feed) & (F.col("generation") == number))
    taken = batches.agg(F.max("through_version")).first()[0]
    adds = F.col("action").isin(versions.INSERT, versions.RESTORE)
    newest = versions.commits(lake, feed).agg(F.max("version"), F.max(F.when(adds, F.col("version")))).first()
    return Position(number, start, start if taken is None else taken, newest[0] or 0, newest[1] or 0)


def restart(lake: Lake, feed: str) -> int:
    """Forget the feed's position and start again from now; what is in RAW already is skipped."""
    at = position(lake, feed)
    lake.append_log(
        "feeds", feed=feed, generation=at.generation + 1, start_version=at.newest, created_at=now()
    )
    return at.generation + 1


def replace_table(lake: Lake, table: str) -> int:
    """Empty a RAW table and start its feed again: what is loaded afterwards is new to the feed."""
    version = versions.replace_table(lake, table)
    if table in FEEDS:
        restart(lake, table)
    return version


def pending(lake: Lake, feed: str, kind: str = versions.INSERT) -> DataFrame:
    """Rows the next run would take in."""
    return versions.changes(lake, feed, kind, after=position(lake, feed).consumed)


def pending_changes(lake: Lake) -> DataFrame:
    """Number of waiting rows per feed and whether there are any."""
    counts = [
        pending(lake, feed).agg(F.count(F.lit(1)).alias("nb_changes")).select(F.lit(feed).alias("feed"), "nb_changes")
        for feed in FEEDS
    ]
    together = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return together.withColumn("has_data", F.col("nb_changes") > 0)


def _new_commits(lake: Lake, feed: str, after: int, max_files: int | None) -> DataFrame:
    """The stream of commits to the feed's RAW table."""
    path = lake.log_path("commits")
    if not path_exists(lake.spark, path):
        lake.spark.createDataFrame([], schemas.ddl(schemas.LOGS["commits"])).write.mode("append").parquet(path)
    reader = lake.spark.readStream.schema(schemas.ddl(schemas.LOGS["commits"]))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    mine = (F.col("table_name") == feed) & (F.col("status") == "LOADED") & (F.col("version") > after)
    return reader.parquet(path).where(mine).select("version", "action")


def write_batch(feed: str, staged: DataFrame, path: str) -> int:
    """Write one batch over whatever an earlier try left, and return its number of rows.

    Orders and events are written by month and sorted by day, so that readers of a few days skip the
    rest; rebalancing sizes the files and splits a heavy month.
    """
    counted = Observation()
    n = F.count(F.lit(1)).alias("n")
    if feed in schemas.BY_MONTH:
        folder, day = schemas.BY_MONTH[feed]
        month = F.coalesce(month_label(F.col(day)), F.lit(NO_MONTH))
        by_month = staged.withColumn(folder, month).hint("rebalance", folder)
        by_month = by_month.sortWithinPartitions(folder, day).observe(counted, n)
        by_month.write.mode("overwrite").partitionBy(folder).parquet(path)
    else:
        # A task keeps the files of both folders open, for which the limit has to lie above two; otherwise it sorts all its lines by folder, and spills.
        by_folder = staged.withColumn("_late", late.is_late()).observe(counted, n)
        with setting(staged.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "3"):
            by_folder.write.mode("overwrite").partitionBy("_late").parquet(path)
    return counted.get["n"]


def label_late_lines(lake: Lake) -> int:
    """Write labels for lines in STAGING whose product has come since; returns how many.

    Nothing is done if neither the catalogue nor the lines have changed since the last look. A look that failed is
    made again under its number, over what it left.
    """
    entries = lake.log("batches").where(F.col("table_name").isin("order_items", "labels", "products"))
    last = {r["table_name"]: r for r in entries.groupBy("table_name").agg(
        F.max("src_batch").alias("batch"), F.max("through_version").alias("version"), F.max("through_batch").alias("through"),
    ).collect()}
    if "products" not in last or "order_items" not in last or last["order_items"]["batch"] is None:
        return 0
    version, through, before = last["products"]["version"], last["order_items"]["batch"], last.get("labels")
    if before and (before["version"], before["through"]) == (version, through):
        return 0
    number = int(before["batch"][1:]) + 1 if before and before["batch"] else 1
    found = late.new_labels(lake.staged_lines().where("_late = 1"), lake.labels(), lake.staged("products"), through)
    counted, name = Observation(), f"t{number:08d}"
    found.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{lake.staging('labels')}/_src_batch={name}")
    n = counted.get["n"]
    lake.append_log(
        "batches", table_name="labels", src_batch=name if n else None, row_count=n, written_at=now(), through_version=version,
        through_batch=through,
    )
    return n


def transform(lake: Lake, feed: str, rows: DataFrame) -> DataFrame:
    if feed == "orders":
        return staging.orders(rows)
    if feed == "order_items":
        # Read here, not when the stream starts: the run refreshes the products first.
        return staging.order_items(rows, lake.staged("products"))
    return staging.web_events(rows)


def batch_name(number: int, epoch: int) -> str:
    """Folder of one micro-batch; sorts in the order the batches happened."""
    return f"g{number:04d}b{epoch:08d}"


def _batch_writer(lake: Lake, feed: str, number: int, done: list[tuple[int, int, bool]]) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch of commits; ``done`` gets the rows staged, the version reached and whether a folder was written."""

    def write(commits: DataFrame, epoch: int) -> None:
        here = Lake(commits.sparkSession, lake.root)
        found = {(r["version"], r["action"]) for r in commits.collect()}  # one short entry per write
        if not found:
            return
        emptied = max((version for version, action in found if action == versions.RESET), default=0)
        chosen = sorted((v, a) for v, a in found if a == versions.INSERT and v > emptied)
        n, name = 0, None
        if chosen:
            name = batch_name(number, epoch)
            rows = versions.rows_of(here, feed, chosen).select(*schemas.RAW[feed])
            n = write_batch(feed, staging.stamped(transform(here, feed, rows)), f"{lake.staging(feed)}/_src_batch={name}")
        reached = max(version for version, _ in found)
        lake.append_log(
            "batches", table_name=feed, src_batch=name, row_count=n, written_at=now(), generation=number, through_version=reached
        )
        done.append((n, reached, name is not None))

    return write


def _start(lake: Lake, feed: str, at: Position, max_files: int | None, done: list[tuple[int, int, bool]], **trigger):
    return (
        _new_commits(lake, feed, at.start_version, max_files)
        .writeStream.foreachBatch(_batch_writer(lake, feed, at.generation, done))
        .option("checkpointLocation", lake.checkpoint(feed, at.generation))
        .trigger(**trigger)
        .start()
    )


def consume(
    lake: Lake, feed: str, run_id: int | None = None, at: Position | None = None, max_files: int | None = None
) -> FeedRun:
    """Take in everything that waits, log the run, and stop.  Without new commits no batch runs."""
    started = lake.clock()
    at = at or position(lake, feed)
    done: list[tuple[int, int, bool]] = []
    _start(lake, feed, at, max_files, done, availableNow=True).awaitTermination()
    staged, reached = sum(n for n, *_ in done), max([at.consumed, *(version for _, version, _ in done)])
    lake.append_log(
        "runs", run_id=run_id, job=feed, state="SUCCEEDED", generation=at.generation, through_version=reached,
        row_count=staged, scheduled_time=started, completed_time=now(),
    )
    return FeedRun(feed, at.generation, reached, staged, sum(wrote for *_, wrote in done))


def follow(lake: Lake, feed: str, every: str = "5 minutes"):
    """Keep taking in new rows on a timer, every batch logged; returns the running query."""
    return _start(lake, feed, position(lake, feed), None, [], processingTime=every)
