"""Merging the small files of the logs, so that a look at a log opens a bounded number of them.

Every entry of a log is a file of its own. A merge writes the rows of the oldest files to one folder of the first level; as soon
as a level has ``fan`` folders they become one of the next, so a log of n entries has at most ``fan`` folders on each of
log(n) levels. A pointer, published as a whole, names the folders and the files that are in them: readers follow the newest pointer and
skip these files where they still lie in the log. What a merge replaces is deleted by the merge after it, so a reader that
started before a merge still finds its files. A merge that fails has published nothing and is done again.

Feeds are streams over the files of the ``commits`` log. Its entries are merged once the feed of their table has taken
them in, so a stream never misses one, and a feed that starts again begins after them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caravel import schemas
from caravel.lake import Lake
from caravel.streaming import feeds
from caravel.workspace import names_in, remove_path

FAN = 64


def _may_go(lake: Lake, name: str) -> Column:
    """Entries that no stream still has to see."""
    if name != "commits":
        return F.lit(True)
    waiting = F.lit(False)
    for feed in feeds.FEEDS:
        at = feeds.position(lake, feed)
        waiting = waiting | ((F.col("table_name") == feed) & (F.col("version") > at.consumed))
    return ~waiting | (F.col("status") != "LOADED")


def merge_log(lake: Lake, name: str, fan: int = FAN) -> int:
    """Merge what has gathered in a log, if that is at least ``fan`` files; returns the number of entries merged."""
    if fan < 2:
        raise ValueError("a merge puts two folders together at least")
    spark, old = lake.spark, lake.log_pointer(name)
    lying = [f for f in names_in(spark, lake.log_path(name)) if f.endswith(".parquet")]
    if len(lying) < fan or len(set(lying).difference(old.files)) < fan:
        return 0
    tail = lake.log_tail(name, old)
    ready = tail.groupBy("_file").agg(F.min(_may_go(lake, name)).alias("all"), F.count("*").alias("n")).where("all")
    chosen = ready.orderBy("_file").limit(fan * fan).collect()
    if len(chosen) < fan:
        return 0
    files, number = [r["_file"] for r in chosen], old.number + 1

    def put_together(rows, level: int) -> str:
        folder = f"{number:08d}-{level}"
        rows.coalesce(1).write.mode("overwrite").parquet(lake.merged_log(name, folder))
        return folder

    folders, level = [*old.folders, put_together(tail.where(F.col("_file").isin(files)).drop("_file"), 1)], 1
    while len(alike := [f for f in folders if f.endswith(f"-{level}")]) >= fan:
        rows = spark.read.schema(schemas.ddl(schemas.LOGS[name])).parquet(*[lake.merged_log(name, f) for f in alike])
        level += 1
        folders = [*(f for f in folders if f not in alike), put_together(rows, level)]
    # Files of earlier merges stay named until they are gone, whenever that is.
    told = [("folder", f) for f in folders] + [("file", f) for f in sorted({*files, *(set(old.files) & set(lying))})]
    pointer = spark.createDataFrame(told, "kind string, name string").coalesce(1)
    pointer.write.mode("overwrite").parquet(lake.merged_log(name, "pointers", f"{number:08d}"))
    _clear(lake, name, old, folders)
    return sum(r["n"] for r in chosen)


def _clear(lake: Lake, name: str, old, folders: list[str]) -> None:
    """Delete what the merge before the newest one replaced."""
    for file in old.files:
        remove_path(lake.spark, f"{lake.log_path(name)}/{file}")
    for folder in names_in(lake.spark, lake.merged_log(name)):
        if folder != "pointers" and folder not in {*old.folders, *folders}:
            remove_path(lake.spark, lake.merged_log(name, folder))
    for number in names_in(lake.spark, lake.merged_log(name, "pointers")):
        if int(number) < old.number:
            remove_path(lake.spark, lake.merged_log(name, "pointers", number))


def merge_logs(lake: Lake, fan: int = FAN) -> dict[str, int]:
    """Merge every log that has gathered enough files; tells how many entries went."""
    return {name: merge_log(lake, name, fan) for name in schemas.LOGS}
