"""The quality report kept up from what each delivery adds, without reading earlier deliveries again.

Counts of defects and rows are added up. Repeated ids follow from the set of ids seen: a refresh writes only ids that are new, and what
is not new is a repetition. Lines without an order are kept as (order id, lines) until the order comes: new orders take theirs out,
new lines without a known order come in. Rows that were deleted, restored or replaced since the last refresh change what was counted before, so
the state is then built anew from the tables as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.lake import Lake, now
from caravel.operators.joins import split_join
from caravel.plans import quality
from caravel.plans.refresh import FULL, INCREMENTAL, NO_DATA
from caravel.sources import versions

QUALITY = "quality_state"  # its name in the log of refreshes
TABLES = ("orders", "order_items", "products", "web_events")
KEYED = {"orders": "order_id", "products": "product_id"}
ORPHANS = "items_without_order"


def _part(lake: Lake, part: str, number: int) -> str:
    return f"{lake.root}/quality/{part}/_refresh={number}"


def _keep(lake: Lake, part: str, number: int, rows: DataFrame) -> DataFrame:
    rows.write.mode("overwrite").parquet(_part(lake, part, number))
    return lake.spark.read.schema(rows.schema).parquet(_part(lake, part, number))


def _keys(lake: Lake, table: str, first: int, last: int) -> DataFrame:
    """Ids of a table that the refreshes from one to another have added, each once."""
    rows = lake.read_or_empty(f"{lake.root}/quality/keys_{table}", "key string, _refresh int")
    return rows.where(F.col("_refresh").between(first, last)).select("key")


def _last(lake: Lake) -> tuple[int, int, dict[str, int]]:
    """Number of the current state, of the full one it goes back to, and the versions it covers."""
    done = lake.log("refreshes").where((F.col("mart") == QUALITY) & (F.col("state") == "SUCCEEDED"))
    full = F.max(F.when(F.col("action") == FULL, F.col("refresh")))
    number, first, position = done.agg(F.max("refresh"), full, F.max_by("through_batch", "refresh")).first()
    return number or 0, first or 0, {t: int(v) for t, v in (p.split("=") for p in (position or "").split(";") if p)}


def _since(lake: Lake, seen: dict[str, int]) -> tuple[dict[str, int], bool]:
    """Newest version of each table, and whether all writes since a position only added rows."""
    done = lake.log("commits").where(F.col("table_name").isin(*TABLES) & (F.col("status") == "LOADED"))
    before = reduce(lambda c, t: F.when(F.col("table_name") == t, F.lit(seen.get(t, 0))).otherwise(c), TABLES, F.lit(0))
    changed = F.max((F.col("version") > before) & (F.col("action") != versions.INSERT))
    found = done.groupBy("table_name").agg(F.max("version").alias("version"), changed.alias("changed")).collect()
    return {r["table_name"]: r["version"] for r in found}, not any(r["changed"] for r in found)


def _long(table: str, counts: DataFrame) -> DataFrame:
    """One row per count of a one-row aggregate."""
    named = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in counts.columns]
    return counts.select(F.inline(F.array(*named)))


def _new_keys(lake: Lake, table: str, rows: DataFrame, first: int, number: int) -> DataFrame:
    key = F.col(KEYED[table]).alias("key")
    fresh = rows.select(key).where("key IS NOT NULL").distinct()
    if first < number:
        fresh = split_join(fresh, _keys(lake, table, first, number - 1), "key", "left_anti")
    return _keep(lake, f"keys_{table}", number, fresh)


def _orphans(lake: Lake, items: DataFrame, came: DataFrame, first: int, number: int) -> DataFrame:
    """Lines by order id that no order has come for."""
    fresh = items.where("order_id IS NOT NULL").groupBy(F.col("order_id").alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    waiting = split_join(fresh, _keys(lake, "orders", first, number), "key", "left_anti")
    if first < number:
        before = lake.spark.read.schema("key string, lines bigint").parquet(_part(lake, "orphans", number - 1))
        still = split_join(before, came, "key", "left_anti")
        waiting = waiting.unionByName(still).groupBy("key").agg(F.sum("lines").alias("lines"))
    return _keep(lake, "orphans", number, waiting)


def refresh(lake: Lake) -> str:
    """Take in what was written since the last refresh; tells whether in full, in part, or not at all.

    A refresh that fails is not logged, so the state before it stays, and the next one writes over what it left.
    """
    started = lake.clock()
    number, first, seen = _last(lake)
    newest, added_only = _since(lake, seen)
    if number and newest == seen:
        return NO_DATA
    whole = not number or not added_only
    number += 1
    first = number if whole else first
    # Only writes up to the versions that are logged as covered are read.
    raw = {
        t: versions.as_of(lake, t, newest.get(t, 0)) if whole
        else versions.rows_of(lake, t, versions.writes(lake, t, after=seen.get(t, 0), through=newest.get(t, 0)))
        for t in TABLES
    }
    rows = {t: quality.keyed(t, raw[t]) for t in TABLES}
    parts = [_long(t, rows[t].agg(*quality.row_counts(t))) for t in TABLES]
    came = {t: _new_keys(lake, t, rows[t], first, number) for t in KEYED}
    for table, key in KEYED.items():
        known = _long(table, rows[table].agg(F.count(key).alias(f"{table}_repeated_id")))
        new = _long(table, came[table].agg((-F.count(F.lit(1))).alias(f"{table}_repeated_id")))
        parts += [known, new]
    without_id = F.count_if(F.col("order_id").isNull()).alias("_without_order_id")
    parts.append(_long("order_items", rows["order_items"].agg(without_id)))
    left = _orphans(lake, rows["order_items"], came["orders"], first, number)
    if first < number:
        parts.append(lake.spark.read.schema(parts[0].schema).parquet(_part(lake, "counts", number - 1)).where(F.col("name") != ORPHANS))
    parts.append(_long("order_items", left.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias(ORPHANS))))
    merged = reduce(DataFrame.unionByName, parts).groupBy("table_name", "name").agg(F.sum("n").alias("n"))
    _keep(lake, "counts", number, merged)
    action = FULL if whole else INCREMENTAL
    lake.append_log(
        "refreshes", mart=QUALITY, refresh=number, action=action, state="SUCCEEDED", data_timestamp=started, start_time=started, end_time=now(),
        through_batch=";".join(f"{t}={v}" for t, v in sorted(newest.items())),
    )
    return action


def report(lake: Lake, shares: dict[str, str] | None = None) -> DataFrame:
    """The quality report as of the last refresh; the state has a few rows, so this costs nothing."""
    number = _last(lake)[0]
    if number == 0:
        raise ValueError(f"{QUALITY} has not been refreshed yet")
    counts = lake.spark.read.schema("table_name string, name string, n bigint").parquet(_part(lake, "counts", number))

    def count(name: str):
        return F.sum(F.when(F.col("name") == name, F.col("n")))

    parts = []
    for table, names in quality.CHECKS.items():
        found = [count(n) + (count("_without_order_id") if n == ORPHANS else F.lit(0)) for n in names]
        one = counts.where(F.col("table_name") == table).agg(*[c.alias(n) for c, n in zip(found, names)], count("_rows").alias("_all"))
        # As in the report on rows, the share of lines without an order is one of those lines.
        allowed = [n for n in names if n != ORPHANS]
        parts.append(quality.as_rows(one.select(*allowed, F.col("_all").alias("_rows")), shares or {}))
        if ORPHANS in names:
            parts.append(quality.as_rows(one.select(ORPHANS, F.col(ORPHANS).alias("_rows")), shares or {}))
    return reduce(DataFrame.unionByName, parts)
