"""Writing the marts from STAGING, in full or only where new rows arrived."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel import schemas
from caravel.lake import Lake, now
from caravel.operators import late
from caravel.plans import marts, states, uniques

DAILY, TOP, COHORTS = "daily_revenue", "top_products", "customer_cohorts"
MARTS = (DAILY, TOP, COHORTS)
UNIQUES = "unique_customers"  # kept up where it is asked for, not by refresh_all

# STAGING tables each mart is computed from.
INPUTS = {DAILY: ("orders",), TOP: ("labels", "order_items", "orders"), COHORTS: ("customers", "orders"), UNIQUES: ("orders",)}

FULL, INCREMENTAL, NO_DATA = "FULL", "INCREMENTAL", "NO_DATA"

MONTH = "order_month"


def _staged_orders(lake: Lake) -> DataFrame:
    """STAGING orders with the folder columns: month and source batch."""
    columns = schemas.ddl(schemas.STAGING["orders"], {MONTH: "string", "_src_batch": "string"})
    return lake.read_or_empty(lake.staging("orders"), columns).where(lake.finished_batches("orders"))


def _batches(position: str) -> dict[str, str]:
    """Newest batch of each table that a position names."""
    return dict(part.split("=") for part in position.split(";") if part)


def _between(rows: DataFrame, table: str, seen: dict[str, str], now: dict[str, str]) -> DataFrame:
    """Rows of the batches after one position and up to another."""
    return rows.where((F.col("_src_batch") > seen.get(table, "")) & (F.col("_src_batch") <= now.get(table, "")))


def _state(lake: Lake, mart: str, number: int, part: str = "state") -> str:
    return lake.mart(f"{mart}_{part}", number)


def _keep(lake: Lake, mart: str, number: int, rows: DataFrame, part: str = "state") -> DataFrame:
    """Write a state beside the mart of the same number, and read it."""
    rows.write.mode("overwrite").parquet(_state(lake, mart, number, part))
    return lake.spark.read.schema(rows.schema).parquet(_state(lake, mart, number, part))


def _top_products(lake: Lake, number: int, seen: dict[str, str] | None, now: dict[str, str]) -> DataFrame:
    """Top products from the sales by day; with a position seen, from the state before and the rows since."""
    nothing: dict[str, str] = {}
    orders = _between(_staged_orders(lake), "orders", nothing, now)
    items = _between(lake.completed_lines(_between(lake.labels(), "labels", nothing, now)), "order_items", nothing, now)
    fresh = orders if seen is None else _between(orders, "orders", seen, now)
    latest = fresh.agg(F.max("order_date").alias("day"))
    if seen is not None:
        latest = latest.unionByName(lake.spark.read.parquet(_state(lake, TOP, number - 1, "newest"))).agg(F.max("day").alias("day"))
    newest = _keep(lake, TOP, number, latest, "newest").first()["day"]
    first = None if newest is None else newest - timedelta(days=states.DAYS)
    # The month bounds what is listed; without any dated order there is no window and nothing in it.
    recent = orders.where(F.lit(False)) if first is None else orders.where((F.col(MONTH) >= f"{first:%Y-%m}") & (F.col("order_date") >= F.lit(first)))
    if seen is None or first is None:
        sales = states.day_sales(items, recent)
    else:
        before = lake.spark.read.parquet(_state(lake, TOP, number - 1))
        if seen.get("labels") != now.get("labels"):
            # Of a product that came several times, the first label holds for what the state has in.
            came = _between(lake.labels(), "labels", seen, now).where(F.col("_after") < seen.get("order_items", ""))
            before = late.relabelled(before, came)
        old = recent.where(F.col("_src_batch") <= seen.get("orders", ""))
        sales = states.updated_sales(
            before, first, _between(recent, "orders", seen, now), items, old, _between(items, "order_items", seen, now)
        )
    return states.top_products(_keep(lake, TOP, number, sales))


def _cohorts(lake: Lake, number: int, seen: dict[str, str] | None, now: dict[str, str]) -> DataFrame:
    """Cohorts from the months of every customer; orders before the position seen are not read."""
    active = states.active_months(_between(_staged_orders(lake), "orders", seen or {}, now))
    if seen is not None:
        active = states.merged_months(lake.spark.read.parquet(_state(lake, COHORTS, number - 1)), active)
    return states.customer_cohorts(lake.staged("customers"), _keep(lake, COHORTS, number, active))


def _parts(lake: Lake, part: str, ddl: str, first: int, last: int) -> DataFrame:
    """What the refreshes from one to another have added to the numbers or states of unique customers."""
    rows = lake.read_or_empty(f"{lake.root}/marts/{UNIQUES}_{part}", f"{ddl}, _refresh int")
    return rows.where(F.col("_refresh").between(first, last)).drop("_refresh")


def _first_part(lake: Lake) -> int:
    """The last full refresh: numbers and states begin with it."""
    full = (F.col("mart") == UNIQUES) & (F.col("action") == FULL) & (F.col("state") == "SUCCEEDED")
    return lake.log("refreshes").where(full).agg(F.max("refresh")).first()[0] or 0


def _uniques(lake: Lake, number: int, seen: dict[str, str] | None, now: dict[str, str]) -> DataFrame:
    """Unique customers by day. A delivery adds the numbers of new customers and states of its own; only its days are counted again."""
    first = number if seen is None else _first_part(lake)
    fresh = _between(_staged_orders(lake), "orders", seen or {}, now)
    _keep(lake, UNIQUES, number, uniques.new_numbers(_parts(lake, "ids", uniques.IDS, first, number - 1), fresh), "ids")
    added = _keep(lake, UNIQUES, number, uniques.day_states(fresh, _parts(lake, "ids", uniques.IDS, first, number)))
    if seen is None:
        return uniques.unique(added, "order_date")
    days = added.select("order_date").distinct()
    touched = _parts(lake, "state", uniques.STATE, first, number).join(days, "order_date", "left_semi")
    kept = lake.spark.read.parquet(lake.mart(UNIQUES, number - 1)).join(days, "order_date", "left_anti")
    return kept.unionByName(uniques.unique(touched, "order_date"))


def customer_states(lake: Lake, first: date | None = None, last: date | None = None) -> DataFrame:
    """States by day of unique customers as of the last refresh, for ``uniques.unique`` over any period."""
    rows = _parts(lake, "state", uniques.STATE, _first_part(lake), _last(lake, UNIQUES)[0])
    rows = rows if first is None else rows.where(F.col("order_date") >= F.lit(first))
    return rows if last is None else rows.where(F.col("order_date") <= F.lit(last))


def _last(lake: Lake, mart: str) -> tuple[int, str]:
    """Folder number of the mart's current contents and the input position they reflect."""
    done = lake.log("refreshes").where((F.col("mart") == mart) & (F.col("state") == "SUCCEEDED"))
    row = done.agg(F.max("refresh"), F.max_by("through_batch", "start_time")).first()
    return row[0] or 0, row[1] or ""


def _position(lake: Lake, mart: str) -> str:
    """Newest complete batch of each table the mart reads, from the log the loads keep."""
    named = F.col("table_name").isin(*INPUTS[mart]) & F.col("src_batch").isNotNull()
    newest = lake.log("batches").where(named).groupBy("table_name")
    named = newest.agg(F.max("src_batch").alias("b")).select(F.concat_ws("=", "table_name", "b").alias("p"))
    return named.agg(F.array_join(F.array_sort(F.collect_list("p")), ";")).first()[0]


BY_STATE = {TOP: _top_products, COHORTS: _cohorts, UNIQUES: _uniques}


def _define(lake: Lake, mart: str, number: int, position: str) -> DataFrame:
    """The mart from all rows up to a position."""
    if mart == DAILY:
        return marts.daily_revenue(lake.staged("orders"))
    return BY_STATE[mart](lake, number, None, _batches(position))


def _update(lake: Lake, mart: str, number: int, seen: str, position: str) -> DataFrame:
    """The mart from what it was at a position and the rows since."""
    if mart == DAILY:
        return _daily_updated(lake, number - 1, seen.partition("=")[2])
    return BY_STATE[mart](lake, number, _batches(seen), _batches(position))


def _touched_days(lake: Lake, after: str) -> DataFrame:
    """Days (with their month folder) that got orders in batches after the one named."""
    fresh = _staged_orders(lake).where(F.col("_src_batch") > after)
    return fresh.select(F.col(MONTH).alias("_month"), F.col("order_date").alias("_day")).distinct()


def orders_of_touched_days(lake: Lake, after: str) -> DataFrame:
    """All orders of the days that got new ones.

    The touched months, of which there are no more than the calendar has, are fetched and name the
    folders to read, so that pruning does not hang on a broadcast; the days are then met by a join.
    """
    touched = _touched_days(lake, after)
    months = [row[0] for row in touched.select("_month").distinct().collect()]
    orders = _staged_orders(lake).where(F.col(MONTH).isin(months))
    return orders.join(touched.select("_day").distinct(), F.col("order_date").eqNullSafe(F.col("_day")), "left_semi")


def _daily_updated(lake: Lake, number: int, after: str) -> DataFrame:
    """The current daily mart with the touched days computed again.

    Distinct counts cannot be added up, so a touched day is recomputed from all its orders.  The
    other days are carried over: the mart has one row per day, so copying it costs nothing.
    """
    days = _touched_days(lake, after).select("_day").distinct()
    current = lake.spark.read.parquet(lake.mart(DAILY, number))
    kept = current.join(days, F.col("order_date").eqNullSafe(F.col("_day")), "left_anti")
    return kept.unionByName(marts.daily_revenue(orders_of_touched_days(lake, after)))


def refresh(lake: Lake, mart: str, full: bool = False) -> str:
    """Bring one mart up to date and say how: in full, in part, or not at all.

    Every refresh writes a new folder and readers move to it once it is logged, so a refresh that
    fails leaves the mart as it was.
    """
    started = lake.clock()
    number, seen = _last(lake, mart)
    position = _position(lake, mart)
    if number and position == seen and not full:
        _record(lake, mart, number, NO_DATA, position, started)
        return NO_DATA
    if number and not full:
        action, rows = INCREMENTAL, _update(lake, mart, number + 1, seen, position)
    else:
        action, rows = FULL, _define(lake, mart, number + 1, position)
    rows.write.mode("overwrite").parquet(lake.mart(mart, number + 1))
    _record(lake, mart, number + 1, action, position, started)
    return action


def refresh_all(lake: Lake) -> dict[str, str]:
    """Refresh every mart; tells what was done for each."""
    return {mart: refresh(lake, mart) for mart in MARTS}


def _record(lake: Lake, mart: str, number: int, action: str, through: str, started) -> None:
    lake.append_log(
        "refreshes", mart=mart, refresh=number, action=action, state="SUCCEEDED", through_batch=through,
        data_timestamp=started, start_time=started, end_time=now(),
    )


def read(lake: Lake, mart: str) -> DataFrame:
    """The mart as of its last refresh; stays readable while nothing refreshes it."""
    number = _last(lake, mart)[0]
    if number == 0:
        raise ValueError(f"{mart} has not been refreshed yet")
    return lake.spark.read.parquet(lake.mart(mart, number))


def history(lake: Lake, rows: int = 50) -> DataFrame:
    """Newest refreshes: mart, what was done, data time, start and end."""
    columns = ["mart", "state", "action", "data_timestamp", "start_time", "end_time"]
    return lake.log("refreshes").orderBy(F.col("start_time").desc(), "mart").select(*columns).limit(rows)
