"""Every query by name: a function of a session and the folder of the supplied tables.

Queries on files, feeds, versions and refreshes build a lake in the shared folder first, from the
whole tables, and return what the operation left there.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel import fixtures as fx
from caravel import schemas
from caravel.functions import documents as doc
from caravel.lake import Lake
from caravel.operators import profile, reconcile
from caravel.operators.joins import first_keys, without_match
from caravel.plans import catalogue, marts, policy, quality, quality_state, refresh, report, staging, uniques
from caravel.plans.report import ReportFilters
from caravel.sources import formats, landing, loads, merging, versions
from caravel.streaming import feeds, runs
from caravel.workspace import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

EVERYTHING = ReportFilters()
CHOSEN = ReportFilters(date(1996, 3, 1), date(2000, 10, 15), ("f", "o"), ("ECONOMY", "LARGE"), top_n=20)
CHOSEN_EVENTS = ReportFilters(date(2024, 1, 5), date(2024, 1, 20), devices=("mobile", "tablet"))

# Event types of the supplied table in place of the shop's own steps; "checkout" never occurs in it.
FIXTURE_STEPS = ("view", "click", "checkout", "signup", "purchase")
CITIES = ("NATION_1", "NATION_4", "NATION_7")
REMOVED_ROWS = 1000


class Shop:
    """RAW and STAGING frames over the supplied tables, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _frame(self, build: Callable[..., DataFrame], *more) -> DataFrame:
        return build(self.spark, self.sf_dir, *more)

    @cached_property
    def raw_orders(self) -> DataFrame:
        return self._frame(fx.raw_orders)

    @cached_property
    def raw_items(self) -> DataFrame:
        return self._frame(fx.raw_order_items)

    @cached_property
    def raw_customers(self) -> DataFrame:
        return self._frame(fx.raw_customers)

    @cached_property
    def raw_products(self) -> DataFrame:
        return self._frame(fx.raw_products)

    @cached_property
    def raw_events(self) -> DataFrame:
        return self._frame(fx.raw_web_events)

    @cached_property
    def orders(self) -> DataFrame:
        return staging.orders(self.raw_orders)

    @cached_property
    def customers(self) -> DataFrame:
        return staging.customers(self.raw_customers)

    @cached_property
    def products(self) -> DataFrame:
        return staging.products(self.raw_products)

    @cached_property
    def items(self) -> DataFrame:
        return staging.order_items(self.raw_items, self.products)

    @cached_property
    def lines(self) -> DataFrame:
        """Valid lines before the catalogue is joined."""
        return staging.valid_lines(self.raw_items)

    @cached_property
    def events(self) -> DataFrame:
        return staging.web_events(self.raw_events)

    @cached_property
    def cohorts(self) -> DataFrame:
        return marts.customer_cohorts(self.customers, self.orders)

    @cached_property
    def best_sellers(self) -> DataFrame:
        return marts.top_products(self.lines, self.orders, self.products)

    def lake(self, label: str) -> Lake:
        return Lake(self.spark, scratch_folder(self.spark, label))


def _on_shop(build: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Shop(spark, sf_dir))


# --- landing files and loads -----------------------------------------------------------------

FILE_KINDS = {
    "orders": "csv", "order_items": "csv", "customers": "parquet", "products": "json", "web_events": "json",
}


def _land(shop: Shop, lake: Lake, table: str, batch: str | None = None) -> str:
    """Put one table (or one delivery of it) into the landing area and return its file name."""
    name = f"{batch or 'j1'}/{table}.{FILE_KINDS[table]}"
    spark, sf_dir = shop.spark, shop.sf_dir
    if table == "orders":
        return landing.put_csv(lake, fx.raw_orders(spark, sf_dir, batch), name)
    if table == "order_items":
        return landing.put_csv(lake, fx.raw_order_items(spark, sf_dir, batch), name)
    if table == "customers":
        return landing.put_parquet(lake, shop.raw_customers, name)
    if table == "products":
        return landing.put_json_arrays(lake, fx.product_json(spark, sf_dir), name)
    return landing.put_json_lines(lake, fx.web_event_fields(spark, sf_dir, batch), name)


def _loaded(table: str) -> Callable[[Shop], DataFrame]:
    """Land a whole table as a file, load it, read RAW."""

    def build(shop: Shop) -> DataFrame:
        lake = shop.lake(f"ingest-{table}")
        loads.load(lake, table, _land(shop, lake, table))
        return versions.as_of(lake, table)

    return build


def csv_scan(shop: Shop) -> DataFrame:
    lake = shop.lake("csv-scan")
    path = lake.landing(_land(shop, lake, "orders"))
    return formats.typed_csv(formats.read_csv_text(shop.spark, path, "orders"), "orders")


def csv_validate(shop: Shop) -> DataFrame:
    """Dry run over a file in which some dates and amounts cannot be read."""
    lake = shop.lake("csv-validate")
    bad_date, bad_amount = F.dayofmonth("order_date") == 13, F.col("total_amount") > 450000
    spoilt = shop.raw_orders.select(
        "order_id",
        "customer_id",
        F.when(bad_date, F.lit("2001-02-30 10:00:00")).otherwise(F.col("order_date").cast("string")).alias("order_date"),
        "status",
        F.when(bad_amount, F.lit("n/a")).otherwise(F.col("total_amount").cast("string")).alias("total_amount"),
    )
    path = lake.landing(landing.put_csv(lake, spoilt, "j1/orders.csv"))
    return formats.csv_faults(formats.read_csv_text(shop.spark, path, "orders", keep_broken=True), "orders")


def csv_line_breaks(shop: Shop) -> DataFrame:
    """Orders whose customer and status hold line breaks, quotes and commas, landed as delimited text and read by byte ranges."""
    lake = shop.lake("csv-line-breaks")
    digit = F.coalesce(F.right(F.trim("order_id"), F.lit(1)), F.lit("0"))
    broken = shop.raw_orders.withColumns({
        "customer_id": F.when(digit.isin("0", "3", "6"), F.concat("customer_id", F.lit('\n"of", the\n\nnorth'))).otherwise(F.col("customer_id")),
        "status": F.when(digit.isin("3", "7"), F.concat(F.lit('"'), "status", F.lit('"\n'))).otherwise(F.col("status")),
    })
    path = lake.landing(landing.put_csv(lake, broken, "j1/orders.csv"))
    return formats.typed_csv(formats.read_csv_text(shop.spark, path, "orders", multi_line=True), "orders")


def json_scan(shop: Shop) -> DataFrame:
    """Documents and distinct keys found in the array files and in the line-delimited files."""
    lake = shop.lake("json-scan")
    array = formats.read_json_array(shop.spark, lake.landing(_land(shop, lake, "products")))
    lines = formats.read_json_lines(shop.spark, lake.landing(_land(shop, lake, "web_events")))

    def summary(docs: DataFrame, layout: str, key: str) -> DataFrame:
        found = docs.select(F.variant_get("data", f"$.{key}", "string").alias("key"))
        counted = profile.key_uniqueness(found, "key")
        return counted.select(
            F.lit(layout).alias("layout"), F.col("row_count").alias("documents"), F.col("distinct_keys").alias("keys")
        )

    return summary(array, "array", "product_id").unionByName(summary(lines, "lines", "event_id"))


def ingest_products(shop: Shop) -> DataFrame:
    return catalogue.product_attributes(_loaded("products")(shop))


def ingest_idempotent(shop: Shop) -> DataFrame:
    """Every file is offered twice; the second offer changes nothing."""
    lake = shop.lake("ingest-twice")
    files = [_land(shop, lake, "orders", batch) for batch in ("j1", "j2")]
    for name in files + files:
        loads.load(lake, "orders", name)
    return versions.as_of(lake, "orders")


def reload_after_replace(shop: Shop) -> DataFrame:
    """A file is loaded, its table replaced, and the same file loaded again."""
    lake = shop.lake("reload")
    name = _land(shop, lake, "orders")
    loads.load(lake, "orders", name)
    feeds.replace_table(lake, "orders")
    loads.load(lake, "orders", name)
    return versions.as_of(lake, "orders")


def audit_files(shop: Shop) -> DataFrame:
    """Rows of each RAW table by the file they came from."""
    lake = shop.lake("audit")
    for batch in ("j1", "j2"):
        _deliver(shop, lake, batch)
    counts = [
        versions.as_of(lake, table, audit=True).groupBy(F.lit(table).alias("table_name"), "_source_file")
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("_loaded_at").isNull()).alias("without_stamp"))
        for table in FILE_KINDS
    ]
    return reduce(DataFrame.unionByName, counts).withColumnRenamed("_source_file", "source_file")


def load_history(shop: Shop) -> DataFrame:
    lake = shop.lake("load-history")
    _deliver(shop, lake, "j1")
    _deliver(shop, lake, "j2")
    return loads.history(lake, since=lake.log("commits").agg(F.min("committed_at")).first()[0]).drop("committed_at")


def load_history_merged(shop: Shop) -> DataFrame:
    """The load history from merged logs: merged after each delivery, what feeds have not seen still apart."""
    lake = shop.lake("load-history-merged")
    for batch in ("j1", "j2"):
        _deliver(shop, lake, batch)
        merging.merge_logs(lake, fan=2)
    return loads.history(lake, since=lake.log("commits").agg(F.min("committed_at")).first()[0]).drop("committed_at")


def landing_files(shop: Shop) -> DataFrame:
    lake = shop.lake("landing-files")
    for table in FILE_KINDS:
        _land(shop, lake, table)
    found = landing.list_files(lake, "j1").where(~F.col("path").rlike("/[_.][^/]*$"))
    parts = F.split("path", "/")
    name = F.split(F.element_at(parts, 2), r"\.")
    return found.groupBy(
        F.element_at(parts, 1).alias("delivery"), F.element_at(name, 1).alias("table_name"), F.element_at(name, 2).alias("kind")
    ).agg((F.sum("bytes") > 0).alias("has_data"))


def _events_file(shop: Shop, label: str) -> DataFrame:
    lake = shop.lake(label)
    return formats.read_json_lines(shop.spark, lake.landing(_land(shop, lake, "web_events")))


def events_external(shop: Shop) -> DataFrame:
    """Both deliveries as one table over the folder tree, nothing copied."""
    lake = shop.lake("events-external")
    for batch in ("j1", "j2"):
        _land(shop, lake, "web_events", batch)
    return catalogue.event_type_counts(
        formats.read_json_external(shop.spark, f"{lake.landing()}/*/web_events*.json")
    )


def in_place_equals_materialised(shop: Shop) -> DataFrame:
    """The same count on the landed file and on the RAW table loaded from it."""
    lake = shop.lake("in-place")
    name = _land(shop, lake, "web_events")
    loads.load(lake, "web_events", name)
    in_place = catalogue.event_type_counts(formats.read_json_lines(shop.spark, lake.landing(name)))
    loaded = catalogue.event_type_counts(versions.as_of(lake, "web_events"))
    return profile.same_counts(in_place, loaded, "event_type", "nb_events")


def _deliver(shop: Shop, lake: Lake, batch: str) -> None:
    """Land and load one delivery: the changing tables, and with the first also the reference data."""
    tables = ["orders", "order_items", "web_events"] + (["customers", "products"] if batch == "j1" else [])
    for table in tables:
        loads.load(lake, table, _land(shop, lake, table, batch if table in feeds.FEEDS else None))


# --- change feeds ------------------------------------------------------------------------------


def _append_batch(shop: Shop, lake: Lake, table: str, batch: str | None) -> int:
    """Add one delivery of a table to RAW without a landing file in between."""
    build = {"orders": fx.raw_orders, "order_items": fx.raw_order_items, "web_events": fx.raw_web_events}[table]
    return versions.append(lake, table, build(shop.spark, shop.sf_dir, batch), f"{batch or 'all'}/{table}")


def _append_reference(shop: Shop, lake: Lake) -> None:
    versions.append(lake, "products", shop.raw_products, "j1/products")
    versions.append(lake, "customers", shop.raw_customers, "j1/customers")


def _incremental(feed: str) -> Callable[[Shop], DataFrame]:
    """First delivery, feed, second delivery, feed; STAGING afterwards."""

    def build(shop: Shop) -> DataFrame:
        lake = shop.lake(f"inc-{feed}")
        if feed == "order_items":
            versions.append(lake, "products", shop.raw_products, "j1/products")
            runs.refresh_products(lake)
        for batch in ("j1", "j2"):
            _append_batch(shop, lake, feed, batch)
            feeds.consume(lake, feed)
        return lake.staged(feed)

    return build


def inc_late_products(shop: Shop) -> DataFrame:
    """STAGING lines of two deliveries; half of the products come after the first one's lines."""
    lake = shop.lake("inc-late-products")
    later = F.coalesce(F.substring(doc.text_at(F.col("data"), "product_id"), -1, 1).isin(*"02468"), F.lit(False))
    for batch, products in (("j1", shop.raw_products.where(~later)), ("j2", shop.raw_products.where(later))):
        versions.append(lake, "products", products, f"{batch}/products")
        runs.refresh_products(lake)
        _append_batch(shop, lake, "order_items", batch)
        feeds.consume(lake, "order_items")
    return lake.staged("order_items")


def stg_web_events(shop: Shop) -> DataFrame:
    """From the RAW table as stored: documents are built once and only read here."""
    lake = shop.lake("stg-events")
    _append_batch(shop, lake, "web_events", None)
    return staging.web_events(versions.as_of(lake, "web_events"))


def backfill_equals_incremental(shop: Shop) -> DataFrame:
    """STAGING orders from one run over all history and from two runs, side by side."""
    at_once = shop.lake("backfill")
    for batch in ("j1", "j2"):
        _append_batch(shop, at_once, "orders", batch)
    feeds.consume(at_once, "orders")
    stepwise = _incremental("orders")(shop)
    tagged = at_once.staged("orders").select(F.lit("all at once").alias("way"), "*")
    return tagged.unionByName(stepwise.select(F.lit("in two batches").alias("way"), "*"))


def pending_changes(shop: Shop) -> DataFrame:
    """What the feeds would take in after the second delivery has been loaded."""
    lake = shop.lake("pending")
    _append_reference(shop, lake)
    runs.refresh_products(lake)
    for feed in feeds.FEEDS:
        _append_batch(shop, lake, feed, "j1")
        feeds.consume(lake, feed)
        _append_batch(shop, lake, feed, "j2")
    return feeds.pending_changes(lake)


def inc_orders_merged(shop: Shop) -> DataFrame:
    """STAGING orders from two deliveries, the logs merged after each run of the feed."""
    lake = shop.lake("inc-orders-merged")
    for batch in ("j1", "j2"):
        _append_batch(shop, lake, "orders", batch)
        feeds.consume(lake, "orders")
        merging.merge_logs(lake, fan=2)
    feeds.consume(lake, "orders")
    return lake.staged("orders")


def _two_runs(shop: Shop, label: str, between: Callable[[Lake], object] | None = None) -> Lake:
    """Both deliveries, each followed by an ordered run."""
    lake = shop.lake(label)
    _append_reference(shop, lake)
    runs.refresh_customers(lake)
    for batch in ("j1", "j2"):
        for feed in feeds.FEEDS:
            _append_batch(shop, lake, feed, batch)
        runs.run_loads(lake)
        if batch == "j1" and between is not None:
            between(lake)
    return lake


def batch_before_after(shop: Shop) -> DataFrame:
    before: list[DataFrame] = []

    def remember(lake: Lake) -> None:
        path = f"{lake.root}/reports/before"
        runs.staged_counts(lake, "before").write.parquet(path)
        before.append(lake.spark.read.parquet(path))

    lake = _two_runs(shop, "before-after", remember)
    return before[0].unionByName(runs.staged_counts(lake, "after"))


def run_loads(shop: Shop) -> DataFrame:
    lake = _two_runs(shop, "run-loads")
    return profile.tagged_counts({t: lake.staged(t) for t in runs.STAGED})


def run_history(shop: Shop) -> DataFrame:
    lake = _two_runs(shop, "run-history")
    runs.run_loads(lake)
    first = lake.log("runs").agg(F.min("scheduled_time")).first()[0]
    return runs.history(lake, rows=None, since=first).select("run_id", "job", "state", "row_count")


# --- versions and recovery -----------------------------------------------------------------------


def _with_first_rows_removed(shop: Shop, label: str) -> tuple[Lake, int]:
    """RAW orders with the first rows in key order deleted; the version of the delete."""
    lake = shop.lake(label)
    _append_batch(shop, lake, "orders", None)
    gone = first_keys(versions.as_of(lake, "orders"), "order_id", REMOVED_ROWS)
    return lake, versions.remove(lake, "orders", gone)


def delete_first_n(shop: Shop) -> DataFrame:
    lake, _ = _with_first_rows_removed(shop, "delete")
    return versions.as_of(lake, "orders")


def as_of_before_delete(shop: Shop) -> DataFrame:
    lake, removal = _with_first_rows_removed(shop, "before-delete")
    return versions.before(lake, "orders", removal)


def as_of_offset(shop: Shop) -> DataFrame:
    """The table at a point in time: when its first write was committed."""
    lake, _ = _with_first_rows_removed(shop, "at-time")
    first_commit = versions.commits(lake, "orders").agg(F.min("committed_at")).scalar()
    return versions.as_of(lake, "orders", versions.version_at(lake, "orders", first_commit))


def as_of_seconds_ago(shop: Shop) -> DataFrame:
    """The table a number of seconds back: after its first write and before the delete that followed."""
    lake = shop.lake("seconds-ago")
    _append_batch(shop, lake, "orders", None)
    time.sleep(3)  # the two commits must lie whole seconds apart
    gone = first_keys(versions.as_of(lake, "orders"), "order_id", REMOVED_ROWS)
    removal = versions.remove(lake, "orders", gone)
    deleted = versions.commits(lake, "orders").where(F.col("version") == removal).first()["committed_at"]
    seconds = int((lake.clock() - deleted).total_seconds()) + 2
    return versions.as_of(lake, "orders", versions.seconds_ago(lake, "orders", seconds))


def restore_missing(shop: Shop) -> DataFrame:
    lake, removal = _with_first_rows_removed(shop, "restore")
    versions.restore(lake, "orders", removal - 1)
    return versions.changes(lake, "orders", versions.RESTORE).select(*schemas.RAW["orders"])


def recovery_counts(shop: Shop) -> DataFrame:
    lake, removal = _with_first_rows_removed(shop, "recovery")
    restored = versions.restore(lake, "orders", removal - 1)
    stages = {"before": removal - 1, "deleted": removal, "restored": restored}
    return profile.tagged_counts({s: versions.as_of(lake, "orders", v) for s, v in stages.items()}, "stage")


def reconcile_orders(shop: Shop) -> DataFrame:
    """Orders before a delete against those after it, to which the second delivery was added once more."""
    lake, removal = _with_first_rows_removed(shop, "reconcile")
    _append_batch(shop, lake, "orders", "j2")
    return reconcile.differences(versions.before(lake, "orders", removal), versions.as_of(lake, "orders"))


def snapshot_copy(shop: Shop) -> DataFrame:
    lake, removal = _with_first_rows_removed(shop, "snapshot")
    copy = versions.snapshot(lake, "orders", f"{lake.root}/snapshots/orders", removal - 1)
    return copy.select(*schemas.RAW["orders"])


def _restored(shop: Shop, label: str) -> Lake:
    """Orders fed to STAGING, then deleted in part and restored."""
    lake = shop.lake(label)
    _append_batch(shop, lake, "orders", None)
    feeds.consume(lake, "orders")
    gone = first_keys(versions.as_of(lake, "orders"), "order_id", REMOVED_ROWS)
    removal = versions.remove(lake, "orders", gone)
    versions.restore(lake, "orders", removal - 1)
    return lake


def changes_inserts(shop: Shop) -> DataFrame:
    return versions.changes(_restored(shop, "changes"), "orders").select(*schemas.RAW["orders"])


def restore_not_reprocessed(shop: Shop) -> DataFrame:
    """Restored rows are not new: another run of the feed leaves STAGING as it was."""
    lake = _restored(shop, "restore-feed")
    feeds.consume(lake, "orders")
    return lake.staged("orders")


# --- refresh of marts ----------------------------------------------------------------------------


def _refreshed(mart: str, fed: tuple[str, ...]) -> Callable[[Shop], DataFrame]:
    """Both deliveries through the feeds a mart depends on, each followed by a refresh."""

    def build(shop: Shop) -> DataFrame:
        lake = shop.lake(f"refresh-{mart}")
        if mart == refresh.TOP:
            versions.append(lake, "products", shop.raw_products, "j1/products")
            runs.refresh_products(lake)
        if mart == refresh.COHORTS:
            versions.append(lake, "customers", shop.raw_customers, "j1/customers")
            runs.refresh_customers(lake)
        for batch in ("j1", "j2"):
            for feed in fed:
                _append_batch(shop, lake, feed, batch)
                feeds.consume(lake, feed)
            refresh.refresh(lake, mart)
        return refresh.read(lake, mart)

    return build


def unique_customers_by_period(shop: Shop) -> DataFrame:
    """Customers of every month, year and of a period that cuts months, from the states by day of two deliveries."""
    lake = shop.lake("unique-customers")
    for batch in ("j1", "j2"):
        _append_batch(shop, lake, "orders", batch)
        feeds.consume(lake, "orders")
        refresh.refresh(lake, refresh.UNIQUES)
    days = refresh.customer_states(lake)
    grains = [uniques.unique(days.withColumn("period", F.date_format("order_date", f)), "period") for f in ("yyyy-MM", "yyyy")]
    chosen = uniques.unique(refresh.customer_states(lake, CHOSEN.date_from, CHOSEN.date_to))
    return reduce(DataFrame.unionByName, [*grains, chosen.select(F.lit("chosen").alias("period"), "unique_customers")])


def quality_kept_up(shop: Shop) -> DataFrame:
    """The quality report of two deliveries from its state, refreshed after each."""
    lake = shop.lake("quality-kept-up")
    versions.append(lake, "products", shop.raw_products, "j1/products")
    for batch in ("j1", "j2"):
        for feed in feeds.FEEDS:
            _append_batch(shop, lake, feed, batch)
        quality_state.refresh(lake)
    return quality_state.report(lake, {"orders_without_id": "0.02"})


def refresh_history(shop: Shop) -> DataFrame:
    """A full build, an update after the second delivery, and a refresh that finds nothing new."""
    lake = _two_runs(shop, "refresh-history", refresh.refresh_all)
    refresh.refresh_all(lake)
    refresh.refresh_all(lake)
    return refresh.history(lake).select("mart", "action", "state")


# --- registry --------------------------------------------------------------------------------------


def _trend(grain: str) -> Callable[[Shop], DataFrame]:
    return lambda s: report.trend(s.orders, ReportFilters(grain=grain))


_BUILDERS: dict[str, Callable[[Shop], DataFrame]] = {
    # files and loads
    "csv_scan": csv_scan,
    "csv_validate": csv_validate,
    "csv_line_breaks": csv_line_breaks,
    "json_scan": json_scan,
    "ingest_orders": _loaded("orders"),
    "ingest_order_items": _loaded("order_items"),
    "ingest_customers": _loaded("customers"),
    "ingest_products": ingest_products,
    "ingest_idempotent": ingest_idempotent,
    "load_history": load_history,
    "load_history_merged": load_history_merged,
    "reload_after_replace": reload_after_replace,
    "audit_files": audit_files,
    "landing_files": landing_files,
    "events_in_place": lambda s: catalogue.events_in_place(_events_file(s, "events-in-place")),
    "event_type_counts": lambda s: catalogue.event_type_counts(_events_file(s, "event-types")),
    "events_external": events_external,
    "in_place_equals_materialised": in_place_equals_materialised,
    # STAGING
    "stg_products": lambda s: staging.products(s.raw_products),
    "stg_customers": lambda s: s.customers,
    "stg_orders": lambda s: s.orders,
    "stg_order_items": lambda s: s.items,
    "stg_web_events": stg_web_events,
    # documents
    "product_attributes": lambda s: catalogue.product_attributes(s.raw_products),
    "category_price_stats": lambda s: catalogue.category_price_stats(s.raw_products),
    "product_tags_outer": lambda s: catalogue.product_tags_outer(s.raw_products),
    "tag_distribution": lambda s: catalogue.tag_distribution(s.raw_products),
    "event_null_profile": lambda s: catalogue.event_null_profile(s.raw_events),
    "event_device_counts": lambda s: catalogue.event_device_counts(s.raw_events),
    "event_ts_bounds": lambda s: catalogue.event_ts_bounds(s.raw_events),
    # checks
    "table_counts": lambda s: profile.tagged_counts(
        {
            "orders": s.raw_orders, "order_items": s.raw_items, "customers": s.raw_customers,
            "products": s.raw_products, "web_events": s.raw_events,
        }
    ),
    "order_key_uniqueness": lambda s: profile.key_uniqueness(s.raw_orders, "order_id"),
    "order_date_bounds": lambda s: profile.bounds(s.orders, "order_date", "first_day", "last_day"),
    "orders_by_status": lambda s: profile.distribution(s.raw_orders, F.col("status"), "status"),
    "orphan_items": lambda s: without_match(s.raw_items, s.raw_orders, "order_id").agg(
        F.count(F.lit(1)).alias("orphan_items")
    ),
    "quality_report": lambda s: quality.quality_report(
        s.raw_orders, s.raw_items, s.raw_products, s.raw_events, {"orders_without_id": "0.02"}
    ),
    "quality_kept_up": quality_kept_up,
    # marts
    "dt_daily_revenue": lambda s: marts.daily_revenue(s.orders),
    "dt_top_products": lambda s: s.best_sellers,
    "dt_customer_cohorts": lambda s: s.cohorts,
    "mart_daily_latest": lambda s: marts.latest_days(marts.daily_revenue(s.orders)),
    "mart_top_listing": lambda s: marts.top_listing(s.best_sellers),
    "mart_cohort_head": lambda s: marts.cohort_head(s.cohorts),
    # reports
    "filter_statuses": lambda s: profile.distinct_values(s.orders, "status"),
    "filter_categories": lambda s: profile.distinct_values(s.products, "category"),
    "filter_devices": lambda s: profile.distinct_values(s.events, "device"),
    "report_daily": lambda s: report.daily(s.orders, EVERYTHING),
    "report_daily_filtered": lambda s: report.daily(s.orders, CHOSEN),
    "report_kpis": lambda s: report.kpis(s.orders, EVERYTHING),
    "report_kpis_filtered": lambda s: report.kpis(s.orders, CHOSEN),
    "unique_customers": lambda s: report.unique_customers(s.orders, EVERYTHING),
    "revenue_last_14_days": lambda s: report.last_days(s.orders, EVERYTHING),
    "revenue_by_day": _trend("day"),
    "revenue_by_week": _trend("week"),
    "revenue_by_month": _trend("month"),
    "report_top_products": lambda s: report.top_products(s.lines, s.orders, EVERYTHING, s.products),
    "report_top_products_filtered": lambda s: report.top_products(s.lines, s.orders, CHOSEN, s.products),
    "revenue_by_category": lambda s: report.revenue_by_category(s.lines, s.orders, EVERYTHING, s.products),
    "revenue_by_category_filtered": lambda s: report.revenue_by_category(s.lines, s.orders, CHOSEN, s.products),
    "conversion_funnel": lambda s: report.funnel(s.events, EVERYTHING, FIXTURE_STEPS),
    "conversion_funnel_filtered": lambda s: report.funnel(s.events, CHOSEN_EVENTS, FIXTURE_STEPS),
    "events_by_device": lambda s: report.events_by_device(s.events, EVERYTHING),
    "events_by_device_filtered": lambda s: report.events_by_device(s.events, CHOSEN_EVENTS),
    "cohort_heatmap": lambda s: report.cohort_heatmap(s.cohorts),
    "latest_orders_display": lambda s: report.display_orders(report.latest_orders(s.orders, s.customers, EVERYTHING)),
    "latest_orders": lambda s: report.latest_orders(s.orders, s.customers, EVERYTHING),
    # change feeds
    "inc_orders_merged": inc_orders_merged,
    "inc_orders": _incremental("orders"),
    "inc_order_items": _incremental("order_items"),
    "inc_late_products": inc_late_products,
    "inc_web_events": _incremental("web_events"),
    "backfill_equals_incremental": backfill_equals_incremental,
    "pending_changes": pending_changes,
    "changes_inserts": changes_inserts,
    "batch_before_after": batch_before_after,
    "run_loads": run_loads,
    "run_history": run_history,
    "restore_not_reprocessed": restore_not_reprocessed,
    # refresh of marts
    "refresh_daily_incremental": _refreshed(refresh.DAILY, ("orders",)),
    "refresh_marts": _refreshed(refresh.TOP, ("orders", "order_items")),
    "refresh_cohorts": _refreshed(refresh.COHORTS, ("orders",)),
    "refresh_unique_customers": _refreshed(refresh.UNIQUES, ("orders",)),
    "unique_customers_by_period": unique_customers_by_period,
    "refresh_history": refresh_history,
    # recovery
    "delete_first_n": delete_first_n,
    "as_of_before_delete": as_of_before_delete,
    "as_of_offset": as_of_offset,
    "as_of_seconds_ago": as_of_seconds_ago,
    "restore_missing": restore_missing,
    "recovery_counts": recovery_counts,
    "snapshot_copy": snapshot_copy,
    "reconcile_orders": reconcile_orders,
    # policies
    "customers_masked": lambda s: policy.customers_view(s.customers, may_see_email=False),
    "orders_for_region": lambda s: policy.orders_for_cities(s.orders, s.customers, CITIES),
}

QUERIES: dict[str, Query] = {name: _on_shop(build) for name, build in _BUILDERS.items()}
