"""Change feeds, ordered runs and mart refreshes."""

from __future__ import annotations

import pytest
from conftest import SMALL, values

from caravel import fixtures as fx
from caravel.lake import Lake
from caravel.plans import marts, refresh, staging
from caravel.sources import versions as v
from caravel.streaming import feeds, runs

ORDERS = "order_id string, customer_id string, order_date timestamp_ntz, status string, total_amount decimal(12,2)"
ITEMS = "order_id string, product_id string, quantity bigint, unit_price decimal(12,2)"


def raw_order(key, day="2026-01-10"):
    return (key, "C1", None if day is None else f"{day} 08:00:00", "New", "10.00")


def ids(lake, table="orders"):
    return sorted(r.order_id for r in lake.staged(table).collect())


def states(lake, run_id):
    found = lake.log("runs").where(f"run_id = {run_id}").collect()
    return {r.job: r.state for r in found}


def files_read(frame):
    """Number of files that the scans of a query opened."""
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            metric = node.metrics().get("numFiles")
            total += metric.get().value() if metric.isDefined() else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.fixture
def shop(lake, rows, documents):
    """A lake with a catalogue and the first orders, lines and events in RAW."""
    v.append(lake, "products", documents('{"product_id":"P1","name":"pen","category":"c","brand":"b"}'), "p")
    v.append(lake, "orders", rows(ORDERS, raw_order("O1"), raw_order("O2")), "o1")
    v.append(lake, "order_items", rows(ITEMS, ("O1", "P1", 1, "2.00"), ("O1", "P2", 1, "3.00")), "i1")
    v.append(lake, "web_events", documents('{"event_id":"1","timestamp":"2026-01-01T00:00:00"}', "{}"), "e1")
    return lake


def test_feed_takes_each_row_once(lake, rows):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1"), raw_order(None)), "f1")
    first = feeds.consume(lake, "orders")
    assert (first.rows_staged, first.batches) == (1, 1)
    again = feeds.consume(lake, "orders")
    assert (again.rows_staged, again.batches) == (0, 0)
    v.append(lake, "orders", rows(ORDERS, raw_order("O2")), "f2")
    assert feeds.consume(lake, "orders").rows_staged == 1
    assert ids(lake) == ["O1", "O2"]


def test_peeking_does_not_move_the_position(shop):
    for _ in range(2):
        assert {r.feed: (r.nb_changes, r.has_data) for r in feeds.pending_changes(shop).collect()} == {
            "orders": (2, True), "order_items": (2, True), "web_events": (2, True),
        }
    feeds.consume(shop, "orders")
    after = {r.feed: r.has_data for r in feeds.pending_changes(shop).collect()}
    assert after == {"orders": False, "order_items": True, "web_events": True}


def test_a_batch_written_twice_counts_once(lake, rows):
    """A batch that failed after its write is run again and replaces what it left."""
    frame = staging.stamped(staging.orders(rows(ORDERS, raw_order("O1"), raw_order("O2", None))))
    path = f"{lake.staging('orders')}/_src_batch={feeds.batch_name(0, 0)}"
    assert [feeds.write_batch("orders", frame, path) for _ in range(2)] == [2, 2]
    assert ids(lake) == []  # not logged yet
    lake.append_log("batches", table_name="orders", src_batch=feeds.batch_name(0, 0), generation=0)
    assert ids(lake) == ["O1", "O2"]


def test_failed_batch_is_taken_in_by_the_next_run(lake, rows, monkeypatch):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1")), "f1")
    real = feeds.write_batch

    def write_then_fail(*args):
        real(*args)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(feeds, "write_batch", write_then_fail)
    with pytest.raises(Exception, match="lost after the write"):
        feeds.consume(lake, "orders")
    monkeypatch.setattr(feeds, "write_batch", real)
    feeds.consume(lake, "orders")
    assert ids(lake) == ["O1"]


def test_small_batches_give_the_same_rows(lake, rows):
    for n in range(4):
        v.append(lake, "orders", rows(ORDERS, raw_order(f"O{n}")), f"f{n}")
    assert feeds.consume(lake, "orders", max_files=1).batches >= 2
    assert ids(lake) == ["O0", "O1", "O2", "O3"]


def test_restored_rows_are_not_taken_in_again(shop, rows):
    feeds.consume(shop, "orders")
    removal = v.remove(shop, "orders", rows("order_id string", ("O1",)))
    v.restore(shop, "orders", removal - 1)
    assert v.as_of(shop, "orders").count() == 2
    feeds.consume(shop, "orders")
    assert ids(shop) == ["O1", "O2"]


def test_restart_skips_what_is_there_and_takes_what_follows(shop, rows):
    feeds.consume(shop, "orders")
    v.append(shop, "orders", rows(ORDERS, raw_order("skipped")), "f2")
    assert feeds.restart(shop, "orders") == 1
    assert not feeds.position(shop, "orders").has_data
    assert feeds.consume(shop, "orders").rows_staged == 0
    v.append(shop, "orders", rows(ORDERS, raw_order("O3")), "f3")
    assert feeds.position(shop, "orders").has_data
    feeds.consume(shop, "orders")
    assert ids(shop) == ["O1", "O2", "O3"]


def test_replaced_table_and_restarted_feed_start_over(shop, rows):
    feeds.consume(shop, "orders")
    feeds.replace_table(shop, "orders")
    v.append(shop, "orders", rows(ORDERS, raw_order("O7")), "o1")
    assert feeds.consume(shop, "orders").rows_staged == 1
    assert ids(shop) == ["O1", "O2", "O7"]


def test_run_order_skips_and_history(shop, rows):
    assert runs.run_loads(shop) == 1
    assert states(shop, 1) == dict.fromkeys(runs.AFTER, "SUCCEEDED")
    assert [r.product_name for r in shop.staged("order_items").orderBy("product_id").collect()] == ["pen", None]
    v.append(shop, "order_items", rows(ITEMS, ("O2", "P1", 2, "1.00")), "i2")
    assert runs.run_loads(shop) == 2
    assert states(shop, 2) == {
        "products": "SUCCEEDED", "orders": "SKIPPED", "order_items": "SUCCEEDED", "web_events": "SKIPPED",
    }
    assert shop.staged("order_items").count() == 3
    newest = runs.history(shop, rows=4).collect()
    assert {r.run_id for r in newest} == {2}
    assert all(r.completed_time >= r.scheduled_time for r in newest)


def test_line_taken_in_before_its_product_stays_without_name(shop, rows, documents):
    runs.run_loads(shop)
    v.append(shop, "products", documents('{"product_id":"P2","name":"ink"}'), "p2")
    v.append(shop, "order_items", rows(ITEMS, ("O2", "P2", 1, "1.00")), "i2")
    runs.run_loads(shop)
    got = shop.staged("order_items").where("product_id = 'P2'")
    assert values(got.select("order_id", "product_name")) == [("O1", None), ("O2", "ink")]


def test_failure_cancels_only_what_depends_on_it(shop, monkeypatch):
    real = feeds.consume

    def broken(lake, feed, *args):
        if feed == "orders":
            raise RuntimeError("no orders today")
        return real(lake, feed, *args)

    monkeypatch.setattr(feeds, "consume", broken)
    with pytest.raises(RuntimeError, match="no orders today"):
        runs.run_loads(shop)
    assert states(shop, 1) == {
        "products": "SUCCEEDED", "orders": "FAILED", "order_items": "CANCELLED", "web_events": "SUCCEEDED",
    }
    monkeypatch.setattr(feeds, "consume", real)
    runs.run_loads(shop)
    assert ids(shop, "order_items") == ["O1", "O1"]


def test_timed_feed_takes_rows_while_it_runs(lake, rows):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1")), "f1")
    query = feeds.follow(lake, "orders", "1 second")
    try:
        query.processAllAvailable()
        v.append(lake, "orders", rows(ORDERS, raw_order("O2")), "f2")
        query.processAllAvailable()
    finally:
        query.stop()
    assert ids(lake) == ["O1", "O2"]
    at = feeds.position(lake, "orders")
    assert (at.consumed, at.has_data) == (2, False)
    assert {r.feed: r.nb_changes for r in feeds.pending_changes(lake).collect()}["orders"] == 0


def test_incremental_mart_equals_full_and_reads_only_touched_days(lake, rows):
    days = ["2026-01-10", "2026-02-10", "2026-03-10", "2026-03-12", None]
    v.append(lake, "orders", rows(ORDERS, *[raw_order(f"O{i}", d) for i, d in enumerate(days)]), "f1")
    feeds.consume(lake, "orders")
    assert refresh.refresh(lake, refresh.DAILY) == "FULL"
    assert refresh.refresh(lake, refresh.DAILY) == "NO_DATA"
    first_batch = feeds.batch_name(0, 0)
    more = [raw_order("O2", "2026-03-10"), raw_order("O9", "2026-03-11"), raw_order("O8", None), raw_order("O7", "2026-04-01")]
    v.append(lake, "orders", rows(ORDERS, *more), "f2")
    feeds.consume(lake, "orders")
    again = refresh.orders_of_touched_days(lake, first_batch)
    assert sorted(r.order_id for r in again.collect()) == ["O2", "O2", "O4", "O7", "O8", "O9"]
    # March, April and no month: two files of the first batch, three of the second; the touched days: three of the second
    assert files_read(refresh.orders_of_touched_days(lake, first_batch)) == 8
    assert refresh.refresh(lake, refresh.DAILY) == "INCREMENTAL"
    whole = values(marts.daily_revenue(lake.staged("orders")))
    assert values(refresh.read(lake, refresh.DAILY)) == whole
    assert refresh.refresh(lake, refresh.DAILY, full=True) == "FULL"
    assert values(refresh.read(lake, refresh.DAILY)) == whole


def test_mart_stays_readable_when_a_refresh_fails(lake, rows, monkeypatch):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1")), "f1")
    feeds.consume(lake, "orders")
    refresh.refresh(lake, refresh.COHORTS)
    before = values(refresh.read(lake, refresh.COHORTS))
    monkeypatch.setattr(refresh, "_define", lambda *a: (_ for _ in ()).throw(RuntimeError("refresh lost")))
    with pytest.raises(RuntimeError):
        refresh.refresh(lake, refresh.COHORTS, full=True)
    assert values(refresh.read(lake, refresh.COHORTS)) == before


def test_unrefreshed_mart_says_so(lake):
    with pytest.raises(ValueError, match="has not been refreshed"):
        refresh.read(lake, refresh.TOP)


def test_batch_and_feed_give_the_same_staging(spark, lake):
    for batch in ("j1", "j2"):
        v.append(lake, "web_events", fx.raw_web_events(spark, SMALL, batch), batch)
        feeds.consume(lake, "web_events")
    whole = staging.web_events(fx.raw_web_events(spark, SMALL))
    assert values(lake.staged("web_events")) == values(whole)


def test_daily_revenue_adds_up_to_the_grand_total(spark):
    orders = staging.orders(fx.raw_orders(spark, SMALL))
    total = orders.selectExpr("sum(total_amount)").first()[0]
    assert marts.daily_revenue(orders).selectExpr("sum(revenue)").first()[0] == total


def test_shared_folder_is_the_one_the_cluster_names(spark):
    from caravel.workspace import scratch_folder, shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_folder(spark).removeprefix("file://") == named.rstrip("/").removeprefix("file://").removeprefix("file:")
    assert scratch_folder(spark, "x").startswith(shared_folder(spark))
    assert isinstance(Lake(spark, scratch_folder(spark, "y")).clock().year, int)


def test_batches_in_which_no_row_is_valid(lake, rows):
    v.append(lake, "orders", rows(ORDERS, raw_order(None)), "f1")
    done = feeds.consume(lake, "orders")
    assert (done.rows_staged, done.batches) == (0, 1)
    assert lake.staged("orders").isEmpty()
    assert refresh.refresh(lake, refresh.DAILY) == "FULL"
    assert refresh.read(lake, refresh.DAILY).isEmpty()


def half_written(lake, rows, key, version):
    """What a load leaves that was lost after its write and before its log entry."""
    v._with_audit(rows(ORDERS, raw_order(key)), "lost").write.parquet(f"{lake.raw('orders')}/_version={version}/_change=insert")


def test_rows_that_were_never_committed_are_not_taken_in(lake, rows):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1")), "f1")
    half_written(lake, rows, "O2", 2)
    assert feeds.pending(lake, "orders").count() == 1
    feeds.consume(lake, "orders")
    assert ids(lake) == ["O1"] and not feeds.position(lake, "orders").has_data
    v.append(lake, "orders", rows(ORDERS, raw_order("O2")), "f2")  # the retry
    feeds.consume(lake, "orders")
    feeds.consume(lake, "orders")
    assert ids(lake) == ["O1", "O2"] == sorted(r.order_id for r in v.as_of(lake, "orders").collect())


def test_what_a_lost_load_left_is_not_read_when_a_delete_gets_its_number(lake, rows):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1"), raw_order("O2")), "f1")
    half_written(lake, rows, "O9", 2)
    assert v.remove(lake, "orders", rows("order_id string", ("O1",))) == 2
    assert [r.order_id for r in v.as_of(lake, "orders").collect()] == ["O2"]
    feeds.consume(lake, "orders")
    assert ids(lake) == ["O1", "O2"]


def test_a_commit_between_position_and_start_is_neither_lost_nor_doubled(lake, rows):
    v.append(lake, "orders", rows(ORDERS, raw_order("O1")), "f1")
    at = feeds.position(lake, "orders")
    v.append(lake, "orders", rows(ORDERS, raw_order("O2")), "f2")
    assert feeds.consume(lake, "orders", at=at).through_version == 2
    assert not feeds.position(lake, "orders").has_data
    assert feeds.consume(lake, "orders").rows_staged == 0
    assert ids(lake) == ["O1", "O2"]


def test_errors_are_logged_whole_and_never_hide_the_failure(shop, monkeypatch):
    class Silent(Exception):
        def __str__(self):
            raise RuntimeError("no text")

    errors = {"orders": ValueError(), "web_events": Silent()}

    def broken(lake, feed, *args):
        raise errors[feed]

    monkeypatch.setattr(feeds, "consume", broken)
    with pytest.raises(ValueError):
        runs.run_loads(shop)
    found = {r.job: (r.state, r.error_message) for r in shop.log("runs").where("run_id = 1").collect()}
    assert found["orders"] == ("FAILED", "ValueError") and found["web_events"] == ("FAILED", "Silent")
    text = "first line\n" + "x" * 3000
    monkeypatch.setattr(feeds, "consume", lambda *a: (_ for _ in ()).throw(RuntimeError(text)))
    with pytest.raises(RuntimeError):
        runs.run_loads(shop)
    assert shop.log("runs").where("run_id = 2 and job = 'orders'").first().error_message == f"RuntimeError: {text}"


def test_a_reference_load_that_fails_leaves_the_old_table(shop, documents, monkeypatch):
    runs.refresh_products(shop)
    before = values(shop.staged("products"))
    v.append(shop, "products", documents('{"product_id":"P2","name":"ink"}'), "p2")
    real = staging.products
    monkeypatch.setattr(staging, "products", lambda raw: real(raw).selectExpr("*", "raise_error('lost') AS more"))
    with pytest.raises(Exception, match="lost"):
        runs.refresh_products(shop)
    assert values(shop.staged("products")) == before
    monkeypatch.setattr(staging, "products", real)
    runs.refresh_products(shop)
    assert shop.staged("products").count() == 2


def test_a_period_reads_its_month_folders_only(lake, rows, spark):
    from datetime import date

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    days = ["2026-01-10", "2026-02-10", "2026-03-10", None]
    v.append(lake, "orders", rows(ORDERS, *[raw_order(f"O{i}", d) for i, d in enumerate(days)]), "f1")
    feeds.consume(lake, "orders")
    period = lake.staged("orders", date(2026, 2, 1), date(2026, 2, 28))
    assert files_read(period) == 1 and [r.order_id for r in period.collect()] == ["O1"]
    assert files_read(lake.staged("orders")) == 4
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_events_lie_in_month_folders(lake, documents):
    v.append(lake, "web_events", documents('{"event_id":"1","timestamp":"2026-01-01T00:00:00"}', '{"event_id":"2"}'), "e1")
    feeds.consume(lake, "web_events")
    assert {p.split("event_month=")[1].split("/")[0] for p in lake.spark.read.parquet(lake.staging("web_events")).inputFiles()} == {"2026-01", "none"}
    assert lake.staged("web_events").count() == 2
