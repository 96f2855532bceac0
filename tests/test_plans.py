"""Physical plans stay free of pairwise joins and read the lines once."""

from __future__ import annotations

import pytest
from conftest import SMALL

from caravel.operators import joins
from caravel.plans import staging, states
from caravel.queries import QUERIES
from caravel.streaming import feeds
from caravel.workspace import cluster_conf

NAMES = [
    "dt_daily_revenue", "dt_top_products", "dt_customer_cohorts", "stg_order_items", "report_kpis",
    "report_top_products_filtered", "latest_orders", "events_by_device", "orphan_items", "orders_for_region",
]


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield spark
    for key in keys:
        spark.conf.unset(key)


def executed_plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_join_when_nothing_fits_a_broadcast(no_broadcast, name):
    frame = QUERIES[name](no_broadcast, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_sums_are_shuffled_by_product_and_reused_for_the_rank(no_broadcast):
    frame = QUERIES["dt_top_products"](no_broadcast, SMALL)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [product_id" in final


def test_changes_read_their_folders_and_columns_only(spark):
    frame = QUERIES["changes_inserts"](spark, SMALL)
    assert all("_change=insert" in path for path in frame.inputFiles())
    assert "_source_file" not in executed_plan(frame)


@pytest.fixture
def small_splits(no_broadcast):
    """A session that takes a few kilobytes for a large partition."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "12",
    }
    for key, value in settings.items():
        no_broadcast.conf.set(key, value)
    yield no_broadcast
    for key in settings:
        no_broadcast.conf.unset(key)


@pytest.mark.parametrize("join", ["sales_by", "without_match", "keep_keys", "split_join"])
def test_a_hot_key_is_split_although_one_side_is_aggregated(small_splits, join):
    from pyspark.sql import functions as F

    from caravel.operators import joins
    from caravel.plans import marts

    n = 60_000
    hot = F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 500).cast("string")
    lines = small_splits.range(0, n, 1, 12).select(
        hot.alias("order_id"), F.md5(F.col("id").cast("string")).alias("product_id"), F.lit(1).alias("quantity"), F.lit(2).alias("line_amount")
    )
    orders = small_splits.range(0, 1000, 1, 4).select((F.col("id") % 500).cast("string").alias("order_id"))
    frame = {
        "sales_by": lambda: marts.sales_by(lines, orders, ["product_id"]).agg(F.sum("units_sold").alias("n")),
        "without_match": lambda: joins.without_match(lines, orders.where("order_id <> '0'"), "order_id").agg(F.count("*").alias("n")),
        "keep_keys": lambda: joins.keep_keys(lines, orders, "order_id").agg(F.count("*").alias("n")),
        "split_join": lambda: joins.split_join(lines, joins.with_copies(orders, "order_id"), "order_id").agg(F.sum("copies").alias("n")),
    }[join]()
    total = frame.first()["n"]
    plan = executed_plan(frame)
    assert "skew=true" in plan
    assert total == {"sales_by": 2 * n, "keep_keys": n, "split_join": 2 * n}.get(join, lines.where("order_id = '0'").count())


def test_cluster_settings_follow_the_size_of_the_shuffle():
    small, large = cluster_conf(1 << 30, 64), cluster_conf(20 << 40, 4000)
    assert small["spark.sql.shuffle.partitions"] == "64"
    assert int(large["spark.sql.shuffle.partitions"]) == 20 * 4096


def test_lines_without_an_order_of_the_window_do_not_shuffle(no_broadcast):
    items = no_broadcast.range(20000).selectExpr(
        "concat('O', id) AS order_id", "'p' AS product_id", "'n' AS product_name", "'c' AS category", "'b' AS brand",
        "id AS quantity", "CAST(1 AS DECIMAL(14,2)) AS line_amount",
    )
    orders = no_broadcast.range(100).selectExpr("concat('O', id * 7) AS order_id", "DATE '2026-01-01' AS order_date")
    sales = states.day_sales(items, orders)
    assert [r["units_sold"] for r in sales.collect()] == [sum(range(0, 700, 7))]
    node = sales._jdf.queryExecution().executedPlan()
    plan = node.toString().split("== Initial Plan ==")[0]
    lines = plan[plan.index("SortMergeJoin"):]
    assert "BroadcastHashJoin" in lines and "LeftSemi" in lines


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_filter_before_a_join_misses_no_match(spark, monkeypatch, words):
    monkeypatch.setattr(joins, "FILTER_WORDS", words)
    rows = spark.range(20000).selectExpr("CASE WHEN id > 0 THEN concat('O', id) END AS k", "id")
    others = spark.range(0, 40000, 97).selectExpr("CASE WHEN id > 0 THEN concat('O', id) END AS k")
    passed = joins.possible_matches(rows, others.unionByName(others), "k")
    assert passed.columns == ["k", "id"]
    found = [r["id"] for r in passed.collect()]
    assert len(found) == len(set(found)) and set(found) >= set(range(97, 20000, 97))
    assert words == 1 or len(found) < 230
    assert joins.possible_matches(rows, others.limit(0), "k").isEmpty()


def test_amounts_of_lines_do_not_shuffle_with_them(no_broadcast):
    raw = no_broadcast.sql("SELECT 'O1' AS order_id, concat('P', id) AS product_id, id + 1 AS quantity, CAST(2 AS DECIMAL(12,2)) AS unit_price FROM range(9)")
    catalogue = no_broadcast.sql("SELECT concat('P', id) AS product_id, 'n' AS name, 'c' AS category, 'b' AS brand FROM range(8)")
    frame = staging.order_items(raw, catalogue)
    assert sum(r["line_amount"] for r in frame.collect()) == 90
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "line_amount" in plan and "line_amount" not in plan[plan.index("Join"):]


def test_lines_are_not_sorted_to_be_written_by_folder(spark, lake, monkeypatch):
    """Spark sorts the lines of a task by folder, unless it may keep more files open than there are folders."""
    key, open_files = "spark.sql.maxConcurrentOutputFileWriters", []
    lines = spark.range(9).selectExpr(
        "'O1' AS order_id", "concat('P', id) AS product_id", "id AS quantity", "CAST(1 AS DECIMAL(12,2)) AS unit_price",
        "CAST(1 AS DECIMAL(14,2)) AS line_amount", "CASE WHEN id % 3 > 0 THEN 'n' END AS product_name",
        "CAST(NULL AS STRING) AS category", "CAST(NULL AS STRING) AS brand",
    )
    writer, path = type(lines.write), f"{lake.staging('order_items')}/_src_batch=b"
    real, before = writer.parquet, spark.conf.get(key)
    monkeypatch.setattr(writer, "parquet", lambda self, *args: (open_files.append(spark.conf.get(key)), real(self, *args))[1])
    assert feeds.write_batch("order_items", lines, path) == 9
    assert (open_files, spark.conf.get(key)) == (["3"], before)
    assert [spark.read.parquet(f"{path}/_late={n}").count() for n in (0, 1)] == [6, 3]
