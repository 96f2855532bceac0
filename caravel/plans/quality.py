"""Data-quality checks gathered into one pass/fail table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.functions import documents as doc
from caravel.operators.joins import without_match


# Checks on each RAW table.
CHECKS = {
    "orders": ("orders_repeated_id", "orders_without_id", "orders_without_date"),
    "order_items": ("items_bad_quantity", "items_bad_price", "items_without_order"),
    "products": ("products_repeated_id", "products_without_id"),
    "web_events": ("events_without_id",),
}


def as_rows(one_row: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Turn the columns of a one-row aggregate (but for ``_rows``) into check rows."""
    checks = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.col(name).cast("bigint").alias("observed"),
            (F.floor(F.col("_rows") * F.lit(shares[name]).cast("decimal(18,9)")) if name in shares else F.lit(0))
            .cast("bigint")
            .alias("allowed"),
        )
        for name in one_row.columns
        if name != "_rows"
    ]
    rows = one_row.select(F.inline(F.array(*checks)))
    return rows.withColumn("passed", F.col("observed") <= F.col("allowed"))


def _extra_copies(key: str | Column) -> Column:
    """Rows beyond the first of each key."""
    return F.count(key) - F.count_distinct(F.col(key) if isinstance(key, str) else key)


def keyed(table: str, raw: DataFrame) -> DataFrame:
    """A RAW table with its id as a column."""
    ids = {"products": "product_id", "web_events": "event_id"}
    return raw.select(doc.text_at(F.col("data"), ids[table]).alias(ids[table])) if table in ids else raw


def row_counts(table: str) -> list[Column]:
    """Counts of a RAW table that add up over any split of its rows, the number of rows as ``_rows``."""
    if table == "orders":
        defects = {"orders_without_id": F.col("order_id").isNull(), "orders_without_date": F.col("order_date").isNull()}
    elif table == "order_items":
        defects = {
            "items_bad_quantity": ~F.coalesce(F.col("quantity") > 0, F.lit(False)),
            "items_bad_price": ~F.coalesce(F.col("unit_price") >= 0, F.lit(False)),
        }
    elif table == "products":
        defects = {"products_without_id": F.col("product_id").isNull()}
    else:
        defects = {"events_without_id": F.col("event_id").isNull()}
    return [*[F.count_if(test).alias(name) for name, test in defects.items()], F.count(F.lit(1)).alias("_rows")]


def quality_report(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    events: DataFrame,
    shares: dict[str, str] | None = None,
) -> DataFrame:
    """Checks on the RAW tables: observed defects against the share of rows allowed (none unless given).

    One aggregate per table answers all its checks but the orphan check, which joins lines and
    orders and so reads these two once more.
    """
    shares = shares or {}
    total = F.count(F.lit(1)).alias("_rows")
    on_orders = orders.agg(_extra_copies("order_id").alias("orders_repeated_id"), *row_counts("orders"))
    on_items = items.agg(*row_counts("order_items"))
    orphans = without_match(items, orders, "order_id").agg(F.count(F.lit(1)).alias("items_without_order"), total)
    ids = keyed("products", products)
    on_products = ids.agg(_extra_copies("product_id").alias("products_repeated_id"), *row_counts("products"))
    on_events = keyed("web_events", events).agg(*row_counts("web_events"))
    parts = [on_orders, on_items, orphans, on_products, on_events]
    return reduce(DataFrame.unionByName, [as_rows(p, shares) for p in parts])


def failures(report: DataFrame) -> DataFrame:
    """What an alert should mention."""
    return report.where(~F.col("passed"))
