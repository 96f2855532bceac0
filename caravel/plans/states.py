"""Small states from which marts follow, and how new rows change them.

Top products keep the sales of each day of the window and product. An order counts its lines, and a line counts for its orders, so new
rows add what new orders make of all lines and what new lines make of the orders that were there; days that the window has left
are dropped. Cohorts keep, for each customer and year, the months with an order as bits: new orders are merged by OR.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions.money import rounded_money
from caravel.operators.joins import possible_matches, split_join
from caravel.operators.ranking import rank_at_most
from caravel.plans import marts

DAYS, TOP = 30, 20
MONEY = "decimal(38,2)"


def day_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Units and revenue per day and product; an order that is there several times counts its lines as often.

    The orders are those of a window, so most lines have none of them and are left out before lines shuffle.
    """
    copies = orders.groupBy("order_id", "order_date").agg(F.count(F.lit(1)).alias("copies"))
    lines = split_join(possible_matches(items, orders, "order_id"), copies, "order_id")
    alike = lines.groupBy("order_date", *marts.PRODUCT_KEYS, "copies").agg(F.sum("quantity").alias("_units"), F.sum("line_amount").alias("_sum"))
    return _added(alike.withColumns({"units_sold": F.col("_units") * F.col("copies"), "revenue": (F.col("_sum") * F.col("copies")).cast(MONEY)}))


def _added(sales: DataFrame) -> DataFrame:
    units, revenue = F.sum("units_sold").alias("units_sold"), F.sum("revenue").cast(MONEY).alias("revenue")
    return sales.groupBy("order_date", *marts.PRODUCT_KEYS).agg(units, revenue)


def updated_sales(state: DataFrame, first: date, new_orders: DataFrame, all_items: DataFrame, old_orders: DataFrame, new_items: DataFrame) -> DataFrame:
    """The state after new rows, for the window that begins at ``first``; the orders are those of the window."""
    kept = state.where(F.col("order_date") >= F.lit(first))
    return _added(kept.unionByName(day_sales(all_items, new_orders)).unionByName(day_sales(new_items, old_orders)))


def top_products(sales: DataFrame, k: int = TOP) -> DataFrame:
    sold = marts.regroup(sales, marts.PRODUCT_KEYS)
    return rank_at_most(sold.withColumn("revenue", rounded_money(F.col("revenue"))), "revenue", k, "revenue_rank")


def active_months(orders: DataFrame) -> DataFrame:
    """Customer, year and the months with an order as bits, January the lowest."""
    known = orders.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
    bit = F.expr("shiftleft(1, month(order_date) - 1)")
    return known.groupBy("customer_id", F.year("order_date").alias("year")).agg(F.bit_or(bit).alias("months"))


def merged_months(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.unionByName(more).groupBy("customer_id", "year").agg(F.bit_or("months").alias("months"))


def customer_cohorts(customers: DataFrame, active: DataFrame) -> DataFrame:
    set_months = "filter(transform(sequence(1, 12), m -> if((months & shiftleft(1, m - 1)) <> 0, make_date(year, m, 1), null)), d -> d IS NOT NULL)"
    return marts.retention(customers, active.select("customer_id", F.expr(set_months).alias("_months")))
