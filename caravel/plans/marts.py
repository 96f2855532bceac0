"""The three marts over STAGING."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions.calendar import midnight, month_start, months_apart
from caravel.functions.money import percent_of, rounded_money, safe_ratio
from caravel.operators.joins import split_join, with_copies
from caravel.operators.ranking import largest, rank_at_most
from caravel.plans.staging import with_product

PRODUCT_KEYS = ["product_id", "product_name", "category", "brand"]


def daily_figures(orders: DataFrame, *keys: str) -> DataFrame:
    """Orders, revenue and average basket per key.

    Revenue adds every row, the count is of distinct ids; Spark groups by (key, id) first and by
    key second, both with map-side partial results, so a day with most of the rows is spread.
    """
    n, total = F.count_distinct(F.col("order_id")), F.sum("total_amount")
    return orders.groupBy(*keys).agg(
        n.alias("nb_orders"), rounded_money(total).alias("revenue"), safe_ratio(total, n).alias("avg_basket")
    )


def daily_revenue(orders: DataFrame) -> DataFrame:
    return daily_figures(orders, "order_date")


def sales_by(items: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Units and revenue of the lines of the given orders, per key.

    Lines are added up per key and number of order copies, which is nearly always one, and
    multiplied afterwards: no wide-decimal product per line.
    """
    lines = split_join(items, with_copies(orders, "order_id"), "order_id")
    alike = lines.groupBy(*keys, "copies").agg(F.sum("quantity").alias("_units"), F.sum("line_amount").alias("_sum"))
    units, revenue = F.sum(F.col("_units") * F.col("copies")), F.sum(F.col("_sum") * F.col("copies"))
    return alike.groupBy(*keys).agg(units.alias("units_sold"), revenue.alias("revenue"))


def product_sales(items: DataFrame, orders: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Units and revenue per product with its name, category and brand.

    STAGING lines carry those already.  Bare lines come with a ``catalogue``: then the sums are
    formed per product id and the catalogue meets the sums, so no line shuffles by product.
    """
    if catalogue is None:
        return sales_by(items, orders, PRODUCT_KEYS)
    return regroup(with_product(sales_by(items, orders, ["product_id"]), catalogue), PRODUCT_KEYS)


def regroup(sold: DataFrame, keys: list[str]) -> DataFrame:
    """Sales added up to coarser keys."""
    units, revenue = F.sum("units_sold").alias("units_sold"), rounded_money(F.sum("revenue")).alias("revenue")
    return sold.groupBy(*keys).agg(units, revenue)


def since_last(orders: DataFrame, days: int) -> DataFrame:
    """Orders of the last ``days`` days before the newest order.

    The bound is a scalar subquery compared with the timestamp column, so it reaches the scan.
    """
    newest = orders.agg(F.date_add(F.max("order_date"), -days)).scalar()
    return orders.where(F.col("order_ts") >= midnight(newest))


def top_products(
    items: DataFrame, orders: DataFrame, catalogue: DataFrame | None = None, days: int = 30, k: int = 20
) -> DataFrame:
    """Products with revenue rank up to ``k`` (ties included) over the last days of data."""
    sold = product_sales(items, since_last(orders, days), catalogue)
    money = sold.withColumn("revenue", rounded_money(F.col("revenue")))
    return rank_at_most(money, "revenue", k, "revenue_rank")


def customer_cohorts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Retention in long form: one row per signup month and month offset with activity.

    Both sides shrink to one row per customer with the set of its months (as many as the calendar
    has, whatever the number of orders) before they meet, so each is shuffled once, on the join key,
    and a customer with very many orders is no heavier than any other.  Every (customer, cohort,
    month) then occurs once and active customers are a plain count.  Cohort size counts customer rows.
    """
    active = orders.groupBy("customer_id").agg(F.collect_set(month_start(F.col("order_date"))).alias("_months"))
    return retention(customers, active)


def retention(customers: DataFrame, active: DataFrame) -> DataFrame:
    """Cohorts from customers and their months with orders (``_months``), every customer and month once."""
    signed = customers.where(F.col("signup_date").isNotNull()).select(
        "customer_id", month_start(F.col("signup_date")).alias("cohort_month")
    )
    size = signed.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    member = signed.groupBy("customer_id").agg(F.collect_set("cohort_month").alias("_cohorts"))
    both = member.join(active, "customer_id").select(F.explode("_cohorts").alias("cohort_month"), "_months")
    seen = both.select("cohort_month", F.explode("_months").alias("_month"))
    offset = months_apart(F.col("cohort_month"), F.col("_month")).alias("months_since_signup")
    kept = seen.where(F.col("_month") >= F.col("cohort_month")).groupBy("cohort_month", offset)
    counted = kept.agg(F.count(F.lit(1)).alias("active_customers"))
    rate = percent_of(F.col("active_customers"), F.col("cohort_size"))
    return counted.join(size, "cohort_month").select(
        "cohort_month", "months_since_signup", "cohort_size", "active_customers", rate.alias("retention_pct")
    )


def latest_days(daily: DataFrame, n: int = 14) -> DataFrame:
    return largest(daily, n, F.col("order_date").desc_nulls_last())


def top_listing(top: DataFrame, n: int = 20) -> DataFrame:
    """Exactly ``n`` of the ranked products; equal ranks in order of their keys."""
    return largest(top, n, F.col("revenue_rank"), *[F.col(c).asc_nulls_last() for c in PRODUCT_KEYS])


def cohort_head(cohorts: DataFrame, n: int = 50) -> DataFrame:
    return largest(cohorts, n, F.col("cohort_month"), F.col("months_since_signup"))
