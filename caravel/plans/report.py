"""The report queries behind the sales dashboard.

``ReportFilters`` holds what a reader picked; empty choices mean "everything".  Filters are put on
plain columns (the timestamp rather than the derived date), so they reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions.calendar import midnight, month_label, period_start
from caravel.functions.money import percent_of, rounded_money
from caravel.functions.text import full_name
from caravel.operators.ranking import largest
from caravel.plans.marts import daily_figures, daily_revenue, product_sales, regroup, since_last

# The steps of the purchase path, in order.
FUNNEL_STEPS = ("page_view", "add_to_cart", "checkout", "purchase")


@dataclass(frozen=True)
class ReportFilters:
    date_from: date | None = None
    date_to: date | None = None
    statuses: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    devices: tuple[str, ...] = ()
    grain: str = "day"
    top_n: int = 10


def any_of(column: str, choices: tuple[str, ...]) -> Column:
    """Membership; no choice made is no constraint."""
    return F.col(column).isin(*choices) if choices else F.lit(True)


def within(moment: str, filters: ReportFilters) -> Column:
    """Both day bounds inclusive; a row without a date is in no period."""
    inside = F.col(moment).isNotNull()
    if filters.date_from is not None:
        inside = inside & (F.col(moment) >= midnight(F.lit(filters.date_from)))
    if filters.date_to is not None:
        inside = inside & (F.col(moment) < midnight(F.lit(filters.date_to + timedelta(days=1))))
    return inside


def chosen_orders(orders: DataFrame, filters: ReportFilters) -> DataFrame:
    return orders.where(within("order_ts", filters) & any_of("status", filters.statuses))


def chosen_events(events: DataFrame, filters: ReportFilters) -> DataFrame:
    return events.where(within("event_ts", filters) & any_of("device", filters.devices))


def daily(orders: DataFrame, filters: ReportFilters) -> DataFrame:
    return daily_revenue(chosen_orders(orders, filters)).orderBy("order_date")


def unique_customers(orders: DataFrame, filters: ReportFilters) -> DataFrame:
    buyers = F.count_distinct(F.col("customer_id"))
    return chosen_orders(orders, filters).agg(buyers.alias("unique_customers"))


def kpis(orders: DataFrame, filters: ReportFilters) -> DataFrame:
    """Last day's figures, their change from the day with data before it, and period totals.

    The two newest days are found from the dates alone; only their orders are counted per day, and
    only those two rows go through the unpartitioned window.  No row when nothing was chosen.
    """
    chosen = chosen_orders(orders, filters)
    newest_first = F.col("order_date").desc()
    two_days = largest(chosen.select("order_date").distinct(), 2, newest_first)
    since = two_days.agg(F.min("order_date")).scalar()
    days = daily_revenue(chosen.where(F.col("order_ts") >= midnight(since)))
    before = Window.orderBy("order_date")
    figures = ("nb_orders", "avg_basket", "revenue")
    changes = [(F.col(c) - F.lag(c).over(before)).alias(f"{c}_delta") for c in figures]
    last = largest(days, 2, newest_first).select("order_date", *figures, *changes)
    period = chosen.agg(
        F.struct(
            rounded_money(F.sum("total_amount")).alias("revenue"),
            F.count_distinct(F.col("customer_id")).alias("customers"),
        )
    ).scalar()
    return largest(last, 1, newest_first).select(
        F.col("order_date").alias("last_day"),
        *[c for name in figures for c in (name, f"{name}_delta")],
        period.getField("revenue").alias("total_revenue"),
        period.getField("customers").alias("unique_customers"),
    )


def last_days(orders: DataFrame, filters: ReportFilters, days: int = 14) -> DataFrame:
    """Daily revenue of the newest ``days`` days (the newest one included)."""
    recent = since_last(chosen_orders(orders, filters), days - 1)
    return daily_revenue(recent).select("order_date", "revenue").orderBy("order_date")


def trend(orders: DataFrame, filters: ReportFilters) -> DataFrame:
    """Orders and revenue per day, week or month."""
    period = period_start(F.col("order_date"), filters.grain)
    periods = daily_figures(chosen_orders(orders, filters).withColumn("period", period), "period")
    return periods.select("period", "nb_orders", "revenue").orderBy("period")


def _chosen_sales(
    items: DataFrame, orders: DataFrame, filters: ReportFilters, catalogue: DataFrame | None, keys: list[str]
) -> DataFrame:
    sold = product_sales(items, chosen_orders(orders, filters), catalogue)
    return regroup(sold.where(any_of("category", filters.categories)), keys)


def top_products(
    items: DataFrame, orders: DataFrame, filters: ReportFilters, catalogue: DataFrame | None = None
) -> DataFrame:
    """Best sellers by name (products that share name, category and brand are one row)."""
    keys = ["product_name", "category", "brand"]
    sold = _chosen_sales(items, orders, filters, catalogue, keys)
    return largest(
        sold, filters.top_n, F.col("revenue").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in keys]
    )


def revenue_by_category(
    items: DataFrame, orders: DataFrame, filters: ReportFilters, catalogue: DataFrame | None = None
) -> DataFrame:
    sold = _chosen_sales(items, orders, filters, catalogue, ["category"])
    return sold.select("category", "revenue").orderBy(
        F.col("revenue").desc_nulls_last(), F.col("category").asc_nulls_last()
    )


def funnel(events: DataFrame, filters: ReportFilters, steps: tuple[str, ...] = FUNNEL_STEPS) -> DataFrame:
    """Events per step in the given order, 0 for a step that never happens, share of the first step.

    The steps are counted independently (no path per session), in one pass without a join.
    """
    counted = [F.count_if(F.col("event_type") == step).alias(f"n{i}") for i, step in enumerate(steps)]
    wide = chosen_events(events, filters).where(F.col("event_type").isin(*steps)).agg(*counted)
    rows = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("step_no"),
            F.lit(step).alias("step"),
            F.col(f"n{i}").alias("n"),
            percent_of(F.col(f"n{i}"), F.col("n0")).alias("pct_of_first"),
        )
        for i, step in enumerate(steps)
    ]
    return wide.select(F.inline(F.array(*rows)))


def events_by_device(events: DataFrame, filters: ReportFilters) -> DataFrame:
    """Events per device and their share of all chosen events."""
    chosen = chosen_events(events, filters)
    counted = chosen.groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    everything = counted.agg(F.sum("n")).scalar()
    return counted.select("device", "n", percent_of(F.col("n"), everything).alias("pct")).orderBy(
        F.col("n").desc(), F.col("device").asc_nulls_last()
    )


def cohort_heatmap(cohorts: DataFrame, last_offset: int = 12) -> DataFrame:
    """Retention, one row per signup month and one column per month offset, NULL where none."""
    offsets = list(range(last_offset + 1))
    wide = (
        cohorts.where(F.col("months_since_signup").between(0, last_offset))
        .groupBy(month_label(F.col("cohort_month")).alias("cohort"))
        .pivot("months_since_signup", offsets)
        .agg(F.max("retention_pct"))
    )
    return wide.select("cohort", *[F.col(str(i)).alias(f"m{i}") for i in offsets]).orderBy("cohort")


def latest_orders(orders: DataFrame, customers: DataFrame, filters: ReportFilters, n: int = 50) -> DataFrame:
    """Newest orders with the customer's name.

    The cut comes before the join: every order yields at least one row, so the first ``n`` joined
    rows belong to the first ``n`` orders.  Customer rows with the same id and name are folded to a
    count first (more than ``n`` of them cannot show), then unfolded.
    """
    order = [
        F.col("order_ts").desc_nulls_last(),
        F.col("order_id"),
        *[F.col(c).asc_nulls_last() for c in ("customer_id", "status", "total_amount")],
    ]
    columns = ["order_id", "order_ts", "customer_id", "status", "total_amount"]
    newest = largest(chosen_orders(orders, filters).select(*columns), n, *order)
    client = full_name(F.col("first_name"), F.col("last_name")).alias("client")
    names = customers.groupBy("customer_id", client).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("_copies"))
    joined = newest.join(names, "customer_id", "left")
    unfolded = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)))))
    shown = unfolded.select("order_id", "order_ts", "customer_id", "client", "status", "total_amount")
    return largest(shown, n, *order, F.col("client").asc_nulls_last())


def display_orders(latest: DataFrame) -> DataFrame:
    """Latest orders with the column names and texts that the dashboard shows; amounts in cents, rounded half up as stored."""
    cents = F.translate(F.format_number(F.col("total_amount"), 2), ",", "")
    return latest.select(
        F.col("order_id").alias("Commande"),
        F.date_format("order_ts", "dd/MM/yyyy HH:mm").alias("Date/heure"),
        F.col("customer_id").alias("ID client"),
        F.col("client").alias("Client"),
        F.col("status").alias("Statut"),
        F.concat(cents, F.lit(" €")).alias("Montant"),
    )


def money_text(amount: Column) -> Column:
    """Whole euros for display, a dash when there is no amount."""
    grouped = F.translate(F.format_number(F.round(amount, 0).cast("decimal(38,0)"), 0), ",", " ")
    return F.coalesce(F.concat(grouped, F.lit(" €")), F.lit("—"))
