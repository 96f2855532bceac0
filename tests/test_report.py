"""Report filters and figures on small tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from conftest import values
from pyspark.sql import functions as F
from test_marts import ITEMS, ORDERS, item, order

from caravel.plans import policy, quality, report
from caravel.plans.report import ReportFilters

EVENTS = "event_id string, event_type string, event_ts timestamp_ntz, device string"
ALL = ReportFilters()


def some_orders(rows):
    return rows(
        ORDERS,
        order("O1", "C1", "2026-01-01", "10.00"), order("O2", "C2", "2026-01-01", "20.00", "open"),
        order("O3", "C1", "2026-01-05", "6.00"), order("O4", None, "2026-01-20", "1.00", None),
        order("O5", "C3", None, "99.00"),
    )


def test_no_choice_is_no_constraint_but_needs_a_date(rows):
    assert report.chosen_orders(some_orders(rows), ALL).count() == 4


def test_bounds_are_inclusive_and_choices_restrict(rows):
    picked = ReportFilters(date(2026, 1, 1), date(2026, 1, 5), ("paid", "it's"))
    assert values(report.chosen_orders(some_orders(rows), picked).select("order_id")) == [("O1",), ("O3",)]


def test_filter_reaches_the_scan(spark, tmp_path, rows):
    some_orders(rows).write.parquet(str(tmp_path / "o"))
    stored = spark.read.parquet(str(tmp_path / "o"))
    picked = ReportFilters(date(2026, 1, 1), date(2026, 1, 5), ("paid",))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = report.daily(stored, picked)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(order_ts,2026-01-01T00:00)" in plan
    assert "LessThan(order_ts,2026-01-06T00:00)" in plan
    assert "EqualTo(status,paid)" in plan


def test_kpis_compare_with_the_previous_day_that_has_data(rows):
    got = report.kpis(some_orders(rows), ALL).first().asDict()
    assert got == {
        "last_day": date(2026, 1, 20), "nb_orders": 1, "nb_orders_delta": 0,
        "avg_basket": Decimal("1.00"), "avg_basket_delta": Decimal("-5.00"),
        "revenue": Decimal("1.00"), "revenue_delta": Decimal("-5.00"),
        "total_revenue": Decimal("37.00"), "unique_customers": 2,
    }


def test_kpis_of_one_day_and_of_none(rows):
    one = report.kpis(some_orders(rows), ReportFilters(date(2026, 1, 5), date(2026, 1, 5))).first()
    assert (one.nb_orders, one.nb_orders_delta, one.revenue_delta) == (1, None, None)
    assert report.kpis(some_orders(rows), ReportFilters(date(2030, 1, 1))).isEmpty()


def test_last_days_counts_calendar_days_back_from_the_newest(rows):
    assert [r.order_date.day for r in report.last_days(some_orders(rows), ALL, 16).collect()] == [5, 20]
    assert [r.order_date.day for r in report.last_days(some_orders(rows), ALL, 15).collect()] == [20]


def test_trend_weeks_start_on_monday(rows):
    got = report.trend(some_orders(rows), ReportFilters(grain="week")).collect()
    assert [(str(r.period), r.nb_orders) for r in got] == [("2025-12-29", 2), ("2026-01-05", 1), ("2026-01-19", 1)]


def test_products_of_the_same_name_merge_and_ties_have_an_order(rows):
    items = rows(
        ITEMS, item("O1", "P1", 1, "5.00", "pen"), item("O3", "P2", 1, "5.00", "pen"),
        item("O1", "P3", 1, "10.00", "ink"), item("O1", "P4", 1, "1.00", None, None, None),
    )
    got = report.top_products(items, some_orders(rows), ReportFilters(top_n=2)).collect()
    assert [(r.product_name, str(r.revenue)) for r in got] == [("ink", "10.00"), ("pen", "10.00")]
    unknown = report.revenue_by_category(items, some_orders(rows), ALL).collect()
    assert [(r.category, str(r.revenue)) for r in unknown] == [("c", "20.00"), (None, "1.00")]
    only = report.revenue_by_category(items, some_orders(rows), ReportFilters(categories=("c",)))
    assert only.count() == 1


def test_funnel_keeps_order_and_fills_missing_steps(rows):
    events = rows(
        EVENTS, ("1", "page_view", "2026-01-01 00:00:00", "tv"), ("2", "page_view", "2026-01-01 23:59:59", None),
        ("3", "purchase", "2026-01-02 00:00:00", "tv"), ("4", "other", "2026-01-02 00:00:00", "tv"),
    )
    got = report.funnel(events, ALL).collect()
    assert [(r.step, r.n, str(r.pct_of_first)) for r in got] == [
        ("page_view", 2, "100.00"), ("add_to_cart", 0, "0.00"), ("checkout", 0, "0.00"), ("purchase", 1, "50.00"),
    ]
    none = report.funnel(events, ReportFilters(devices=("radio",))).collect()
    assert [(r.n, r.pct_of_first) for r in none] == [(0, None)] * 4
    shares = report.events_by_device(events, ReportFilters(date(2026, 1, 1), date(2026, 1, 1))).collect()
    assert [(r.device, r.n, str(r.pct)) for r in shares] == [("tv", 1, "50.00"), (None, 1, "50.00")]


def test_heatmap_has_a_column_per_offset_and_holes(rows):
    cohorts = rows(
        "cohort_month date, months_since_signup bigint, retention_pct decimal(8,2)",
        ("2026-01-01", 0, "50.00"), ("2026-01-01", 12, "5.00"), ("2026-01-01", 13, "1.00"), ("2026-02-01", 1, "7.00"),
    )
    got = [tuple(r) for r in report.cohort_heatmap(cohorts).select("cohort", "m0", "m1", "m12").collect()]
    assert got == [
        ("2026-01", Decimal("50.00"), None, Decimal("5.00")), ("2026-02", None, Decimal("7.00"), None),
    ]
    assert len(report.cohort_heatmap(cohorts).columns) == 14


def test_latest_orders_names_copies_and_unknown_customers(rows):
    customers = rows(
        "customer_id string, first_name string, last_name string",
        *[("C1", "Ann", "Lee")] * 60, ("C1", "Bo", "Li"), ("C2", "Cy", None),
    )
    got = report.latest_orders(some_orders(rows), customers, ALL).collect()
    assert len(got) == 50
    assert (got[0].order_id, got[0].client) == ("O4", None)
    assert {(r.order_id, r.client) for r in got[1:]} == {("O3", "Ann Lee")}
    whole = report.latest_orders(some_orders(rows), customers, ALL, 1000).collect()
    assert len(whole) == 1 + 61 + 61 + 1
    assert [r.client for r in whole if r.order_id == "O2"] == [None]


def test_money_text(rows):
    frame = rows("a decimal(18,2)", ("1234567.50",), ("-0.4",), (None,))
    assert [r[0] for r in frame.select(report.money_text(F.col("a"))).collect()] == ["1 234 568 €", "0 €", "—"]


def test_masking_and_city_limits(rows):
    customers = rows(
        "customer_id string, email string, city string", ("C1", "ann@x.org", "A"), ("C1", "ann@x.org", "A"),
        ("C2", "nope", "B"), ("C3", None, None),
    )
    assert values(policy.customers_view(customers, False).select("customer_id", "email").distinct()) == [
        ("C1", "a***@x.org"), ("C2", "***"), ("C3", None),
    ]
    assert policy.customers_view(customers, True) is customers
    assert values(policy.orders_for_cities(some_orders(rows), customers, ("A",)).select("order_id")) == [("O1",), ("O3",)]
    assert policy.orders_for_cities(some_orders(rows), customers, ()).isEmpty()


def test_quality_report_passes_and_fails(rows, documents):
    orders = rows("order_id string, order_date timestamp_ntz", ("O1", None), ("O1", "2026-01-01 00:00:00"), (None, None))
    items = rows(
        "order_id string, quantity bigint, unit_price decimal(12,2)", ("O1", 1, "1"), ("O9", 0, None), (None, None, "-1")
    )
    found = quality.quality_report(
        orders, items, documents('{"product_id":"P"}', '{"product_id":"P"}', "{}"), documents('{"event_id":null}'),
        {"orders_without_id": "0.34"},
    )
    assert {r.check_name: (r.observed, r.passed) for r in found.collect()} == {
        "orders_repeated_id": (1, False), "orders_without_id": (1, True), "orders_without_date": (2, False),
        "items_bad_quantity": (2, False), "items_bad_price": (2, False), "items_without_order": (2, False),
        "products_repeated_id": (1, False), "products_without_id": (1, False), "events_without_id": (1, False),
    }
    assert quality.failures(found).count() == 8
