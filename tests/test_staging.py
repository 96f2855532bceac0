"""Clean-up rules on hand-made defects, and the two fixture paths against each other."""

from __future__ import annotations

from conftest import SMALL, values

from caravel import fixtures, schemas
from caravel.plans import catalogue, staging


def test_orders(rows):
    raw = rows(
        "order_id string, customer_id string, order_date timestamp_ntz, status string, total_amount decimal(12,2)",
        (" O1 ", " C1", None, "  PAID ", None),
        (None, "C2", None, "new", None),
    )
    assert values(staging.orders(raw)) == [("O1", "C1", None, None, "paid", None)]


def test_customers(rows):
    raw = rows(
        "customer_id string, email string, first_name string, last_name string, city string, signup_date date",
        (" C1 ", "  A@B.C ", " Ann", "Lee", "X", None),
        (None, "x@y.z", "N", "N", "Y", None),
    )
    assert values(staging.customers(raw)) == [("C1", "a@b.c", " Ann", "Lee", "X", None)]


def test_lines_are_filtered_enriched_and_never_lost_to_the_catalogue(rows):
    raw = rows(
        "order_id string, product_id string, quantity bigint, unit_price decimal(12,2)",
        ("O1", " P1 ", 3, "1.10"), ("O1", "P9", 1, "2.00"), ("O2", None, 1, "0.00"),
        ("O3", "P1", 0, "1.00"), ("O3", "P1", -1, "1.00"), ("O3", "P1", 1, "-0.01"),
        ("O3", "P1", None, "1.00"), ("O3", "P1", 1, None),
    )
    products = rows("product_id string, name string, category string, brand string", ("P1", "pen", "office", "B"))
    got = [tuple(str(v) if v is not None else None for v in r) for r in values(staging.order_items(raw, products))]
    assert got == [
        ("O1", "P1", "3", "1.10", "3.30", "pen", "office", "B"),
        ("O1", "P9", "1", "2.00", "2.00", None, None, None),
        ("O2", None, "1", "0.00", "0.00", None, None, None),
    ]


def test_repeated_product_multiplies_its_lines(rows):
    raw = rows("order_id string, product_id string, quantity bigint, unit_price decimal(12,2)", ("O1", "P1", 1, 1))
    products = rows(
        "product_id string, name string, category string, brand string", ("P1", "a", "c", "b"), ("P1", "z", "c", "b")
    )
    assert staging.order_items(raw, products).count() == 2


def test_products_tags_and_nested_fields(documents):
    raw = documents(
        '{"product_id":"P1","name":"n","price":"9.995","attributes":{"color":"red","warranty_months":24,"weight_g":12.5},"tags":["a","b"]}',
        '{"product_id":"P2","tags":[]}',
        '{"product_id":"P3","tags":null,"attributes":null}',
        '{"tags":"not an array"}',
    )
    got = {r.product_id: r for r in staging.products(raw).collect()}
    assert (got["P1"].color, got["P1"].warranty_months, got["P1"].weight_g, got["P1"].nb_tags) == ("red", 24, 13, 2)
    assert str(got["P1"].price) == "10.00"
    assert [got[k].nb_tags for k in ("P2", "P3", None)] == [0, 0, 0]


def test_events_null_and_missing_are_the_same(documents):
    raw = documents(
        '{"event_id":"1","user_id":null,"event_type":"Page_View","timestamp":"2026-05-05T10:00:00+02:00","context":{"referrer":null,"ip":"1.1.1.1"}}',
        '{"event_id":"2","event_type":"x","timestamp":"2026-05-05T23:59:59.5","device":"tv","context":{"referrer":"ads"}}',
        '{"event_id":"3","user_id":"C1","timestamp":null}',
        '{"event_id":null,"user_id":"C1"}',
        '{"user_id":"C1"}',
    )
    got = {r.event_id: r for r in staging.web_events(raw).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert [got[i].is_anonymous for i in "123"] == [True, True, False]
    assert [got[i].referrer for i in "123"] == ["direct", "ads", "direct"]
    assert (str(got["1"].event_ts), str(got["1"].event_date), got["1"].event_type) == (
        "2026-05-05 10:00:00", "2026-05-05", "page_view",
    )
    assert got["3"].event_ts is None


def test_null_profile_counts_missing_null_and_the_word(documents):
    raw = documents('{"user_id":null}', "{}", '{"user_id":"null"}', '{"user_id":"C1","product_id":"P","context":{"referrer":"r"}}')
    assert tuple(catalogue.event_null_profile(raw).first()) == (4, 3, 3, 3)


def test_tags_outer_and_inner(documents):
    raw = documents(
        '{"product_id":"P1","name":"n","tags":["a","b"]}', '{"product_id":"P2","name":"n","tags":[]}',
        '{"product_id":"P3","name":"n"}', '{"product_id":"P4","name":"n","tags":["a"]}',
    )
    assert values(catalogue.product_tags_outer(raw).select("product_id", "tag")) == [
        ("P1", "a"), ("P1", "b"), ("P2", None), ("P3", None), ("P4", "a"),
    ]
    assert values(catalogue.tag_distribution(raw)) == [("a", 2), ("b", 1)]


def test_transforms_return_the_declared_schemas(spark):
    got = {
        "orders": staging.orders(fixtures.raw_orders(spark, SMALL)),
        "customers": staging.customers(fixtures.raw_customers(spark, SMALL)),
        "products": staging.products(fixtures.raw_products(spark, SMALL)),
        "order_items": staging.order_items(
            fixtures.raw_order_items(spark, SMALL), staging.products(fixtures.raw_products(spark, SMALL))
        ),
        "web_events": staging.web_events(fixtures.raw_web_events(spark, SMALL)),
    }
    for table, frame in got.items():
        assert dict(frame.dtypes) == schemas.STAGING[table], table
