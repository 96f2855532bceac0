"""Lines that come before their product: STAGING and marts equal a rebuild, whatever the order of arrival."""

from __future__ import annotations

import random

import pytest
from conftest import values

from caravel.operators import late
from caravel.plans import marts, refresh, staging
from caravel.sources import versions as v
from caravel.streaming import feeds, runs

ORDERS = "order_id string, customer_id string, order_date timestamp_ntz, status string, total_amount decimal(12,2)"
ITEMS = "order_id string, product_id string, quantity bigint, unit_price decimal(12,2)"


def product(key, name="pen"):
    return f'{{"product_id":"{key}","name":"{name} {key}","category":"c","brand":"b"}}'


def rebuilt(lake):
    return staging.order_items(v.as_of(lake, "order_items"), staging.products(v.as_of(lake, "products")))


def look(lake):
    return [r.row_count for r in lake.log("batches").where("table_name = 'labels'").orderBy("written_at").collect()]


def test_any_order_of_arrival_equals_a_rebuild(lake, rows, documents):
    draw = random.Random(1)
    keys = [f"P{i}" for i in range(9)]
    draw.shuffle(keys)
    arrivals = [[], keys[:3], keys[3:6]]
    for turn, came in enumerate(arrivals):
        if came or turn == 0:
            v.append(lake, "products", documents(product("Q"), product(keys[0] + "x")) if not came else documents(*map(product, came)), f"p{turn}")
        lines = [(f"O{draw.randint(0, 9)}", draw.choice([None, "Q", " P1 ", *keys]), draw.randint(1, 3), "2.50") for _ in range(25)]
        v.append(lake, "order_items", rows(ITEMS, *lines), f"i{turn}")
        orders = [(f"O{turn * 2 + i}", "C1", f"2026-01-{10 + turn} 08:00:00", "new", "1.00") for i in range(3)]
        v.append(lake, "orders", rows(ORDERS, *orders), f"o{turn}")
        runs.run_loads(lake)
        assert values(lake.staged("order_items")) == values(rebuilt(lake))
        assert refresh.refresh(lake, refresh.TOP) == (refresh.INCREMENTAL if turn else refresh.FULL)
        whole = marts.top_products(rebuilt(lake), lake.staged("orders"))
        assert values(refresh.read(lake, refresh.TOP)) == values(whole)
    assert sum(n or 0 for n in look(lake)) >= 4


def test_products_alone_complete_lines_and_marts(lake, rows, documents):
    v.append(lake, "products", documents(product("P1")), "p0")
    v.append(lake, "orders", rows(ORDERS, ("O1", "C", "2026-01-01 01:00:00", "s", "1.00")), "o0")
    v.append(lake, "order_items", rows(ITEMS, ("O1", "P1", 1, "2.00"), ("O1", "P2", 1, "3.00"), ("O1", "P2", 2, "3.00")), "i0")
    runs.run_loads(lake)
    refresh.refresh(lake, refresh.TOP)
    v.append(lake, "products", documents(product("P2"), product("P3")), "p1")
    runs.run_loads(lake)
    assert look(lake)[-1] == 1  # P3 has no lines
    assert values(lake.staged("order_items")) == values(rebuilt(lake))
    assert refresh.refresh(lake, refresh.TOP) == refresh.INCREMENTAL
    assert {r.product_name for r in refresh.read(lake, refresh.TOP).collect()} == {"pen P1", "pen P2"}
    assert refresh.refresh(lake, refresh.TOP) == refresh.NO_DATA
    looks = len(look(lake))
    runs.refresh_products(lake)
    assert len(look(lake)) == looks  # nothing has changed


def test_a_copy_of_a_late_product_doubles_its_lines_as_a_rebuild_does(lake, rows, documents):
    v.append(lake, "order_items", rows(ITEMS, ("O1", "P1", 1, "2.00"), (None, "P1", 1, "2.00")), "i0")
    v.append(lake, "products", documents(product("Q")), "p0")
    runs.run_loads(lake)
    v.append(lake, "products", documents(product("P1"), product("P1"), product("P1", "ink"), '{"name":"x"}'), "p1")
    runs.run_loads(lake)
    assert lake.staged("order_items").count() == 6
    assert values(lake.staged("order_items")) == values(rebuilt(lake))


def test_a_failed_look_is_not_seen_and_made_again(lake, rows, documents, monkeypatch):
    v.append(lake, "products", documents(product("Q")), "p0")
    v.append(lake, "order_items", rows(ITEMS, ("O1", "P1", 1, "2.00"), ("O1", "P2", 1, "2.00")), "i0")
    runs.run_loads(lake)
    v.append(lake, "products", documents(product("P1")), "p1")
    real, failing = type(lake).append_log, [True]

    def fail_once(self, name, **entry):
        if entry.get("table_name") == "labels" and failing.pop():
            raise RuntimeError("lost before the entry")
        real(self, name, **entry)

    monkeypatch.setattr(type(lake), "append_log", fail_once)
    with pytest.raises(RuntimeError):
        runs.refresh_products(lake)
    assert {r.product_name for r in lake.staged("order_items").collect()} == {None}
    monkeypatch.setattr(type(lake), "append_log", real)
    assert feeds.label_late_lines(lake) == 1
    assert values(lake.staged("order_items")) == values(rebuilt(lake))
    assert feeds.label_late_lines(lake) == 0


def test_a_label_holds_for_its_batches_only(rows):
    lines = rows("product_id string, product_name string, category string, brand string, _src_batch string",
                 *[("P", None, None, None, f"b{i}") for i in range(1, 5)], ("R", None, None, None, "b1"))
    labels = rows("product_id string, product_name string, category string, brand string, _after string, _through string",
                  ("P", "old", None, None, "", "b2"), ("P", "new", None, None, "b2", "b3"))
    found = {(r.product_id, r._src_batch): r.product_name for r in late.completed(lines, labels).collect()}
    assert found == {("P", "b1"): "old", ("P", "b2"): "old", ("P", "b3"): "new", ("P", "b4"): None, ("R", "b1"): None}
    assert {r._src_batch for r in late.waiting(lines, labels).where("product_id = 'P'").collect()} == {"b4"}
    catalogue = rows("product_id string, name string, category string, brand string", ("P", "third", None, None), ("S", "s", None, None), ("R", None, None, None))
    assert values(late.new_labels(lines, labels, catalogue, "b4")) == [("P", "third", None, None, "b3", "b4")]
