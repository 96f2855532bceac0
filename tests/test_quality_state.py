"""The quality state equals the report on all rows after each delivery."""

from __future__ import annotations

import random

from conftest import values

from caravel.plans import quality, quality_state
from caravel.sources import versions as v

ORDERS = "order_id string, customer_id string, order_date timestamp_ntz, status string, total_amount decimal(12,2)"
ITEMS = "order_id string, product_id string, quantity bigint, unit_price decimal(12,2)"
SHARES = {"orders_without_id": "0.25", "items_bad_price": "0.5"}


def whole(lake):
    now = [v.as_of(lake, t) for t in quality_state.TABLES]
    return quality.quality_report(*now, SHARES)


def test_state_follows_every_delivery(lake, rows, documents):
    draw = random.Random(5)
    for turn in range(3):
        key = lambda: draw.choice([None, *[f"O{draw.randint(0, 8 * turn + 12)}" for _ in range(8)]])
        orders = [(key(), "C1", draw.choice([None, "2026-01-01 00:00:00"]), "s", "1.00") for _ in range(6)]
        items = [(key(), "P", draw.choice([None, 0, 1, 2]), draw.choice([None, "-1.00", "2.00"])) for _ in range(14)]
        v.append(lake, "orders", rows(ORDERS, *orders), f"o{turn}")
        if turn != 1:  # a delivery of orders alone, which some earlier lines waited for
            v.append(lake, "order_items", rows(ITEMS, *items), f"i{turn}")
            v.append(lake, "products", documents('{"product_id":"P"}', f'{{"product_id":"P{turn}"}}', "{}"), f"p{turn}")
            v.append(lake, "web_events", documents('{"event_id":null}', '{"event_id":"1"}'), f"e{turn}")
        assert quality_state.refresh(lake) == ("INCREMENTAL" if turn else "FULL")
        assert values(quality_state.report(lake, SHARES)) == values(whole(lake))
    assert quality_state.refresh(lake) == "NO_DATA"
    gone = v.remove(lake, "orders", rows("order_id string", *[(f"O{i}",) for i in range(9)]))
    assert quality_state.refresh(lake) == "FULL"
    assert values(quality_state.report(lake, SHARES)) == values(whole(lake))
    v.restore(lake, "orders", gone - 1)
    assert quality_state.refresh(lake) == "FULL"
    assert values(quality_state.report(lake, SHARES)) == values(whole(lake))


def test_a_delivery_reads_its_own_rows_only(lake, rows, monkeypatch):
    v.append(lake, "orders", rows(ORDERS, ("O1", "C", None, "s", "1.00")), "o0")
    quality_state.refresh(lake)
    v.append(lake, "orders", rows(ORDERS, ("O1", "C", None, "s", "1.00"), ("O2", "C", None, "s", "1.00")), "o1")
    read, real = [], v.rows_of
    monkeypatch.setattr(v, "rows_of", lambda lake, table, chosen: read.append((table, chosen)) or real(lake, table, chosen))
    assert quality_state.refresh(lake) == "INCREMENTAL"
    assert [(t, c) for t, c in read if c] == [("orders", [(2, "insert")])]
    assert {r.check_name: r.observed for r in quality_state.report(lake).collect()}["orders_repeated_id"] == 1
