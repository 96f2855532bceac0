"""Unique customers from merged day states equal a set of ids, at two sizes and after every delivery."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from conftest import values
from test_states import arrive, order

from caravel.plans import refresh, uniques


@pytest.mark.parametrize("customers, orders, few", [(40, 300, 12), (70_000, 90_000, 2000)])
def test_any_period_equals_a_set(spark, customers, orders, few):
    draw = random.Random(customers)
    start = date(2026, 1, 1)
    pairs = [
        (None if draw.random() < 0.02 else start + timedelta(days=draw.choice([0, draw.randint(0, 6)])), None if draw.random() < 0.02 else f"C{draw.randint(1, customers)}")
        for _ in range(orders)
    ]
    frame = spark.createDataFrame(pairs, "order_date date, customer_id string").repartition(5)
    half = frame.where("hash(customer_id, order_date) % 2 = 0"), frame.where("NOT coalesce(hash(customer_id, order_date) % 2 = 0, false)")
    known, states = spark.createDataFrame([], uniques.IDS), []
    for part in half:  # the second delivery repeats days and customers of the first
        known = known.unionByName(uniques.new_numbers(known, part, slots=7))
        states.append(uniques.day_states(part, known, few))
    numbers = [r["number"] for r in known.collect()]
    ids = {c for _, c in pairs if c}
    assert len(numbers) == len(set(numbers)) == len(ids) and min(numbers) >= 1
    assert max(numbers) < 1.2 * len(ids) + 100  # dense
    state = states[0].unionByName(states[1])
    kinds = state.selectExpr("count(places) AS lists", "count(bits) AS maps", "count_if((places IS NULL) = (bits IS NULL)) AS odd").first()
    assert kinds["lists"] and kinds["maps"] and not kinds["odd"]
    by_day = defaultdict(set)
    for day, customer in pairs:
        if day and customer:
            by_day[day].add(customer)
    assert values(uniques.unique(state, "order_date")) == sorted((d, len(c)) for d, c in by_day.items())
    some = [start + timedelta(days=n) for n in (0, 2, 3)]
    assert uniques.unique(state.where(state.order_date.isin(some))).first()[0] == len(set().union(*(by_day[d] for d in some)))


def test_no_state_counts_nobody(spark):
    assert uniques.unique(spark.createDataFrame([], uniques.STATE)).first()[0] == 0
    assert uniques.unique(spark.createDataFrame([], uniques.STATE), "order_date").isEmpty()


def test_mart_follows_deliveries_and_reads_new_orders_only(lake, rows):
    found = defaultdict(set)
    for turn, orders in enumerate((
        [("O1", "C1", "2026-01-05"), ("O2", "C2", "2026-01-05"), ("O3", None, "2026-01-06"), ("O4", "C4", None)],
        [("O5", "C1", "2026-01-05"), ("O6", "C3", "2026-01-05"), ("O7", "C3", "2026-01-07")],
        [("O8", "C9", "2026-02-01")],
    )):
        arrive(lake, rows, "orders", turn, *[order(*o) for o in orders])
        assert refresh.refresh(lake, refresh.UNIQUES) == (refresh.INCREMENTAL if turn else refresh.FULL)
        for _, customer, day in orders:
            if customer and day:
                found[date.fromisoformat(day)].add(customer)
        assert values(refresh.read(lake, refresh.UNIQUES)) == sorted((d, len(c)) for d, c in found.items())
        assert uniques.unique(refresh.customer_states(lake)).first()[0] == len(set().union(*found.values()))
    assert uniques.unique(refresh.customer_states(lake, date(2026, 1, 6), date(2026, 2, 1))).first()[0] == 2
    assert refresh.refresh(lake, refresh.UNIQUES) == refresh.NO_DATA
    # Each refresh wrote states of its own delivery only.
    written = lake.spark.read.parquet(f"{lake.root}/marts/{refresh.UNIQUES}_state").groupBy("_refresh").count()
    assert values(written) == [(1, 1), (2, 2), (3, 1)]
    # A full refresh starts numbers and states again, and a refresh that failed before its log entry leaves nothing behind.
    lake.spark.read.parquet(lake.mart(f"{refresh.UNIQUES}_state", 2)).write.parquet(lake.mart(f"{refresh.UNIQUES}_state", 4))
    assert uniques.unique(refresh.customer_states(lake)).first()[0] == 4
    assert refresh.refresh(lake, refresh.UNIQUES, full=True) == refresh.FULL
    assert uniques.unique(refresh.customer_states(lake)).first()[0] == 4
    assert values(refresh.read(lake, refresh.UNIQUES)) == sorted((d, len(c)) for d, c in found.items())
