"""Recorded writes, point-in-time reads and recovery."""

from __future__ import annotations

import time

import pytest
from conftest import values

from caravel.sources import versions as v

ORDERS = "order_id string, customer_id string, order_date timestamp_ntz, status string, total_amount decimal(12,2)"


def ids(frame):
    return sorted(str(r.order_id) for r in frame.collect())


@pytest.fixture
def orders(rows):
    return lambda *keys: rows(ORDERS, *[(k, "C", None, "new", "1.00") for k in keys])


@pytest.fixture
def keys(rows):
    return lambda *found: rows("order_id string", *[(k,) for k in found])


def test_every_version_can_be_read(lake, orders, keys):
    assert v.append(lake, "orders", orders("a", "b", None), "f1") == 1
    assert v.remove(lake, "orders", keys("a", None, "zzz")) == 2
    assert v.append(lake, "orders", orders("a", "c"), "f2") == 3
    assert v.remove(lake, "orders", keys("b", "a")) == 4
    seen = [ids(v.as_of(lake, "orders", n)) for n in range(5)]
    assert seen == [[], ["None", "a", "b"], ["None", "b"], ["None", "a", "b", "c"], ["None", "c"]]
    assert ids(v.as_of(lake, "orders")) == seen[4]
    assert ids(v.before(lake, "orders", 4)) == seen[3]


def test_reading_an_empty_table(lake):
    assert v.current_version(lake, "orders") == 0
    assert v.as_of(lake, "orders").isEmpty()


def test_difference_is_distinct_and_keeps_identical_survivors_out(lake, orders, keys):
    v.append(lake, "orders", orders("a", "a", "b", "c"), "f1")
    removal = v.remove(lake, "orders", keys("a", "b"))
    v.append(lake, "orders", orders("b"), "f1")
    past = removal - 1
    assert ids(v.lost_rows(lake, "orders", past, audit=False)) == ["a"]
    assert ids(v.lost_rows(lake, "orders", past, bag=True, audit=False)) == ["a", "a"]


def test_difference_equals_the_plain_set_difference(lake, rows, keys):
    data = [(f"k{i % 7}", f"C{i % 3}", None, "s", str(i % 4)) for i in range(60)]
    v.append(lake, "orders", rows(ORDERS, *data), "f1")
    v.remove(lake, "orders", keys("k1", "k2", "k5"))
    v.append(lake, "orders", rows(ORDERS, *data[:9]), "f2")
    v.remove(lake, "orders", keys("k2"))
    past, now = v.as_of(lake, "orders", 1), v.as_of(lake, "orders")
    assert values(v.lost_rows(lake, "orders", 1, audit=False)) == values(past.subtract(now))
    assert values(v.lost_rows(lake, "orders", 1, bag=True, audit=False)) == values(past.exceptAll(now))


def test_restore_round_trip_keeps_the_first_audit_stamp(lake, orders, keys):
    v.append(lake, "orders", orders("a", "b", "c"), "f1")
    original = values(v.as_of(lake, "orders", audit=True))
    removal = v.remove(lake, "orders", keys("a", "b"))
    assert ids(v.as_of(lake, "orders")) == ["c"]
    v.restore(lake, "orders", removal - 1)
    assert values(v.as_of(lake, "orders", audit=True)) == original
    assert ids(v.changes(lake, "orders", v.RESTORE)) == ["a", "b"]
    assert ids(v.changes(lake, "orders")) == ["a", "b", "c"]


def test_time_offsets(lake, orders, keys):
    v.append(lake, "orders", orders("a", "b"), "f1")
    time.sleep(3)
    v.remove(lake, "orders", keys("a"))
    assert v.seconds_ago(lake, "orders", 0) == 2
    assert v.seconds_ago(lake, "orders", 2) == 1
    assert v.seconds_ago(lake, "orders", 3600) == 0


def test_snapshot_does_not_follow_the_table(lake, orders, keys):
    v.append(lake, "orders", orders("a", "b"), "f1")
    copy = v.snapshot(lake, "orders", f"{lake.root}/copy")
    v.remove(lake, "orders", keys("a", "b"))
    assert ids(copy) == ["a", "b"]
    assert ids(v.as_of(lake, "orders")) == []


def test_a_write_that_was_not_logged_is_replaced_by_the_next(lake, orders):
    v.append(lake, "orders", orders("a"), "f1")
    orders("half").write.parquet(f"{lake.raw('orders')}/_version=2/_change=insert")
    assert ids(v.as_of(lake, "orders")) == ["a"]
    assert v.append(lake, "orders", orders("b"), "f2") == 2
    assert ids(v.as_of(lake, "orders")) == ["a", "b"]


def test_point_in_time_join_is_an_equi_join(spark, lake, orders, keys):
    v.append(lake, "orders", orders("a", "b"), "f1")
    v.remove(lake, "orders", keys("a"))
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        plan = v.as_of(lake, "orders")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_writes_without_rows(lake, orders, keys):
    assert v.append(lake, "orders", orders(), "empty") == 1
    assert v.append(lake, "orders", orders("a").where("order_id = 'zzz'"), "none left") == 2
    v.append(lake, "orders", orders("a"), "f1")
    v.remove(lake, "orders", keys("not there"))
    v.restore(lake, "orders", 3)
    assert ids(v.as_of(lake, "orders")) == ["a"]
    logged = {r.version: r.row_count for r in v.commits(lake, "orders").collect()}
    assert logged == {1: 0, 2: 0, 3: 1, 4: None, 5: 0}
