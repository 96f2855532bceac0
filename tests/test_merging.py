"""Logs read the same before and after merging, feeds go on where they stood."""

from __future__ import annotations

import pytest
from conftest import values

from caravel import schemas
from caravel.lake import Lake
from caravel.sources import loads, merging, versions
from caravel.streaming import feeds, runs
from caravel.workspace import names_in, path_exists

ORDERS = "order_id string, customer_id string, order_date timestamp_ntz, status string, total_amount decimal(12,2)"


def deliver(lake, rows, first, n=2):
    for i in range(first, first + n):
        versions.append(lake, "orders", rows(ORDERS, (f"O{i}", "C1", "2026-01-01 10:00:00", "paid", i)), f"j{i}/orders.csv")


def seen(lake):
    return {name: values(lake.log(name)) for name in schemas.LOGS}


def staged(lake):
    return sorted(r["order_id"] for r in lake.staged("orders").collect())


def test_logs_feeds_and_versions_are_the_same_after_every_merge(lake, rows):
    for turn in range(5):
        deliver(lake, rows, 2 * turn)
        if turn % 2 == 0:
            feeds.consume(lake, "orders")
        before, at = seen(lake), feeds.position(lake, "orders")
        merging.merge_logs(lake, fan=2)
        assert seen(lake) == before and feeds.position(lake, "orders") == at
        assert versions.as_of(lake, "orders", 1).count() == 1 and versions.as_of(lake, "orders").count() == 2 * turn + 2
    assert lake.log_pointer("commits").number >= 3
    feeds.consume(lake, "orders")
    assert staged(lake) == [f"O{i}" for i in range(10)]
    assert feeds.restart(lake, "orders") == 1
    merging.merge_logs(lake, fan=2)
    deliver(lake, rows, 10)
    feeds.consume(lake, "orders")
    assert staged(lake) == sorted(f"O{i}" for i in range(12))
    assert versions.current_version(lake, "orders") == 12 and loads.history(lake, "orders").count() == 12


def test_entries_that_a_feed_has_not_taken_in_stay(lake, rows):
    deliver(lake, rows, 0, 3)
    assert merging.merge_log(lake, "commits", fan=2) == 0
    feeds.consume(lake, "orders")
    deliver(lake, rows, 3, 1)
    assert merging.merge_log(lake, "commits", fan=2) == 3
    feeds.consume(lake, "orders")
    assert staged(lake) == ["O0", "O1", "O2", "O3"]


def test_number_of_files_is_bounded(lake):
    for i in range(30):
        lake.append_log("runs", run_id=i, job="orders", state="SKIPPED")
        merging.merge_log(lake, "runs", fan=3)
    pointer = lake.log_pointer("runs")
    lying = [f for f in names_in(lake.spark, lake.log_path("runs")) if f.endswith(".parquet")]
    levels = [f.split("-")[1] for f in pointer.folders]
    assert len(lying) <= 6 and all(levels.count(x) < 3 for x in levels) and len(pointer.folders) <= 6
    assert sorted(r["run_id"] for r in lake.log("runs").collect()) == list(range(30))
    kept = [f for f in names_in(lake.spark, lake.merged_log("runs")) if f != "pointers"]
    assert len(kept) <= 2 * len(pointer.folders) + 3 and len(names_in(lake.spark, lake.merged_log("runs", "pointers"))) <= 2


@pytest.mark.parametrize("step", ["rows", "pointer", "clearing"])
def test_a_merge_that_fails_is_done_again(lake, monkeypatch, step):
    for i in range(4):
        lake.append_log("runs", run_id=i, job="orders", state="SKIPPED")
    merging.merge_log(lake, "runs", fan=4)
    for i in range(4, 8):
        lake.append_log("runs", run_id=i, job="orders", state="SKIPPED")

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "clearing":
            m.setattr(merging, "_clear", fail)
        else:
            merged = Lake.merged_log
            m.setattr(Lake, "merged_log", lambda self, name, *more: fail() if more[:1] == ("pointers",) and len(more) == 2 or step == "rows" and more and more[0].endswith("-1") and more[0] > "00000002" else merged(self, name, *more))
        with pytest.raises(RuntimeError):
            merging.merge_log(lake, "runs", fan=4)
    assert sorted(r["run_id"] for r in lake.log("runs").collect()) == list(range(8))
    merging.merge_log(lake, "runs", fan=4)
    assert sorted(r["run_id"] for r in lake.log("runs").collect()) == list(range(8))


def test_a_batch_that_is_not_logged_is_not_read(lake, rows):
    deliver(lake, rows, 0)
    feeds.consume(lake, "orders")
    half = lake.spark.read.parquet(f"{lake.staging('orders')}/_src_batch={feeds.batch_name(0, 0)}")
    half.write.partitionBy("order_month").parquet(f"{lake.staging('orders')}/_src_batch={feeds.batch_name(0, 1)}")
    assert staged(lake) == ["O0", "O1"]
    assert path_exists(lake.spark, f"{lake.staging('orders')}/_src_batch={feeds.batch_name(0, 1)}")


def test_runs_merge_by_themselves(lake, rows, monkeypatch):
    monkeypatch.setattr(merging, "FAN", 2)
    for turn in range(3):
        deliver(lake, rows, 2 * turn)
        runs.run_loads(lake)
    assert lake.log_pointer("runs").number and staged(lake) == [f"O{i}" for i in range(6)]
