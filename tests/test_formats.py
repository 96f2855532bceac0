"""File formats on small hand-written files."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import values
from pyspark.sql import functions as F

from caravel.functions.text import strict_cast, tolerant_cast
from caravel.sources import formats, landing, loads, versions

HEADER = "order_id,customer_id,order_date,status,total_amount\n"


def write(lake, name, text):
    path = Path(lake.landing(name).removeprefix("file:"))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return name


def typed(spark, lake, name):
    return formats.typed_csv(formats.read_csv_text(spark, lake.landing(name), "orders"), "orders")


def test_csv_quotes_null_tokens_short_and_long_rows(spark, lake):
    name = write(
        lake,
        "j1/orders.csv",
        HEADER
        + 'O1,C1,2026-05-05 15:56:00,"paid, ""late""",10.50\n'
        + "O2,NULL,,null,\n"
        + "O3,C3\n"
        + "O4,C4,2026-05-06 00:00:00,new,1,extra,fields\n",
    )
    got = [tuple(str(v) if v is not None else None for v in r) for r in typed(spark, lake, name).orderBy("order_id").collect()]
    assert got == [
        ("O1", "C1", "2026-05-05 15:56:00", 'paid, "late"', "10.50"),
        ("O2", None, None, None, None),
        ("O3", "C3", None, None, None),
        ("O4", "C4", "2026-05-06 00:00:00", "new", "1.00"),
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_csv_bad_value_stops_the_load_and_is_logged(spark, lake, ansi):
    name = write(lake, "j1/orders.csv", HEADER + "O1,C1,2026-05-05 10:00:00,new,ten\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="total_amount"):
            loads.load(lake, "orders", name)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    logged = loads.history(lake, "orders").first()
    assert (logged.status, logged.row_count) == ("LOAD_FAILED", 0)
    assert logged.first_error_message
    assert versions.as_of(lake, "orders").count() == 0


def test_load_works_after_a_failed_one(spark, lake):
    name = write(lake, "j1/orders.csv", HEADER + "O1,C1,2026-05-05 10:00:00,new,ten\n")
    with pytest.raises(Exception):
        loads.load(lake, "orders", name)
    write(lake, "j1/orders.csv", HEADER + "O1,C1,2026-05-05 10:00:00,new,10\n")
    assert loads.load(lake, "orders", name) == 1
    assert versions.as_of(lake, "orders").count() == 1


def test_validation_reports_every_bad_value_without_loading(spark, lake):
    name = write(
        lake,
        "j1/orders.csv",
        HEADER + "O1,C1,yesterday,new,ten\nO2,C2,2026-01-01 00:00:00,new,5\nO3,C3,2026-01-01 00:00:00,new,1e99\n",
    )
    faults = formats.csv_faults(formats.read_csv_text(spark, lake.landing(name), "orders"), "orders")
    assert values(faults.select("row_key", "column_name", "value")) == [
        ("O1", "order_date", "yesterday"),
        ("O1", "total_amount", "ten"),
        ("O3", "total_amount", "1e99"),
    ]
    assert loads.history(lake).isEmpty()


def test_whole_numbers_round_half_up(spark, lake):
    name = write(lake, "j1/order_items.csv", "order_id,product_id,quantity,unit_price\nO1,P1,2.5,1.005\n")
    text = formats.read_csv_text(spark, lake.landing(name), "order_items")
    row = formats.typed_csv(text, "order_items").first()
    assert (row.quantity, str(row.unit_price)) == (3, "1.01")


def test_json_array_gives_one_row_per_element_whatever_the_layout(spark, lake):
    write(lake, "arrays/a.json", '[{"product_id":"P1","tags":[]},\n {"product_id":"P2"}]')
    write(lake, "arrays/b.json", '[\n  {\n    "product_id": "P3",\n    "tags": null\n  }\n]\n')
    write(lake, "arrays/c.json", "[]")
    found = formats.read_json_array(spark, lake.landing("arrays"))
    assert values(found.selectExpr("variant_get(data, '$.product_id', 'string')")) == [("P1",), ("P2",), ("P3",)]


def test_broken_json_stops_the_load(spark, lake):
    write(lake, "j1/products.json", '[{"product_id":"P1"},')
    with pytest.raises(Exception):
        loads.load(lake, "products", "j1/products.json")
    write(lake, "j1/web_events.json", '{"event_id":"1"}\n{"event_id":\n')
    with pytest.raises(Exception):
        loads.load(lake, "web_events", "j1/web_events.json")


def test_external_table_sees_matching_files_only_and_new_ones_when_asked_again(spark, lake):
    write(lake, "j1/web_events.json", '{"event_type":"view"}\n{"event_type":"click"}\n')
    write(lake, "j1/products.json", '{"event_type":"no"}\n')
    folders = f"{lake.landing()}/*/web_events*.json"
    assert formats.read_json_external(spark, folders).count() == 2
    write(lake, "j2/web_events_j2.json", '{"event_type":"view"}\n')
    assert formats.read_json_external(spark, folders).count() == 3


def test_parquet_load_casts_to_declared_types(spark, lake, rows):
    frame = rows(
        "customer_id string, email string, first_name string, last_name string, city string, signup_date string",
        ("C1", "a@b.c", "A", "B", "X", "2026-02-03"),
    )
    landing.put_parquet(lake, frame, "j1/customers.parquet")
    loads.load(lake, "customers", "j1/customers.parquet")
    loaded = versions.as_of(lake, "customers")
    assert dict(loaded.dtypes)["signup_date"] == "date"
    assert str(loaded.first().signup_date) == "2026-02-03"


def test_audit_columns(spark, lake):
    name = write(lake, "j1/orders.csv", HEADER + "O1,C1,2026-05-05 10:00:00,new,10\n")
    loads.load(lake, "orders", name)
    row = versions.as_of(lake, "orders", audit=True).first()
    assert row._source_file == "j1/orders.csv"
    assert row._loaded_at is not None


def test_a_file_is_loaded_once_until_the_table_is_replaced(spark, lake):
    name = write(lake, "j1/orders.csv", HEADER + "O1,C1,2026-05-05 10:00:00,new,10\n")
    assert loads.load(lake, "orders", name) == 1
    assert loads.load(lake, "orders", name) is None
    assert versions.as_of(lake, "orders").count() == 1
    versions.replace_table(lake, "orders")
    assert versions.as_of(lake, "orders").count() == 0
    assert loads.history(lake, "orders").isEmpty()
    assert loads.load(lake, "orders", name) == 3
    assert versions.as_of(lake, "orders").count() == 1


def test_preview_and_listing(spark, lake):
    write(lake, "j1/orders.csv", HEADER + "".join(f"O{i},C,2026-01-01 00:00:00,new,1\n" for i in range(30)))
    write(lake, "j2/orders.csv", HEADER)
    text = formats.read_csv_text(spark, lake.landing("j1/orders.csv"), "orders")
    assert formats.preview(text).count() == 10
    assert values(landing.list_files(lake, "j2").select("path")) == [("j2/orders.csv",)]
    assert landing.list_files(lake).count() == 2


def test_array_files_hold_a_bounded_number_of_documents(spark, lake):
    documents = spark.range(0, 25, 1, 3).selectExpr("concat('{\"n\":', id % 2, '}') AS value")
    landing.put_json_arrays(lake, documents, "j1/products.json", per_file=4)
    sizes = spark.read.text(lake.landing("j1/products.json"), wholetext=True).selectExpr(
        "size(from_json(value, 'array<variant>')) AS n"
    )
    assert max(r.n for r in sizes.collect()) <= 4
    assert formats.read_json_array(spark, lake.landing("j1/products.json")).count() == 25


def test_a_line_break_inside_quotes_is_reported_never_loaded_wrong(lake, spark):
    import os

    for name, body in {"middle": 'O1,"C\n1",2026-01-01 00:00:00,new,1.00', "last": 'O1,C1,2026-01-01 00:00:00,new,"1\n.00"'}.items():
        folder = lake.landing(f"j1/{name}.csv")
        os.makedirs(folder.removeprefix("file:"))
        with open(f"{folder.removeprefix('file:')}/part.csv", "w") as out:
            out.write(f'order_id,customer_id,order_date,status,total_amount\nO0,"a ""quoted"" name",2026-01-01 00:00:00,new,2.00\n{body}\n')
        text = formats.read_csv_text(spark, folder, "orders", keep_broken=True)
        assert "line break inside quotes" in {r.error for r in formats.csv_faults(text, "orders").collect()}
        with pytest.raises(Exception, match="line break inside quotes"):
            formats.read_csv_text(spark, folder, "orders").collect()
        whole = formats.read_csv_text(spark, folder, "orders", multi_line=True).collect()
        assert [r.order_id for r in whole] == ["O0", "O1"] and "\n" in (whole[1].customer_id + whole[1].total_amount)


def test_a_text_is_cast_once_and_plain_digits_without_a_decimal(spark):
    texts = ["1", "-7", " 12 ", "12.5", "-2.5", "1e3", "9223372036854775807", "9223372036854775808", "abc", "", ".5", "5.", "1L", "0x1", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    both = frame.select(tolerant_cast(F.col("t"), "bigint").alias("new"), F.col("t").try_cast("decimal(38,0)").try_cast("bigint").alias("old"))
    assert [r["new"] for r in both.collect()] == [r["old"] for r in both.collect()]
    assert [r["new"] for r in both.collect()][:5] == [1, -7, 12, 13, -3]
    plan = frame.select(strict_cast(F.col("t"), "t", "decimal(12,2)").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(t#") == 1


def test_patterns_are_kept_for_elements_at_the_edges_of_an_array(spark, lake):
    """An element between a comma and a brace is taken as it is; one that begins otherwise is still checked."""
    name = write(lake, "docs.json", '[{"a":"}],{[\\\\"},{"b":{"c":[1]}} ,1,\n{"d":"\\""}\n]')
    found = formats.read_json_array(spark, lake.landing(name))
    assert sorted(r[0] for r in found.selectExpr("to_json(data)").collect()) == ["1", '{"a":"}],{[\\\\"}', '{"b":{"c":[1]}}', '{"d":"\\""}']
    assert "array_sort(" not in found._jdf.queryExecution().optimizedPlan().toString()
