"""Files whose records span lines, read by byte ranges, against readers that see each file whole."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from caravel import schemas
from caravel.functions.text import blank_to_null
from caravel.sources import formats, ranges

ELEMENTS = [
    {"a": 1, "b": 'x}"{[', "c": {"d": [{"e": "\\"}, 2]}}, {}, {"z": "é}}\\\\"}, 3, "s}", None, [1, 2], {"q": [{}, {"r": "]"}]},
]


@pytest.fixture(params=["64m", "40", "7"])
def small_ranges(spark, request):
    settings = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def write(folder, name, text):
    with open(folder / name, "w", newline="") as out:
        out.write(text)
    return str(folder / name)


def elements(spark, path):
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in ranges.json_elements(spark, path).selectExpr("to_json(data)").collect())


def test_array_elements_whatever_the_layout(spark, tmp_path, small_ranges):
    layouts = [json.dumps(ELEMENTS), json.dumps(ELEMENTS, indent=2) + "\n", "[]", " [ ] \n", "[1,2]", json.dumps(ELEMENTS[:2])]
    for i, text in enumerate(layouts):
        assert elements(spark, write(tmp_path, f"{i}.json", text)) == sorted(json.dumps(e, sort_keys=True) for e in json.loads(text))
    everything = [json.dumps(e, sort_keys=True) for text in layouts for e in json.loads(text)]
    assert elements(spark, str(tmp_path)) == sorted(everything)


@pytest.mark.parametrize(
    "text", ['[{"a":1},', '[{"a":1}', '{"a":1}', '[{"a":1} {"b":2}]', '[{"a":1},]', '[{"a":1}] x', '[,{"a":1}]', '[{"a":"]', '[{"a":1}]]', '[{"a":1]}']
)
def test_a_file_that_is_no_array_stops_the_job(spark, tmp_path, text):
    path = write(tmp_path, "broken.json", text)
    with pytest.raises(Exception):
        elements(spark, path)


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    many = [{"product_id": f"P{i}", "tags": [f"}}{i}"], "attributes": {"color": "red"}} for i in range(3000)]
    path = write(tmp_path, "large.json", json.dumps(many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert ranges.pieces(spark, path, "}").select("block").distinct().count() >= 10
        assert elements(spark, path) == sorted(json.dumps(e, sort_keys=True) for e in many)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def dirty_field(draw):
    text = "".join(draw.choice('xy ,"\n') for _ in range(draw.randint(0, 6)))
    quoted = '"' + text.replace('"', '""') + '"'
    return draw.choice([quoted, quoted, quoted, 'x"y', ' "q"', '"ab"z', "", "x", "z z", "é"])


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_delimited_records_equal_those_of_a_reader_of_whole_files(spark, tmp_path, small_ranges, monkeypatch, line_end):
    monkeypatch.setitem(schemas.RAW, "dirty", dict.fromkeys("abc", "string"))
    draw = random.Random(small_ranges + line_end)
    for name in "pq":
        records = [",".join(dirty_field(draw) for _ in range(draw.choice([3, 3, 3, 2, 4]))) for _ in range(15)]
        write(tmp_path, f"{name}.csv", "a,b,c" + line_end + line_end.join(r if r.strip() else "x" for r in records) + draw.choice(["", line_end]))
    whole = spark.read.options(**formats.CSV_FORMAT, multiLine=True).schema("a string, b string, c string").csv(str(tmp_path))
    want = whole.select(*[blank_to_null(F.col(c)).alias(c) for c in "abc"])
    assert sorted(map(str, formats.read_csv_text(spark, str(tmp_path), "dirty", multi_line=True).collect())) == sorted(map(str, want.collect()))


def test_files_without_records(spark, tmp_path, small_ranges):
    write(tmp_path, "head.csv", "order_id,customer_id,order_date,status,total_amount\n")
    write(tmp_path, "empty.csv", "")
    assert formats.read_csv_text(spark, str(tmp_path), "orders", multi_line=True).collect() == []


def test_state_of_pieces_is_carried_over(spark):
    rows = [("f", 0, 0, None, 1), ("f", 0, 1, None, 0), ("f", 0, 2, 1, 0), ("f", 0, 3, None, 1), ("f", 0, 4, None, 0), ("f", 9, 5, None, 1)]
    frame = spark.createDataFrame(rows, "file string, block long, at long, fixed int, flips int")
    got = {r["at"]: (r["known"], r["parity"] % 2) for r in ranges.with_state(frame, ["file", "block"], "at").collect()}
    assert {at: k for at, (k, _) in got.items()} == {0: None, 1: None, 2: None, 3: 1, 4: 0, 5: None}
    assert [got[at][1] for at in (0, 1, 2, 5)] == [0, 1, 1, 0]
