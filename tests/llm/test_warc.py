from __future__ import annotations

import base64
import gzip
import hashlib
import sys
from pathlib import Path

import pytest

from caravel.llm import queries, warc

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle_check import differences  # noqa: E402

PAGES = "page_id bigint, url string, html string"


def held(frame):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def expected(rows, least=0):
    """By a dictionary of payloads."""
    holder, out = {}, []
    for page, _, html in rows:
        if page is not None:
            holder[html or ""] = max(page, holder.get(html or "", page))
    for page, _, html in rows:
        payload = (html or "").encode()
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = page is not None and len(payload) >= least and holder[html or ""] != page
        out.append((page, len(payload), sha1, "revisit" if revisit else "response", holder[html or ""] if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://b.example.com/x?q=1", "<p>same</p>"), (9, "https://a.example.org:8080/", "<p>same</p>"), (4, None, None), (5, "", ""),
    (6, "not a url\twith\nspace", "é" * 2000), (7, "http://[broken", "<p>same</p>"), (8, "http://b.example.com/x?q=1", "x\r\n\r\ny"),
    (8, "http://b.example.com/x?q=1", "x\r\n\r\ny"), (8, "http://c.example.com", "other"), (None, "http://d.example.com", "<p>same</p>"),
]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least):
    frame = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' AS payload", "1 AS refers_to", "2 AS sha1").repartition(3)
    folder, directory = warc.archive(spark, frame, least=least)
    assert held(warc.read_archives(directory, folder)) == expected(ROWS, least)
    assert held(warc.lookup(directory, folder, frame)) == expected(ROWS, least)


def test_lookup_reads_the_captures_of_a_url_only(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 40}", f"<p>{i}</p>") for i in range(400)]
    folder = warc.scratch_folder(spark, "warc")
    captures = warc.write_archives(warc.pages_of(spark.createDataFrame(rows, PAGES).repartition(4)), f"file://{folder}")
    directory = warc.write_index(captures, f"file://{folder}", block_lines=10)
    assert directory.count() >= 40
    wanted = ["http://h3.example.com/p3", "http://h0.example.com/p0", "http://none.example.com/", None, "http://h3.example.com/p3"]
    asked = spark.createDataFrame([(u, 1) for u in wanted], "url string, key int")
    found = sorted((r["page_id"], bytes(r["payload"]).decode()) for r in warc.lookup(directory, f"file://{folder}", asked).collect())
    assert found == sorted((i, html) for i, url, html in rows if url in wanted)


def test_lookup_opens_the_blocks_that_can_hold_a_key_only(spark):
    rows = [(i, f"http://h{i % 50:02d}.example.com/p{i}", "x") for i in range(600)] + [(1000 + i, "http://hot.example.org/", f"{i}") for i in range(300)]
    folder = f"file://{warc.scratch_folder(spark, 'warc')}"
    captures = warc.write_archives(warc.pages_of(spark.createDataFrame(rows, PAGES).repartition(3)), folder)
    directory = warc.write_index(captures, folder, block_lines=10)
    blocks = directory.orderBy("first_key", "file", "offset").collect()
    # All blocks are spoilt but those that bisection leads to: one that starts before the key and those that start with it.
    asked = {"http://h07.example.com/p7": "com,example,h07)/p7", "http://hot.example.org/": "org,example,hot)/"}
    for file in {r["file"] for r in blocks}:
        path = f"{folder.removeprefix('file://')}/{file}"
        mine = [r for r in blocks if r["file"] == file]
        data = bytearray(open(path, "rb").read())
        for i, r in enumerate(mine):
            later = [x["first_key"] for x in mine[i + 1 : i + 2]]
            if not any(r["first_key"] <= k and (not later or k <= later[0]) for k in asked.values()):
                data[r["offset"] : r["offset"] + r["length"]] = bytes(r["length"])
        open(path, "wb").write(data)
    found = warc.lookup(directory, folder, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert sorted(r["page_id"] for r in found.collect()) == [7, *range(1000, 1300)]
    with pytest.raises(Exception):
        warc.lookup(directory, folder, spark.createDataFrame([("http://h30.example.com/p30",)], "url string")).collect()


def test_urls_with_blanks_keep_their_order(spark):
    """A blank sorts before, its escape after some signs; the index is sorted by what it stores."""
    rows = [(i, f"http://a.com/x{mark}y{i % 9}", str(i)) for i, mark in enumerate([" ", "!", "#", "$", "%", "&", "\t", "  "] * 12)]
    frame = spark.createDataFrame(rows, PAGES)
    folder = f"file://{warc.scratch_folder(spark, 'warc')}"
    directory = warc.write_index(warc.write_archives(warc.pages_of(frame), folder), folder, block_lines=3)
    assert held(warc.lookup(directory, folder, frame)) == expected(rows)


def test_keys_sort_by_host_from_the_right():
    keys = [warc.url_key(u) for u in ("http://www.b.com/x", "http://b.com", "https://m.b.com:81/a?z=1", "ftp://a.org/", "plain", None)]
    assert keys == ["com,b,www)/x", "com,b)/", "com,b,m:81)/a?z=1", "org,a)/", "plain", ""]


def test_records_are_whole_gzip_members_and_damage_is_noticed():
    member = warc.record(3, "http://a.com/\r\nX-Bad: 1", b"body", warc.digest(b"body"), 4, None, False)
    fields, block = warc.parse(member)
    assert block == b"body" and fields["X-Page-ID"] == "3" and "X-Bad" not in fields
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(gzip.decompress(member)[:-3]))
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_empty_table(spark):
    folder, directory = warc.archive(spark, spark.createDataFrame([], PAGES))
    assert held(warc.read_archives(directory, folder)) == []
    assert warc.lookup(directory, folder, spark.createDataFrame([("http://a.com",)], "url string")).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.op3_warc(spark, sf), sf, queries.ORACLES["op3_warc"]) is None
