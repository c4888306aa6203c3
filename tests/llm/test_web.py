import gzip
import hashlib
import re

from quarry.llm import warc
from quarry.llm.common import scratch_path
from quarry.plans.explain import plan_text

BIG = "<html>" + "x" * 200 + "</html>"
TRAP = BIG + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
ROWS = [(3, "http://a/1", BIG), (1, "http://a/1 b\r\nX: y", BIG), (2, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", TRAP), (8, "u", TRAP), (9, "é", "ü" * 60), (9, "é", "ü" * 60), (None, "n", BIG), (10, "v", "z" * 2_000_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "'x' as type", "1 as digest").repartition(3).cache()
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path, archive_bytes=300)
    whole = warc.transactions(warc.read_archives(spark, path))
    got = warc.capture_digests(whole).collect()
    files = spark.read.format("binaryFile").load(path).collect()
    members = [list(warc._members(bytes(f.content))) for f in files]
    assert len(files) > 5 and all(m[-1] == b"" for m in members)  # what ends a file is a member of nothing
    assert all(len(list(warc._parse(m))) == 1 for own in members for m in own[:-1]) and sum(len(m) - 1 for m in members) == 3 * len(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        texts = [t or "" for i, _, t in ROWS if i == r.page_id]
        assert r.payload_digest == hashlib.sha256(texts[0].encode()).hexdigest() and r.payload_bytes == len(texts[0].encode())
        same = sorted(i for i, _, t in ROWS if t == texts[0] and i is not None)
        if r.payload_bytes < 100:
            assert (r.record_type, r.refers_to) == ("response", None)
        elif r.record_type == "response":
            assert r.page_id == same[0] and r.refers_to is None
        else:
            assert r.refers_to == same[0]
    assert sorted((r.page_id for r in got if r.record_type == "revisit"), key=str) == [3, 8, 9, None]
    rows = whole.collect()
    assert all(r.request and r.metadata for r in rows)
    assert {bytes(r.capture.payload).decode() for r in rows if r.capture.type == "response"} == {t or "" for _, _, t in ROWS}
    pages.unpersist()


def test_archives_that_others_wrote():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3, gzip.compress(one * 2) + gzip.compress(b"") + gzip.compress(one)):
        assert [r["payload"] for r in warc.parse(data)] == [b"abc"] * 3
    try:
        list(warc.parse(gzip.compress(one)[:-12]))
    except ValueError:
        return
    raise AssertionError


def test_missing_partners_and_bad_archives(spark):
    lone = spark.createDataFrame([("<a>", "response", None, None, "u", "d", bytearray(b"x"), 1, "d", None), ("<b>", "metadata", "<gone>", None, "u", "d", None, None, None, {"k": "v"})], warc.RECORD)
    row = warc.transactions(lone).first()
    assert row.record_id == "<a>" and row.request is None and row.metadata is None and row.original is None
    for bad in (b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nabc"):
        try:
            list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError(bad)
    assert list(warc.parse(b"")) == []


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    assert warc.capture_digests(warc.transactions(warc.read_archives(spark, path))).count() == 0


def test_payloads_stay_where_they_are(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(3)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = [part for part in plan_text(warc.records(pages)).split("\n\n") if re.match(r"\s*\(\d+\) (Broadcast)?Exchange", part)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert moved and not any("body#" in part for part in moved)


def test_revisits_in_every_bitmap(spark):
    pages = spark.range(0, 70_000, 1, 2).selectExpr("id as page_id", "'u' as url", "repeat('x', 100) || id % 50000 as html")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    got = warc.capture_digests(warc.transactions(warc.read_archives(spark, path, payloads=False)))
    assert pages.count() == got.count() == 70_000
    wrong = got.where("NOT (record_type = IF(page_id < 50000, 'response', 'revisit') AND refers_to <=> IF(page_id < 50000, NULL, page_id - 50000) AND payload_digest = sha2(repeat('x', 100) || page_id % 50000, 256))")
    assert wrong.count() == 0
