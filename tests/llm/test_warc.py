"""WARC archives: roles against a plain loop, bytes against the format, and revisits resolved."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import queries, warc
from lumenframe.llm.common import stage
from tests.helpers import collected, oracle

SF = "/root/testdata/sf0.001"
BIG = "<p>ü\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30  # a payload that looks like records


def brute(rows, least=1000):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        again = len(data) >= least and same and i != max(same)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=repr)


def run(spark, rows, where, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(df, str(where), **options)
    records = stage(warc.read_records(spark, str(where), payloads=True), "test-warc")
    found = warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return records, sorted(map(tuple, found.collect()), key=repr)


def test_warc_equals_sql(spark):
    assert collected(queries.op11_warc(spark, SF)) == oracle(SF, queries.oracle_sql()["op11_warc"])


def test_roles_of_copies_and_odd_rows(spark, tmp_path):
    rows = [(i, f"http://x/{i}", BIG if i % 3 else f"small {i % 4}") for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (None, "u", BIG), (None, "u", BIG + "2"), (None, "v", BIG + "2"), (50, "a b\r\nInjected: x", BIG + "3"), (51, "é", BIG + "3"), (51, "é", BIG + "3"), (50, "a", BIG + "3")]
    rows += [(60, "l", "x" * 3_000_000), (61, "l", "x" * 3_000_000), (62, "n", "a" * 999), (63, "n", "a" * 999), (64, "n", "é" * 500), (65, "n", "é" * 500)]
    records, got = run(spark, rows, tmp_path / "a")
    assert got == brute(rows)
    by_id = {r["page_id"]: r for r in records.collect()}
    assert by_id[50]["target_uri"] == "a%20b%0D%0AInjected:%20x" or by_id[50]["target_uri"] == "a"
    again = warc.restore(records)
    assert sorted(((r["page_id"], r["payload"]) for r in again.collect()), key=repr) == sorted(((i, h or "") for i, _, h in rows), key=repr)
    warc.write_archives(again, str(tmp_path / "b"), payload_col="payload")
    second = warc.resolve(stage(warc.read_records(spark, str(tmp_path / "b")), "test-warc"))
    assert sorted(map(tuple, second.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == got


def test_bitmaps_that_mistake_most_rows_change_nothing(spark, tmp_path, monkeypatch):
    real = warc._bitmap
    monkeypatch.setattr(warc, "_bitmap", lambda listed, key, most: (real(listed, key, most)[0], F.col("page_id") % 2 == 0 if "origin_id" in listed.columns or len(listed.columns) == 4 else F.lit(True)))
    rows = [(2 * i, f"u{i}", BIG + str(i % 7)) for i in range(30)] + [(2 * i + 1, "o", BIG + f"own {i}") for i in range(9)]
    assert run(spark, rows, tmp_path / "a")[1] == brute(rows)


def test_files_are_bounded_and_well_formed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 5000)
    rows = [(i, f"http://x/{i}", f"{i} " * 700) for i in range(60)]
    assert run(spark, rows, tmp_path / "a", date="2024-05-06T07:08:09Z")[1] == brute(rows)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 3
    seen = 0
    for f in files:
        data = f.read_bytes()
        at = 0
        while at < len(data):
            head, body = data[at:].split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n") and b"WARC-Date: 2024-05-06T07:08:09Z" in head
            n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            assert body[n : n + 4] == b"\r\n\r\n"
            at += len(head) + 4 + n + 4
            seen += 1
    assert seen == 60


def test_no_rows_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", BIG, "x", 5, "y")], "page_id long, url string, html string, payload string, payload_bytes int, maybe string")
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).collect() == []
    warc.write_archives(df, str(tmp_path / "one"))
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.read_records(spark, str(tmp_path / "one")).collect()] == [(1, len(BIG.encode()))]


def test_hot_copies_meet_apart(spark, tmp_path, monkeypatch):
    from lumenframe.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "u", BIG if i % 2 else BIG + str(i)) for i in range(60)]
    assert run(spark, rows, tmp_path / "a")[1] == brute(rows)


def test_foreign_and_damaged_archives(spark, tmp_path):
    digest = b"sha1:" + __import__("base64").b32encode(hashlib.sha1(b"hello").digest())
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    page = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:2>\r\nPage-ID: 7\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: " + digest + b"\r\nContent-Length: %d\r\n\r\n" % (len(http) + 5) + http + b"hello\r\n\r\n"
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:3>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: " + digest + b"\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.warc").write_bytes(info + page + again)
    records = stage(warc.read_records(spark, str(tmp_path / "in"), payloads=True), "test-warc")
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.resolve(records).collect()}
    assert got == {"<urn:1>": ("warcinfo", None, None), "<urn:2>": ("response", 5, None), "<urn:3>": ("revisit", 5, 7)}
    assert sorted(r["payload"] for r in warc.restore(records).collect()) == ["hello", "hello"]
    for bad in (page.replace(b"hello", b"hullo"), page[:-3], page.replace(b"hello", b"hello!"), b"junk" + page):
        with pytest.raises(ValueError):
            for fields, http_fields, payload in warc.parse(bad):
                if hashlib.sha1(payload).digest() != hashlib.sha1(b"hello").digest():
                    raise ValueError
