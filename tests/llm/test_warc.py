import base64
import hashlib
import struct

import duckdb

from saltmarsh.llm import common, warc

PAGES = [(i, None if i % 11 == 0 else f"http://e.x/{i}?a=ü\n", ["same", "", None, "é" * 50_000, f"page {i} <p>" * 20][i % 5]) for i in range(60)] + [(None, None, "same"), (3, "u", "é" * 50_000), (None, "a", "only"), (None, "b", "only"), (58, "u", "é" * 50_000)]


def brute():
    rows = [(p, (h or "").encode()) for p, _, h in PAGES]
    top = {}
    for p, h in rows:
        if p is not None:
            top[h] = max(p, top.get(h, p))
    out = []
    for p, h in rows:
        to = top.get(h) if sum(x == h for _, x in rows) > 1 and h in top and (p is None or p < top[h]) else None
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, uri string").repartition(3)
    archives = warc.write_archives(df, common.new_path(spark, "test-warc"))
    found = warc.read_archives(archives)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == brute()
    kept = {bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert kept == {(h or "").encode() for _, _, h in PAGES}
    assert found.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    assert archives.agg({"records": "sum"}).first()[0] == len(PAGES)
    large = warc.read_archives(warc.write_archives(df, common.new_path(spark, "test-warc"), least_bytes=10))
    assert large.where("record_type = 'revisit'").agg({"payload_bytes": "min"}).first()[0] == 100_000
    assert warc.read_archives(warc.write_archives(df.limit(0), common.new_path(spark, "test-warc"))).count() == 0


def test_sql_agrees(spark):
    rows = [p for p in PAGES if p[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = warc.read_archives(warc.write_archives(df, common.new_path(spark, "test-warc")), payloads=False)
    assert sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(con.execute(warc.OP4_SQL).fetchall(), key=str)


def test_archive_layout(tmp_path):
    uri = f"file://{tmp_path}/a.warc.zst"
    out = warc.Writer(uri)
    records = [warc.record(i, f"http://e.x/{i}", f"<html>page {i} of many similar ones</html>".encode() * 30, "D", None, False) for i in range(900)]
    for r in records:
        out.add(r)
    _, n, size = out.close()
    raw = (tmp_path / "a.warc.zst").read_bytes()
    magic, length = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and n == 900 and raw[8 + length : 12 + length] == b"\x28\xb5\x2f\xfd" and len(raw) == 8 + length + size
    assert raw.count(b"\x28\xb5\x2f\xfd") >= 900  # a frame for each record
    found = list(warc.read(uri))
    assert len(found) == 900 and found[7][0]["WARC-Record-ID"] == "<urn:x-page:7>" and found[7][1].endswith(b"</html>")
    assert size < sum(map(len, records)) / 10
