"""Archives: exact round trips, equal payloads once, and the awkward cases."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from grainmill.llm import warc

SCHEMA = "page_id long, url string, html string, body string, sha256 string, file string, part string, copies int"


def given(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", "w", 1) for i, u, h in rows], SCHEMA)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (30, "http://a/3", "<p>same</p>"), (4, "http://a/4", None), (5, None, ""), (6, "http://a/6", "ends in a break\r\n"),
    (7, "http://a/7", "holds\r\n\r\nends\r\n\r\n\r\n\r\nof records\r\n\r\n"), (8, "http://a/8", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"), (9, "http://a/\r\nX: 9", "\r\n\r\n"), (10, "http://a/10", "\r\r\n\r\n\r\r\n"),
    (11, "http://a/ü", "äöü漢字😀 \x00\x01"), (12, "http://a/long", "word " * 400_000), (13, "http://a/13", "ends in a break\r\n"), (None, "http://a/none", "<p>same</p>"), (None, "http://a/only", "only"), (None, "http://a/only", "only"),
    (14, "http://a/14", "twice"), (14, "http://a/14", "twice"), (14, "http://a/14b", "twice"), (15, "u", "\n\r\n"), (16, "u", "\r\n"), (17, "u", "\r"),
]


def plain(rows, least=0):
    groups = {}
    for n, (i, u, h) in enumerate(rows):
        groups.setdefault((h or "").encode(), []).append((i is not None, i or 0, u or "", -n, i))
    out = []
    for body, members in groups.items():
        top = max(members)
        for m in members:
            first = len(body) < least or m == top
            out.append((m[4], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_pages_like_plain_python(spark, least):
    got = [tuple(r) for r in warc.pages(given(spark, ROWS).repartition(3), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == plain(ROWS, least)


def test_records_come_back_byte_for_byte(spark, tmp_path):
    warc.write(given(spark, ROWS).repartition(4), f"{tmp_path}/a")
    warc.store(warc.read(spark, f"{tmp_path}/a"), f"{tmp_path}/s")
    back = {}
    for r in warc.original(warc.restore(spark, f"{tmp_path}/s")).collect():
        back.setdefault(Path(r["file"]).name, []).append((r["place"], bytes(r["record"])))
    files = list(Path(tmp_path, "a").glob("*.gz"))
    assert sum(len(x) for x in back.values()) == len(ROWS)
    for f in files:
        assert gzip.decompress(f.read_bytes()) == b"".join(x for _, x in sorted(back.get(f.name, [])))
    kept = spark.read.parquet(f"{tmp_path}/s/part=payloads")
    assert kept.count() == kept.select("sha256").distinct().count() == len({(h or "").encode() for _, _, h in ROWS})


def test_payloads_that_repeat_in_archives_are_stored_once(spark, tmp_path):
    warc.write(given(spark, ROWS), f"{tmp_path}/a", least=10**9)  # every record a response
    warc.store(warc.read(spark, f"{tmp_path}/a"), f"{tmp_path}/s")
    kept = spark.read.parquet(f"{tmp_path}/s/part=payloads")
    assert kept.count() == len({(h or "").encode() for _, _, h in ROWS})
    found = warc.restore(spark, f"{tmp_path}/s")
    assert sorted(bytes(r[0]) for r in found.select("payload").collect()) == sorted((h or "").encode() for _, _, h in ROWS)
    assert found.where("record_type <> 'response'").count() == 0


def test_other_archives_and_damage(spark, tmp_path):
    record = lambda head, block: f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    Path(tmp_path, "x").mkdir()
    members = [record("WARC-Type: warcinfo\r\nContent-Type: text/plain\r\n", b"software: x\r\n\r\ny"), record("WARC-Type: revisit\r\nWARC-Refers-To: <urn:absent>\r\n", b""), record("warc-type: resource\r\n", b"\xff\xfe\x00")]
    Path(tmp_path, "x", "m.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))  # a member for each record
    rows = warc.read(spark, f"{tmp_path}/x").orderBy("place").collect()
    assert [(r["record_type"], r["payload"] and bytes(r["payload"])) for r in rows] == [("warcinfo", b"software: x\r\n\r\ny"), ("revisit", None), ("resource", b"\xff\xfe\x00")]
    warc.store(warc.read(spark, f"{tmp_path}/x"), f"{tmp_path}/s")
    assert {r["record_type"]: r["payload_bytes"] for r in warc.restore(spark, f"{tmp_path}/s").collect()} == {"warcinfo": 16, "revisit": None, "resource": 3}
    Path(tmp_path, "x", "m.warc.gz").write_bytes(gzip.compress(members[0][:-9]))
    with pytest.raises(Exception, match="has no end"):
        warc.read(spark, f"{tmp_path}/x").count()
    bad = spark.read.parquet(f"{tmp_path}/s").withColumn("payload", F.when(F.col("payload").isNotNull(), F.lit(b"other")))
    bad.write.partitionBy("part").parquet(f"{tmp_path}/b")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.restore(spark, f"{tmp_path}/b").collect()


def test_empty_table(spark):
    assert warc.pages(given(spark, [])).count() == 0


def test_base32(spark):
    for text in ("", "a", "longer"):
        got = spark.range(1).select(warc.base32(F.sha1(F.lit(text.encode())))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
