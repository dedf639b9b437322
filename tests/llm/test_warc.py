import base64
import gzip
import hashlib
import os

import pytest

from twinspan.llm import warc
from twinspan.operators.storage import new_path

BIG, OTHER = "<html>" + "é" * 700 + "</html>", "<p>" + "y" * 998
SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (5, "http://a/5", BIG),
    (3, "http://b/3", "small"),
    (4, "http://b/4", "small"),
    (6, None, None),
    (7, "http://c/\r\nx", ""),
    (8, "http://d/8", OTHER),
    (9, "http://d/9", "z" * 999),
    (10, "http://d/10", "z" * 999),
    (None, "http://e/", OTHER),
    (11, "http://f/", "w" * 1000),
    (11, "http://f/", "w" * 1000),
    (12, "http://long/", "long text " * 300_000),
]


def by_hand(pages):
    largest, count = {}, {}
    for i, _, h in pages:
        body = (h or "").encode()
        if len(body) >= 1000:
            count[body] = count.get(body, 0) + 1
            if i is not None:
                largest[body] = max(i, largest.get(body, i))
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = count.get(body, 0) > 1 and body in largest and largest[body] != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", largest[body] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], SCHEMA + ", payload_digest int, body string").repartition(3)
    got = warc.round_trip(pages, new_path(spark, "warc"))
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(PAGES)


def test_selected_records_by_index(spark):
    folder = new_path(spark, "warc")
    index = spark.read.schema(warc.INDEX).parquet(warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), folder))
    assert index.count() == len(PAGES)
    some = warc.read_records(index.where("page_id in (4, 5, 12)"), folder).collect()
    assert {r.page_id: bytes(r.body).decode() for r in some} == {4: "small", 5: BIG, 12: "long text " * 300_000}
    revisit = warc.read_records(index.where("page_id = 1"), folder).first()
    assert (revisit.record_type, revisit.refers_to, bytes(revisit.body)) == ("revisit", 5, b"")
    assert revisit.payload_digest == hashlib.sha1(BIG.encode()).hexdigest()


def plain_records(data):
    """A reader of its own: (WARC fields, HTTP head, payload) of each record of an uncompressed archive."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        block, data = data[: int(fields["Content-Length"])], data[int(fields["Content-Length"]) :]
        assert data[:4] == b"\r\n\r\n"
        http, _, payload = block.partition(b"\r\n\r\n")
        out.append((fields, http.decode().split("\r\n"), payload))
        data = data[4:]
    return out


def test_archives_are_warc(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    clashing = spark.createDataFrame([(*p, 1, 2, 3, "x") for p in PAGES], SCHEMA + ", file int, offset int, refers_to int, record_type string")
    warc.write_archives(clashing.repartition(2), folder)
    files = [f for f in os.listdir(f"{tmp_path}/warc") if f.endswith(".warc.gz")]
    records = [r for f in files for r in plain_records(gzip.decompress(open(f"{tmp_path}/warc/{f}", "rb").read()))]
    assert len(records) == len(PAGES)
    assert len({f["WARC-Record-ID"] for f, *_ in records}) == len(PAGES)  # page id 11 and the null id among them
    for fields, http, payload in records:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields)
        assert fields["Content-Type"] == "application/http; msgtype=response" and http[0] == "HTTP/1.1 200 OK"
        size = int(dict(h.split(": ", 1) for h in http[1:])["Content-Length"])
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and size >= warc.REVISIT_BYTES and fields["WARC-Refers-To-Target-URI"] and fields["WARC-Refers-To-Date"]
        else:
            assert len(payload) == size
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert sum(f["WARC-Type"] == "revisit" for f, *_ in records) == sum(r[3] == "revisit" for r in by_hand(PAGES))
    assert sum(p == BIG.encode() for *_, p in records) == 1


def test_each_archive_is_read_once_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 200)
    folder = new_path(spark, "warc")
    index = spark.read.schema(warc.INDEX).parquet(warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), folder))
    assert warc.read_records(index, folder).rdd.getNumPartitions() >= 4
    plan = warc.round_trip(spark.createDataFrame(PAGES, SCHEMA), new_path(spark, "warc"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # what was parsed lies in a table


def test_damage_is_noticed():
    raw = warc.record("r", 1, "u", b"body", hashlib.sha1(b"body").hexdigest())
    assert warc.parsed(raw)[1] == b"body"
    for bad in (raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9.9"), raw + b"x", raw.replace(b"HTTP/1.1", b"HTPT/1.1")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_names_of_stores():
    assert [warc.arrow_uri(x) for x in ("s3a://b/x", "file:///x", "hdfs://n/x")] == ["s3://b/x", "file:///x", "hdfs://n/x"]


def test_ranges_coalesce():
    gap, most = warc.GAP_BYTES, warc.READ_BYTES
    ranges = [(0, 10), (10, 10), (30, 5), (40 + gap, 10), (50 + gap, most), (50 + gap + most, 1)]
    reads = list(warc.coalesced(ranges))
    assert [r for _, _, inside in reads for r in inside] == ranges
    assert [(a, b) for a, b, _ in reads] == [(0, 35), (40 + gap, 50 + gap), (50 + gap, 50 + gap + most), (50 + gap + most, 51 + gap + most)]
    assert list(warc.coalesced([])) == []


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), new_path(spark, "warc")).count() == 0
