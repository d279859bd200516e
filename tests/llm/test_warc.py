import base64
import gzip
import hashlib
import pathlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pytest
from cases import awkward, rows

from waymark.llm import arrays, warc

SCHEMA = "page_id long, url string, html string, digest string, file string, offset long, row int, task int, body string"


def pages(spark, texts, ids=None, urls=None):
    return spark.createDataFrame([(i if ids is None else ids[i], f"http://a.example/{i}" if urls is None else urls[i], t, "x", "f", 3, 1, 2, "b") for i, t in enumerate(texts)], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(texts, min_bytes=0):
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t or ""].append(i)
    out = []
    for i, t in enumerate(texts):
        size, last = len((t or "").encode()), max(by[t or ""])
        again = size >= min_bytes and i != last
        out.append((i, size, digest(t), "revisit" if again else "response", last if again else None))
    return sorted(out)


@pytest.mark.parametrize("min_bytes", [0, 1, 6, 10**9])
def test_equals_brute_force(spark, min_bytes):
    texts = awkward() + ["<html>é\r\n\r\n</html>"] * 4 + ["WARC/1.1\r\n\r\n"] * 2
    index = warc.write(pages(spark, texts), min_bytes=min_bytes)
    assert sorted(rows(warc.resolved(warc.read(index)))) == brute(texts, min_bytes)


def test_payload_and_url_come_back_exactly(spark):
    texts = awkward() + ["\x00\r\nWARC/1.1   end\r\n\r\n"]
    urls = [None, "", "http://a/ b\r\nX-Other: 1", "http://é.example/%41?q=1#x", "\t"] + [f"http://h/{i}" for i in range(len(texts) - 5)]
    got = {r["page_id"]: r for r in warc.read(warc.write(pages(spark, texts, urls=urls), min_bytes=10**9)).collect()}
    assert [got[i]["url"] for i in range(len(texts))] == urls
    assert [bytes(got[i]["payload"]) for i in range(len(texts))] == [(t or "").encode() for t in texts]


def test_files_are_whole_archives_of_the_index(spark):
    texts = ["a" * n for n in range(50)] * 2
    index = warc.write(pages(spark, texts)).collect()
    by = defaultdict(list)
    for r in index:
        by[r["file"]].append(r)
    for file, found in by.items():
        data = pathlib.Path(urlparse(file).path).read_bytes()
        at = min(r["offset"] for r in found)
        assert gzip.decompress(data[:at]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            assert r["record_id"].encode() in gzip.decompress(data[at : at + r["length"]])
            at += r["length"]
        assert at == len(data)
    assert Counter(r["record_type"] for r in index) == {"response": 50, "revisit": 50}


def test_several_files_per_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    texts = [str(i) * 500 for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        index = warc.write(pages(spark, texts).coalesce(1))
        assert index.select("file").distinct().count() == 8
        assert sorted(rows(warc.resolved(warc.read(index)))) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_selected_records_only(spark):
    texts = [f"page {i}" * 200 for i in range(200)]
    index = warc.write(pages(spark, texts))
    some = index.where("page_id % 7 = 0")
    for gap, most in ((0, 1), (1 << 16, 1 << 23), (100, 2000)):
        got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(some, gap, most).collect()}
        assert got == {i: t for i, t in enumerate(texts) if i % 7 == 0}


def test_neighbouring_ranges_are_one_read():
    places = [(0, 10), (10, 10), (25, 5), (1000, 10), (1010, 500), (1510, 10)]
    assert warc.ranges(places, gap=5, most=100) == [(0, 30, [0, 1, 2]), (1000, 1010, [3]), (1010, 1510, [4]), (1510, 1520, [5])]
    assert warc.ranges(places, gap=0, most=1000) == [(0, 20, [0, 1]), (25, 30, [2]), (1000, 1520, [3, 4, 5])]
    assert warc.ranges([(5, 5), (5, 5)], 0, 100) == [(5, 10, [0, 1])] or len(warc.ranges([(5, 5), (5, 5)], 0, 100)) == 1
    assert warc.ranges([], 0, 0) == []


def test_a_changed_payload_is_noticed(spark):
    index = warc.write(pages(spark, ["a payload"]))
    row = index.first()
    path = pathlib.Path(arrays.local_path(row["file"]))
    record = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 200 OK\r\n\r\nother")
    path.write_bytes(path.read_bytes()[: row["offset"]] + gzip.compress(record))
    size = path.stat().st_size - row["offset"]
    changed = index.selectExpr("page_id", "file", "offset", f"cast({size} as bigint) as length")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(changed).collect()


def test_repeated_rows_null_ids_and_empty_table(spark):
    found = rows(warc.resolved(warc.read(warc.write(pages(spark, ["same"] * 4 + [None], ids=[5, 5, None, 1, None])))))
    kinds = Counter((r[0], r[3], r[4]) for r in found)
    assert kinds == {(5, "response", None): 1, (5, "revisit", 5): 1, (None, "revisit", 5): 1, (1, "revisit", 5): 1, (None, "response", None): 1}
    assert rows(warc.resolved(warc.read(warc.write(pages(spark, []))))) == []
