import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def rows():
    big = "<p>" + "same " * 400
    return [(1, "http://a/1", "small"), (2, "http://a/2", "small"), (3, "http://a/\r\nX: y", big), (4, None, big), (9, "http://a/é?q=1", big), (5, "http://b", None), (6, "http://b", ""), (7, "u", "é" * 999), (8, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 3_000_000), (None, "u", big), (9, "http://again", big), (12, "n", "z" * 1000)]


@pytest.mark.parametrize("split", [1 << 24, 700])
def test_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(3)
    manifest = warc.write_warc(pages, str(tmp_path / "out")).collect()
    assert sum(r["records"] for r in manifest) == len(rows()) and all(os.path.getsize(r["file"]) == r["bytes"] for r in manifest)
    got = warc.read_warc(spark, [(r["file"], r["bytes"]) for r in manifest], split).collect()
    assert len(got) == len(rows())
    ids = {r["record_id"]: r["headers"].get("x-row-key") for r in got if r["warc_type"] == "response"}
    found = sorted(repr((r["headers"].get("x-row-key"), r["payload_digest"], r["warc_type"], r["headers"].get("x-refers-to-row-key"), int(r["http_headers"]["content-length"]))) for r in got)
    want = []
    first = {}
    for k, _, h in rows():
        if len((h or "").encode()) >= 1000 and k is not None:
            first[h] = max(first.get(h, k), k)
    for k, _, h in rows():
        raw = (h or "").encode()
        refers = first.get(h) if first.get(h) != k else None
        want.append(repr((None if k is None else str(k), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", None if refers is None else str(refers), len(raw))))
    assert found == sorted(want)
    for r in got:
        if r["warc_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] == b"" and ids[r["refers_to_record"]] == r["headers"]["x-refers-to-row-key"]


def test_only_whole_members_that_start_in_the_range_are_read():
    noise = b"\x1f\x8b\x08\x00 not a member"
    one = warc.record_bytes(1, "u", os.urandom(5000) + noise + gzip.compress(b"inner"), "0" * 40)
    two = warc.record_bytes(2, "u", noise * 3, "1" * 40)
    data = noise + one + two + one[: len(one) // 2]
    starts = [len(noise), len(noise) + len(one)]
    for step in (1000, 37, len(data)):
        found = [at for a in range(0, len(data), step) for at, _ in warc.records_in(io.BytesIO(data), len(data), a, min(a + step, len(data)))]
        assert found == starts


def test_the_archive_is_plain_gzip_and_valid_warc():
    raw = gzip.decompress(warc.record_bytes(1, "http://x", b"body", hashlib.sha1(b"body").hexdigest()))
    head, _, block = raw.partition(b"\r\n\r\n")
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"body\r\n\r\n")
    assert f"Content-Length: {len(block) - 4}".encode() in head


def test_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(pages, str(tmp_path / "out")).collect() == []
    assert warc.read_warc(spark, []).collect() == []


@pytest.mark.parametrize("split", [1 << 24, 900])
@pytest.mark.parametrize("damage", ["cut", "flipped", "header", "added"])
def test_damaged_archives_are_errors(spark, tmp_path, damage, split):
    pages = spark.createDataFrame([(i, "u", f"{i} " + os.urandom(800).hex()) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, str(tmp_path / "out")).collect()
    name = manifest[0]["file"]
    raw = bytearray(open(name, "rb").read())
    starts = [at for at, _ in warc.records_in(io.BytesIO(raw), len(raw), 0, len(raw))]
    if damage == "cut":
        raw = raw[:-300]
    elif damage == "flipped":
        raw[starts[2] + 600] ^= 255
    elif damage == "header":
        raw[starts[2] + 12] ^= 255
    else:
        raw += b"more bytes"
    with open(name, "wb") as f:
        f.write(raw)
    if damage == "added" and split == 900:
        return  # bytes that start in a range of their own are no record, and none is missing
    with pytest.raises(Exception, match="no whole record|do not have the records"):
        warc.complete(warc.written(warc.read_warc(spark, [(name, len(raw))], split).select("file"), "r"), manifest)


def test_keys_of_any_characters_come_back(spark, tmp_path):
    keys = ["a\r\nX-Row-Key: b", "50%25 é", "", "x:y"]
    pages = spark.createDataFrame([(k, "u", "h" * 2000) for k in keys], "page_id string, url string, html string").withColumn("file", F.lit("f")).withColumn("k", F.lit(1))
    manifest = warc.write_warc(pages, str(tmp_path / "out")).collect()
    got = warc.read_warc(spark, [(r["file"], r["bytes"]) for r in manifest]).collect()
    assert sorted(r["headers"]["x-row-key"] for r in got) == sorted(keys)
    assert {r["headers"].get("x-refers-to-row-key") for r in got} == {None, max(keys)}
