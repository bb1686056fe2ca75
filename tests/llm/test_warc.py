"""Archives: repeated rows, small payloads, several files, and joins without a hot null key."""

import base64
import glob
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import warc

COLUMNS = "page_id long, url string, html string"


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def expected(rows, least):
    """What a reader must find: of equal payloads of ``least`` bytes the largest id is stored, once; smaller ones are stored each."""
    out, stored = Counter(), set()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for i, u, h in rows:
        size, key = len((h or "").encode()), h or ""
        holds = (-1 if i is None else i) == top[key] and key not in stored
        if size >= least and holds:
            stored.add(key)
        refers = None if size < least or holds else top[key]
        out[i, u, size, digest(h), "response" if refers is None else "revisit", refers] += 1
    return out


@pytest.mark.parametrize("least", [0, 4, 1000])
def test_repeated_rows_and_small_payloads(spark, least):
    rows = [(1, "a", "same"), (2, "b", "same"), (2, "b", "same"), (2, "b", "same"), (3, "c", "abc"), (4, "d", "abc"), (5, None, None), (6, "f", ""), (7, "g", "é" * 600), (8, "h", "é" * 600), (9, "i", "alone")]
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, COLUMNS), least).collect())
    assert got == expected(rows, least)


def test_several_files_hold_each_capture_once(spark, tmp_path):
    rows = [(i, f"http://h/{i % 7}", ("page %d " % (i % 40)) * 50) for i in range(200)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, COLUMNS), path, file_bytes=4096)
    assert len(glob.glob(f"{path}/part-*")) > 3
    found = warc.read_captures(spark, path).collect()
    assert sorted((r.page.page_id, r.page.url) for r in found) == sorted((i, u) for i, u, _ in rows)
    for r in found:
        text = r.response.payload if r.response.type == "response" else r.original.payload
        assert text == rows[r.page.page_id][2] and r.request.uri == r.page.url


def test_a_record_of_more_than_one_member(spark, tmp_path):
    rows = [(1, "u", "0123456789abcdef" * (1 << 20) + "end"), (2, "v", "small")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, COLUMNS), path)
    got = {r.page.page_id: r.response.payload for r in warc.read_captures(spark, path).collect()}
    assert got == {1: rows[0][2], 2: "small"}


def test_responses_do_not_meet_in_one_task(spark, tmp_path):
    """None of 2,000 distinct pages refers to another: as nulls they would all be one key."""
    path = str(tmp_path / "w")
    warc.write_archives(spark.range(2_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")), path)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        sizes = sorted(r["count"] for r in warc.read_captures(spark, path, payloads=False).groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2_000 and len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
