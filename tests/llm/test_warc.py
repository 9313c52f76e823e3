import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc

KIND = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://h{i % 3}.test/p {i}\r\nX: y", f"<p>{i % 17}</p>" * (i % 5)) for i in range(60)]
    return [*rows, (60, None, None), (61, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", rows[7][2]), (None, "n", "alone"), (5, "http://again.test/", rows[5][2])]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/a"
    df = spark.createDataFrame(rows, KIND).withColumn("shard", F.lit("clash")).withColumn("to", F.lit(1))
    warc.write_archive(df, folder, roll=900, shard_rows=16)
    out = warc.read_archive(spark, folder).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        ref = first.get(html or "")
        revisit = ref is not None and ref != i
        want.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", ref if revisit else None))
    assert sorted((tuple(r)[0:1] + (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr) == sorted(want, key=repr)
    assert {r["page_id"]: r["html"] for r in out if r["record_type"] == "response"}[61] == "é\r\n\r\nWARC/1.1\r\n"
    files = sorted(Path(tmp_path, "a").glob("*.warc.gz"))
    assert len(files) > 5 and not list(Path(tmp_path, "a").glob(".tmp*"))
    assert gzip.open(files[0]).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    warc.write_archive(df.repartition(5), f"file://{tmp_path}/b", roll=900, shard_rows=16)
    assert [(f.name, f.read_bytes()) for f in files] == [(f.name, f.read_bytes()) for f in sorted(Path(tmp_path, "b").glob("*.warc.gz"))]


def test_small_payloads_are_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], KIND)
    warc.write_archive(df, f"file://{tmp_path}/a", min_revisit_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_and_damaged(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], KIND), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0
    warc.write_archive(spark.createDataFrame([(1, "u", "text " * 50)], KIND), f"file://{tmp_path}/d")
    file = next(Path(tmp_path, "d").glob("*.warc.gz"))
    data = b"".join(gzip.compress(m.replace(b"text text", b"test text")) for m in warc._members(file.open("rb")))
    file.write_bytes(data)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"file://{tmp_path}/d").collect()


def test_large_ids_beside_null(spark, tmp_path):
    rows = [(2**60 + 1, "u1", "same"), (2**60 + 2, "u2", "same"), (None, "u3", "same"), (2**60 + 3, "u4", None), (None, "u5", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, f"file://{tmp_path}/large")
    got = {r["url"]: (r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, f"file://{tmp_path}/large").collect()}
    assert got == {
        "u1": (2**60 + 1, "response", None), "u2": (2**60 + 2, "revisit", 2**60 + 1), "u3": (None, "revisit", 2**60 + 1),
        "u4": (2**60 + 3, "response", None), "u5": (None, "response", None),
    }
