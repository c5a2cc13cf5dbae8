import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest

from lexloom.llm import queries, warc

SF = "/root/testdata/sf0.01"


def brute(rows, least=0):
    out = []
    top = {}
    for k, _, html in rows:
        top.setdefault(html or "", []).append(k)
    for k, _, html in rows:
        data = (html or "").encode()
        best = max((x for x in top[html or ""] if x is not None), default=None)
        revisit = len(data) >= least and len(top[html or ""]) > 1 and best is not None and k != best
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op5_warc(spark, SF).collect()), key=str) == brute(rows)


ODD = [(1, "u", "same"), (2, None, "same"), (2, "v", "same"), (None, "w", "same"), (3, "x\r\ny", None), (4, "z", ""), (-5, "ü", "é" * 70000), (6, "s", "short"), (7, "s", "short"), (8, "big", "a\0" * 9_000_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    pages = spark.createDataFrame([(*r, "extra") for r in ODD], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(pages, min_bytes=least, file_bytes=100_000).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(ODD, least)
    assert {r["url"] for r in got} == {"u", None, "v", "w", "x%0D%0Ay", "z", "ü", "s", "big"}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_files_are_bounded_by_bytes_and_read_as_streams(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, "u", rng.bytes(int(n)).hex()) for i, n in enumerate([*rng.integers(0, 2000, 300), *rng.integers(9_000, 14_000, 20), 60_000, 400_000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    bound = 50_000
    monkeypatch.setattr(warc, "CLASSES", (5_000, 30_000, 40_000))
    warc.write(pages, f"file://{tmp_path}/a", file_bytes=bound)
    found = {}
    for path in tmp_path.glob("a/*/part-*"):
        records = list(warc.read(open(path, "rb")))
        payloads = [len(r.http[1]) for r in records]
        assert sum(payloads) <= bound or len(payloads) == 1
        found |= {warc.page_of(r.headers["warc-record-id"]): r.http[1].decode() for r in records}
    assert found == {k: html for k, _, html in rows}
    got = warc.read_archives(spark, f"file://{tmp_path}/a")
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()  # no file is read into a row
    assert {r["page_id"]: r["payload"].decode() for r in got.collect()} == found
    monkeypatch.setattr(warc, "_opens", lambda url: False)  # a store that only Spark can open
    whole = warc.read_archives(spark, f"file://{tmp_path}/a")
    assert "content" in whole._jdf.queryExecution().executedPlan().toString()
    assert {r["page_id"]: r["payload"].decode() for r in whole.collect()} == found


def test_members_are_plain_gzip_of_one_record_each():
    data = [warc.record(i, "u", b"x" * i) for i in range(3)]
    archive = b"".join(warc.member(d) for d in data)
    assert gzip.decompress(archive) == b"".join(data)
    for chunk in (1, 7, 1 << 16):
        assert [warc.page_of(r.headers["warc-record-id"]) for r in warc.read(io.BytesIO(archive), chunk)] == [0, 1, 2]


@pytest.mark.parametrize("fault", ["cut", "digest", "length", "long"])
def test_damage_is_told(fault):
    data = warc.record(1, "u", b"payload")
    data = {"digest": data.replace(b"payload", b"pAyload"), "length": data.replace(b"Content-Length: ", b"Content-Size: "), "long": data + b"more"}.get(fault, data)
    packed = warc.member(data)
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(packed[:-20] if fault == "cut" else packed), 16))


def test_ids():
    for k in (None, 0, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(k)) == k
    assert zlib.crc32(b"") == 0
