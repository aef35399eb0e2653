import gzip
import hashlib
import os

import pytest

from quarry.llm import warc
from quarry.llm.scratch import Scratch


def expected(rows):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        again = p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(spark, df.withColumn("payload", df.page_id).withColumn("n", df.page_id))  # clashing names
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)


def test_round_trip(spark):
    long = "é<p>" * 40
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "", ""), (None, "u", long), (7, "u", "\r\n\r\nWARC/1.0\r\n\x1f\x8b\x08" * 9), (8, "u", "x" * 3_000_000), (8, "u", "x" * 3_000_000)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def members(path, start, end):
    with open(path, "rb") as f:
        return [at for at, _ in warc.Members(f, os.path.getsize(path), start, end)]


def test_each_record_has_one_owner(tmp_path):
    payloads = [os.urandom(n) for n in (10, 5000, 200_000, 3, 70_000)] + [b"\x1f\x8b\x08\x00" * 3000]
    parts = [warc.record_bytes(str(i), "response", "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1") == len(parts)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    size = path.stat().st_size
    for step in (1000, 4097, 65536, size):
        assert [at for s in range(0, size, step) for at in members(path, s, s + step)] == starts


def test_damage_costs_one_record(tmp_path):
    parts = [warc.record_bytes(str(i), "response", "u", os.urandom(3000), "x", None) for i in range(4)]
    broken = bytearray(b"".join(parts))
    broken[len(parts[0]) + 200 : len(parts[0]) + 300] = b"\xff" * 100
    path = tmp_path / "a.warc.gz"
    path.write_bytes(bytes(broken))
    starts = [sum(map(len, parts[:i])) for i in range(4)]
    assert members(path, 0, 10**9) == [starts[0], starts[2], starts[3]]
    path.write_bytes(b"".join(parts)[:-20])
    assert members(path, 0, 10**9) == starts[:3]


def test_reader_over_small_ranges(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * (i * 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    s = Scratch(spark, "t")
    manifest = s.save(warc.write_archives(warc.archive_records(df, s), f"{s.path}/archives"), "manifest")
    assert manifest.count() == 1
    got = warc.read_archives(manifest, range_bytes=700).collect()
    assert sorted(int(r.record_id) for r in got) == list(range(40))
    assert {int(r.record_id): bytes(r.payload).decode() for r in got} == {i: h for i, _, h in rows}
