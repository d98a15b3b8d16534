import base64
import hashlib
import os
from collections import defaultdict

import pytest

from quillfact.llm import op10_warc as m


def want_of(rows, min_bytes=0):
    by = defaultdict(list)
    for i, (p, _, h) in enumerate(rows):
        by[h or ""].append((p is None, p or 0, i))
    out = []
    for h, xs in by.items():
        data = h.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, (none, p, _) in enumerate(sorted(xs)):
            p = None if none else p
            first = None if sorted(xs)[0][0] else sorted(xs)[0][1]
            again = k > 0 and len(data) >= min_bytes
            out.append((p, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def fake(length=5, tail="xxxxx"):
    return f"{m.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: {length}\r\n\r\n{tail}"


def pages():
    whole = f"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    digest = base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    nested = f"{m.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:778>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(whole)}\r\n\r\n{whole}\r\n\r\n"
    rows = [(k, f"http://h/{k}", f"<p>é {k} " + "y" * (37 * k % 400)) for k in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "a\r\nb", "dup"), (99, "u", "dup"), (99, "v", "dup"), (None, "w", "dup"), (103, "x", m.MAGIC), (104, "x", "a" + m.MAGIC + m.MAGIC), (105, "x", fake() + "tail"), (106, "x", "pre" + nested + nested + "post"), (107, "x", fake(10**6, "")), (108, "x", "\r\n\r\n"), (109, "x", "z" * 5000 + nested + "z" * 5000), (None, None, None)]
    return rows


@pytest.mark.parametrize("split,parts", [("128m", 1), ("700b", 1), ("700b", 4), ("3000b", 2)])
def test_round_trip(spark, tmp_path, split, parts):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, value int, digest string").repartition(parts)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        path = m.write(df, f"{tmp_path}/w")
        got = sorted(map(tuple, m.read(spark, path).select(*m._RECORD_COLS).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want_of(rows)


def test_files_are_archives(spark, tmp_path):
    rows = pages()
    m.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    [name] = [f for f in os.listdir(f"{tmp_path}/w") if f.startswith("part-")]
    data, at, n = open(f"{tmp_path}/w/{name}", "rb").read(), 0, 0
    while at < len(data):
        assert data[at : at + 10] == b"WARC/1.1\r\n"
        head = m.Head(data[at + 10 :])
        assert data[at + head.size - 4 : at + head.size] == b"\r\n\r\n"
        at, n = at + head.size, n + 1
    assert n == len(rows)


def test_min_bytes_and_empty(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, m.read(spark, m.write(df, f"{tmp_path}/w", min_bytes=3)).select(*m._RECORD_COLS).collect()), key=str)
    assert got == want_of(rows, 3)
    assert m.read(spark, m.write(df.limit(0), f"{tmp_path}/e")).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(map(tuple, m.op10_warc_roundtrip(spark, "/root/testdata/sf0.001").select(*m._RECORD_COLS).collect()), key=str)
    assert got == want_of(rows)
