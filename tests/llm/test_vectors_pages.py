"""Exact retrieval and WARC archives against plain versions."""

import hashlib
import io
import math
import random

import pytest

from sparkloom.llm import op7_topk_products as op7
from sparkloom.llm import op10_warc as op10
from sparkloom.llm.common import new_folder, table


def plain_top(rows, asked, k=5):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ints:
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_op7_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, op7.op7_topk_products(spark, sf).collect())) == plain_top(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_products_of_odd_vectors(spark, spread):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * math.exp(spread * rng.random()) for _ in range(8)]) for i in range(400)]
    rows += [(i, [float(i % 3)] * 8) for i in range(400, 600)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, []), (905, []), (906, [1.0]), (910, [0.0] * 8), (920, [1e6] * 8)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<double>, score double")
    asked = lambda i: i % 10 == 0 or i == 904
    got = op7.top_products(df, df.filter("vec_id % 10 = 0 or vec_id = 904"), seeds=20, block=16, bucket=32, coordinate_from=0.3)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, asked)
    assert op7.top_products(df, df.limit(0)).count() == 0


def test_products_beyond_doubles(spark):
    rows = [(i, [1e9 + i, -1e9 + 3 * i]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op7.top_products(df, df.filter("vec_id = 3"), k=3)
    limit = 2**63 - 1
    want = [(q, n, i, min(limit, s)) for q, n, i, s in plain_top(rows, lambda i: i == 3, 3)]
    assert [r[3] for r in sorted(map(tuple, got.collect()))] == [r[3] for r in want]


def plain_records(rows):
    first = {}
    for page, html in rows:
        if page is not None and len(html.encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    for page, html in rows:
        other = first.get(html)
        revisit = other is not None and other != page and sum(h == html for _, h in rows) > 1
        yield page, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if revisit else "response", other if revisit else None


def test_op10_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html or "") for r in table(spark, sf, "pages").collect()]
    assert sorted(map(tuple, op10.op10_warc(spark, sf).collect())) == sorted(plain_records(rows))


def test_archives_of_odd_pages(spark):
    long = "é" * 80
    rows = [(1, None, None), (2, "http://a/\r\nx: y", long), (3, None, long), (3, "u", long), (None, "u", long), (None, "v", "b" * 200), (5, "u", "b" * 99), (6, "u", "b" * 99), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    archives = op10.write_archives(df, new_folder(spark, "test-warc"))
    for split in (64, 1000, 1 << 20):
        read = op10.read_archives(spark, archives, split).collect()
        got = sorted(((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in read), key=str)
        assert got == sorted(plain_records([(p, h or "") for p, _, h in rows]), key=str)
    assert sum(a.n_records for a in archives) == len(rows)
    assert op10.read_archives(spark, op10.write_archives(df.limit(0), new_folder(spark, "test-warc"))).count() == 0


def test_members_at_every_cut():
    data = b"".join(op10.gzip_member(b"WARC/1.1\r\nn: %d\r\n\r\n" % i + b"\x1f\x8b\x08" * i, 0) for i in range(30)) + b"\x1f\x8b"
    for size in (1, 7, 50, 10_000):
        got = [m for i in range(0, len(data), size) for m in op10.members(io.BytesIO(data), i, min(len(data), i + size), chunk=16)]
        assert [int(m.split(b"\r\n")[1][3:]) for m in got] == list(range(30))
