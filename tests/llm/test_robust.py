"""Damage, clashing names, long texts, many files, pruning, and odd tables through whole operators."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
import public_tokenizers as P
from sparkloom.llm import op7_topk_products as op7
from sparkloom.llm import op8_pii as op8
from sparkloom.llm import op9_huffman_ids as op9
from sparkloom.llm import op10_warc as op10
from sparkloom.llm.common import fresh, new_folder, table

from test_texts import plain_base
from test_tokens import word_ids


def test_fresh_names():
    assert fresh("x", ["a"]) == "x" and fresh("x", ["X", "_x"]) == "__x"


def test_op8_counts_and_spans(spark, sf):
    found = op8.op8_pii(spark, sf)
    assert found.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in found.collect():
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in base) for kind in ("email", "ip", "card", "phone")]
        spans = [(int(s), int(e), k) for k, s, e in re.findall(r"(\w+):(\d+):(\d+)", r.spans)]
        assert [s for s in spans if s[2] in ("email", "ip", "card", "phone")] == base and [s[0] for s in spans] == sorted(s[0] for s in spans)
        assert len(spans) == len(base) + r.n_iban + r.n_ssn


def test_redact_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "kept", 7)], "doc_id long, text string, _email_matches string, __EMAIL_pieces int")
    out = op8.redact(docs)
    assert out.columns == docs.columns and tuple(out.first()) == (1, "mail [EMAIL]", "kept", 7)


@pytest.fixture(scope="module")
def archive(spark):
    pages = [(i, f"u{i}", f"<p>{i}</p>" * (1 + i % 50)) for i in range(60)] + [(100, None, "x" * 5_000_000), (101, "u", "x" * 5_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    return op10.write_archives(df, new_folder(spark, "test-warc"))


def test_whole_archive(spark, archive):
    rows = op10.read_archives(spark, archive, 3000).collect()
    assert len(rows) == 62 == sum(a.n_records for a in archive) and {r.payload_bytes for r in rows if int(r.page_id) > 99} == {5_000_000}
    assert [r.refers_to for r in rows if r.page_id == "101"] == ["100"]


def test_damage_is_an_error(archive, tmp_path):
    """Whatever byte is flipped and wherever the file is cut, reading it by parts fails or gives all records."""
    path = max(archive, key=lambda a: a.n_records).path.removeprefix("file:")
    raw = open(path, "rb").read()
    rng = np.random.default_rng(3)
    starts = [m.start() for m in re.finditer(re.escape(op10.GZIP), raw)]

    def read(data):
        target = tmp_path / "a.gz"
        target.write_bytes(data)
        with target.open("rb") as f:
            return [m for i in range(0, len(raw), 5000) for m in op10.members(f, i, min(len(raw), i + 5000), whole=True)]

    whole = read(raw)
    assert len(whole) >= 60
    for at in [*rng.integers(0, len(raw), 60).tolist(), *starts[:20], *(s + 1 for s in starts[:20])]:
        bad = bytearray(raw)
        bad[at] ^= 1 << int(rng.integers(0, 8))
        try:
            assert read(bytes(bad)) == whole  # a bit that gzip does not look at
        except ValueError:
            pass
    for end in (0, 1, starts[5], starts[5] + 7, len(raw) - 3):
        with pytest.raises(ValueError):
            read(raw[:end])


def test_many_shards(spark):
    texts = [f"word{i} " * (i % 40) + "ÉÄ 12" for i in range(300)] + ["long text, " * 100_000, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id")], "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    shards = op9.write_ids(df, path, 2, new_folder(spark, "test-ids"), shards=3, file_bytes=4000)
    assert len(shards) > 10 and [s.start for s in shards] == np.cumsum([0, *(s.n_ids for s in shards[:-1])]).tolist()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, bytes(r.ids)) for r in op9.read_ids(spark, shards, 50).collect())
    rows = [(-1, "no id")] * 2 + [(i, t or "") for i, t in enumerate(texts)]
    want, start = [], 0
    for (i, _), ids in zip(rows, word_ids([t for _, t in rows])):
        want.append((i, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize(("spread", "most"), [(1.0, 0.1), (0.3, 0.6)])
def test_products_are_pruned(spread, most):
    """Vectors of spread lengths: buckets are skipped and fronts cut, and the best are those of brute force."""
    rng = np.random.default_rng(5)
    p = np.floor(rng.normal(size=(100_000, 16)) * np.exp(spread * rng.normal(size=(100_000, 1))) * 256)
    q, ids = p[:200], np.arange(len(p))
    length = np.sqrt((p * p).sum(axis=1))
    block, order = op7.Block(np.arange(200), ids[:200], q, 5), np.argsort(-length)
    for i in range(0, len(p), 10_000):  # ranges by length, each in buckets
        part = order[i : i + 10_000]
        for j in range(0, len(part), 512):
            block.search(ids[part[j : j + 512]], p[part[j : j + 512]], 512, 0.6)
    scores = q @ p.T
    scores[np.arange(200), np.arange(200)] = -np.inf
    for n in range(200):
        best = np.lexsort((ids, -scores[n]))[:5]
        assert block.best[n] == [(-int(scores[n, k]), int(k)) for k in best]
    assert block.verified < most * 200 * len(p)


def test_seeds_are_in_one_place(spark):
    """More rows than seeds, many of one length and id at the seeds' edge."""
    rows = [(i % 7, [float(i % 3), 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for seeds in (1, 10, 30, 89, 90, 500):
        got = op7.top_products(df, df.filter("vec_id = 3").distinct(), k=4, seeds=seeds, block=2, bucket=4, range_rows=8)
        scores = {}
        for q in {tuple(v) for i, v in rows if i == 3}:
            every = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q, v)), i) for i, v in rows if i != 3)
            scores[q] = [(n, i, -s) for n, (s, i) in enumerate(every[:4], 1)]
        assert sorted(tuple(r[1:]) for r in got.collect()) == sorted(x for own in scores.values() for x in own)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, empty texts, a clashing column; then no rows at all."""
    good = [(i, f"A plain sentence number {i} about the river and the town, with {i * 7} boats and {i * 3} birds over green fields.", "en", "s", 90) for i in range(40)]
    odd = [(100, None, "en", "s", None), (101, "", None, None, 0), (None, "A plain sentence without an id about the river and the town.", "en", "s", 5), good[3], (102, good[5][1], "de", "t", 90)]
    spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit(1)).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/some/labels.parquet")
    spark.createDataFrame([(1, good[9][1]), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    rows = cp.run(spark, f"{tmp_path}/some").collect()
    ids = sorted(str(r.doc_id) for r in rows)
    assert "102" not in ids and "9" not in ids and ids.count("3") == 2 and "None" in ids and {str(i) for i in range(20) if i != 9} <= set(ids)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/some/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_crc_of_query(spark, sf):
    rows = op9.op9_huffman_ids(spark, sf).filter("n_tokens = 1").collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) for r in rows)
