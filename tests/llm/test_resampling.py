"""The classifier against a plain computation of weights, keys and the kept set, and on held-out labels."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op6_quality as op6
from sparkloom.llm.common import table

MASK = (1 << 64) - 1


def plain_shape(t):
    if t.isdigit():
        return 1
    if t.islower():
        return 2
    if t.isupper():
        return 3 if len(t) > 1 else 4
    if t.istitle():
        return 4
    return 5 if t[0].isalpha() else 16 + zlib.crc32(t.encode()) % 1000


def plain_grams(text, bits):
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    word = [zlib.crc32(t.lower().encode()) for t in tokens]
    look = [plain_shape(t) * 2 + (i > 0 and word[i] == word[i - 1]) for i, t in enumerate(tokens)]
    bucket = lambda family, x: (family, (x * 0x9E3779B97F4A7C15 & MASK) >> (64 - bits))
    pairs = [bucket(1, a * 31 + b) for a, b in zip(word, word[1:])]
    shapes = [bucket(2, (a * 4099 + b) * 4099 + c) for a, b, c in zip(look, look[1:], look[2:])]
    return [*(bucket(0, w) for w in word), *pairs, *shapes]


def plain_weights(docs, targets, bits, prior):
    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(plain_grams(text, bits))
        if i in targets:
            target.update(plain_grams(text, bits))
    totals = [[sum(n for (f, _), n in c.items() if f == k) for k in range(3)] for c in (raw, target)]

    def ratio(g):
        r, t = totals[0][g[0]], totals[1][g[0]]
        return math.log((target[g] + prior) / (raw[g] / r * t + prior)) if r and t else 0.0

    return [sum(map(ratio, plain_grams(text, bits))) for _, text in docs]


@pytest.mark.parametrize(("k", "temperature"), [(None, 1.0), (60, 1.0), (7, 3.0), (0, 1.0), (5000, 1.0)])
def test_plain_resampling(spark, sf, k, temperature):
    docs = table(spark, sf, "documents").unionByName(spark.createDataFrame([(None, "no id here"), (90_001, None), (90_002, "")], "doc_id long, text string"), allowMissingColumns=True)
    labels = table(spark, sf, "labels").withColumn("toxic", F.lit(0))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    targets = {r.doc_id for r in labels.collect() if r.quality == 1}
    weights = plain_weights(rows, targets, 14, 20.0)
    hashes = {r.doc_id: r.h & MASK for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    keys = [w / temperature - math.log(-math.log(((hashes[i] >> 11) + 0.5) / 2**53)) for (i, _), w in zip(rows, weights)]
    n = sum(w >= -3.0 for w in weights) if k is None else k
    least = sorted(keys, reverse=True)[n - 1] if 0 < n <= len(keys) else (math.inf if n < 1 else -math.inf)
    got = sorted(op6.resample(docs, labels, k=k, temperature=temperature, keep=("doc_id",)).collect(), key=lambda r: (str(r.doc_id), r._key))
    want = sorted(zip(rows, weights, keys), key=lambda x: (str(x[0][0]), x[2]))
    assert [r.doc_id for r in got] == [x[0][0] for x in want]
    assert [r._weight for r in got] == pytest.approx([x[1] for x in want], abs=1e-6)
    assert [r._key for r in got] == pytest.approx([x[2] for x in want], abs=1e-6)
    assert [r._kept for r in got] == [x[2] >= least - 1e-7 for x in want]


def test_held_out_labels(spark):
    """Fitted with the labels of even ids, judged by those of odd ids."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    found = op6.resample(table(spark, sf, "documents"), labels.filter("doc_id % 2 = 0"), keep=("doc_id",))
    rows = found.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("_kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    share = {(r.quality, r.toxic): r.kept for r in rows}
    print(rows)
    assert share[1, 0] >= 0.99 and share[0, 0] <= 0.05 and share[1, 1] <= 0.5


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 5, "w", "t") for i in range(5)], "doc_id long, text string, _weight int, _text string, _Kept string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = op6.resample(docs, labels)
    assert out.columns == ["doc_id", "text", "_text", "_weight", "_toxic", "_key", "_kept"] and all(r._kept for r in out.collect())


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "Fine words, here. " * 100_000), (2, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert op6.resample(docs, labels).count() == 2
