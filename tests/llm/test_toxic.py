"""Toxic rows are left out of the corpus, however long they are; clean ones stay."""

import random

from sparkloom.llm import op6_quality as op6
from sparkloom.llm.common import table


def test_labelled_toxic_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = op6.op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    toxic = [r for r in found if r.quality == 1 and r.toxic == 1]
    good = [r for r in found if r.quality == 1 and r.toxic == 0]
    assert sum(not r.kept for r in toxic) >= 0.9 * len(toxic) and sum(r.kept for r in good) >= 0.99 * len(good)


def test_one_word_in_a_long_text(spark):
    rng = random.Random(4)
    text = lambda: [rng.choice("red green blue brown black white grey".split()) for _ in range(2000)]
    rows = [(i, " ".join([*text(), "Scum"] if i % 5 == 0 else text())) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in op6.resample(docs, labels).collect() if r._kept}
    assert not any(i % 5 == 0 for i in kept) and len(kept) >= 150
