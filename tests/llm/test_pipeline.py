"""The pipeline's stages against plain versions, stage by stage on what the one before kept."""

import re

import corpus_pipeline as cp
import public_tokenizers as P
from sparkloom.llm import op5_byte_bpe as op5
from sparkloom.llm.common import new_folder, table

from test_near_copies import plain_stay
from test_texts import PLAIN, plain_contamination


def plain_redacted(text):
    for kind, pattern, valid in PLAIN:
        text = re.sub(pattern, lambda m: f"[{kind.upper()}]" if valid(m[0]) else m[0], text)
    return text


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    folder, docs, outs = new_folder(spark, "test-pipeline"), table(spark, sf, "documents"), []
    for n, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        outs.append(docs)
        if n < 4:
            assert docs.columns == cp.COLUMNS
    first = {r.doc_id: r.text for r in outs[0].collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf, "labels").collect()}
    good = [i for i, q in labels.items() if q == (1, 0)]
    assert all(i in first for i in good)
    second = {r.doc_id: r.text for r in outs[1].collect()}
    assert second == {i: first[i] for i in plain_stay(list(first.items()))}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {r[0] for r in plain_contamination(second.items(), items) if not r[-1]}
    third = {r.doc_id: r.text for r in outs[2].collect()}
    assert third == {i: t for i, t in second.items() if i in clean}
    fourth = {r.doc_id: r.text for r in outs[3].collect()}
    assert fourth == {i: plain_redacted(t) for i, t in third.items()}
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op5.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: r.ids for r in outs[4].collect()} == {i: own.encode_ordinary(t) for i, t in fourth.items()}


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0
