"""A text that is kept goes to Python once, not beside a copy of itself."""

import re

from sparkloom.llm import op3_decontaminate as op3
from sparkloom.llm import op6_quality as op6
from sparkloom.llm.common import table


def sent(df):
    """The columns that the outermost Python step gets."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"(\w+)#\d+", re.search(r"MapInArrow \w+\(([^)]*)\)", plan)[1])


def test_columns_sent(spark, sf):
    docs, labels, items = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    assert sorted(sent(op6.resample(docs, labels))) == sorted(docs.columns)
    assert sorted(sent(op6.resample(docs, labels, keep=("doc_id", "lang")).filter("_kept"))) == ["doc_id", "lang", "text_"]
    assert sorted(sent(op3.contamination(docs, items, keep=("text", "lang")))) == ["doc_id", "lang", "text"]
    assert sorted(sent(op3.contamination(docs, items))) == ["doc_id", "text_"]


def test_place_of_text(spark):
    words = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(words, 1, "a"), ("Fine words here.", 2, None), (None, None, "c")], "text string, doc_id long, note string")
    labels = spark.createDataFrame([(2, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", words)], "item_id string, text string")
    weight = {r.doc_id: r._weight for r in op6.resample(docs, labels, keep=("doc_id",)).collect()}
    for keep in (("text", "doc_id", "note"), ("note", "doc_id", "text"), ("doc_id", "note")):
        out = op6.resample(docs, labels, keep=keep)
        assert out.columns[: len(keep)] == list(keep) and {r.doc_id: r._weight for r in out.collect()} == weight
    assert weight[2] > weight[1]
    for keep in ((), ("text",), ("note", "text"), ("note",)):
        out = op3.contamination(docs, items, keep=keep)
        assert out.columns[: 1 + len(keep)] == ["doc_id", *keep]
        rows = {r.doc_id: r for r in out.collect()}
        assert {i: (r.n_words, r.n_hit) for i, r in rows.items()} == {1: (11, 11), 2: (3, 0), None: (0, 0)}
        assert all(rows[d.doc_id][c] == d[c] for d in docs.collect() for c in keep)
    by_text = op3.contamination(docs, items, id_col="text", keep=("doc_id",))
    assert by_text.columns[:2] == ["text", "doc_id"] and {(r.text, r.n_hit) for r in by_text.collect()} == {(words, 11), ("Fine words here.", 0), (None, 0)}
