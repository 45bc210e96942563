"""Decontamination in several passes judges each row by its own text."""

import pytest

from sparkloom.llm import op3_decontaminate as op3


@pytest.mark.parametrize("keep", [(), ("lang",)])
def test_rows_that_share_an_id(spark, keep):
    rows = [(1, "x a b y", "l"), (1, "clean", "l"), (None, "q c d", "l"), (None, "fine here too", "l"), (None, None, "l"), (2, "a b", "l"), (2, "a b", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f")], "item_id long, text string")
    out = lambda **blocks: sorted(map(str, op3.contamination(docs, items, keep=keep, **blocks).collect()))
    assert out(block_bytes=2, blocks_at_once=1) == out()


def test_files_of_items(spark, monkeypatch):
    """One file or many, small batches or large, repeated and null ids, kept columns named like results."""
    rows = [(i % 5 or None, f"w{i % 7} a b {'c ' * (i % 4)}d e f", f"x{i}", i, "spans") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_ string, N_Words int, spans string").repartition(3)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "c d e f", "e f", "w3", None, "", "a b c"])] + [(None, "w5")], "item_id long, text string")
    one = op3.contamination(docs, items, keep=("text_", "N_Words", "spans"))
    assert one.columns == ["doc_id", "text_", "n_words", "n_hit", "spans", "items"]
    want = sorted(map(str, one.collect()))
    assert len(want) == 200 and any("'2'" in r for r in want)
    for size, most, batch in ((1, 1, 1), (4, 2, 500), (4, 9, 10**6)):
        many = op3.contamination(docs, items, keep=("text_",), block_bytes=size, blocks_at_once=most, batch_bytes=batch)
        assert sorted(map(str, many.collect())) == want
    assert op3.contamination(docs.limit(0), items).count() == 0
    assert all(r.n_hit == 0 for r in op3.contamination(docs, items.limit(0)).collect())
