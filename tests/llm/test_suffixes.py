"""Repeated strings against brute force."""

import random

import numpy as np

import pytest

from sparkloom.llm import op2_suffix_dedup as op2
from sparkloom.llm.common import table
from sparkloom.llm.dc3 import suffix_ranks


def got_rows(df):
    return sorted(map(tuple, op2.digests(df).collect()), key=str)


def test_op2_query(spark, sf):
    rows = [(r.doc_id, r.text.encode()) for r in table(spark, sf, "documents").collect()]
    want = sorted(op2.plain_removed(rows, 50), key=str)
    assert sorted(map(tuple, op2.op2_suffix_dedup(spark, sf).collect()), key=str) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize(("width", "gram", "crowded"), [(20, 8, 4096), (20, 12, 1), (50, 24, 4096), (50, 24, 1)])
def test_removed_from_odd_rows(spark, width, gram, crowded):
    rng = random.Random(width)
    words = ["ab", "a", "é", "xyz", "ab" * 8, " ", "some more of the same text, "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    rows = [*enumerate(texts), (50, None), (51, ""), (52, texts[3]), (52, texts[3]), (53, "a" * 300), (54, "a" * 200), (None, texts[3]), (None, "a" * 90), (-1, texts[5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    want = op2.plain_removed([(d, (t or "").encode()) for d, t in rows if d is not None], width)
    got = got_rows(op2.removed(df.repartition(5), None, width, gram, crowded=crowded))
    assert [r for r in got if r[0] is not None] == sorted(want, key=str)
    assert sorted(r[1:4] for r in got if r[0] is None) == sorted((len(t.encode()), 0, 0) for d, t in rows if d is None)
    assert op2.removed(df.limit(0), None, width, gram).count() == 0


def test_long_texts(spark):
    """Texts of many pieces and chunks: near copies, one letter repeated, copies behind other text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(70_000))
    near = long[:1000] + "#" + long[1001:200_000] + "#" + long[200_001:]
    rows = [(3, long), (1, near), (2, "x" + long[5_000:5_300]), (4, "q" * 400_000), (5, "q" * 100_000 + "r"), (6, long[:40] + "q" * 60)]
    assert len(long) > op2.PIECE and len(op2.chunk_starts(np.frombuffer(rows[3][1].encode(), np.uint8), np.array([0]), np.array([400_000]), 50)[0]) < 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_rows(op2.removed(df.repartition(3))) == sorted(op2.plain_removed([(d, t.encode()) for d, t in rows], 50), key=str)


def test_chunks_hang_on_content():
    rng = random.Random(5)
    own = bytes(rng.randint(97, 122) for _ in range(5000))
    found = []
    for before in (b"", b"something else"):
        raw = np.frombuffer(before + own, np.uint8)
        first, stop = op2.chunk_starts(raw, np.array([0]), np.array([len(raw)]), 50)
        assert first[0] == 0 and stop[-1] == len(raw) - 49 and (first[1:] == stop[:-1]).all()
        found.append({raw[a : b + 49].tobytes() for a, b in zip(first, stop)})
    assert len(found[0] & found[1]) >= len(found[0]) - 2 > 10


@pytest.mark.parametrize("width", [4, 9, 50])
def test_suffix_ranks(width):
    rng = random.Random(width)
    for n in [1, 2, 3, 4, 5, *(rng.randint(6, 200) for _ in range(60))]:
        text = [rng.randint(0, 3) for _ in range(n)]
        ranks = suffix_ranks(np.array(text), width)
        prefixes = [tuple((text[i : i + width] + [0] * width)[:width]) for i in range(n)]
        assert [prefixes[i] for i in np.argsort(ranks, kind="stable")] == sorted(prefixes)


def test_nothing_shared(spark):
    df = spark.createDataFrame([(1, "a" * 100), (2, "b" * 100)], "doc_id long, text string")
    assert [r[2] for r in got_rows(op2.removed(df))] == [0, 0]
