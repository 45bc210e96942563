"""The pipeline's near-duplicate stage against plain Jaccard similarities."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import near_copies
from sparkloom.llm.common import table


def plain_set(text, width=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1) if words else 0)}


def plain_stay(rows):
    """Smallest ids of the components over all pairs of similarity 0.8 or more."""
    by_set = {}
    for i, t in rows:
        by_set.setdefault(frozenset(plain_set(t)), []).append(i)
    sets = list(by_set)
    first = {}
    for k, s in enumerate(sets):
        for x in s:
            first.setdefault(x, []).append(k)
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in {p for own in first.values() for p in itertools.combinations(own, 2)}:
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            up[root(a)] = root(b)
    least = {}
    for k, s in enumerate(sets):
        least[root(k)] = min(least.get(root(k), 1 << 60), *by_set[s])
    return set(least.values())


def test_leaves_no_near_copies(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert kept == plain_stay([(r.doc_id, r.text or "") for r in docs.collect()])


@pytest.mark.parametrize(("hot", "held"), [(128, 400_000), (5, 400_000), (2, 2000), (1, 1)])
def test_groups_of_near_copies(spark, hot, held):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, rows = [word() for _ in range(300)], [(0, None), (1, " "), (2, "one two"), (3, "One  two"), (4, "one three")]
    for i in range(5, 65):
        own = list(base)
        for at in rng.sample(range(300), rng.randrange(9)):
            own[at] = word()
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(word() for _ in range(80))) for i in range(65, 75)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs, hot=hot, held=held).collect()} == plain_stay([(i, t or "") for i, t in rows])


def test_odd_tables(spark):
    """Null ids and texts, repeated rows, clashing columns, no rows."""
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, 1), (1, long + " more", 2), (3, long, 1), (None, long, 3), (None, None, 4), (7, None, 5), (8, "", 6), (9, "other words here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays int").withColumns({c: F.lit(1) for c in ("node", "id", "key", "Band")})
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.stays) for r in kept.collect()) == [("1", 2), ("7", 5), ("9", 7), ("None", 3), ("None", 4)]
    assert near_copies.keep_one(docs.limit(0)).count() == 0
    twice = near_copies.keep_one(docs.filter("doc_id = 3"))
    assert twice.count() == 2


def test_long_text(spark):
    words = " ".join(f"v{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, words), (2, words.replace("v77 ", "x ")), (3, words[: len(words) // 2])], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [1, 3]
