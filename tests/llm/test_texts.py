"""Decontamination, SimHash, PII and the classifier against plain versions."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash

from sparkloom.llm import components as comp
from sparkloom.llm import op3_decontaminate as op3
from sparkloom.llm import op4_simhash as op4
from sparkloom.llm import op6_quality as op6
from sparkloom.llm import op8_pii as op8
from sparkloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_contamination(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        words, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n, i in itertools.product(sizes, range(len(words))):
            if len(w := tuple(words[i : i + n])) == n and (own := windows.get(w)):
                hit.update(range(i, i + n))
                found |= own
        names = ",".join(sorted(map(str, found)))
        yield doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def test_op3_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = sorted(plain_contamination(docs, items))
    assert sorted(map(tuple, op3.op3_decontaminate(spark, sf).collect())) == want
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("blocks", [{}, {"block_bytes": 8}, {"block_bytes": 8, "blocks_at_once": 2}])
def test_contamination_of_odd_rows(spark, blocks):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "ñ", "c-d", "É", "7"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = [*enumerate(texts), (100, None), (101, ""), (None, texts[0]), (0, texts[0]), (102, "a b " * 20_000)]
    items = [(1, "a b"), (2, "A  b!! a"), (3, None), (4, " .. "), (5, "ñ É 7"), (10, "b a b a b a b a b a b a"), (5, "ñ É 7"), (None, "a")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = op3.digests(op3.contamination(d, i, **blocks))
    want = plain_contamination(docs, [r for r in items if r[0] is not None])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_contamination_spans(spark):
    d = spark.createDataFrame([(1, "É! x, A-B c")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    r = op3.contamination(d, i).first()
    assert [tuple(s) for s in r.spans] == [(7, 10)] and r["items"] == ["1"]
    assert op3.contamination(d, i.limit(0)).first().n_hit == 0
    assert op3.contamination(d.limit(0), i).count() == 0


def plain_simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance):
    parent = {f: f for _, f in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= distance:
            parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in rows), key=str)


def test_op4_query(spark, sf):
    rows = [(r.doc_id, plain_simhash(r.text)) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, op4.op4_simhash(spark, sf).collect()), key=str) == plain_components(rows, 2)


def test_simhash_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (4, "a B"), (5, "é É"), (6, "x " * 70_000), (None, "a b"), (7, "a b c d e f")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in op4.near_duplicates(d).collect()]
    assert sorted(got, key=str) == plain_components([(i, plain_simhash(t)) for i, t in rows], 2)
    assert op4.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "hot"), [(1, 256), (2, 256), (2, 1), (3, 256), (1, 1), (6, 256), (6, 2), (4, 1)])
def test_links_connect_all(spark, distance, hot):
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(12)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = op4.links(spark.createDataFrame(signed, "fp long"), distance, hot).distinct()
    parts = {r.node & (2**64 - 1): r.component for r in comp.components(found.toDF("a", "b")).collect()}
    want = plain_components([(n, f) for n, f in enumerate(sorted(fps))], distance)
    groups = {}
    for f, (_, _, c) in zip(sorted(fps), sorted(want)):
        groups.setdefault(c, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(parts.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("hot", [256, 1])
def test_links_broadcast_no_keys(spark, hot):
    """The keys are 64 times the fingerprints that their size is estimated by."""
    rng = random.Random(7)
    found = op4.links(spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(500)] + [(0,), (1,)], "fp long"), 2, hot)
    assert [(r.fp, r.other) for r in found.distinct().collect()] == [(0, 1)]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin .*Inner", plan)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (4, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in comp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn_ok(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def plain_base(text):
    spans = [(m.start(), n, m.end(), kind) for n, (kind, pattern, valid) in enumerate(PLAIN) for m in re.finditer(pattern, text or "") if valid(m[0])]
    return [(s, e, k) for s, _, e, k in sorted(spans)]


def test_op8_query(spark, sf):
    got = {r.doc_id: r.base_sha256 for r in op8.op8_pii(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in plain_base(r.text)).encode()).hexdigest()


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(11)
    parts = ["a", "é", "😀", "@", ".", "b.co", "-", "_", "1", "4111111111111111", "+1 ", "(555)", " ", "255.1.2.3", "999.1.1.1", "+49", "0", "%", "x@y.z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 2_000, "1" * 2_000, "1 " * 2_000, "a@b" + ".c" * 2_000, "x@y.z 1.2.3.4 " * 700, "+1(" * 2_000, "@" * 2_000, "1." * 2_000]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if s.base] for r in op8.find_spans(d).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_base(t), (t or "")[:80]
    assert op8.find_spans(d.limit(0)).count() == 0


def test_very_long_texts(spark):
    texts = ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "a@b" + ".c" * 100_000, "+1(" * 100_000, "@" * 100_000, "1." * 100_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in op8.find_spans(d).collect()}
    assert {i: n for i, n in got.items() if n and i != 6} == {3: [(0, 200_003, "email")]}
    assert len(got[6]) == 25_000 and got[6][1] == (8, 15, "ip")


def test_added_kinds_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, my SSN is 123-45-6789; part 123-45-6789" + " x" * 30 + " no 321-54-9876 mail a@b.org 4111 1111 1111 1111"
    d = spark.createDataFrame([(1, text), (2, None), (3, "GB82WEST12345698765433")], "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in op8.find_spans(d).collect()}
    assert kinds == {1: ["iban", "ssn", "email", "card"], 2: [], 3: []}
    out = {r.doc_id: r.text for r in op8.redact(d).collect()}
    assert "DE89" not in out[1] and "[IBAN]" in out[1] and "a@b.org" not in out[1] and "4111" not in out[1] and "321-54-9876" in out[1]
    assert out[2] is None and out[3] == "GB82WEST12345698765433"


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 100) for _ in range(3000)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 1500, 3499, 3500):
        assert op6.kth_largest(df, k, "x", short=50, bins=16) == sorted(values, reverse=True)[k - 1]
    assert op6.kth_largest(df, 3501, "x") == float("-inf")


def test_quality_separates_junk(spark):
    sf = "/root/testdata/sf0.01"
    found = op6.op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    bad = [r for r in found if r.quality == 0]
    good = [r for r in found if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in good) == len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "a"), (1, "good words here", "a"), (None, None, "b"), (3, "", "c"), (4, "!!" * 50_000, "d")], "doc_id long, text string, _other string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    out = op6.resample(docs, labels).collect()
    assert len(out) == 5 and {r._other for r in out} == {"a", "b", "c", "d"}
    assert op6.resample(docs.limit(0), labels).count() == 0
    assert all(r._kept for r in op6.resample(docs, labels.limit(0)).collect())
    assert sum(r._kept for r in op6.resample(docs, labels, k=1, temperature=1.0).collect()) >= 1
