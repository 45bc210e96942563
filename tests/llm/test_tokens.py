"""Tokenising operators against the libraries, on whole fixture tables and on odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers as P
from sparkloom.llm import op1_token_counts as op1
from sparkloom.llm import op5_byte_bpe as op5
from sparkloom.llm import op9_huffman_ids as op9
from sparkloom.llm.common import new_folder, table

PARTS = [" ", "  ", "\n", "a", "The", " of", "'s", "▁", "é", "①", "😀", "\t", "\r", ";", "<s>", "<|endoftext|>", "<|start", "\x85", "\x00", "0", "12", "ß", "Ñ", ".", " ", "ʰ", "漢", "\x1c", "½", "\xa0", "İ", "Å", "é"]


def odd_texts(n=400):
    rng = random.Random(7)
    return ["", " ", "\n\n", "x" * 30_000, "a b\n" * 5_000, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", -1) for i, t in enumerate(odd_texts())] + [(5000, None, "x", 1), (None, "null id", "x", 1), (7, "a again", "x", 1), (7, "a again", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def library_counts(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return [len(model.encode(t)) for t in texts]


def test_token_counts(docs):
    got = sorted(map(tuple, op1.token_counts(docs, P.path("piece_bpe_32k.model"), max_tokens=10).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(i, len(t.encode()), n, n > 10) for (i, t), n in zip(rows, library_counts([t for _, t in rows]))]
    assert got == sorted(want, key=str)


def test_token_counts_of_nothing(docs):
    assert op1.token_counts(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_pretokens_are_counted_once(spark, docs, monkeypatch):
    """Each distinct pre-token goes to the model once, however many documents and files have it."""
    path = P.path("piece_bpe_32k.model")
    files = op1.dictionaries(docs.repartition(4), new_folder(spark, "test-words"), path, "doc_id", "text").collect()
    words = [op1.words_of(f.words) for f in files]
    assert len(files) >= 4 and all(len(set(w)) == len(w) for w in words)
    seen, count = [], op1.PieceCounter.count
    monkeypatch.setattr(op1.PieceCounter, "count", lambda self, own: seen.extend(own) or count(self, own))
    buckets = {}
    for f in files:
        for b in op1.deal(3)([pa.record_batch({"number": [f.number], "words": pa.array([f.words], pa.binary())})]):
            buckets.setdefault(b.column(0)[0].as_py(), []).append(b)
    for own in buckets.values():
        op1.counted(path)(pa.Table.from_batches(own))
    whole = [w for own in words for w in own]
    assert sorted(seen) == sorted(set(whole)) and len(seen) < len(whole) and len(buckets) == 3


def test_sections_and_whole_texts(spark, monkeypatch):
    """Long texts by sections, and a model whose pieces may join pre-tokens, give the library's counts."""
    pieces, texts = op1.PieceCounter(P.path("piece_bpe_32k.model")), [*odd_texts(), "one two  three " * 30, " a" * 40 + "  "]
    want = library_counts(texts)
    monkeypatch.setattr(op1, "SECTION", 7)

    def total(text):
        parts = [pieces.pretokens(s) for s in pieces.sections(text)] if text else []
        return sum(feeds + sum(pieces.count(own)) for own, feeds in parts)

    assert [total(t) for t in texts] == want
    pieces.splits = False
    assert [total(t) for t in texts] == want


def test_long_text_counts(spark):
    text = "some words and 12 numbers\n" * 100_000
    got = op1.token_counts(spark.createDataFrame([("k", text), (None, None)], "doc_id string, text string"), P.path("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == [("None", 0, 0), ("k", len(text), library_counts([text])[0])]


def test_op1_query(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], library_counts([r.text for r in rows])))
    assert {r.doc_id: r.n_tokens for r in op1.op1_token_counts(spark, sf).collect()} == want


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op5.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_byte_bpe(docs):
    own = tiktoken_encoding()
    coded = op5.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decoded=True)
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in coded.collect()), key=str)
    assert got == sorted(((r.doc_id, own.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=str)
    back = op5.decode(coded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted(x[2] for x in got)
    assert op5.encode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op5_query(spark, sf):
    own, want = tiktoken_encoding(), {}
    for r in table(spark, sf, "documents").collect():
        ids = own.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: tuple(r[1:]) for r in op5.op5_byte_bpe(spark, sf).collect()} == want


def word_ids(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 2] for e in Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)]


def test_ids_files(spark, docs):
    shards = op9.write_ids(docs, P.path("word_bpe_49k.json"), 2, new_folder(spark, "test-ids"), block=64)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in op9.read_ids(spark, shards, docs_a_split=17).collect()]
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want, start = [], 0
    for (there, i, _), ids in zip(rows, word_ids([t for _, _, t in rows])):
        want.append((i if there else None, start, ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_ids_files_of_nothing(spark, docs):
    shards = op9.write_ids(docs.limit(0), P.path("word_bpe_49k.json"), 2, new_folder(spark, "test-ids"))
    assert op9.read_ids(spark, shards).count() == 0


def test_op9_query(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    want, start = {}, 0
    for (i, _), ids in zip(rows, word_ids([t for _, t in rows])):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r[1:]) for r in op9.op9_huffman_ids(spark, sf).collect()} == want


@pytest.mark.parametrize("counts", [[5], [0, 3, 0], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512], [7] * 256, list(range(1, 300))])
def test_code_lengths(counts):
    counts = np.array(counts)
    lengths = op9.code_lengths(counts, 9)
    used = lengths[lengths > 0].astype(int)
    assert (lengths > 0).tolist() == (counts > 0).tolist() and used.max() <= 9
    assert sum(2.0**-n for n in used) <= 1
    codes = op9.canonical_codes(lengths)
    words = [f"{codes[i]:0{lengths[i]}b}" for i in np.flatnonzero(lengths)]
    assert all(not b.startswith(a) for a in words for b in words if a is not b)
