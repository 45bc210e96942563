"""Token ids in a binary file format: canonical length-limited Huffman codes from global counts.

Writing tokenises once: documents are dealt out by ranges of their id, and each task writes the ids of
its range, in ascending id, to working files of about ``file_bytes`` and counts them.  The counts are summed by id (a row an
id reaches the driver, never more than the vocabulary has), and package-merge turns them into code
lengths of at most ``max_bits``.  A second stage turns each working file into one shard: the ids as
one bit stream, with the bit offset of every ``block``-th id as a checkpoint.  Blocks are independent:
decoding looks all blocks up in one table at once, step by step.  A shard holds the code lengths, from
which the canonical codes follow.

Shard layout (little-endian): magic, length of a JSON head, head (counts, parts and their sizes),
compressed code lengths, document ids (int64, with a null map), ids per document (uint32), bit offset
of each block (uint64), payload bits from the most significant on.

Null texts count as empty: the end id only.  Null document ids come first.  Rows with equal ids are
ordered by text, equal rows repeat.  No rows give one shard or none and an empty result.  Other
columns play no part.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, cut, held, new_folder, slices, table, vocabulary_path
from .files import AttemptFile, open_input, remove_folder

MAGIC = b"SLTI0001"
LETTER, NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
# Texts of these characters alone are split here; any other text goes to the library whole.
# Capitals of the range whose lower case is beyond LETTER are not plain either.
BEYOND = "".join(c for c in map(chr, range(0xA1, 0x250)) if any(ord(x) > 0x24F for x in c.lower()))
PLAIN = rf"[^\t\n\r -~¡-įı-ɏ]|[{BEYOND}]|<\|"  # found in texts that are not plain
APART = f"('s|'t|'re|'ve|'m|'ll|'d|[{NUMBER}]|[^\t\n\r {LETTER}{NUMBER}]+)"  # pre-tokens other than words
_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


class WordBpe:
    """Ids of texts under a tokenizers file whose pre-tokens are lower-case words, digits and marks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = BoundedCache(1_000_000, 14_000_000)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.library.to_str())
        split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"].get("pretokenizers") else {}
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        # The shortcut holds for this split and these normalisers only.
        self.shortcut = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(self.vocabulary, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, many in one call: blanks keep them apart, word-end tokens tell where each ends."""
        out: list[bytes] = []
        for i in range(0, len(words), 4096):
            own = words[i : i + 4096]
            ids = np.array(self.library.encode(" ".join(own), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                out += [raw[a:b] for a, b in itertools.pairwise(at)]
            else:
                out += self.encode_whole(own)
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty.

        In a plain text blanks are put around all pre-tokens but words, so that splitting at blanks gives
        the pre-tokens.  This and finding the distinct ones are array operations; only the distinct ones
        become Python objects.
        """
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, PLAIN)).to_numpy(zero_copy_only=False) if self.shortcut else np.zeros(len(texts), dtype=bool)
        out: list = [None] * len(texts)
        odd = np.flatnonzero(~plain)
        for i, ids in zip(odd.tolist(), self.encode_whole(texts.take(pa.array(odd)).to_pylist()), strict=True):
            out[i] = ids
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.filter(pa.array(plain))), APART, r" \1 "))
        runs = pc.dictionary_encode(split.flatten())
        distinct = runs.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        new = [r for r, x in zip(distinct, found, strict=True) if x is None]
        there = [r for r in new if r]  # splitting leaves an empty run at a blank end
        fresh = dict(zip(there, self.encode_words(there), strict=True)) | {"": b""}
        found = [fresh[r] if x is None else x for r, x in zip(distinct, found, strict=True)]
        self.known.add(fresh)
        taken = pa.array(found, pa.binary()).take(runs.indices)  # the ids of all runs, one behind the other
        if len(taken):
            ends, flat = np.frombuffer(taken.buffers()[1], dtype=np.int32), memoryview(taken.buffers()[2])
            edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        else:
            flat, edges = b"", [0] * (len(split) + 1)
        for i, (low, high) in zip(np.flatnonzero(plain).tolist(), itertools.pairwise(edges), strict=True):
            out[i] = bytes(flat[low:high])
        return out


def word_bpe(path: str) -> WordBpe:
    return held("token ids", path, lambda: WordBpe(path))


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most max_bits for the symbols with a count, 0 for the others (package-merge)."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    symbols = np.flatnonzero(counts)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << max_bits:
        raise ValueError(f"{len(symbols)} symbols do not fit in codes of {max_bits} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[symbols].astype(np.float64)
    rows, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        rows.append(order < len(weights))  # which of the sorted items are symbols
        ordered = both[order]
        packages = ordered[: len(ordered) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(symbols) - 2
    for leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        lengths[symbols[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code, before = 0, 0
    for n in np.unique(lengths[order]):
        own = order[lengths[order] == n]
        code <<= int(n) - before
        codes[own] = code + np.arange(len(own), dtype=np.uint32)
        code, before = code + len(own), int(n)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids as 32-bit words of a bit stream that is ``start`` bits into its first word: words, bit offsets, end.

    A code lies in one word or two; the codes of a word have no bit in common, so their sum joins them.
    """
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n) + start
    at = ends - n
    wide = codes[ids].astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4"), at, int(ends[-1])


def lookup(packed_lengths: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next max_bits bits: the symbol and its code length."""
    if packed_lengths not in _tables:
        lengths = np.frombuffer(zlib.decompress(packed_lengths), dtype=np.uint8)
        most = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        repeat = 1 << (most - lengths[order].astype(np.int64))
        symbol, length = np.zeros(1 << most, dtype=np.uint32), np.ones(1 << most, dtype=np.uint8)
        filled = np.repeat(order, repeat)
        symbol[: len(filled)], length[: len(filled)] = filled, lengths[filled]
        _tables.clear()
        _tables[packed_lengths] = (symbol, length, most)
    return _tables[packed_lengths]


def unpack(payload: bytes, offsets: np.ndarray, n_ids: int, block: int, packed_lengths: bytes) -> np.ndarray:
    """Ids of consecutive blocks that begin at bit offsets of payload; all blocks advance together."""
    symbol, length, most = lookup(packed_lengths)
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    n = len(raw) - 4
    ahead = raw[:n] << np.uint64(32) | raw[1 : n + 1] << np.uint64(24) | raw[2 : n + 2] << np.uint64(16) | raw[3 : n + 3] << np.uint64(8) | raw[4 : n + 4]
    at, last = offsets.astype(np.int64).copy(), (n - 1) * 8
    out = np.empty((min(block, n_ids), len(offsets)), dtype="<u4")
    shift, mask = np.int64(40 - most), np.uint64((1 << most) - 1)
    for step in range(len(out)):
        value = (ahead[at >> 3] >> (shift - (at & 7)).astype(np.uint64)) & mask
        out[step] = symbol[value]
        at = np.minimum(at + length[value], last)
    return np.ascontiguousarray(out.T).reshape(-1)[: n_ids if len(offsets) == 1 else None]


@dataclass(frozen=True)
class Shard:
    """One shard file: its place in the order of ids, its name, what it holds, and the ids before it."""

    order: int
    path: str
    n_docs: int
    n_ids: int
    start: int


def _write_work(folder: str, part: int, keys: list, texts: list[bytes]) -> tuple[str, np.ndarray]:
    """A working file of plain ids, and how often each occurs."""
    import zstandard

    n_each = np.array([len(t) // 4 for t in texts], dtype="<u4")
    ids = np.frombuffer(b"".join(texts), dtype="<u4")
    nulls = np.array([k is None for k in keys], dtype=np.uint8).tobytes()
    named = np.array([0 if k is None else k for k in keys], dtype="<i8").tobytes()
    narrow = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids
    parts = [named, nulls, n_each.tobytes(), zstandard.ZstdCompressor(level=1).compress(narrow.tobytes())]
    head = json.dumps({"n_docs": len(keys), "n_ids": len(ids), "width": narrow.itemsize, "sizes": [len(p) for p in parts]}).encode()
    file = AttemptFile(folder, f"work-{part:06d}", ".ids")
    for p in (struct.pack("<I", len(head)), head, *parts):
        file.write(p)
    file.close()
    return file.path, np.bincount(ids)


def _write_shard(folder: str, part: int, work: str, packed: bytes, block: int) -> str:
    """The shard of a working file."""
    import zstandard

    lengths = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    codes = canonical_codes(lengths)
    with open_input(work) as f:
        head = json.loads(f.read(struct.unpack("<I", f.read(4))[0]))
        named, nulls, n_each, squeezed = (f.read(n) for n in head["sizes"])
    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed), dtype=f"<u{head['width']}")
    body, offsets, done = [], [], 0  # done: bits so far; what is not a whole word yet is carried on
    carry, step = np.zeros(1, dtype=">u4"), max(block, (1 << 19) // block * block)
    for i in range(0, len(ids), step):
        words, at, end = pack(ids[i : i + step], codes, lengths, done & 31)
        words[0] += carry[0]
        offsets.append((at[::block] + (done & ~31)).astype("<u8"))
        whole = end >> 5
        body.append(words[:whole].tobytes())
        carry = words[whole : whole + 1]
        done = (done & ~31) + end
    body.append(carry.tobytes())
    parts = [packed, named, nulls, n_each, np.concatenate(offsets).tobytes(), b"".join(body)]
    shard_head = json.dumps({"n_docs": head["n_docs"], "n_ids": head["n_ids"], "block": block, "sizes": [len(p) for p in parts]}).encode()
    file = AttemptFile(folder, f"shard-{part:06d}", ".slti")
    for p in (MAGIC, struct.pack("<I", len(shard_head)), shard_head, *parts):
        file.write(p)
    file.close()
    return file.path


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str, max_bits: int = 16, block: int = 1024, shards: int | None = None, file_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> list[Shard]:
    """Writes the ids of all documents, each followed by end_id, in ascending order of id_col; a shard a working file."""
    spark = docs.sparkSession

    def tokenise(batches):
        from pyspark import TaskContext

        bpe, end = word_bpe(path), struct.pack("<I", end_id)
        keys, texts, size, n = [], [], 0, 0

        def flush():
            part = TaskContext.get().partitionId() << 24 | n
            name, counts = _write_work(f"{folder}/work", part, keys, texts)
            seen = np.flatnonzero(counts)
            listed = pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pa.StructArray.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([size // 4], pa.int64()), listed], ["part", "path", "n_docs", "n_ids", "counts"])

        for b in slices(batches, 1024):
            for key, ids in zip(b.column(0).to_pylist(), bpe.encode(b.column(1)), strict=True):
                keys.append(key)
                texts.append(ids + end)
                size += len(ids) + 4
                if size >= file_bytes:
                    yield flush()
                    keys, texts, size, n = [], [], 0, n + 1
        if keys:
            yield flush()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = read.repartitionByRange(*([shards] if shards else []), "id").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    written = cut(dealt.mapInArrow(tokenise, "part long, path string, n_docs long, n_ids long, counts array<struct<id: long, n: long>>"))
    counts = {r["id"]: r["n"] for r in written.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n")).toLocalIterator()}
    lengths = code_lengths(np.array([counts.get(i, 0) for i in range(max([*counts, end_id]) + 1)], dtype=np.int64), max_bits)
    shared = spark.sparkContext.broadcast(zlib.compress(lengths.tobytes(), 9))  # a byte an id of the vocabulary at most
    works = [tuple(r) for r in written.select("part", "path", "n_docs", "n_ids").collect()]  # a row a file
    if not works:
        return []

    def code(batches):
        for b in batches:
            for part, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_write_shard(folder, part, name, shared.value, block)])], ["part", "path"])

    listed = spark.sparkContext.parallelize([w[:2] for w in works], len(works)).toDF("part long, path string")
    paths = {r["part"]: r["path"] for r in listed.mapInArrow(code, "part long, path string").collect()}
    remove_folder(f"{folder}/work")
    out, start = [], 0
    for part, _, n_docs, n_ids in sorted(works):
        out.append(Shard(part, paths[part], n_docs, n_ids, start))
        start += n_ids
    return out


def _read_shard(path: str, first: int, last: int):
    """(document id or None, ids before it in the shard, its ids as bytes) for documents first to last - 1."""
    with open_input(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no shard of ids")
        head = json.loads(f.read(struct.unpack("<I", f.read(4))[0]))
        packed, keys, nulls, n_each, offsets = (f.read(n) for n in head["sizes"][:-1])
        begin = f.tell()
        keys, nulls = np.frombuffer(keys, dtype="<i8"), np.frombuffer(nulls, dtype=np.uint8)
        ends = np.cumsum(np.frombuffer(n_each, dtype="<u4"), dtype=np.int64)
        offsets, block = np.frombuffer(offsets, dtype="<u8"), head["block"]
        from_id, to_id = int(ends[first - 1]) if first else 0, int(ends[last - 1])
        low, high = from_id // block, -(-to_id // block)
        byte = int(offsets[low]) // 8
        stop = int(offsets[high]) // 8 + 1 if high < len(offsets) else head["sizes"][-1]
        f.seek(begin + byte)
        payload = f.read(stop - byte)
    ids = unpack(payload, offsets[low:high] - np.uint64(byte * 8), min(head["n_ids"], high * block) - low * block, block, packed)
    for i in range(first, last):
        at = int(ends[i - 1]) if i else 0
        yield None if nulls[i] else int(keys[i]), at, ids[at - low * block : int(ends[i]) - low * block].tobytes()


def read_ids(spark: SparkSession, shards: list[Shard], docs_a_split: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids): ids as little-endian unsigned 32-bit integers in one binary, start the ids of all documents before."""
    splits = [(s.path, i, min(s.n_docs, i + docs_a_split), s.start) for s in shards for i in range(0, s.n_docs, docs_a_split)]
    schema = f"`{id_col}` long, start long, ids binary"
    if not splits:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for path, first, last, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for n, (key, at, ids) in enumerate(_read_shard(path, first, last), 1):
                    rows.append((key, start + at, ids))
                    if len(rows) == 512 or n == last - first:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], [id_col, "start", "ids"])
                        rows = []

    listed = spark.sparkContext.parallelize(splits, len(splits)).toDF("path string, first long, last long, start long")
    return listed.mapInArrow(run, schema)


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("word_bpe_49k.json")
    folder = new_folder(spark, "token-ids")
    read = read_ids(spark, write_ids(table(spark, sf_dir, "documents"), path, 2, folder))
    out = cut(read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    remove_folder(folder)
    return out


QUERIES = {"op9_huffman_ids": op9_huffman_ids}
