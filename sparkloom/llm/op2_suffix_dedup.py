"""Removal of repeated byte strings by suffix arrays of the difference cover {1, 2} mod 3.

A byte goes if a string of ``width`` bytes over it also starts in a document with a smaller id.

1. Documents are cut into chunks where their content says so, and written to working files.  A chunk is
   the run of starts between two cuts with all bytes of the strings that start there.  A shuffle of the
   chunks' digests finds the smallest document of each chunk.  In every other document all strings of the
   chunk are repeats, whatever stands around it, so exact copies, near copies and long shared passages are
   settled here, and only the first document's chunk goes on.
2. Of all hashes of ``gram``-byte strings in a string of width bytes, the least is its anchor; equal strings
   have equal anchors.  A shuffle of the anchors of the remaining chunks finds those of two documents.
3. Runs of strings with such an anchor go to the bucket of its hash, each different run of a file once.  A
   bucket joins its runs to one text, sorts its suffixes (triples at 1 and 2 mod 3 are named, names sorted by
   recursion, the rest merged: see dc3), compares the prefixes of width bytes of neighbours in suffix order,
   and so finds the smallest document of each class of equal strings.
4. The smallest documents go back to the files, which remove what a smaller document has.

An anchor with more than ``crowded`` runs over all files may have more text around it than a bucket should
hold.  Its strings are dealt out one by one by their own hash, so they spread over all buckets, and equal
ones still meet.  Hashes of chunks are 128-bit digests; those of anchors and strings only tell where to
compare, and what is equal is told by bytes.  Texts are hashed in pieces of PIECE bytes, so a long text
costs its own size a few times over, not eight bytes a byte.

Nulls count as empty texts; documents with a null id keep all bytes and cover no others; rows that
share an id are not duplicates of each other, and each loses what a smaller id has; no rows give no
rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, slices, table, texts_of
from .dc3 import suffix_ranks
from .files import AttemptFile, open_input, remove_folder

NOBODY = np.iinfo(np.int64).max
FILE_BYTES, PIECE = 8 << 20, 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK_GRAM, CHUNK_EVERY, CHUNK_MOST = 16, 160, 8192


def _sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of span values, by doubling."""
    done, out = 1, values
    while done < span:
        step = min(done, span - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes (8 at least) from each place that has so many."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = -(-(len(raw) - 7) // 8)
    padded, words = np.concatenate([raw, np.zeros(16, np.uint8)]), np.empty(8 * eights, np.uint64)
    for at in range(8):
        words[at::8] = padded[at : at + 8 * eights].view("<u8")
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
            h = (h ^ words[at : at + n]) * MIX
            h ^= h >> np.uint64(29)
    return h


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of hashes, by their upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pieces_of(order: np.ndarray):
    """(value, first, end) of each run of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(order)] if len(order) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(order[a]), a, b


def chunk_starts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First start, and end of the starts, of each chunk of the documents raw[starts:ends]."""
    found = []
    for a in range(0, len(raw), PIECE):
        h = gram_hashes(raw[max(0, a - 1) : a + PIECE + CHUNK_GRAM - 1], CHUNK_GRAM)
        at = (h >> np.uint64(24)) % np.uint64(CHUNK_EVERY) == 0
        at[1:] &= h[1:] != h[:-1]  # not at each byte of a run of one letter
        found.append(np.flatnonzero(at[min(a, 1) :]) + a)
    limit = ends - width + 1
    places = np.concatenate([np.zeros(0, np.int64), *found])
    doc = np.searchsorted(ends, places, side="right")
    places, doc = places[doc < len(ends)], doc[doc < len(ends)]
    inside = (places > starts[doc]) & (places < limit[doc])
    first = np.union1d(starts[limit > starts], places[inside])
    stop = np.minimum(np.append(first[1:], len(raw)), limit[np.searchsorted(ends, first, side="right")])
    times = -(-(stop - first) // CHUNK_MOST)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    first, stop = np.repeat(first, times) + nth * CHUNK_MOST, np.repeat(stop, times)
    return first, np.minimum(first + CHUNK_MOST, stop)


class Work:
    """A working file: ids (null map), text sizes and bytes of some documents, and their chunks.

    ``first``, ``stop`` and ``which`` tell the starts of each chunk and its digest; ``digests`` are the different
    ones, sorted, and ``least`` has the smallest document of the file for each.
    """

    @staticmethod
    def write(folder: str, number: int, keys: list, texts: list[bytes], width: int) -> tuple[str, np.ndarray, np.ndarray]:
        """Path of the new file, its digests and their smallest documents."""
        import zstandard

        whole, nulls = b"".join(texts), np.array([k is None for k in keys], bool)
        ids = np.array([0 if k is None else k for k in keys], np.int64)
        raw, sizes = np.frombuffer(whole, np.uint8), np.array(list(map(len, texts)), np.int64)
        ends = np.cumsum(sizes)
        first, stop = chunk_starts(raw, ends - sizes, ends, width)
        doc = np.searchsorted(ends, first, side="right")
        first, stop, doc = first[~nulls[doc]], stop[~nulls[doc]], doc[~nulls[doc]]
        view, digest = memoryview(whole), hashlib.blake2b
        marks = b"".join(digest(view[a : b + width - 1], digest_size=16).digest() for a, b in zip(first.tolist(), stop.tolist(), strict=True))
        digests, which = distinct_digests(np.frombuffer(marks, "<u8").reshape(-1, 2))
        least = np.full(len(digests), NOBODY)
        np.minimum.at(least, which, ids[doc])
        parts = [ids.tobytes(), nulls.tobytes(), sizes.tobytes(), first.tobytes(), stop.tobytes(), which.tobytes(), digests.tobytes(), least.tobytes(), whole]
        squeezed = [zstandard.ZstdCompressor(level=1).compress(p) for p in parts]
        head = json.dumps([[len(p), len(q)] for p, q in zip(squeezed, parts, strict=True)]).encode()
        file = AttemptFile(folder, f"docs-{number:x}", ".work")
        for p in (struct.pack("<I", len(head)), head, *squeezed):
            file.write(p)
        file.close()
        return file.path, digests, least

    def __init__(self, path: str):
        import zstandard

        with open_input(path) as f:
            sizes = json.loads(f.read(struct.unpack("<I", f.read(4))[0]))
            squeezed = [f.read(n) for n, _ in sizes]
        parts = [zstandard.ZstdDecompressor().decompress(p, max_output_size=m) if m else b"" for p, (_, m) in zip(squeezed, sizes, strict=True)]
        self.ids, lengths, self.first, self.stop, self.which, self.least = (np.frombuffer(parts[i], "<i8") for i in (0, 2, 3, 4, 5, 7))
        self.nulls, self.raw = np.frombuffer(parts[1], bool), np.frombuffer(parts[8], np.uint8)
        self.digests = np.frombuffer(parts[6], "<u8").reshape(-1, 2)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def doc(self, places: np.ndarray) -> np.ndarray:
        """The id of the document at each place."""
        return self.ids[np.searchsorted(self.ends, places, side="right")]

    def own(self, foreign: np.ndarray) -> np.ndarray:
        """Whether each chunk's document is the smallest of all that have it; foreign tells the digests with a smaller one elsewhere."""
        return ~foreign[self.which] & (self.least[self.which] == self.doc(self.first))

    def runs(self, own: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings of own chunks: anchor, first start and end of the starts of runs with one anchor."""
        live = np.zeros(len(self.raw) + 1, np.int8)
        live[self.first[own]] += 1
        live[self.stop[own]] -= 1
        live = np.cumsum(live, dtype=np.int8).astype(bool)
        span, found = width - gram + 1, []
        for a in range(0, len(self.raw), PIECE):
            if not live[a : a + PIECE].any():
                continue
            least = _sliding(gram_hashes(self.raw[a : a + PIECE + width - 1], gram), span, np.minimum)
            here = live[a : a + len(least)]
            new = here.copy()
            new[1:] &= ~here[:-1] | (least[1:] != least[:-1])
            first = np.flatnonzero(new)
            over = here.copy()
            over[:-1] &= ~here[1:] | new[1:]
            stop = np.flatnonzero(over) + 1
            times = -(-(stop - first) // span)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            begin, end = np.repeat(first, times) + nth * span, np.repeat(stop, times)
            found.append((least[begin], begin + a, np.minimum(begin + span, end) + a))
        none = np.zeros(0, np.int64)
        least, begin, end = (np.concatenate(c) for c in zip((none.view(np.uint64), none, none), *found, strict=True))
        with np.errstate(over="ignore"):  # least hashes crowd at the low end: spread them, one to one
            least = (least ^ (least >> np.uint64(32))) * MIX
        return least ^ (least >> np.uint64(29)), begin, end


def distinct_digests(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different digests, sorted, and which of them each is."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return digests[order[new]], which


def anchor_counts(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different anchors, sorted, how many runs each has, and whether those are of two documents."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    return h[first], last - first + 1, doc[first] != doc[last[: len(first)]]


def string_hashes(raw: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """A hash of the string of width bytes at each place."""
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ raw[first + i]) * np.uint64(0x100000001B3)
        h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def padded_rows(raw: np.ndarray, first: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Rows of bytes: the length before, zeros behind."""
    padded = np.concatenate([raw, np.zeros(longest, np.uint8)])
    rows = np.zeros((len(first), longest + 1), np.uint8)
    for i in range(0, len(first), 1 << 14):
        part = slice(i, i + (1 << 14))
        size = (end - first)[part]
        block = padded[first[part][:, None] + np.arange(longest)[None, :]]
        rows[part, 0], rows[part, 1:] = size, np.where(np.arange(longest)[None, :] < size[:, None], block, 0)
    return rows


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and which each is.  Rows are sorted by a hash and compared with their neighbours.

    Different rows of one hash may part equal ones, which then stay apart; the suffix array joins them.
    """
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words, h = wide.view(np.uint64), np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            h = (h ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    order = np.argsort(h)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    same = np.flatnonzero(~new)
    new[same] = (words[order[same]] != words[order[same - 1]]).any(axis=1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return rows[order[new]], which


def smallest_documents(rows: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """For each row and each start in it, the smallest document with the string of width bytes there; else NOBODY."""
    size = rows[:, 0].astype(np.int64)
    starts_of = rows.shape[1] - width
    inside = np.arange(rows.shape[1])[None, :] <= size[:, None]  # a mark behind each string
    symbols = np.where(np.arange(rows.shape[1])[None, :] < size[:, None], np.concatenate([rows[:, 1:].astype(np.int64) + 1, np.zeros((len(rows), 1), np.int64)], axis=1), 0)
    text = symbols[inside]
    ranks = suffix_ranks(text, width)
    begins = np.cumsum(size + 1) - size - 1
    full = np.arange(starts_of)[None, :] <= (size - width)[:, None]
    row, at = np.nonzero(full)
    place = begins[row] + at
    order = np.argsort(ranks[place], kind="stable")
    place, row, at = place[order], row[order], at[order]
    differs = np.ones(len(place), dtype=bool)  # from the neighbour before in suffix order
    narrow = text.astype(np.int16)
    for i in range(1, len(place), 1 << 15):
        a, b = place[i - 1 : i - 1 + (1 << 15)], place[i : i + (1 << 15)]
        a, reach = a[: len(b)], np.arange(width)[None, :]
        differs[i : i + len(b)] = (narrow[a[:, None] + reach] != narrow[b[:, None] + reach]).any(axis=1)
    least = np.minimum.reduceat(docs[row], np.flatnonzero(differs)) if len(place) else np.zeros(0, np.int64)
    out = np.full((len(rows), starts_of), NOBODY, dtype=np.int64)
    out[row, at] = least[np.cumsum(differs) - 1] if len(place) else NOBODY
    return out


def runs_of(table_: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, bits) for rows of smallest documents: the starts, as bits, that a document below ``most`` has."""
    powers = np.uint64(1) << np.arange(table_.shape[1], dtype=np.uint64)
    left, found = np.where(table_ < most[:, None], table_, NOBODY), []
    index = np.arange(len(left))
    while len(left):
        least = left.min(axis=1)
        some = least < NOBODY
        left, least, index = left[some], least[some], index[some]
        if not len(left):
            break
        same = left == least[:, None]
        found.append((index, least, (same * powers[None, :]).sum(axis=1, dtype=np.uint64)))
        left = np.where(same, NOBODY, left)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Strings:
    """The strings that a file sends: runs with shared anchors, and single strings of crowded ones.

    ``rows`` are the different ones in the order in which they are sent, ``part`` their fine buckets; run i, from
    ``first`` to ``stop``, is row ``which[i]``.
    """

    def __init__(self, work: Work, own: np.ndarray, flags: list[tuple[int, bytes]], width: int, gram: int, buckets: int, parts: int):
        h, first, stop = work.runs(own, width, gram)
        anchors, _, _ = anchor_counts(h, np.zeros(len(h), np.int64))
        kinds = aligned(bucket_of(anchors, buckets), flags)
        kind = kinds[np.searchsorted(anchors, h)] if len(h) else np.zeros(0, np.uint8)
        h, first, stop, kind = h[kind > 0], first[kind > 0], stop[kind > 0], kind[kind > 0]
        split = kind > 1
        times = (stop - first)[split]
        single = np.repeat(first[split], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        h, first, stop = np.concatenate([h[~split], string_hashes(work.raw, single, width)]), np.concatenate([first[~split], single]), np.concatenate([stop[~split], single + 1])
        rows, which = distinct_rows(padded_rows(work.raw, first, stop + width - 1, 2 * width - gram)) if len(first) else (np.zeros((0, 2 * width - gram + 1), np.uint8), np.zeros(0, np.int64))
        part = np.zeros(len(rows), np.int64)
        part[which] = bucket_of(h, buckets * parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.rows, self.part, self.which, self.first, self.stop = rows[order], part[order], place[which], first, stop
        self.doc = work.doc(first) if len(first) else np.zeros(0, np.int64)


def aligned(bucket: np.ndarray, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """A byte for each entry of sorted buckets, from the bytes of each bucket."""
    out, answers = np.zeros(len(bucket), np.uint8), dict(answers)
    for b, i, j in pieces_of(bucket):
        out[i:j] = np.frombuffer(answers[b], np.uint8)
    return out


def _bytes(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    """Long columns from whole numbers, binary ones from bytes."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if c and isinstance(c[0], bytes) else pa.int64()) for c in columns.values()], list(columns))


def _whole(parts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Several arrays as one, and where each begins and ends."""
    arrays = [np.frombuffer(x, kind) for x in parts]
    return np.concatenate(arrays), np.cumsum([0, *map(len, arrays)])


def owners(t: pa.Table) -> pa.Table:
    """Of one bucket of digests: for each file whether another file has a smaller document (1) or not (0)."""
    marks, edges = _whole(_bytes(t.column("digests")), "<u8")
    least, _ = _whole(_bytes(t.column("least")), "<i8")
    digests, which = distinct_digests(marks.reshape(-1, 2))
    first = np.full(len(digests), NOBODY)
    np.minimum.at(first, which, least)
    foreign = (first[which] < least).astype(np.uint8)
    edges = edges // 2
    return pa.table({"number": t.column("number"), "bucket": t.column("bucket"), "bits": pa.array([foreign[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})


def share(crowded: int):
    def shared(t: pa.Table) -> pa.Table:
        """Of one bucket of anchors: for each file 0 if one document alone has it, 1 if two, 2 if it has many runs."""
        values, edges = _whole(_bytes(t.column("anchors")), "<u4")
        times, _ = _whole(_bytes(t.column("times")), "<u2")
        marks, _ = _whole(_bytes(t.column("marks")), np.uint8)
        _, which = np.unique(values, return_inverse=True)
        which = which.reshape(-1)
        files, runs, twice = np.bincount(which), np.bincount(which, weights=times), np.bincount(which, weights=marks)
        kind = np.where((files > 1) | (twice > 0), np.where(runs > crowded, 2, 1), 0).astype(np.uint8)[which]
        return pa.table({"number": t.column("number"), "bucket": t.column("bucket"), "bits": pa.array([kind[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})

    return shared


def sorter(width: int, longest: int):
    def sort_bucket(t: pa.Table) -> pa.Table:
        """The smallest documents of all strings of one bucket, by file, as (number of the row, document, bits of starts)."""
        files = len(t)
        text, ends = _whole(_bytes(t.column("text")), np.uint8)
        sizes, edges = _whole(_bytes(t.column("sizes")), np.uint8)
        least, _ = _whole(_bytes(t.column("least")), "<i8")
        more, _ = _whole(_bytes(t.column("more")), "<i8")
        part, _ = _whole(_bytes(t.column("part")), np.uint8)
        file = np.repeat(np.arange(files), np.diff(edges))
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        out: list[list] = [[] for _ in range(files)]
        for p in np.unique(part).tolist():  # a fine bucket at a time
            own = np.flatnonzero(part == p)
            whole, which = distinct_rows(padded_rows(text, begin[own], begin[own] + sizes[own], longest))
            first = np.full(len(whole), NOBODY)
            np.minimum.at(first, which, least[own])
            answer = smallest_documents(whole, first, width)
            index, doc, bits = runs_of(answer[which], least[own] + more[own])
            row = own[index]
            by = np.argsort(file[row], kind="stable")
            row, doc, bits = row[by], doc[by], bits[by]
            for f, a, b in pieces_of(file[row]):
                out[f].append((row[a:b] - edges[f], doc[a:b], bits[a:b]))
        rows = [[x.tobytes() for x in (np.concatenate(c) for c in zip(*found, strict=True))] if found else None for found in out]
        some = pa.array([i for i, x in enumerate(rows) if x], pa.int64())
        return pa.table({"number": t.column("number").take(some), "bucket": t.column("bucket").take(some), **{n: pa.array([rows[i][k] for i in some.to_pylist()], pa.binary()) for k, n in enumerate(("row", "doc", "bits"))}})

    return sort_bucket


def removed(docs: DataFrame, folder: str | None = None, width: int = 50, gram: int = 24, bucket_bytes: int = 16 << 20, parts: int = 8, crowded: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (removed byte ranges, start and end) and kept (binary) for every row of docs.

    The working files in ``folder`` (a new one unless given) are read when the result is; delete them afterwards.
    """
    if not 8 <= gram < width <= gram + 62 or width < CHUNK_GRAM or 2 * width - gram > 255:
        raise ValueError("the starts around an anchor have to fit in 63 bits, their bytes in 255")
    spark = docs.sparkSession
    folder, longest = folder or new_folder(spark, "suffixes"), 2 * width - gram

    def write(batches):
        from pyspark import TaskContext

        keys, texts, size, n = [], [], 0, 0

        def flush():
            number = TaskContext.get().partitionId() << 32 | n
            path, digests, least = Work.write(folder, number, keys, texts, width)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([digests.tobytes()], pa.binary()), pa.array([least.tobytes()], pa.binary()), pa.array([size], pa.int64())], ["number", "path", "digests", "least", "size"])

        for b in slices(batches):
            for k, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                keys.append(k)
                texts.append(t.encode())
                size += len(texts[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    keys, texts, size, n = [], [], 0, n + 1
        if keys:
            yield flush()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    files = cut(read.mapInArrow(write, "number long, path string, digests binary, least binary, size long"))
    total, n_files = files.agg(F.sum("size"), F.count("*")).first()
    schema = f"`{id_col}` long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    if not n_files:
        return spark.createDataFrame([], schema)
    buckets, tasks = max(8, total // bucket_bytes), max(1, min(n_files, 10_000))

    def by_file(answers: DataFrame, *columns: str) -> DataFrame:
        return answers.groupBy("number").agg(F.collect_list(F.struct("bucket", *columns)).alias(columns[0]))

    def deal(batches):
        for b in batches:
            for number, marks, least in zip(b.column(0).to_pylist(), _bytes(b.column(1)), _bytes(b.column(2)), strict=True):
                digests, least = np.frombuffer(marks, "<u8").reshape(-1, 2), np.frombuffer(least, "<i8")
                cuts = list(pieces_of(bucket_of(digests[:, 0], buckets)))
                if cuts:
                    yield _batch({"bucket": [k for k, _, _ in cuts], "number": [number] * len(cuts), "digests": [digests[i:j].tobytes() for _, i, j in cuts], "least": [least[i:j].tobytes() for _, i, j in cuts]})

    dealt = files.select("number", "digests", "least").mapInArrow(deal, "bucket long, number long, digests binary, least binary")
    foreign = by_file(dealt.groupBy("bucket").applyInArrow(owners, "number long, bucket long, bits binary"), "bits").withColumnRenamed("bits", "foreign")
    paths = files.select("number", "path")
    # Files are few and small as rows, but each is much work: they go to a task each, and their answers with them.
    known = cut(paths.join(foreign, "number", "left").repartition(tasks, "number"))

    def own_chunks(work: Work, answers: list | None) -> np.ndarray:
        bits = aligned(bucket_of(work.digests[:, 0], buckets), [(a["bucket"], a["bits"]) for a in answers or []])
        return work.own(bits.astype(bool))

    def list_anchors(batches):
        for b in batches:
            for number, path, answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                work = Work(path)
                h, first, _ = work.runs(own_chunks(work, answers), width, gram)
                if not len(h):
                    continue
                anchors, times, marks = anchor_counts(h, work.doc(first))
                cuts = list(pieces_of(bucket_of(anchors, buckets)))
                values, times = anchors.astype(np.uint32), np.minimum(times, 65535).astype("<u2")
                yield _batch({"bucket": [k for k, _, _ in cuts], "number": [number] * len(cuts), **{name: [c[i:j].tobytes() for _, i, j in cuts] for name, c in (("anchors", values), ("times", times), ("marks", marks.astype(np.uint8)))}})

    listed = known.mapInArrow(list_anchors, "bucket long, number long, anchors binary, times binary, marks binary")
    kinds = by_file(listed.groupBy("bucket").applyInArrow(share(crowded), "number long, bucket long, bits binary"), "bits").withColumnRenamed("bits", "kinds")
    known = cut(known.join(kinds, "number", "left").repartition(tasks, "number"))

    def strings_of(work: Work, foreign_: list | None, kinds_: list | None) -> tuple[np.ndarray, Strings]:
        own = own_chunks(work, foreign_)
        return own, Strings(work, own, [(a["bucket"], a["bits"]) for a in kinds_ or []], width, gram, buckets, parts)

    def send(batches):
        for b in batches:
            for number, path, foreign_, kinds_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not kinds_:
                    continue
                _, strings = strings_of(Work(path), foreign_, kinds_)
                rows, group = strings.rows, strings.part // parts
                least, most = np.full(len(rows), NOBODY), np.full(len(rows), -NOBODY)
                np.minimum.at(least, strings.which, strings.doc)
                np.maximum.at(most, strings.which, strings.doc)
                for k, i, j in pieces_of(group) if len(group) else ():
                    full = np.arange(1, rows.shape[1])[None, :] <= rows[i:j, :1]
                    yield _batch({"bucket": [k], "number": [number], "text": [rows[i:j, 1:][full].tobytes()], "sizes": [rows[i:j, 0].tobytes()], "least": [least[i:j].tobytes()], "more": [(most - least)[i:j].tobytes()], "part": [(strings.part[i:j] % parts).astype(np.uint8).tobytes()]})

    sent = known.mapInArrow(send, "bucket long, number long, text binary, sizes binary, least binary, more binary, part binary")
    answers = by_file(sent.groupBy("bucket").applyInArrow(sorter(width, longest), "number long, bucket long, row binary, doc binary, bits binary"), "row", "doc", "bits").withColumnRenamed("row", "answers")
    todo = cut(known.join(answers, "number", "left").repartition(tasks, "number"))

    def finish(batches):
        for b in batches:
            for _, path, foreign_, kinds_, answers_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                work = Work(path)
                own, strings = strings_of(work, foreign_, kinds_)
                first, stop = repeats(strings, answers_ or [], parts)
                first, end = np.concatenate([work.first[~own], first]), np.concatenate([work.stop[~own], stop]) + width - 1
                doc = np.searchsorted(work.ends, first, side="right")
                spans = merged(first + doc, end + doc)  # a place more for each document, so that ranges of two never touch
                doc = np.searchsorted(work.ends + np.arange(1, len(work.ends) + 1), spans[0], side="right")
                spans = spans[0] - doc, spans[1] - doc
                at, rows = np.searchsorted(doc, np.arange(len(work.ids) + 1)), []
                for i, (s, e) in enumerate(zip(work.starts.tolist(), work.ends.tolist(), strict=True)):
                    mine = [(x - s, y - s) for x, y in zip(*(c[at[i] : at[i + 1]].tolist() for c in spans), strict=True)]
                    text, edges = work.raw[s:e].tobytes(), [0, *(x for pair in mine for x in pair), e - s]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((None if work.nulls[i] else int(work.ids[i]), e - s, [{"start": x, "end": y} for x, y in mine], kept))
                    if len(rows) == 256 or e - s > PIECE:
                        yield result(rows)
                        rows = []
                if rows:
                    yield result(rows)

    def result(rows: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [id_col, "n_bytes", "spans", "kept"])

    return todo.mapInArrow(finish, schema)


def repeats(strings: Strings, answers: list, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First starts and ends of starts of what a smaller document has, from a file's answers."""
    group = strings.part // parts  # rows were numbered within their bucket
    offset = {k: i for k, i, _ in pieces_of(group)} if len(group) else {}
    none = np.zeros(0, np.int64)
    found = [(offset[a["bucket"]] + np.frombuffer(a["row"], "<i8"), np.frombuffer(a["doc"], "<i8"), np.frombuffer(a["bits"], "<u8")) for a in answers]
    row, other, bits = (np.concatenate(c) for c in zip((none, none, none.view(np.uint64)), *found, strict=True))
    by = np.argsort(row, kind="stable")
    row, other, bits = row[by], other[by], bits[by]
    low, high = np.searchsorted(row, strings.which, side="left"), np.searchsorted(row, strings.which, side="right")
    times = high - low
    run = np.repeat(np.arange(len(times)), times)
    answer = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    smaller = other[answer] < strings.doc[run]
    run, answer = run[smaller], answer[smaller]
    places = [strings.first[run[(bits[answer] >> np.uint64(bit)) & np.uint64(1) > 0]] + bit for bit in range(63)]
    first = np.concatenate([none, *places])
    return first, first + 1


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges without overlap over the same bytes; ranges that touch become one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    return first[new], reach[np.append(np.flatnonzero(new)[1:], len(first)) - 1] if len(first) else reach


def digests(found: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def plain_removed(texts: list[tuple[int, bytes]], width: int) -> list[tuple[int, int, int, int, str]]:
    """The same by brute force, for tests."""
    first: dict[bytes, int] = {}
    for doc, raw in sorted(texts):
        for i in range(len(raw) - width + 1):
            first.setdefault(raw[i : i + width], doc)
    out = []
    for doc, raw in texts:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < doc:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "suffixes")
    out = cut(digests(removed(docs, folder)))
    remove_folder(folder)
    return out


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
