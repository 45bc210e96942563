"""Benchmark decontamination: documents are scanned once by Aho-Corasick automata over benchmark windows.

Texts are normalised bytewise: A-Z to lower case, every byte that is no word byte to a blank, runs of
blanks to one.  A window is ``width`` consecutive words of an item (an item of fewer words is one
window).  The automaton holds every distinct window between blanks; a match ends at a byte offset of
the normalised text, which tells the word it ends at, and words map back to byte ranges of the
original text.

The executors write the items to files of ``block_bytes`` of text in the shared folder, so that neither the
driver nor a broadcast holds the benchmark; a file makes one automaton.  There is one pass over the
documents: a task holds ``batch_bytes`` of texts at a time and scans them with the automaton of each
file in turn, ``blocks_at_once`` of which a worker keeps.  A benchmark of one file is one automaton, built once a
worker; a larger one costs a build for each batch and file, and gives the same rows.

Null documents and items have no words; an item without words has no window; null item ids are left
out; a repeated document row gives a repeated result; repeated item ids count once; other columns
play no part, kept ones that are called like a column of the result are replaced by it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, new_folder, slices, table, texts_of, with_text
from .files import AttemptFile, open_input, remove_folder

# Fixed values of the contract: bytes that are no part of a word, after A-Z became a-z.
NO_WORD = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
TO_WORDS = bytes(0x20 if b in NO_WORD and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


class Windows:
    """An automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        import ahocorasick

        owners: dict[str, tuple[int, set]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                window = words[i : i + width]
                owners.setdefault(f" {b' '.join(window).decode('latin-1')} ", (len(window), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton() if owners else None
        for window, (length, ids) in owners.items():
            self.automaton.add_word(window, (length, tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, normal: bytes) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (first, end) that windows cover in a text of words between single blanks, and the items."""
        found, items = [], set()
        if self.automaton is None:
            return found, items
        hits = list(self.automaton.iter(normal.decode("latin-1")))
        if hits:
            blanks = np.flatnonzero(np.frombuffer(normal, dtype=np.uint8) == 0x20)
            for at, (length, ids) in hits:
                end = int(np.searchsorted(blanks, at))  # the blank behind word n is blank n + 1
                found.append((end - length, end))
                items.update(ids)
        return found, items


def windows(path: str, width: int, most: int) -> Windows:
    """The automaton of a file of items; a Python worker keeps the last ones."""

    def build() -> Windows:
        with open_input(path) as f, pa.ipc.open_stream(f) as items:
            return Windows([pair for b in items for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], width)

    return held("decontamination", (path, width), build, most)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap that cover the same words."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def byte_ranges(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges in the UTF-8 of the original text for ranges of its words."""
    if not ranges:
        return []
    spans = [m.span() for m in WORD.finditer(text.encode())]
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]


def write_blocks(items: DataFrame, folder: str, id_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Files of items, each of at most block_bytes of text (or one item); only their paths reach the driver."""
    schema = pa.schema([("id", pa.string()), ("text", pa.string())])

    def run(batches):
        block, size = [], 0

        def flush():
            file = AttemptFile(folder, "items", ".arrow")
            with pa.ipc.new_stream(file.out, schema) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block, strict=True)], schema=schema))
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([file.path])], ["path"])

        for b in slices(batches):
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(text.encode())
                if block and size + n > block_bytes:
                    yield flush()
                    block, size = [], 0
                block.append((item, text))
                size += n
        if block:
            yield flush()

    read = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    total = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return sorted(r["path"] for r in read.repartition(total // block_bytes + 1).mapInArrow(run, "path string").collect())


OWN = ("n_words", "n_hit", "spans", "items")
TYPES = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 8_000_000,
    blocks_at_once: int = 4,
    batch_bytes: int = 16_000_000,
    keep: tuple[str, ...] = (),
    folder: str | None = None,
) -> DataFrame:
    """For every row of docs: id, n_words, n_hit (words inside hit passages), spans (start and end byte of each
    passage in the original text), items (ids of the items with occurring windows, sorted as strings);
    ``keep`` names further columns of docs to pass through.  The files in ``folder`` (a new one unless given) are
    read when the result is; delete them afterwards.
    """
    paths = write_blocks(items, folder or new_folder(docs.sparkSession, "benchmark"), item_id_col, item_text_col, block_bytes)
    kept = [id_col, *(c for c in keep if c.lower() not in OWN and c != id_col)]
    sent, at = with_text(docs, text_col, kept)

    def scan(held: list):
        """Result batches for some input batches, a file of items after the other."""
        words = [[words_of(t) for t in texts_of(b.column(at))] for b in held]
        ranges: list[list] = [[[] for _ in own] for own in words]
        ids: list[list] = [[set() for _ in own] for own in words]
        for path in paths:
            automaton = windows(path, width, blocks_at_once)
            for own, r, i in zip(words, ranges, ids, strict=True):
                for n, text in enumerate(own):
                    found, names = automaton.scan(b" " + b" ".join(text) + b" ")
                    r[n] += found
                    i[n] |= names
        for b, own, r, i in zip(held, words, ranges, ids, strict=True):
            rows = []
            for text, w, found, names in zip(texts_of(b.column(at)), own, r, i, strict=True):
                hit = merged(found)
                rows.append((len(w), sum(e - s for s, e in hit), [{"start": s, "end": e} for s, e in byte_ranges(text, hit)], sorted(names)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True))], [*kept, *OWN])

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            held.append(b)
            size += b.column(at).nbytes
            if size >= (batch_bytes if len(paths) > 1 else 1):
                yield from scan(held)
                held, size = [], 0
        if held:
            yield from scan(held)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return sent.mapInArrow(run, f"{schema}, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "benchmark")
    out = cut(digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), folder=folder)))
    remove_folder(folder)
    return out


QUERIES = {"op3_decontaminate": op3_decontaminate}
