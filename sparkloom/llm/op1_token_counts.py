"""Token counts of whole texts under a sentencepiece BPE vocabulary, without materialising ids of texts.

No piece of the vocabulary has a word mark behind another character, and none holds a line feed
(checked when the model is loaded).  So no merge ever crosses such a place, and a text falls into
pre-tokens whose piece counts add up.  Of a model for which this does not hold each whole text is one pre-token.

1. Tasks split texts and write working files of FILE_BYTES of text: of each document its different pre-tokens,
   as numbers of the file's dictionary, and how often it has them.  The dictionary is returned.
2. Dictionaries are dealt out by hashes of their words, so that equal ones meet: each distinct pre-token is counted
   once by the model, and the count joined to every file that has it.  Only words move, one a file, not
   their occurrences.
3. The counts go back to the files, which sum frequency times count by document.

Nulls count as empty texts, empty texts have no tokens, a null id stays null; a repeated row gives a
repeated row; no rows give no rows; columns other than the two named ones play no part.  A long text is split a
section at a time.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, new_folder, slices, table, texts_of, vocabulary_path
from .files import AttemptFile, open_input, remove_folder

MARK = "▁"
RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+")
SINGLE = re.compile(f"(?<=[^ {MARK}]) ")
FILE_BYTES, SECTION = 8 << 20, 1 << 20


class PieceCounter:
    """Splits texts into pre-tokens and counts the pieces of pre-tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        # A piece that joins two pre-tokens would make their counts depend on each other.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces) and self._plain()

    def _plain(self) -> bool:
        """Whether the model leaves text as it is, but for one mark put before it."""
        shown = "".join(self.model.encode(" a  B \nc\u2460", out_type=str))
        return shown.replace("<0x0A>", "\n").startswith(f"{MARK}{MARK}a{MARK}{MARK}B{MARK}\nc")

    def sections(self, text: str):
        """Parts of a text between blanks that no blank precedes; the mark put before a part stands for the blank."""
        at = 0
        while self.splits and len(text) - at > SECTION:
            found = SINGLE.search(text, at + SECTION)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:]

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a section, and its line feeds, which are a piece each."""
        if not self.splits:
            return [text], 0
        feeds = text.count("\n")
        if "  " in text or MARK in text or text[:1] == " ":
            return RUNS.findall(MARK + text.replace(" ", MARK)), feeds
        return [x for x in (MARK + text.replace(" ", f" {MARK}")).replace("\n", " ").split(" ") if x], feeds

    def count(self, pretokens: list[str]) -> list[int]:
        """Pieces of pre-tokens; the model itself puts a mark before what it encodes."""
        if not self.splits:
            return [len(x) for x in self.model.encode(pretokens, num_threads=1)]
        marked = [p[0] == MARK for p in pretokens]
        ids = self.model.encode([p[1:] if m else f"\n{p}" for p, m in zip(pretokens, marked, strict=True)], num_threads=1)
        # A pre-token that is one mark only is encoded as "": the model gives that no mark.
        return [1 if p == MARK else len(x) - (0 if m else 2) for p, m, x in zip(pretokens, marked, ids, strict=True)]


def counter(model_path: str) -> PieceCounter:
    """One counter a Python worker."""
    return held("token counts", model_path, lambda: PieceCounter(model_path))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 31 in size, compressed: byte planes, as the upper ones are nearly all alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<i4")


class Frequencies:
    """What one working file gets: a dictionary of pre-tokens, and of each document their numbers and frequencies."""

    def __init__(self, pieces: PieceCounter):
        self.pieces, self.size, self.ids, self.n_bytes = pieces, 0, [], []
        self.words: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.feeds, self.sizes, self.numbers, self.times = [], [], [], []

    def add(self, text: str) -> None:
        feeds, size = 0, 0
        for section in self.pieces.sections(text) if text else ():
            own, more = self.pieces.pretokens(section)
            feeds += more
            found, often = np.unique(np.fromiter(map(self.words.__getitem__, own), np.int32, len(own)), return_counts=True)
            size += len(found)
            self.numbers.append(found)
            self.times.append(often.astype(np.int32))
        self.feeds.append(feeds)
        self.sizes.append(size)
        self.size += len(text)

    def write(self, folder: str, kind: pa.DataType) -> str:
        none = np.zeros(0, np.int32)
        numbers, times = (np.concatenate([none, *parts]) for parts in (self.numbers, self.times))
        # Numbers rise within a document, so steps between them are small.
        blobs = [packed(np.diff(numbers, prepend=np.int32(0))), packed(times)]
        columns = [pa.chunked_array(self.ids, kind).combine_chunks(), pa.array(np.concatenate(self.n_bytes)), pa.array(self.feeds, pa.int64()), pa.array(self.sizes, pa.int64())]
        batch = pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "feeds", "sizes"])
        file = AttemptFile(folder, "frequencies", ".arrow")
        with pa.ipc.new_stream(file.out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        for blob in blobs:
            file.write(len(blob).to_bytes(8, "little"))
            file.write(blob)
        file.close()
        return file.path


def sums(path: str, counts: np.ndarray):
    """Result batches of a working file; counts has the pieces of each pre-token of its dictionary."""
    with open_input(path) as f:
        with pa.ipc.open_stream(f) as batches:
            whole = batches.read_next_batch()
            list(batches)
        numbers, times = (unpacked(f.read(int.from_bytes(f.read(8), "little"))) for _ in range(2))
    each = np.concatenate([[0], np.cumsum(counts[np.cumsum(numbers)] * times.astype(np.int64))])
    ends = np.cumsum([0, *whole.column(3).to_pylist()])
    total = each[ends[1:]] - each[ends[:-1]] + whole.column(2).to_numpy()
    yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(total, pa.int64())], ["id", "n_bytes", "n_tokens"])


def dictionaries(docs: DataFrame, folder: str, model_path: str, id_col: str, text_col: str) -> DataFrame:
    """(number, path, words, size): a row a working file, with its different pre-tokens as an Arrow message."""

    def run(batches):
        from pyspark import TaskContext

        pieces, n = counter(model_path), 0
        own = Frequencies(pieces)

        def flush(kind):
            path, number, words = own.write(folder, kind), TaskContext.get().partitionId() << 32 | n, message(list(own.words))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([words], pa.binary()), pa.array([len(words)], pa.int64())], ["number", "path", "words", "size"])

        kind = None
        for b in slices(batches):
            start, kind = 0, b.column(0).type
            for i, text in enumerate(texts_of(b.column(2))):
                own.add(text)
                if own.size >= FILE_BYTES or i == b.num_rows - 1:
                    part = b.slice(start, i + 1 - start)
                    start = i + 1
                    own.ids.append(part.column(0))
                    own.n_bytes.append(part.column(1).to_numpy())
                if own.size >= FILE_BYTES:
                    yield flush(kind)
                    own, n = Frequencies(pieces), n + 1
        if own.ids:
            yield flush(kind)

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return read.mapInArrow(run, "number long, path string, words binary, size long")


def message(words: list[str]) -> bytes:
    """Words as one compressed Arrow stream."""
    out, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([pa.array(words, pa.large_string())], ["word"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def words_of(data: bytes) -> list[str]:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all().column(0).to_pylist()


def deal(buckets: int):
    """Maps rows (number, words) to (bucket, number, places, words): the words of a file by their hash."""

    def run(batches):
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(data)
                bucket = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) * buckets >> 32
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
                for i, j in itertools.pairwise([*cuts, len(order)]):
                    own = order[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int64()), pa.array([number], pa.int64()), pa.array([packed(np.diff(own, prepend=0))], pa.binary()), pa.array([message([words[k] for k in own.tolist()])], pa.binary())], ["bucket", "number", "places", "words"])

    return run


def counted(model_path: str):
    """Of one bucket: for each file the pieces of its words; each distinct word is counted once."""

    def run(t: pa.Table) -> pa.Table:
        pieces, files = counter(model_path), [words_of(x) for x in t.column("words").to_pylist()]
        known = dict.fromkeys(itertools.chain.from_iterable(files), 0)
        for part in itertools.batched(list(known), 4096):
            known.update(zip(part, pieces.count(list(part)), strict=True))
        found = [packed(np.fromiter(map(known.__getitem__, words), np.int32, len(words))) for words in files]
        return pa.table({"number": t.column("number"), "places": t.column("places"), "pieces": pa.array(found, pa.binary())})

    return run


def token_counts(docs: DataFrame, model_path: str, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, bucket_bytes: int = 4 << 20) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > max_tokens) for every row of docs.

    The working files in ``folder`` (a new one unless given) are read when the result is; delete them afterwards.
    """
    files = cut(dictionaries(docs, folder or new_folder(docs.sparkSession, "frequencies"), model_path, id_col, text_col))
    size, n_files = files.agg(F.sum("size"), F.count("*")).first()
    dealt = files.select("number", "words").mapInArrow(deal(max(16, (size or 0) // bucket_bytes)), "bucket long, number long, places binary, words binary")
    counts = dealt.groupBy("bucket").applyInArrow(counted(model_path), "number long, places binary, pieces binary")
    whole = counts.groupBy("number").agg(F.collect_list(F.struct("places", "pieces")).alias("counts"))
    todo = cut(files.select("number", "path").join(whole, "number", "left").repartition(max(1, min(n_files, 10_000)), "number"))

    def run(batches):
        for b in batches:
            for path, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = [(np.cumsum(unpacked(x["places"])), unpacked(x["pieces"])) for x in parts or []]
                pieces = np.zeros(sum(len(p) for _, p in found), np.int64)
                for places, own in found:
                    pieces[places] = own
                yield from sums(path, pieces)

    kind = docs.schema[id_col].dataType.simpleString()
    out = todo.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col).withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "frequencies")
    out = cut(token_counts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"), folder=folder))
    remove_folder(folder)
    return out


QUERIES = {"op1_token_counts": op1_token_counts}
