"""Byte-level BPE over a rank file, encoded by a sentencepiece BPE model built from the ranks alone.

The model's pieces are the tokens with each byte written as one printable character, a piece's score
is its negative rank, and normalisation is the identity: sentencepiece then always merges the
leftmost pair whose union has the lowest rank, which is the rule of the rank file.  The serialised
model is written here field by field.  Pre-tokens of the split pattern are encoded once a worker
and kept in a bounded dictionary.  A pre-token that is itself a token is that token.

Nulls count as empty texts (no ids, empty bytes); a null id stays null; repeated rows give repeated
rows; other columns play no part.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, held, slices, table, texts_of, vocabulary_path

# Characters below U+0250: their letters, numbers and white space can be listed, so that the faster
# matcher of the standard library splits texts that have no others.
LETTER, NUMBER, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
BEYOND = re.compile("[^\x00-ɏ]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself in Latin-1 where that prints, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) if kind == 2 else b"") + body


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 unknown, piece n + 1 the token that comes n-th by rank."""
    letters = byte_letters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))

    unknown = piece("⁇", 0.0, 2)
    tokens = b"".join(piece("".join(letters[b] for b in token), -float(n), 1) for n, token in enumerate(sorted(ranks, key=ranks.__getitem__)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(ranks) + 1)) + b"".join(_field(n, 0, _varint(v)) for n, v in ((40, 0), (41, 2**64 - 1), (42, 2**64 - 1), (43, 2**64 - 1))) + _field(45, 2, "⁇".encode())
    plain = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return unknown + tokens + _field(2, 2, trainer) + _field(3, 2, plain)


def listed_pattern(pattern: str) -> re.Pattern:
    """The split pattern for texts without characters from U+0250 on."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{BLANK}{LETTER}{NUMBER}]")
    return re.compile(inside.replace(r"\p{L}", f"[{LETTER}]").replace(r"\p{N}", f"[{NUMBER}]").replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]"))


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        order = sorted(self.ranks, key=self.ranks.__getitem__)
        self.rank_of_piece = np.array([-1, *(self.ranks[t] for t in order)], dtype=np.int32)
        self.bytes_of = {self.ranks[t]: t for t in order}
        self.to_letters = str.maketrans(dict(enumerate(byte_letters())))
        self.any_text, self.low_text = regex.compile(pattern), listed_pattern(pattern)
        self.known = BoundedCache(500_000, 12_000_000)

    def pretokens(self, text: str) -> list[str]:
        return (self.any_text if BEYOND.search(text) else self.low_text).findall(text)

    def encode_new(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian bytes."""
        raw = [p.encode() for p in pretokens]
        ids = self.model.encode([r.decode("latin-1").translate(self.to_letters) for r in raw], num_threads=1)
        one = self.ranks.get
        return [struct.pack("<i", n) if (n := one(r)) is not None else self.rank_of_piece[x].tobytes() for r, x in zip(raw, ids, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pretokens(t) for t in texts]
        self.known.fill(set().union(*split), self.encode_new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), dtype="<i4") for own in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec a Python worker."""
    return held("byte pairs", (path, pattern), lambda: ByteBpe(path, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id and ids (array of int) for every row; with ``decoded`` also the bytes that the ids stand for.  No shuffle."""

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for b in slices(batches):
            ids = bpe.encode(texts_of(b.column(1)))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
            if decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded (binary) for rows with ids; null ids decode to no bytes."""

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(np.array(x or [], dtype=np.int32)) for x in b.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
