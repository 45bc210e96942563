"""Near copies by SimHash: deletion-variant signatures propose pairs, Jaccard similarity verifies them.

The general form of operator 4, for links that a word shingle similarity defines.  The fingerprint is made of
a text's different words, as one changed word breaks ``width`` shingles but stays one word: at a similarity of
0.8 the fingerprints of 224 bits differ in about 12 bits and seldom in more than 22.  They are cut into
8 segments, fewer than the bits that may differ, so that at 15 or fewer differing bits some segment differs by at
most one; at more, it does with a probability that the README gives as measured recall.  Each segment of 28 bits is
indexed with each of its bits blanked, and an equality join on these keys proposes pairs of different shingle sets, of
which those go on that differ in ``most_bits`` at most; the similarity of the whole sets verifies them.  Fingerprints with
equal segments share all keys of it, so a key counts for the first bit, or where both values of its bit occur.

Keys that more than ``hot`` sets share are not joined, as their pairs grow with the square.  Such a key holds the sets of
two segments that differ in its bit; it becomes part of the group around the one that more sets have, so a set
is in one group for its own segment, and in those of more frequent neighbours.  Groups stream through a task
one after the other: those outside a key's largest component so far are held, ``held`` shingles at a time,
with an index of their shingles, and the others pass by, so that every pair of a key that components still part is
compared and no pair is ever a row.  What comes out are links that join components, less than one a set.

Null texts count as empty; texts without words are copies of each other; texts of fewer words than
``width`` have one shingle; rows with a null id link others and are never left out; no rows give no rows; other
columns are kept, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, cut, fresh, held, slices, texts_of
from .components import components

SEGMENTS, SEGMENT_BITS = 8, 28
FREQUENT = 512  # shingles of held sets that have a bit of their own


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, dtype="<u8")
    normal = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    return np.unique(np.fromiter([digest(normal[s:e], 42) for s, e in zip(starts[:n], last, strict=True)], dtype="<u8", count=n))


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def _hashes(words: list[bytes]) -> list[bytes]:
    return [hashlib.blake2b(w, digest_size=SEGMENTS * SEGMENT_BITS // 8).digest() for w in words]


def segments_of(text: str) -> list[int]:
    """The segments of the fingerprint of a text's different words; a bit is 1 if set in over half of their hashes."""
    words = set(text.encode().lower().split())
    if not words:
        return []
    known = held("near copies", "words", lambda: BoundedCache(300_000, 6_000_000))
    ones, n = np.zeros(SEGMENTS * SEGMENT_BITS, dtype=np.int64), 0
    for part in itertools.batched(words, 1 << 15):  # a long text's words, a bounded number at a time
        known.fill(set(part), _hashes)
        bits = np.frombuffer(b"".join(map(known.__getitem__, part)), dtype=np.uint8).reshape(len(part), -1)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return (ones * 2 > n).reshape(SEGMENTS, SEGMENT_BITS).dot(1 << np.arange(SEGMENT_BITS)).tolist()


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, node, n, segments): the shingle set's name and size, and the fingerprint.  No shuffle."""

    def run(batches):
        for b in slices(batches):
            texts = texts_of(b.column(1))
            sets = [shingles(t, width) for t in texts]
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([segments_of(t) for t in texts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "node", "n", "segments"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node long, n int, segments array<int>")


def variant_keys(nodes: DataFrame) -> DataFrame:
    """(node, key, bit): a row for each segment and blanked bit; a key holds both and the rest of the segment's bits."""
    places = nodes.filter(F.size("segments") > 0).select("node", "segments", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * SEGMENT_BITS - 1))).alias("place"))
    parts = places.select("node", "place", F.expr(f"segments[CAST(FLOOR(place / {SEGMENT_BITS}) AS INT)]").alias("whole"), F.expr(f"shiftleft(1, place % {SEGMENT_BITS})").alias("mask"))
    key = F.expr(f"shiftleft(CAST(place AS BIGINT), {SEGMENT_BITS}) | CAST(whole & ~mask AS BIGINT)")
    return parts.select("node", key.alias("key"), F.expr("whole & mask <> 0").alias("bit"))


def _group(bit):
    """The group around the segment that a key and a value of its blanked bit make: the segment's number and bits."""
    place = f"shiftright(key, {SEGMENT_BITS})"
    mask = F.expr(f"CAST(shiftleft(1, CAST({place} % {SEGMENT_BITS} AS INT)) AS BIGINT)")
    segment = F.expr(f"shiftleft(CAST(FLOOR({place} / {SEGMENT_BITS}) AS BIGINT), {SEGMENT_BITS})")
    return segment.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).bitwiseOR(F.when(bit, mask).otherwise(0))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, own): the shingle sets of wanted nodes, made again from one of their rows' texts."""

    def run(batches):
        for b in slices(batches, 64):
            sets = [shingles(t, width) for t in texts_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64()))], ["name", "own"])

    named = nodes.join(wanted, "node", "left_semi").select("node", "name", "one")
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = read.join(named.select("one").distinct(), F.col("id").eqNullSafe(F.col("one")), "left_semi").select("text")
    made = texts.mapInArrow(run, "name long, own array<long>").join(named.select("node", "name"), "name")
    return made.groupBy("node").agg(F.first("own").alias("own"))


def _near(pairs: DataFrame, nodes: DataFrame, tenths: int, most_bits: int) -> DataFrame:
    """The pairs (a, b), each once, whose fingerprints and set sizes are near enough."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("segments").alias(f"s_{s}"))
    once = pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bits = sum((F.bit_count(F.element_at("s_a", i + 1).bitwiseXOR(F.element_at("s_b", i + 1))) for i in range(SEGMENTS)), F.lit(0))
    fits = F.least("n_a", "n_b") * 10 >= F.greatest("n_a", "n_b") * tenths
    return once.join(side("a"), "a").join(side("b"), "b").filter(fits & (bits <= most_bits)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    # Both / (all - both) >= tenths / 10, in whole numbers.
    both = F.size(F.array_intersect("own_a", "own_b"))
    return joined.filter(both * (10 + tenths) >= (F.size("own_a") + F.size("own_b")) * tenths).select("a", "b")


class Held:
    """Sets of one key with an index: bits for frequent shingles, lists of places for the others."""

    def __init__(self, nodes: list[int], parts: list[int], sets: list[np.ndarray]):
        self.nodes, self.parts, self.sizes = nodes, parts, np.array(list(map(len, sets)))
        often = Counter(itertools.chain.from_iterable(s.tolist() for s in sets))
        self.bits = {x: i for i, (x, _) in enumerate(often.most_common(FREQUENT))}
        self.places: dict[int, list[int]] = {}
        masks = np.zeros((len(sets), FREQUENT), bool)
        for n, own in enumerate(sets):
            for x in own.tolist():
                if x in self.bits:
                    masks[n, self.bits[x]] = True
                else:
                    self.places.setdefault(x, []).append(n)
        self.masks = np.packbits(masks, axis=1).view(np.uint64)
        self.up: dict[int, int] = {}

    def root(self, part: int) -> int:
        while (above := self.up.get(part, part)) != part:
            part = above
        return part

    def meet(self, node: int, part: int, own: np.ndarray, tenths: int):
        """Links (node, held node) that join two components, for a set that passes by."""
        mask, found = np.zeros(FREQUENT, bool), []
        for x in own.tolist():
            if (bit := self.bits.get(x)) is not None:
                mask[bit] = True
            elif x in self.places:
                found += self.places[x]
        both = np.bitwise_count(self.masks & np.packbits(mask).view(np.uint64)).sum(axis=1, dtype=np.int64)
        if found:
            both += np.bincount(found, minlength=len(both))
        for n in np.flatnonzero(both * (10 + tenths) >= (self.sizes + len(own)) * tenths).tolist():
            a, b = self.root(part), self.root(self.parts[n])
            if a != b:
                self.up[max(a, b)] = min(a, b)
                yield node, self.nodes[n]


def _streamed(rows: DataFrame, tenths: int) -> DataFrame:
    """(a, b): links that join components, of rows (key, block, held, node, part, own) in that order within a partition."""

    def run(batches):
        place, waiting, index, out = None, [], None, []

        def build() -> Held:
            """An index of the held sets, which come first; they meet each other now."""
            made = Held(*map(list, zip(*waiting, strict=True))) if waiting else Held([], [], [])
            for one in waiting:
                out.extend(made.meet(*one, tenths))
            waiting.clear()
            return made

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
            for i, (key, block, first, node, part) in enumerate(keys):
                own = b.column(5)[i].values.to_numpy()
                if (key, block) != place:
                    if waiting:
                        build()
                    place, index = (key, block), None
                if first:
                    waiting.append((node, part, own))
                    continue
                if index is None:
                    index = build()
                out += index.meet(node, part, own, tenths)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        if waiting:
            build()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _crowded(members: DataFrame, nodes: DataFrame, found: DataFrame, sets, parts: int, tenths: int, held: int) -> DataFrame:
    """Links between components that share a group; members (key, node)."""
    component = components(found).withColumnRenamed("component", "part")
    parted = cut(members.join(nodes.select("node", "n"), "node").join(component, "node", "left").withColumn("part", F.coalesce("part", "node")))
    sizes = parted.groupBy("key", "part").agg(F.sum("n").alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("part", F.struct("m", "part")).alias("most"), F.sum("m").alias("all"), F.max("m").alias("m"))
    open_keys = cut(largest.filter("all > m").withColumn("blocks", F.ceil((F.col("all") - F.col("m")) / held).cast("int")).select("key", "most", "blocks"))
    rows = cut(parted.drop("n").join(open_keys, "key"))
    own = sets(rows.select("node").distinct())
    # Members outside the largest component are held in one block of a group and pass by the blocks behind it; the others
    # pass by all blocks.
    rest, own_block = F.col("part") != F.col("most"), F.pmod(F.xxhash64("node"), "blocks").cast("int")
    turns = F.when(rest, F.sequence(own_block, F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.select("key", F.explode(turns).alias("block"), rest.alias("rest"), own_block.alias("own_block"), "node", "part")
    dealt = dealt.select("key", "block", (F.col("rest") & (F.col("block") == F.col("own_block"))).alias("first"), "node", "part")
    whole = dealt.join(own, "node").select("key", "block", "first", "node", "part", "own")
    return _streamed(whole.repartition(parts, "key", "block").sortWithinPartitions("key", "block", F.desc("first"), "node"), tenths)


def links(docs: DataFrame, nodes: DataFrame, width: int, tenths: int, most_bits: int, hot: int, held: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) with links enough to connect all distinct sets of proposed pairs that are similar enough."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Small rows of which many are made: over all tasks first, by a hash, as dealing out by node counts as done.
    # The keys are dealt out once, both to be counted and to be joined to what is shared.
    keys = variant_keys(nodes.select("node", "segments").repartition(parts, F.xxhash64("node"))).repartition(parts, "key")
    first_bit = F.shiftright("key", SEGMENT_BITS) % SEGMENT_BITS == 0
    # A node has a key once; asking for two nodes, not two rows, keeps the columns dealt out the same for both uses.
    counts = keys.groupBy("key").agg(F.count("*").alias("m"), F.count_if("bit").alias("ones"), F.min("node").alias("low"), F.max("node").alias("high")).filter((F.col("low") < F.col("high")) & (first_bit | (F.col("ones") > 0) & (F.col("ones") < F.col("m"))))
    counts = counts.select(F.col("key").alias("k"), (F.col("m") <= hot).alias("few"), (F.col("ones") * 2 >= F.col("m")).alias("centre"))
    # Of a crowded key the sets of the less frequent value of its bit go to the group around the other one.
    shared = cut(keys.join(counts, (F.col("key") == F.col("k")) & (F.col("few") | first_bit | (F.col("bit") != F.col("centre")))).select("key", "node", "bit", "few", "centre"))
    neighbours = shared.filter(~F.col("few")).select(_group(F.col("centre")).alias("key"), "node")
    sets = lambda wanted: _sets(docs, nodes, wanted, width, id_col, text_col)
    plain = shared.filter("few")
    side = lambda s: plain.select("key", F.col("node").alias(s), F.col("bit").alias(f"bit_{s}"))
    pairs = side("a").join(side("b"), "key").filter((F.col("a") < F.col("b")) & (first_bit | (F.col("bit_a") != F.col("bit_b")))).select("a", "b")
    near = cut(_near(pairs, nodes, tenths, most_bits))
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    found = cut(_verified(near, sets(wanted), tenths))
    own = nodes.filter(F.size("segments") > 0).select(F.posexplode("segments").alias("at", "whole"), "node")
    own = own.select(F.expr(f"shiftleft(CAST(at AS BIGINT), {SEGMENT_BITS}) | whole").alias("key"), "node").join(neighbours.select("key").distinct(), "key", "left_semi")
    members = cut(own.unionByName(neighbours).distinct())
    if members.isEmpty():
        return found
    return cut(found.unionByName(_crowded(members, nodes, found, sets, parts, tenths, held)))


def keep_one(docs: DataFrame, width: int = 5, tenths: int = 8, most_bits: int = 56, hot: int = 3, held: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component of similar sets; all columns are kept.

    Rows that repeat such an id all stay, and so do rows without an id.
    """
    rows = sketches(docs, width, id_col, text_col)
    once = cut(rows.groupBy(F.col("node").alias("name")).agg(F.first("n").alias("n"), F.first("segments").alias("segments"), F.min("id").alias("one")))
    nodes = once.withColumn("node", F.monotonically_increasing_id())  # short numbers for what is dealt out often
    parts = components(links(docs, nodes, width, tenths, most_bits, hot, held, id_col, text_col))
    named = nodes.select("node", "one").join(parts, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("one").alias("one"))
    stay = fresh("stays", docs.columns)
    kept = named.select(F.col("one").alias(stay)).filter(F.col(stay).isNotNull()).distinct()
    return docs.join(kept, F.col(id_col) == F.col(stay), "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
