"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_distance // 2 + 1`` segments: of two fingerprints within
max_distance bits, one segment then differs by at most one bit.  Each segment is indexed with every
one of its bits replaced by a wildcard, so both have an equal key; an equality join on the keys
proposes pairs and the number of differing bits verifies them.  Only distinct fingerprints are joined,
copies come back through their fingerprint.

Keys that more than ``hot`` fingerprints share are not joined, as their pairs grow with the square.
Their fingerprints go a second, exact way: up to 3 bits, each is indexed with every ``max_distance`` of its 64
bits replaced by wildcards.  Such a key holds 2 ** max_distance fingerprints at most, which are all
linked to each other, so one star a key says all.  Beyond 3 bits they are compared with leaders of their key, and
then with what components still part.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other;
rows with a null id keep their fingerprint and get the component of it; repeated rows give repeated
rows; other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, texts_of
from .components import components

BITS = 64


def simhash(text: str, width: int) -> int:
    """Signed 64-bit fingerprint of a text's word shingles."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    normal = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    hashes = np.fromiter([digest(normal[s:e], 42) for s, e in zip(starts[:n], last, strict=True)], dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 15):  # a long text's bits, a bounded piece at a time
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is a long whose bit is 1 if set in over half of the shingle hashes.  No shuffle."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t, width) for t in texts_of(b.column(1))], pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variant_keys(fps: DataFrame, max_distance: int) -> DataFrame:
    """(fp, slot, key): key is one segment of fp with one bit blanked, slot tells which.

    Slot and key stay inside codegen: the masks are literals, one explode makes the rows.
    """
    masks = [_signed(((1 << n) - 1) << at & ~(1 << (at + i))) for at, n in segment_bounds(max_distance // 2 + 1) for i in range(n)]
    variants = F.array(*(F.struct(F.lit(i).cast("smallint").alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    return fps.select("fp", F.explode(variants).alias("v")).select("fp", "v.slot", "v.key")


def _spread(fps: DataFrame) -> DataFrame:
    """fps over all shuffle partitions: they are small, but what is made of each is not, and tasks are sized before."""
    # By a hash of fp: dealing out by fp itself would be taken for done already, and left out of the plan.
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def links(fps: DataFrame, max_distance: int = 2, hot: int = 256) -> DataFrame:
    """(fp, other) with links enough to connect all distinct fingerprints within max_distance bits of each other."""
    if max_distance == 0:
        return fps.select("fp", F.col("fp").alias("other")).limit(0)
    keys = variant_keys(_spread(fps), max_distance)
    crowded = cut(keys.groupBy("slot", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("slot", "key"))
    if crowded.isEmpty():
        return _joined(keys, max_distance)
    plain = keys.join(crowded, ["slot", "key"], "left_anti")
    if max_distance > 3:
        own = keys.join(crowded, ["slot", "key"], "left_semi").select(F.struct("slot", "key").alias("key"), F.col("fp").alias("node"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
        found = cut(_joined(plain, max_distance).select(F.col("fp").alias("a"), F.col("other").alias("b")))
        whole = linked(own, found, lambda pairs: cut(pairs.filter(near & (F.col("a") != F.col("b"))).distinct()), 3)
        return whole.select(F.col("a").alias("fp"), F.col("b").alias("other"))
    members = keys.join(crowded, ["slot", "key"], "left_semi").select("fp").distinct()
    return _joined(plain, max_distance).unionByName(_neighbourhoods(_spread(members), max_distance))


def linked(members: DataFrame, found: DataFrame, verified: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """found (a, b) with links that also connect what keys with many members (key, node) propose.

    Members are compared with one leader a key, ``rounds`` times, then those that components still part with each
    other.  ``verified`` gives the true ones of some pairs (a, b), materialised.
    """
    if members.isEmpty():
        return found
    for n in range(rounds + 1):
        parted = members.join(components(found).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        parted = cut(parted.select("key", "node", "part"))
        if n < rounds:  # one leader a key against the members of other components
            lead = parted.groupBy("key").agg(F.min_by(F.struct("node", "part"), F.xxhash64("node", F.lit(n))).alias("l"))
            pairs = parted.join(lead, "key").filter("part != l.part").select(F.col("node").alias("a"), F.col("l.node").alias("b"))
        else:  # what is outside a key's largest component against all other components
            sizes = parted.groupBy("key", "part").agg(F.count("*").alias("m"))
            most = sizes.groupBy("key").agg(F.max_by("part", "m").alias("most"))
            rest = parted.join(most, "key").filter("part != most").select("key", F.col("node").alias("b"), F.col("part").alias("part_b"))
            pairs = parted.withColumnRenamed("node", "a").join(rest, "key").filter("part != part_b").select("a", "b")
        found = cut(found.unionByName(verified(pairs)).distinct())
    return found


def _joined(keys: DataFrame, max_distance: int) -> DataFrame:
    # Estimates take the keys to be as small as the fingerprints they are made of, and the driver would broadcast them all.
    a, b = keys.alias("a").hint("merge"), keys.alias("b").hint("merge")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance
    on = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near
    return a.join(b, on).select(F.col("a.fp").alias("fp"), F.col("b.fp").alias("other"))


def _neighbourhoods(fps: DataFrame, max_distance: int) -> DataFrame:
    """Stars over fingerprints that are equal but for max_distance wildcard bits; max_distance is 1, 2 or 3."""
    bit = [F.lit(_signed(1 << i)) for i in range(BITS)]
    single = F.array(*bit)
    blanked = F.col("fp")
    rows = fps.select("fp", F.posexplode(single).alias("p1", "b1"))
    mask, slot, last = F.col("b1"), F.col("p1"), F.col("p1")
    for k in range(2, max_distance + 1):
        rows = rows.select("*", F.posexplode(F.slice(single, last + 2, BITS)).alias(f"o{k}", f"b{k}")).withColumn(f"p{k}", last + 1 + F.col(f"o{k}"))
        mask, slot, last = mask.bitwiseOR(F.col(f"b{k}")), slot * BITS + F.col(f"p{k}"), F.col(f"p{k}")
    keyed = rows.select("fp", slot.alias("slot"), blanked.bitwiseAND(F.bitwise_not(mask)).alias("key"))
    groups = keyed.groupBy("slot", "key").agg(F.collect_set("fp").alias("own")).filter(F.size("own") > 1)
    stars = groups.select(F.array_min("own").alias("fp"), F.explode("own").alias("other"))
    return stars.filter("fp != other").distinct()


def _components(rows: DataFrame, max_distance: int, hot: int, id_col: str) -> DataFrame:
    """(fp, component_id) of all distinct fingerprints of rows."""
    fps = rows.groupBy("fp").agg(F.min(id_col).alias("rep"))
    linked = cut(links(fps.select("fp"), max_distance, hot).distinct())
    # Fingerprints are the nodes; what a component is called is settled afterwards by its smallest id.
    parts = components(linked.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, max_distance: int = 2, hot: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable over links of fingerprints."""
    rows = cut(fingerprints(docs, width, id_col, text_col))
    return rows.join(_components(rows, max_distance, hot, id_col), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, max_distance: int = 2, hot: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component; all columns are kept.

    Rows that repeat such an id all stay, and so do rows without an id, which no component is named after.
    """
    rows = cut(fingerprints(docs, width, id_col, text_col))
    stay = _components(rows, max_distance, hot, id_col).select(F.col("component_id").alias("_stays")).filter("_stays is not null").distinct()
    named = docs.join(stay, F.col(id_col) == F.col("_stays"), "left_semi")
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
