"""Relational operators beyond single DataFrame calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.storage import materialised


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given (total) order."""
    return top_k_per_group(df, keys, order, 1)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; the optimizer turns the rank filter into a group limit before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def array_agg(column: str) -> Column:
    """All values of a group as an array, nulls included."""
    return F.transform(F.collect_list(F.struct(F.col(column).alias("x"))), lambda s: s["x"])


def union_all(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of all parts by position, names from the first."""
    whole = reduce(DataFrame.union, parts)
    return whole.distinct() if distinct else whole


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time.

    Both sides become one stream by key and time slice, in which the last seen right values are carried
    on; what a slice starts with comes from the slices' last values alone.  So a key with much of all
    rows is spread over its slices, and no pairs are made.  Left columns come first; values are null
    where there is no earlier right row.
    """
    seen = F.struct(*(F.col(v) for v in values))
    kind = right.select(seen.alias("s")).schema["s"].dataType
    sliced = lambda df: df.withColumn("_slice", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (slice_seconds * 1_000_000)))
    a = sliced(left.withColumn("_at", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_seen", F.lit(None).cast(kind)))
    b = sliced(right.select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), seen.alias("_seen")))
    both = a.unionByName(b, allowMissingColumns=True)
    ends = both.groupBy(*keys, "_slice").agg(F.max_by("_seen", F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    within = W.partitionBy(*keys, "_slice").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(within)).filter("_side = 1")
    joined = carried.join(starts, [*keys, "_slice"], "left").withColumn("_last", F.coalesce("_last", "_begin"))
    return joined.select(*left.columns, *(F.col("_last")[v].alias(v) for v in values))


def bucketed_range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float, across: int = 16_384, down: int = 2_048) -> DataFrame:
    """Points joined to the half-open ranges that hold them, by an equality join on buckets.

    A range goes to the buckets of its own level, which are ``width`` times a power of two wide and, above the lowest
    level, an eighth of it at least, so to nine at most, however wide it is; a point goes to one bucket of each level
    that some range has.  A bucket of more than ``across`` points or ``down`` ranges is dealt into blocks of about so
    many of both, in which each of its points meets each of its ranges once, so that no task has a whole crowded bucket.
    """
    bucket, block = ["_level", "_bucket"], ["_level", "_bucket", "_across", "_down"]
    level = F.ceil(F.log2((F.col(end) - F.col(start)) / width)) - 3
    r = ranges.filter(F.col(end) > F.col(start)).withColumn("_level", F.greatest(F.lit(0), level).cast("int"))
    levels = sorted(x[0] for x in r.select("_level").distinct().collect())  # a few dozen at most, as lengths are doubles
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), "_level")
    r = r.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(end) / wide))))
    p = points.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>"))).withColumn("_bucket", F.floor(F.col(point) / wide))

    # Estimates see neither the buckets of a range nor the blocks, so what looks small enough to broadcast may not be.
    sizes = p.groupBy(*bucket).agg(F.count("*").alias("_p")).join(r.groupBy(*bucket).agg(F.count("*").alias("_r")).hint("merge"), bucket)
    # How many parts a crowded bucket's points and ranges make: a row for each ``across`` points or ``down`` ranges at most.
    crowded = sizes.filter((F.col("_p") > across) | (F.col("_r") > down)).select(*bucket, F.ceil(F.col("_p") / across).alias("_ps"), F.ceil(F.col("_r") / down).alias("_rs"))
    crowded = materialised(crowded)

    def dealt(rows: DataFrame, own: str, owns: str, other: str, others: str) -> DataFrame:
        """rows with a part of their own side, once for each part of the other side."""
        rows = rows.join(F.broadcast(crowded), bucket, "left").withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(owns, F.lit(1))))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop("_ps", "_rs")
        # By a fixed number: tasks would be put together by their bytes, which do not tell how many rows come out of a block.
        return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block)

    if crowded.isEmpty():
        block = bucket
    else:
        p, r = dealt(p, "_across", "_ps", "_down", "_rs"), dealt(r, "_down", "_rs", "_across", "_ps")
    return p.join(r.hint("merge"), block).filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop(*block)


def inherited(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """Rows of a parent table and of its children, cut to the parent's columns."""
    return reduce(DataFrame.unionByName, [parent, *(c.select(*parent.columns) for c in children)])


def row_filtered(df: DataFrame, policy: Column) -> DataFrame:
    """Row-level security: the rows that a policy lets a user see."""
    return df.filter(policy)


def reference_ntile(n: int, order: list[Column], keys: list[str]) -> Column:
    """floor(row * n / rows) + 1 by key, which spreads larger tiles over the range; ranks.tiles does a whole table."""
    w = W.partitionBy(*keys)
    return (F.floor((F.row_number().over(w.orderBy(*order)) - 1) * n / F.count("*").over(w)) + 1).cast("int")
