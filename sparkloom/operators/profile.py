"""Column statistics in one pass over a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """A row a column: row_count, null_frac, ndv, min and max as text, avg_width in characters.

    One aggregate over the table, a buffer a task; a column's distinct values are shuffled only for an exact ndv.
    """
    text = {c: F.col(c).cast("string") for c in columns}
    facts = {
        "row_count": lambda v: F.count("*"),
        "null_frac": lambda v: F.round(F.avg(v.isNull().cast("int")), 6),
        "ndv": lambda v: F.approx_count_distinct(v),
        "min_value": F.min,
        "max_value": F.max,
        "avg_width": lambda v: F.round(F.avg(F.length(v)), 6),
    }
    if exact:
        facts.pop("ndv")
    wide = df.agg(*(fact(v).alias(f"{i}_{name}") for i, v in enumerate(text.values()) for name, fact in facts.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{i}_{name}").alias(name) for name in facts)) for i, c in enumerate(columns)))
    found = wide.select(F.inline(rows))
    if exact:
        values = reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("column_name"), v.alias("v")).distinct() for c, v in text.items()))
        found = found.join(values.groupBy("column_name").agg(F.count("v").alias("ndv")), "column_name", "left").fillna(0, ["ndv"])
    return found.select("column_name", "row_count", "null_frac", "ndv", "min_value", "max_value", "avg_width")


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def equi_depth(df: DataFrame, column: str, buckets: int = 10, accuracy: int = 10_000) -> DataFrame:
    """(bounds) as an array of quantiles, off by 1 / accuracy of the rows at most: exact for fewer rows than that."""
    return df.agg(F.percentile_approx(column, [i / buckets for i in range(buckets + 1)], accuracy).alias("bounds"))
