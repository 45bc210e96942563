"""Row numbers and ranks over a whole table, and cursors on them, without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.storage import materialised

INSIDE = (1 << 33) - 1  # the lower bits of monotonically_increasing_id count rows within a partition


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """df with row numbers from 1 in a total order: rows are dealt out by ranges and numbered there, and each
    range starts behind the sizes of those before it.  Only sizes, a row a partition, meet in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialised(dealt).withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(INSIDE)) + 1).select(*df.columns, name)


def ranked(df: DataFrame, order: list[Column], by: list[str], name: str = "rank") -> DataFrame:
    """df with RANK() over the whole table; ``by`` are the columns of the order, rows of equal ones share a rank."""
    rows = numbered(df, order, "_row")
    first = rows.groupBy(*by).agg(F.min("_row").alias(name))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    return rows.alias("r").join(first.alias("f"), same).select(*(F.col(f"r.{c}") for c in df.columns), F.col(f"f.{name}"))


def tiles(df: DataFrame, n: int, order: list[Column], name: str = "tile") -> DataFrame:
    """df with floor((row - 1) * n / rows) + 1 over the whole table."""
    total = df.agg(F.count("*").alias("_total"))
    rows = numbered(df, order, "_row").crossJoin(F.broadcast(total))  # a row
    return rows.withColumn(name, (F.floor((F.col("_row") - 1) * n / F.col("_total")) + 1).cast("int")).select(*df.columns, name)


class Cursor:
    """A server-side cursor: rows in a fixed order, fetched from where it stands.  Before the first row it stands at 0."""

    def __init__(self, df: DataFrame, order: list[Column]):
        self.columns = df.columns
        self.rows = materialised(numbered(df, order, "_cursor"))
        self.size, self.at = self.rows.count(), 0

    def _page(self, first: int, n: int) -> DataFrame:
        return self.rows.filter(F.col("_cursor").between(first, first + n - 1)).orderBy("_cursor").select(*self.columns)

    def _to(self, at: int) -> DataFrame:
        self.at = min(max(at, 0), self.size + 1)
        return self._page(self.at, 1)

    def next(self, n: int = 1) -> DataFrame:
        """FETCH [FORWARD n]: the n rows behind; the cursor then stands at the last of them."""
        page, self.at = self._page(self.at + 1, n), min(self.at + n, self.size + 1)
        return page

    def prior(self) -> DataFrame:
        return self._to(self.at - 1)

    def first(self) -> DataFrame:
        return self._to(1)

    def last(self) -> DataFrame:
        return self._to(self.size)

    def absolute(self, n: int) -> DataFrame:
        """Row n; a negative n counts from the end."""
        return self._to(n if n >= 0 else self.size + 1 + n)

    def relative(self, n: int) -> DataFrame:
        return self._to(self.at + n)
