"""Sources and sinks: delimited files, partitioned and foreign tables, federations, views, snapshots."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, path: str, schema: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """Typed rows of a delimited file; without sep, the likeliest of , ; tab and | in its first line."""
    if sep is None:
        first = spark.read.text(path).head()
        sep = max(",;\t|", key=(first[0] if first else "").count)
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def export_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, compression: str = "none") -> str:
    df.write.csv(path, sep=sep, header=header, mode="overwrite", compression=compression)
    return path


def copy_to(df: DataFrame, path: str, kind: str = "csv", **options: str) -> str:
    """CSV or BINARY (Parquet)."""
    if kind.lower() == "binary":
        df.write.mode("overwrite").parquet(path)
        return path
    return export_csv(df, path, options.get("delimiter", ","), options.get("header", True) not in (False, "false"))


def foreign_csv(spark: SparkSession, path: str, columns: dict[str, str], delimiter: str = ",") -> DataFrame:
    """A foreign table: columns by header name, missing ones null."""
    raw = spark.read.csv(path, header=True, sep=delimiter)
    return raw.select(*((F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def foreign_json(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """A file of JSON objects, one a line or all in an array."""
    return spark.read.schema(schema).json(path, multiLine=array)


def federated(*parts: DataFrame) -> DataFrame:
    """One table over several sources of equal columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def range_partition(value: Column, bounds: list[tuple[str, object]]) -> Column:
    """Name of the first partition whose bound is above value (None: no bound)."""
    name = F.lit(None).cast("string")
    for part, less_than in reversed(bounds):
        name = F.lit(part) if less_than is None else F.when(value < F.lit(less_than), part).otherwise(name)
    return name


def list_partition(value: Column, lists: dict[str, list]) -> Column:
    name = F.lit(None).cast("string")
    for part, values in lists.items():
        name = F.when(value.isin(values), part).otherwise(name)
    return name


def hash_partition(value: Column, n: int) -> Column:
    return F.concat(F.lit("p"), F.pmod(value, F.lit(n)).cast("string"))


def write_partitioned(df: DataFrame, path: str, partition: Column, name: str = "part") -> str:
    """Parquet with a folder a partition, which later filters on its column prune."""
    df.withColumn(name, partition).repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)
    return path


def materialized_view(spark: SparkSession, name: str, query: str, folder: str) -> DataFrame:
    """Runs a query into a new Parquet folder and points a view at it; call again to refresh."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    spark.sql(query).write.parquet(path)
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def backup(tables: dict[str, DataFrame], folder: str) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
