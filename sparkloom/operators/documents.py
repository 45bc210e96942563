"""A document store over JSON text: (_id, json)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(field: str, op: str, value: str | float) -> Column:
    got = F.get_json_object("json", f"$.{field}")
    if op.upper() == "CONTAINS":
        return F.contains(got, F.lit(str(value)))
    if isinstance(value, (int, float)):
        got = got.try_cast("double")
    return {"=": got == value, "!=": got != value, ">": got > value, ">=": got >= value, "<": got < value, "<=": got <= value}[op]


def find(docs: DataFrame, field: str, op: str, value: str | float) -> DataFrame:
    return docs.filter(condition(field, op, value))


def inject_id(json: Column, number: Column) -> Column:
    """JSON text with the id as its first field, a number; text that has one, or is no object, stays as it is."""
    has = F.contains(json, F.lit('"_id"')) | ~F.contains(json, F.lit("{"))
    field = F.concat(F.lit('{"_id":'), number.cast("string"), F.when(F.rlike(json, F.lit(r"^[^{]*\{\s*\}")), "").otherwise(", "))
    return F.when(has, json).otherwise(F.concat(F.substring_index(json, "{", 1), field, F.substring(json, F.instr(json, "{") + 1, F.length(json))))


def with_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(_id, json) with the id put into each document; all other fields keep their types."""
    return docs.select(F.col(id_col).alias("_id"), inject_id(F.col("json"), F.col(id_col)).alias("json"))


def replace(docs: DataFrame, where: Column, json: str) -> DataFrame:
    """(_id, json) with the documents that a filter meets replaced; each keeps its id."""
    return docs.withColumn("json", F.when(F.coalesce(where, F.lit(False)), inject_id(F.lit(json), F.col("_id"))).otherwise(F.col("json")))


def delete(docs: DataFrame, where: Column) -> DataFrame:
    return docs.filter(~F.coalesce(where, F.lit(False)))
