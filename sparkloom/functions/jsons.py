"""JSON text functions as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# How the schema of a variant begins, and the type that it is called here.
KINDS = {"OBJECT": "OBJECT", "ARRAY": "ARRAY", "STRING": "STRING", "BIGINT": "INTEGER", "DECIMAL": "DOUBLE", "DOUBLE": "DOUBLE", "FLOAT": "DOUBLE", "BOOLEAN": "BOOLEAN", "VOID": "NULL"}


def json_type(j: Column) -> Column:
    """OBJECT, ARRAY, STRING, INTEGER, DOUBLE, BOOLEAN or NULL; null for text that is no JSON.

    The text is parsed once: the front of its schema is looked up in a constant map.
    """
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(F.try_parse_json(j)), "^[A-Z]+", 0))


def json_valid(j: Column) -> Column:
    return F.try_parse_json(j).isNotNull()


def json_length(j: Column) -> Column:
    """Keys of an object, items of an array, characters of a string, else 1; null for text that is no JSON."""
    front = F.left(F.ltrim(j), F.lit(1))
    size = F.when(front == "{", F.size(F.json_object_keys(j))).when(front == "[", F.json_array_length(j)).when(front == '"', F.length(F.get_json_object(j, "$"))).otherwise(F.lit(1))
    return F.when(json_valid(j), size)


def json_set(j: Column, path: str, value: str) -> Column:
    """JSON text with the value at a path ($.key, $.key.inner, $.list[2]) set; other values keep their types.

    value is JSON text, or a plain string if it is no JSON.  Keys come out sorted.  The text stays as it is if it is no
    JSON, or if the way to the last step is not there; that step may add a key, but no array item.
    """
    steps = [int(i) if i else k for k, i in re.findall(r"\.([^.\[]+)|\[(\d+)\]", path)]
    try:
        new = F.parse_json(F.lit(json.dumps(json.loads(value))))
    except ValueError:
        new = F.parse_json(F.lit(json.dumps(value)))
    return F.coalesce(F.to_json(_put(F.try_parse_json(j), steps, new)), j)


def _put(at: Column, steps: list[str | int], new: Column) -> Column:
    """The variant ``at`` with the place that steps lead to replaced."""
    if not steps:
        return new
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        items = F.try_variant_get(at, "$", "array<variant>")
        changed = F.to_variant_object(F.transform(items, lambda x, i: F.when(i == step, _put(x, rest, new)).otherwise(x)))
        return F.when(items.isNotNull(), changed).otherwise(at)
    entries = F.try_variant_get(at, "$", "map<string,variant>")
    others = F.map_filter(entries, lambda k, _: k != F.lit(step))
    changed = F.to_variant_object(F.map_concat(others, F.create_map(F.lit(step), _put(F.try_element_at(entries, F.lit(step)), rest, new))))
    there = entries.isNotNull() & (F.lit(True) if not rest else F.map_contains_key(entries, step))
    return F.when(there, changed).otherwise(at)


def json_contains(j: Column, value: str, path: str | None = None) -> Column:
    """Whether the JSON (at a path) is the value, or an array that holds it; the value is JSON text of a scalar."""
    at = F.get_json_object(j, path) if path else j
    plain = value.strip('"')
    return F.coalesce((at == plain) | (at == value) | F.array_contains(F.from_json(at, "array<string>"), plain), F.lit(False))
