"""Packages of functions that a session loads by name; what Spark has built in needs no loading.

Each function is SQL over built-in ones, so the optimizer sees through it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

HEX = "lpad(lower(hex({0})), {1}, '0')"
# 100-nanosecond steps since 1582-10-15, as version 1 counts time.
TICKS = "(unix_micros(current_timestamp()) + 12219292800000000) * 10"
UUID_V1 = "concat_ws('-', " + ", ".join((
    HEX.format(f"({TICKS}) & 4294967295", 8),
    HEX.format(f"shiftright({TICKS}, 32) & 65535", 4),
    HEX.format(f"shiftright({TICKS}, 48) & 4095 | 4096", 4),
    HEX.format("CAST(rand() * 16384 AS BIGINT) | 32768", 4),
    HEX.format("CAST(rand() * 281474976710656 AS BIGINT) | 1099511627776", 12),
)) + ")"
VALID = "x RLIKE '^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'"
TRIGRAMS = "CASE WHEN length({0}) > 0 THEN transform(sequence(1, length({0})), i -> substring(concat(' ', {0}, ' '), i, 3)) ELSE array() END"
PACKAGES = {
    "math": {"log_natural(x DOUBLE) RETURNS DOUBLE": "ln(x)", "safe_mod(x BIGINT, y BIGINT) RETURNS BIGINT": "try_mod(x, y)"},
    "crypto": {"sha256(x STRING) RETURNS STRING": "sha2(x, 256)", "encode_base64(x STRING) RETURNS STRING": "base64(CAST(x AS BINARY))", "decode_base64(x STRING) RETURNS STRING": "CAST(unbase64(x) AS STRING)"},
    "uuid": {"gen_random_uuid() RETURNS STRING": "uuid()", "uuid_generate_v1() RETURNS STRING": UUID_V1, "is_valid_uuid(x STRING) RETURNS BOOLEAN": f"coalesce({VALID}, false)"},
    "text": {"shared_trigrams(x STRING, y STRING) RETURNS INT": f"size(array_intersect({TRIGRAMS.format('x')}, {TRIGRAMS.format('y')}))"},
    "vector": {
        "vector_dims(x ARRAY<DOUBLE>) RETURNS INT": "size(x)",
        "vector_norm(x ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(x, 0D, (a, e) -> a + e * e))",
        "inner_product(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, e) -> s + e)",
    },
}


def _names(package: str) -> list[str]:
    return sorted(head.split("(")[0] for head in PACKAGES[package])


def load(spark: SparkSession, package: str) -> list[str]:
    """Makes a package's functions callable in SQL; their names."""
    for head, body in PACKAGES[package].items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return _names(package)


def drop(spark: SparkSession, package: str) -> None:
    for name in _names(package):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def loaded(spark: SparkSession) -> list[str]:
    """Packages whose functions are all there."""
    return [p for p in sorted(PACKAGES) if all(spark.catalog.functionExists(n) for n in _names(p))]
