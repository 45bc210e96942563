"""Catalog tables: information_schema and pg_catalog over what a session has and what is registered here.

Tables and views come from ``spark.catalog``, so a table created anywhere in the session is listed; indexes,
triggers, routines, partitions, events and privileges are what their owners have registered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and columns of the catalog tables, and the listed types and functions.
INFORMATION = {
    "tables": "TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, TABLE_ROWS long",
    "columns": "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, IS_NULLABLE string, COLUMN_KEY string, EXTRA string",
    "statistics": "TABLE_SCHEMA string, TABLE_NAME string, INDEX_NAME string, COLUMN_NAME string, NON_UNIQUE int, INDEX_TYPE string",
    "views": "TABLE_SCHEMA string, VIEW_NAME string, VIEW_DEFINITION string",
    "triggers": "TRIGGER_SCHEMA string, TRIGGER_NAME string, EVENT_MANIPULATION string, EVENT_OBJECT_TABLE string, ACTION_TIMING string, ACTION_STATEMENT string",
    "routines": "ROUTINE_SCHEMA string, ROUTINE_NAME string, ROUTINE_TYPE string, ROUTINE_DEFINITION string",
    "schemata": "SCHEMA_NAME string, DEFAULT_CHARACTER_SET_NAME string",
    "partitions": "TABLE_SCHEMA string, TABLE_NAME string, PARTITION_NAME string, PARTITION_METHOD string, PARTITION_EXPRESSION string, TABLE_ROWS long",
    "events": "EVENT_SCHEMA string, EVENT_NAME string, EVENT_DEFINITION string, INTERVAL_VALUE string, STATUS string",
    "user_privileges": "GRANTEE string, TABLE_NAME string, PRIVILEGE_TYPE string",
}
PG = {
    "pg_tables": "schemaname string, tablename string, tableowner string, hasindexes string",
    "pg_class": "relname string, relkind string, reltuples long",
    "pg_attribute": "attrelid string, attname string, atttypid string, attnum int, attnotnull string",
    "pg_index": "indrelid string, indexrelid string, indisunique string, indisprimary string",
    "pg_user": "usename string, usecreatedb string, usesysid string",
    "pg_database": "datname string, datdba string, encoding string",
    "pg_namespace": "nspname string, nspowner string",
    "pg_type": "typname string, typtype string, typlen string",
    "pg_proc": "proname string, pronamespace string, pronargs string, prorettype string",
}
TYPES = [("int", "4"), ("int4", "4"), ("int8", "8"), ("int2", "2"), ("text", "-1"), ("real", "4"), ("float4", "4"), ("float8", "8"), ("bool", "1"), ("date", "4"), ("json", "-1")]
OWNER, SCHEMA, CHARSET = "root", "public", "UTF8"


@dataclass
class Catalog:
    """What is registered beside the session's own tables; rows are tuples in the order of the tables above, without schema."""

    spark: SparkSession
    keys: dict[str, list[str]] = field(default_factory=dict)  # table: primary key
    indexes: list[tuple[str, str, str, bool]] = field(default_factory=list)  # table, index, column, unique
    triggers: list[tuple[str, str, str, str, str]] = field(default_factory=list)  # name, event, table, timing, body
    routines: list[tuple[str, str, str]] = field(default_factory=list)  # name, type, body
    partitions: list[tuple[str, str, str, str]] = field(default_factory=list)  # table, partition, method, expression
    events: list[tuple[str, str, str, str]] = field(default_factory=list)  # name, SQL, interval, status
    grants: list[tuple[str, str, str]] = field(default_factory=list)  # user, table, privilege
    views: dict[str, str] = field(default_factory=dict)  # view: SQL

    def _names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def _counted(self, rows: list[tuple], schema: str, name_at: int) -> DataFrame:
        """Rows with the number of rows of their table: one count a table, all in one query."""
        counts = [self.spark.table(n).agg(F.lit(n).alias("n"), F.count("*").alias("c")) for n in sorted({r[name_at] for r in rows})]
        plain = self.spark.createDataFrame(rows, ", ".join(schema.split(", ")[:-1]))
        if not counts:
            return plain.withColumn(schema.split(", ")[-1].split()[0], F.lit(None).cast("long"))
        name, total = plain.columns[name_at], schema.split(", ")[-1].split()[0]
        found = reduce(DataFrame.unionByName, counts)
        return plain.join(F.broadcast(found), F.col(name) == F.col("n"), "left").withColumn(total, F.col("c")).select(*plain.columns, total)

    def information_schema(self, name: str) -> DataFrame:
        schema = INFORMATION[name]
        if name == "tables":
            kind = lambda t: "VIEW" if t in self.views else "BASE TABLE"
            return self._counted([(SCHEMA, t, kind(t)) for t in self._names()], schema, 1)
        if name == "partitions":
            return self._counted([(SCHEMA, *p) for p in self.partitions], schema, 1)
        rows = {
            "columns": lambda: [(SCHEMA, t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO", "PRI" if f.name in self.keys.get(t, []) else "", "") for t in self._names() for i, f in enumerate(self.spark.table(t).schema.fields, 1)],
            "statistics": lambda: [(SCHEMA, t, "PRIMARY", c, 0, "BTREE") for t, k in self.keys.items() for c in k] + [(SCHEMA, t, i, c, int(not u), "BTREE") for t, i, c, u in self.indexes],
            "views": lambda: [(SCHEMA, v, sql) for v, sql in self.views.items()],
            "triggers": lambda: [(SCHEMA, *t) for t in self.triggers],
            "routines": lambda: [(SCHEMA, *r) for r in self.routines],
            "schemata": lambda: [(d.name, CHARSET) for d in self.spark.catalog.listDatabases()],
            "events": lambda: [(SCHEMA, *e) for e in self.events],
            "user_privileges": lambda: list(self.grants),
        }[name]()
        return self.spark.createDataFrame(rows, schema)

    def pg_catalog(self, name: str) -> DataFrame:
        schema, flag = PG[name], lambda x: "t" if x else "f"
        if name == "pg_class":
            return self._counted([(t, "v" if t in self.views else "r") for t in self._names()], schema, 0)
        indexed = {t for t, *_ in self.indexes} | set(self.keys)
        rows = {
            "pg_tables": lambda: [(SCHEMA, t, OWNER, flag(t in indexed)) for t in self._names() if t not in self.views],
            "pg_attribute": lambda: [(t, f.name, f.dataType.simpleString(), i, flag(not f.nullable)) for t in self._names() for i, f in enumerate(self.spark.table(t).schema.fields, 1)],
            "pg_index": lambda: [(t, f"{t}_pkey", "t", "t") for t in self.keys] + [(t, i, flag(u), "f") for t, i, _, u in self.indexes],
            "pg_user": lambda: [(u, flag(u == OWNER), str(10 + n)) for n, u in enumerate(sorted({OWNER, *(g[0] for g in self.grants)}, key=lambda x: (x != OWNER, x)))],
            "pg_database": lambda: [(d.name, OWNER, CHARSET) for d in self.spark.catalog.listDatabases()],
            "pg_namespace": lambda: [(n, OWNER) for n in sorted({SCHEMA, "pg_catalog", "information_schema"})],
            "pg_type": lambda: [(t, "b", size) for t, size in TYPES],
            "pg_proc": lambda: [(r, SCHEMA, None, None) for r, *_ in self.routines],
        }[name]()
        return self.spark.createDataFrame(rows, schema)
