"""Tables with updates: changes write new Parquet parts, and a commit is a small file that lists the parts.

Parts are never changed once written, so readers of an old version are not disturbed.  Version n is the file
``_log/n.json`` in the table's folder; it is made only if it is not there, so of two writers one fails and
starts anew, and another process opens the table at its newest version.  What a check refuses is deleted
before it is part of any version.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources import store

Trigger = Callable[[DataFrame | None], DataFrame | None]


class ConstraintError(ValueError):
    """Rows that a constraint does not allow."""


class Signal(ValueError):
    """What a trigger raises to stop a change."""


def signal_if(condition: str, message: str) -> Trigger:
    """A trigger that raises Signal if a row meets the condition, and otherwise leaves the rows as they are."""

    def check(rows: DataFrame) -> DataFrame:
        if not rows.filter(condition).isEmpty():
            raise Signal(message)
        return rows

    return check


@dataclass
class Constraints:
    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[tuple[str, SnapshotTable, str]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)

    def check(self, new: DataFrame, old: DataFrame | None = None) -> None:
        """Raises for the first constraint that new rows break, beside the old ones; nulls pass checks, unique and foreign keys."""
        rules = {f"NOT NULL {c}": F.col(c).isNull() for c in [*self.primary_key, *self.not_null]}
        rules |= {f"CHECK {n}": ~F.expr(e) for n, e in self.checks.items()}
        if rules:
            broken = new.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{i}") for i, bad in enumerate(rules.values()))).first()
            for i, name in enumerate(rules):
                if broken[f"c{i}"]:
                    raise ConstraintError(f"{name}: {broken[f'c{i}']} rows")
        for keys in ([self.primary_key] if self.primary_key else []) + self.unique:
            whole = new.dropna(subset=keys)
            twice = not whole.groupBy(*keys).count().filter("count > 1").isEmpty()
            if twice or (old is not None and not whole.join(old.select(*keys), keys, "left_semi").isEmpty()):
                raise ConstraintError(f"UNIQUE {', '.join(keys)}")
        for column, parent, key in self.foreign_keys:
            known = parent.read().select(F.col(key).alias("_known"))
            if not new.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti").isEmpty():
                raise ConstraintError(f"FOREIGN KEY {column}")

    def altered(self, drop: list[str], rename: dict[str, str]) -> Constraints:
        """The constraints with columns renamed; those that name a dropped column go."""
        name = lambda c: rename.get(c, c)
        gone = set(drop)
        word = lambda e: re.sub(r"\w+", lambda m: name(m[0]), e)
        names = lambda e: set(re.findall(r"\w+", e))
        return Constraints(
            [] if gone & set(self.primary_key) else [name(c) for c in self.primary_key],
            [name(c) for c in self.not_null if c not in gone],
            [[name(c) for c in keys] for keys in self.unique if not gone & set(keys)],
            {n: word(e) for n, e in self.checks.items() if not gone & names(e)},
            [(name(c), t, k) for c, t, k in self.foreign_keys if c not in gone],
            {name(c): e for c, e in self.defaults.items() if c not in gone},
            {name(c): word(e) for c, e in self.generated.items() if c not in gone and not gone & names(e)},
        )


class SnapshotTable:
    """Insert, upsert, update, delete, savepoints, triggers and change data over versions."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str, constraints: Constraints | None = None):
        """A new table, or an old one at its newest version if the folder has one of that name."""
        self.spark, self.folder, self.name = spark, f"{folder}/{name}", name
        self.constraints = constraints or Constraints()
        self.triggers: list[tuple[str, Trigger]] = []
        self.cdc = False
        self.versions = [json.loads(store.get_text(spark, f"{self.folder}/_log/{n}")) for n in store.names(spark, f"{self.folder}/_log") if n.endswith(".json")]
        if not self.versions:
            self._log([], spark.createDataFrame([], schema).schema)

    # Versions and parts

    def read(self, version: int = -1) -> DataFrame:
        v = self.versions[version]
        schema = StructType.fromJson(v["schema"])
        return self.spark.read.schema(schema).parquet(*v["parts"]) if v["parts"] else self.spark.createDataFrame([], schema)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.versions[-1]["schema"])

    def _part(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Writes rows as a part that no version has yet; its path and what was written."""
        path = f"{self.folder}/part-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path, self.spark.read.schema(rows.schema).parquet(path)

    def _log(self, parts: list[str], schema: StructType | None = None, **more) -> None:
        number = self.versions[-1]["number"] + 1 if self.versions else 0
        entry = {"number": number, "parts": parts, "schema": (schema or self.schema).jsonValue()} | more
        store.put_text(self.spark, f"{self.folder}/_log/{number:012d}.json", json.dumps(entry))
        self.versions.append(entry)

    @contextlib.contextmanager
    def _staged(self) -> Iterator[list[str]]:
        """Paths put in the list are deleted if the change fails."""
        staged: list[str] = []
        try:
            yield staged
        except BaseException:
            for path in staged:
                store.delete(self.spark, path)
            raise

    # Triggers

    def on(self, when: str, change: Trigger) -> None:
        """A trigger "before|after insert|update|delete", optionally followed by "statement".

        Before triggers get the rows that the change is about and give the rows to use instead (of a delete: the rows
        to delete); they may raise Signal.  After triggers get the rows as written or deleted.  Statement triggers
        run once a change and get no rows.
        """
        if not re.fullmatch(r"(before|after) (insert|update|delete)( statement)?", when):
            raise ValueError(when)
        self.triggers.append((when, change))

    def _fire(self, when: str, rows: DataFrame) -> DataFrame:
        for own, change in self.triggers:
            if own == f"{when} statement":
                change(None)
            elif own == when:
                changed = change(rows)
                rows = rows if changed is None or when.startswith("after") else changed
        return rows

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))

    def _prepared(self, rows: DataFrame) -> DataFrame:
        c = self.constraints
        for f in self.schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.expr(c.defaults[f.name]) if f.name in c.defaults else F.lit(None).cast(f.dataType))
        for name, expression in c.generated.items():
            rows = rows.withColumn(name, F.expr(expression))
        return self._typed(self._fire("before insert", rows))

    # Changes

    def insert(self, rows: DataFrame) -> DataFrame:
        """Adds rows as a new part; returns them as written (RETURNING)."""
        with self._staged() as staged:
            path, new = self._part(self._prepared(rows))
            staged.append(path)
            self.constraints.check(new, self.read())
            self._commit([*self.versions[-1]["parts"], path], new=new)
        self._fire("after insert", new)
        return new

    def upsert(self, rows: DataFrame, keys: list[str], ignore: bool = False) -> DataFrame:
        """Rows of known keys replace the old ones, or are left out with ignore; returns the rows as written.

        Two new rows of one key are an error, as neither is the later one.
        """
        with self._staged() as staged:
            old = self.read()
            new = self._prepared(rows)
            path, new = self._part(new.join(old.select(*keys), keys, "left_anti").select(*old.columns) if ignore else new)
            staged.append(path)
            if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ConstraintError(f"two new rows of one {', '.join(keys)}")
            if ignore:
                self.constraints.check(new, old)
                self._commit([*self.versions[-1]["parts"], path], new=new)
            else:
                kept, rest = self._part(old.join(new.select(*keys), keys, "left_anti").select(*old.columns))
                staged.append(kept)
                self.constraints.check(new, rest)
                self._commit([kept, path], old=old.join(new.select(*keys), keys, "left_semi").select(*old.columns), new=new)
        self._fire("after insert", new)
        return new

    def update(self, where: str | Column, values: dict[str, str]) -> DataFrame:
        """Changes rows; returns the changed ones as written (RETURNING)."""
        hit = self._hit(where)
        with self._staged() as staged:
            old = self.read()
            changed = old.filter(hit).withColumns({c: F.expr(e) for c, e in values.items()})
            for name, expression in self.constraints.generated.items():
                changed = changed.withColumn(name, F.expr(expression))
            path, new = self._part(self._typed(self._fire("before update", changed)))
            kept, rest = self._part(old.filter(~hit))
            staged += [path, kept]
            self.constraints.check(new, rest)
            self._commit([kept, path], old=old.filter(hit), new=new)
        self._fire("after update", new)
        return new

    def delete(self, where: str | Column) -> DataFrame:
        """Deletes rows; returns them (RETURNING)."""
        with self._staged() as staged:
            old = self.read()
            gone = old.filter(self._hit(where))
            if any(own == "before delete" for own, _ in self.triggers):
                path, gone = self._part(self._typed(self._fire("before delete", gone)))
                staged.append(path)
                same = [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in old.columns]
                left = old.alias("o").join(gone.alias("g"), same, "left_anti")
            else:
                self._fire("before delete", gone)
                left = old.filter(~self._hit(where))
            kept, _ = self._part(left)
            staged.append(kept)
            self._commit([kept], old=gone)
        self._fire("after delete", gone)
        return gone

    @staticmethod
    def _hit(where: str | Column) -> Column:
        return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))

    def truncate(self) -> None:
        self._commit([], old=self.read())

    def cascade_from(self, parent: SnapshotTable, column: str, key: str, set_null: bool = False) -> None:
        """Follows a delete in the parent: rows whose parent is gone go too, or lose their reference."""
        kept = parent.read().select(F.col(key).alias("_k"))
        old = self.read()
        gone = old.filter(F.col(column).isNotNull()).join(kept, F.col(column) == F.col("_k"), "left_anti")
        rest = old.join(kept, F.col(column) == F.col("_k"), "left_semi").unionByName(old.filter(F.col(column).isNull()))
        with self._staged() as staged:
            path, _ = self._part(rest)
            staged.append(path)
            changed, new = self._part(gone.withColumn(column, F.lit(None).cast(old.schema[column].dataType)) if set_null else gone.limit(0))
            staged.append(changed)
            self._commit([path, changed], old=gone, new=new)

    def alter(self, add: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> None:
        """Adds columns (name: type, filled with null), drops and renames columns; constraints follow."""
        new = self.read().drop(*(drop or []))
        for name, kind in (add or {}).items():
            new = new.withColumn(name, F.lit(None).cast(kind))
        path, new = self._part(new.withColumnsRenamed(rename or {}))
        self.constraints = self.constraints.altered(drop or [], rename or {})
        self._log([path], new.schema)

    # Transactions

    def savepoint(self, name: str) -> None:
        """Names the newest version; the name stays with the table."""
        store.delete(self.spark, f"{self.folder}/_savepoints/{name}")
        store.put_text(self.spark, f"{self.folder}/_savepoints/{name}", str(self.versions[-1]["number"]))

    def rollback(self, to: str | None = None) -> None:
        """Back to a savepoint, or by one version: a new version with the old parts, so readers see no gap."""
        number = int(store.get_text(self.spark, f"{self.folder}/_savepoints/{to}")) if to else self.versions[max(0, len(self.versions) - 2)]["number"]
        back = next(v for v in self.versions if v["number"] == number)
        self._log(back["parts"], StructType.fromJson(back["schema"]))

    @contextlib.contextmanager
    def transaction(self) -> Iterator[SnapshotTable]:
        """All changes inside, or none: an error inside takes the table back to where it was, and is raised."""
        began = self.versions[-1]
        try:
            yield self
        except BaseException:
            if self.versions[-1] is not began:
                self._log(began["parts"], StructType.fromJson(began["schema"]))
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all but the newest versions and deletes parts that none of these has; returns how many versions went."""
        gone, self.versions = self.versions[:-keep], self.versions[-keep:]
        used = {p for v in self.versions for p in v["parts"]}
        for v in gone:
            store.delete(self.spark, f"{self.folder}/_log/{v['number']:012d}.json")
        for path in {p for v in gone for p in v["parts"]} - used:
            store.delete(self.spark, path)
        store.delete(self.spark, f"{self.folder}/_savepoints")
        return len(gone)

    # Change data

    def enable_cdc(self) -> None:
        """From now on every change is logged; see change_log."""
        self.cdc = True

    def _commit(self, parts: list[str], old: DataFrame | None = None, new: DataFrame | None = None) -> None:
        """Makes a version; old are the rows that are gone or changed, new those that are there instead."""
        if not self.cdc:
            return self._log(parts)
        number, keys = self.versions[-1]["number"] + 1, self.constraints.primary_key
        text = lambda df, name: df.select(*keys, F.to_json(F.struct(*df.columns)).alias(name))
        empty = self.read().limit(0)
        a, b = text(empty if old is None else old, "old_data"), text(empty if new is None else new, "new_data")
        if keys:
            rows = a.join(b, keys, "full").select("old_data", "new_data")
        else:
            rows = a.withColumn("new_data", F.lit(None).cast("string")).unionByName(b.withColumn("old_data", F.lit(None).cast("string")))
        op = F.when(F.col("old_data").isNull(), "I").when(F.col("new_data").isNull(), "D").otherwise("U")
        # Numbers rise from commit to commit; within one they tell rows apart.
        seq = F.lit(number).cast("long") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40)
        changes = f"{self.folder}/_changes/part-{uuid.uuid4().hex}"
        rows.select(op.alias("op"), seq.alias("seq"), F.lit(self.name).alias("table"), "old_data", "new_data", F.current_timestamp().alias("ts")).write.parquet(changes)
        self._log(parts, changes=changes)

    def change_log(self, after: int = -1) -> DataFrame:
        """(op, seq, table, old_data, new_data, ts) of the logged changes with a sequence number above ``after``."""
        listed = [v["changes"] for v in self.versions if v.get("changes")]
        schema = "op string, seq long, table string, old_data string, new_data string, ts timestamp"
        found = self.spark.read.schema(schema).parquet(*listed) if listed else self.spark.createDataFrame([], schema)
        return found.filter(F.col("seq") > after)

    def changes(self, since: int, keys: list[str]) -> DataFrame:
        """Change data from version ``since`` to the newest: (op, keys, old_data, new_data); op is I, U or D."""
        return diff(self.read(since), self.read(), keys)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(op, keys, old_data, new_data as JSON) of the rows that differ, by one full outer join."""
    a = old.select(*keys, F.to_json(F.struct(*old.columns)).alias("old_data"))
    b = new.select(*keys, F.to_json(F.struct(*new.columns)).alias("new_data"))
    op = F.when(F.col("old_data").isNull(), "I").when(F.col("new_data").isNull(), "D").when(F.col("old_data") != F.col("new_data"), "U")
    return a.join(b, keys, "full").withColumn("op", op).filter("op is not null").select("op", *keys, "old_data", "new_data")
