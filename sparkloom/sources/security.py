"""Users, grants and row-level security over snapshot tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.snapshots import SnapshotTable


class Denied(PermissionError):
    """What a user may not do."""


@dataclass(frozen=True)
class Policy:
    """Rows that users may see (USING) and write (WITH CHECK, else USING); for one command or all.

    CURRENT_USER and CURRENT_USER_ID() stand for the user's name.
    """

    name: str
    using: str
    with_check: str | None = None
    command: str = "all"

    def holds(self, command: str) -> bool:
        return self.command.lower() in ("all", command)


def for_user(expression: str, user: str) -> Column:
    literal = "'" + user.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.coalesce(F.expr(re.sub(r"(?i)\bcurrent_user(_id\(\)|\(\))?(?!\w)", lambda _: literal, expression)), F.lit(False))


@dataclass
class SecuredTable:
    """A table as one user meets it.  A row is met if some policy of the command lets it; without policies all are."""

    table: SnapshotTable
    user: str
    policies: list[Policy] = field(default_factory=list)
    grants: set[str] | None = None  # select, insert, update, delete; None: all

    def _allowed(self, command: str) -> None:
        if self.grants is not None and command not in self.grants:
            raise Denied(f"{self.user} may not {command}")

    def _any(self, command: str, check: bool = False) -> Column:
        own = [p for p in self.policies if p.holds(command)]
        if not own:
            return F.lit(not self.policies)
        seen = F.lit(False)
        for p in own:
            seen = seen | for_user((p.with_check or p.using) if check else p.using, self.user)
        return seen

    def read(self) -> DataFrame:
        self._allowed("select")
        return self.table.read().filter(self._any("select"))

    def _checked(self, command: str):
        def check(rows: DataFrame) -> DataFrame:
            if not rows.filter(~self._any(command, check=True)).isEmpty():
                raise Denied(f"a row breaks the policies of {self.table.name} for {self.user}")
            return rows

        return check

    def _with(self, when: str, check, change):
        """Runs a change with the policies' check behind the table's own triggers."""
        self.table.triggers.append((when, check))
        try:
            return change()
        finally:
            self.table.triggers.pop()

    def insert(self, rows: DataFrame) -> DataFrame:
        self._allowed("insert")
        return self._with("before insert", self._checked("insert"), lambda: self.table.insert(rows))

    def update(self, where: str, values: dict[str, str]) -> DataFrame:
        """Changes the rows that the user meets; what becomes of them has to pass the check."""
        self._allowed("update")
        hit = self._any("update") & F.coalesce(F.expr(where), F.lit(False))
        return self._with("before update", self._checked("update"), lambda: self.table.update(hit, values))

    def delete(self, where: str) -> DataFrame:
        self._allowed("delete")
        return self.table.delete(self._any("delete") & F.coalesce(F.expr(where), F.lit(False)))
