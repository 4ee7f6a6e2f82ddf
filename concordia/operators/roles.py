"""Roles and what each may do: views that hold a principal's rows and columns alone, and writers that check the same rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "*"
# The two owners can't log in; the serving and the ingest role may read, insert, and update a few columns.
LOGIN = ("app", "ingest")
ROLES = ("core_owner", "audit_owner", *LOGIN)
GRANTS = {
    "document": {"select": (ALL,), "insert": (ALL,), "update": ("access_restricted", "data_vintage")},
    "chunk": {"select": (ALL,), "insert": (ALL,), "update": (ALL,), "delete": (ALL,)},
    "claim": {"select": (ALL,), "insert": (ALL,)},
    "conflict": {"select": (ALL,), "insert": (ALL,), "update": ("status", "lease_owner", "lease_expires_at", "reopen_count")},
    "conflict_candidate": {"select": (ALL,), "insert": (ALL,)},
    "resolution": {"select": (ALL,), "insert": (ALL,)},
    "event": {"select": (ALL,), "insert": (ALL,)},
    "job": {"select": (ALL,), "insert": (ALL,), "update": ("status", "attempt", "next_attempt_at", "lease_owner", "lease_expires_at", "last_error")},
}
#: Tables whose rows carry access_restricted: these rows are hidden from all but entitled principals, in reads and updates alike.
CONFIDENTIAL = ("document", "chunk")


@dataclass(frozen=True)
class Session:
    """Who acts: a role that can log in, and whether restricted rows are allowed, which nothing but True says."""

    role: str
    allow_restricted: bool | None = None

    def __post_init__(self):
        if self.role not in ROLES:
            raise ValueError(f"no role {self.role}")
        if self.role not in LOGIN:
            raise PermissionError(f"{self.role} can't log in")

    @property
    def entitled(self) -> bool:
        return self.allow_restricted is True or self.role == "ingest"


class Catalogue:
    """Tables by name, read and changed through a session alone. columns narrows what a role may select of a table."""

    def __init__(self, tables: dict[str, DataFrame], columns: dict[tuple[str, str], tuple[str, ...]] | None = None):
        self.tables, self.columns = tables, columns or {}

    def _granted(self, session: Session, table: str, command: str) -> tuple[str, ...]:
        columns = GRANTS.get(table, {}).get(command)
        if columns is None:
            raise PermissionError(f"{session.role} may not {command} {table}")
        return columns

    def _rows(self, session: Session, table: str) -> DataFrame:
        df = self.tables[table]
        if table not in CONFIDENTIAL or session.entitled:
            return df
        return df.where(~F.coalesce(F.col("access_restricted"), F.lit(True)))  # a null flag is restricted

    def view(self, session: Session, table: str) -> DataFrame:
        """The rows and columns of a table that the session may read; the filter stands before whatever is done to them."""
        self._granted(session, table, "select")
        df = self._rows(session, table)
        own = self.columns.get((session.role, table))
        return df if own is None else df.select(*[c for c in df.columns if c in own])

    def insert(self, session: Session, table: str, rows: DataFrame) -> DataFrame:
        """The table with rows added; rows must have its columns."""
        self._granted(session, table, "insert")
        if set(rows.columns) != set(self.tables[table].columns):
            raise ValueError("an insert needs the table's columns")
        return self.tables[table].unionByName(rows)

    def update(self, session: Session, table: str, changes: DataFrame, key: str) -> DataFrame:
        """The table with the columns of changes (key and the columns to set) put in; rows that the session can't see stay.

        PermissionError where a column isn't granted. Keys of changes must be distinct.
        """
        granted, set_ = self._granted(session, table, "update"), [c for c in changes.columns if c != key]
        refused = [c for c in set_ if ALL not in granted and c not in granted]
        if refused:
            raise PermissionError(f"{session.role} may not update {', '.join(refused)} of {table}")
        new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in set_])
        df = self.tables[table]
        seen = F.lit(True) if table not in CONFIDENTIAL or session.entitled else ~F.coalesce(F.col("access_restricted"), F.lit(True))
        put = {c: F.when(F.col("__key").isNotNull() & F.col("__seen"), F.col(f"__{c}")).otherwise(F.col(c)) for c in set_}
        return df.withColumn("__seen", seen).join(new, F.col(key) == F.col("__key"), "left").withColumns(put).select(*df.columns)

    def delete(self, session: Session, table: str, keys: DataFrame, key: str) -> DataFrame:
        """The table without the rows of keys that the session may see."""
        self._granted(session, table, "delete")
        gone = self._rows(session, table).join(keys.select(key), key, "left_semi").select(F.col(key).alias("__gone"))
        return self.tables[table].join(gone, F.col(key) == F.col("__gone"), "left_anti")


def rights() -> list[tuple[str, str, str, str]]:
    """role, table, command, column of every grant; owners have none, as they never act."""
    return [(role, table, command, column) for role in LOGIN for table, commands in GRANTS.items() for command, columns in commands.items() for column in columns]
