"""Definitions of tables: declared, checked, never inferred."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

from larkspur.errors import CatalogTooLarge, ParseError, ReservedName, UnknownColumn
from larkspur.functions.values import SPARK_TYPES, UUID

#: The prefix of reserved names, the most tables over a store's life, and the longest names and counts.
RESERVED = "_hz_"
MOST_TABLES = 65536
LONGEST = 65535


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    pk: bool = False
    partition_key: bool = False
    immutable: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class IndexDef:
    name: str
    columns: tuple[str, ...]
    ordered: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    indexes: tuple[IndexDef, ...] = ()

    def to_json(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_json(d: dict[str, Any]) -> TableDef:
        return TableDef(d["name"], tuple(ColumnDef(**c) for c in d["columns"]), tuple(IndexDef(i["name"], tuple(i["columns"]), i["ordered"]) for i in d["indexes"]))


@dataclass(frozen=True)
class Table:
    """A definition that passed all checks, with its columns by name."""

    define: TableDef
    number: int = 0
    by_name: dict[str, ColumnDef] = field(default_factory=dict, compare=False)

    @property
    def name(self) -> str:
        return self.define.name

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.define.columns]

    @property
    def pk(self) -> str:
        return next(c.name for c in self.define.columns if c.pk)

    @property
    def partition_key(self) -> str | None:
        return next((c.name for c in self.define.columns if c.partition_key), None)

    def column(self, name: str) -> ColumnDef:
        if name not in self.by_name:
            raise UnknownColumn(f"{self.name}.{name}")
        return self.by_name[name]

    def struct(self) -> T.StructType:
        """Columns in declared order; UUIDs are lower-case text, marked as such."""
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind], True, {"etype": c.kind, "pk": c.pk, "partition_key": c.partition_key, "immutable": c.immutable}) for c in self.define.columns])

    def probed(self, name: str) -> bool:
        """Whether a join may probe the column: the primary key, or the first column of an index."""
        return name == self.pk or any(i.columns[0] == name for i in self.define.indexes)


def resolve(define: TableDef, number: int = 0) -> Table:
    """Checks a definition and gives unnamed indexes their names."""
    cols = define.columns
    names = [c.name for c in cols]
    if not define.name or not cols or not all(names) or len(set(names)) != len(names):
        raise ParseError("tables and columns need unique, non-empty names")
    if define.name.lower().startswith(RESERVED):
        raise ReservedName(define.name)
    if max(len(define.name), len(cols), len(define.indexes), *(len(n) for n in names)) > LONGEST:
        raise CatalogTooLarge(define.name[:40])
    pks, parts = [c for c in cols if c.pk], [c for c in cols if c.partition_key]
    if len(pks) != 1 or pks[0].kind != UUID:
        raise ParseError("a table needs exactly one primary key, a UUID")
    if pks[0].nullable:
        raise ParseError("the primary key can't be NULL")
    if len(parts) > 1 or parts and (parts[0].kind != UUID or parts[0].pk):
        raise ParseError("a partition key is one UUID column, not the primary key")
    if parts and define.indexes:
        raise ParseError("a partitioned table takes no indexes")
    made: list[IndexDef] = []
    for i in define.indexes:
        if not i.columns or len(set(i.columns)) != len(i.columns):
            raise ParseError("an index needs columns, each once")
        for c in i.columns:
            if c not in names:
                raise UnknownColumn(f"{define.name}.{c}")
            if c == pks[0].name:
                raise ParseError("the primary key needs no index")
        if len(i.columns) > 1 and not i.ordered:
            raise ParseError("an index on several columns must be ORDERED")
        made.append(i if i.name else IndexDef("idx_" + "_".join(i.columns), i.columns, i.ordered))
    if len({i.columns for i in made}) != len(made) or len({i.name for i in made}) != len(made):
        raise ParseError("two indexes have the same columns or name")
    fixed = TableDef(define.name, cols, tuple(made))
    return Table(fixed, number, {c.name: c for c in cols})
