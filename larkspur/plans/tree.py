"""Statements and expressions as data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Col:
    name: str
    of: str | None = None


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    at: int


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Both:
    left: Any
    right: Any


@dataclass(frozen=True)
class Either:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class IsNull:
    of: Any
    negated: bool = False


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    alias: str | None
    left: Col
    right: Col


@dataclass
class Select:
    table: str
    alias: str | None = None
    columns: list[Col] | None = None  # None: all
    count: bool = False
    joins: list[Join] = field(default_factory=list)
    where: Any = None
    order: Col | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Any]]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Any]]
    where: Any = None


@dataclass
class Delete:
    table: str
    where: Any = None


@dataclass
class Create:
    table: str
    columns: list[Any]
    indexes: list[Any]


@dataclass
class Drop:
    table: str


def walk(e: Any):
    """An expression and all below it."""
    if e is None:
        return
    yield e
    for name in ("left", "right", "of"):
        below = getattr(e, name, None)
        if below is not None and not isinstance(below, str):
            yield from walk(below)


def conjuncts(e: Any) -> list[Any]:
    """The parts of a chain of AND."""
    if e is None:
        return []
    if isinstance(e, Both):
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]
