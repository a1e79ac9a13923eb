"""SELECT as a DataFrame; filtering, joining, sorting and limits are Catalyst's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import ParseError, UnindexedJoin, UnknownColumn
from larkspur.functions.exprs import Compiler
from larkspur.functions.values import INT, TEXT, UUID, parse_uuid
from larkspur.plans import tree as t
from larkspur.plans.access import Access, choose_access
from larkspur.sources.schema import Table

UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass
class Side:
    """One table of a query: what it may be called, and the prefix of its columns in the joined row."""

    table: Table
    alias: str | None
    prefix: str

    def called(self, name: str | None) -> bool:
        return name is None or name == self.alias or name == self.table.name

    @property
    def shown(self) -> str:
        return self.alias or self.table.name


@dataclass
class Plan:
    """A bound SELECT: sides, output names, access path of the driving side, kinds of the outputs."""

    stmt: t.Select
    sides: list[Side]
    names: list[str]
    outputs: list[tuple[Side, str]]
    kinds: list[str]
    access: Access
    wants_uuid: set[int]
    order: tuple[Side, str] | None = None
    on: tuple[tuple[Side, str], tuple[Side, str]] | None = None


def find(sides: list[Side], col: t.Col) -> tuple[Side, str]:
    """The side that owns a column; unknown or ambiguous names are errors."""
    named = [s for s in sides if s.called(col.of)]
    if not named:
        raise UnknownColumn(f"no table is called {col.of}")
    owners = [s for s in named if col.name in s.table.by_name]
    if len(owners) != 1:
        raise UnknownColumn(f"{col.name} is {'ambiguous' if owners else 'unknown'}")
    return owners[0], col.name


def uuid_params(sides: list[Side], where: Any) -> set[int]:
    """Parameters compared with a UUID column: strings for them are parsed."""
    out = set()
    for e in t.walk(where):
        if isinstance(e, t.Compare):
            for a, b in ((e.left, e.right), (e.right, e.left)):
                if isinstance(a, t.Col) and isinstance(b, t.Param):
                    side, name = find(sides, a)
                    if side.table.column(name).kind == UUID:
                        out.add(b.at)
    return out


def coerce(args: list[Any], wanted: set[int]) -> list[Any]:
    return [parse_uuid(a) if k in wanted and isinstance(a, str) else a for k, a in enumerate(args)]


def check_names(sides: list[Side], where: Any) -> None:
    for e in t.walk(where):
        if isinstance(e, t.Col):
            find(sides, e)


def bind_select(stmt: t.Select, get: Callable[[str], Table]) -> Plan:
    sides = [Side(get(stmt.table), stmt.alias, "l_")]
    if len(stmt.joins) > 1:
        raise ParseError("one JOIN at most")
    on = None
    for j in stmt.joins:
        right = Side(get(j.table), j.alias, "r_")
        if right.table.name == sides[0].table.name:
            raise ParseError("a table can't be joined with itself")
        sides.append(right)
        a, b = find(sides, j.left), find(sides, j.right)
        if a[0] is b[0]:
            raise ParseError("ON must compare the two tables")
        on = (a, b) if a[0] is sides[0] else (b, a)
        can = [side.table.probed(name) for side, name in on]
        # The preserved side drives, so the other one is probed; an inner join may drive either.
        if not (can[1] if j.kind == "left" else can[0] if j.kind == "right" else any(can)):
            raise UnindexedJoin(f"{on[1][0].table.name}.{on[1][1]}" if j.kind == "left" else f"{on[0][0].table.name}.{on[0][1]}")
    check_names(sides, stmt.where)
    if stmt.count:
        names, outputs, kinds = ["count"], [], [INT]
    else:
        if stmt.columns is None:
            outputs = [(s, n) for s in sides for n in s.table.names]
            names = [f"{s.shown}.{n}" if on else n for s, n in outputs]
        else:
            outputs = [find(sides, c) for c in stmt.columns]
            names = [n for _, n in outputs]
        kinds = [s.table.column(n).kind for s, n in outputs]
    order = find(sides, stmt.order) if stmt.order else None
    access = Access("scan")
    driver = sides[1] if stmt.joins and stmt.joins[0].kind == "right" else sides[0]
    owns = lambda c: find(sides, c)[0] is driver
    ordered = order[1] if order and order[0] is driver else None
    access = choose_access(driver.table, stmt.where, ordered, stmt.limit is not None, owns)
    return Plan(stmt, sides, names, outputs, kinds, access, uuid_params(sides, stmt.where), order, on)


def compiler(sides: list[Side], args: list[Any]) -> Compiler:
    def resolve(c: t.Col) -> tuple[str, Column]:
        side, name = find(sides, c)
        return side.table.column(name).kind, F.col(side.prefix + name)

    return Compiler(resolve, args)


def prefixed(df: DataFrame, side: Side) -> DataFrame:
    return df.select(*(F.col(n).alias(side.prefix + n) for n in side.table.names))


def joined(plan: Plan, current: Callable[[Table], DataFrame]) -> DataFrame:
    (left, a), (right, b) = plan.on
    x, y = F.col(left.prefix + a), F.col(right.prefix + b)
    kinds = left.table.column(a).kind, right.table.column(b).kind
    if kinds[0] == kinds[1]:
        on = x == y
    elif set(kinds) == {UUID, TEXT}:
        # A string probes a UUID key by its parsed form; an index compares kinds and finds nothing.
        probe = {"left": right, "right": left}.get(plan.stmt.joins[0].kind) or (right if right.table.probed(b) else left)
        name = b if probe is right else a
        s, u = (x, y) if kinds[0] == TEXT else (y, x)
        is_key = probe.table.pk == name and probe.table.column(name).kind == UUID
        on = (F.when(s.rlike(UUID_SHAPE), F.lower(s)) == u) if is_key else F.lit(False)
    else:
        on = F.lit(False)
    frames = prefixed(current(left.table), left), prefixed(current(right.table), right)
    return frames[0].join(frames[1], on, plan.stmt.joins[0].kind)


def select(plan: Plan, args: list[Any], current: Callable[[Table], DataFrame]) -> DataFrame:
    """The result, columns in order; names may repeat."""
    stmt, sides = plan.stmt, plan.sides
    rows = joined(plan, current) if plan.on else prefixed(current(sides[0].table), sides[0])
    if plan.access.empty(args):
        rows = rows.filter(F.lit(False))
    elif stmt.where is not None:
        rows = rows.filter(compiler(sides, args).condition(stmt.where))
    if stmt.count:
        return rows.agg(F.count(F.lit(1)).alias("count"))
    if plan.order:
        side, name = plan.order
        key = F.col(side.prefix + name)
        # Keys break ties, so that LIMIT is the same in every run.
        rows = rows.orderBy(key.desc_nulls_last() if stmt.descending else key.asc_nulls_first(), *(F.col(s.prefix + s.table.pk) for s in sides))
    if stmt.offset:
        rows = rows.offset(stmt.offset)
    if stmt.limit is not None:
        rows = rows.limit(stmt.limit)
    return rows.select(*(F.col(s.prefix + n).alias(f"_{k}") for k, (s, n) in enumerate(plan.outputs))).toDF(*plan.names)
