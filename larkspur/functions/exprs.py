"""Expressions compiled to Spark columns.

The dialect's logic is two-valued: NULL equals NULL, a range comparison with NULL is false, NOT of that is true. A wrong
operand makes an error instead; inside a condition an error is carried as a NULL boolean, so that the row doesn't match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.values import BOOL, BYTES, INT, NULL, SPARK_TYPES, TEXT, UUID, cell, kind_of
from larkspur.plans import tree as t

WHOLE = r"^[+-]?[0-9]+$"


@dataclass
class Typed:
    """A value of known kind; ``wrong`` is true where it can't be computed, None where it always can."""

    kind: str
    col: Column
    wrong: Column | None = None


def constant(value: Any) -> Typed:
    kind = kind_of(value)
    spark = SPARK_TYPES.get(kind, SPARK_TYPES[TEXT])
    return Typed(kind, F.lit(cell(value)).cast(spark))


def wrap(op: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic that wraps, whatever the session's ANSI setting; only rows that overflow go through decimals."""
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    x, y = (c.cast("decimal(19,0)") for c in (a, b))
    raw = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    half = F.lit(str(2**63)).cast("decimal(20,0)")
    return F.coalesce(plain, (F.pmod(raw + half, F.lit(str(2**64)).cast("decimal(20,0)")) - half).cast("bigint"))


class Compiler:
    """Compiles over ``resolve``, which gives kind and column of a name, and arguments for the parameters."""

    def __init__(self, resolve: Callable[[t.Col], tuple[str, Column]], args: list[Any]):
        self.resolve, self.args = resolve, args

    def condition(self, e: Any) -> Column:
        """A filter: true where the row matches. Plain comparisons stay plain, so that they reach the scan."""
        strict = self.fallible(e)
        return F.coalesce(self.predicate(e, True, True), F.lit(False)) if strict else self.predicate(e, True, False)

    def fallible(self, e: Any) -> bool:
        return any(isinstance(x, t.Arith) for x in t.walk(e)) and any(self.value(x).wrong is not None for x in t.walk(e) if isinstance(x, t.Arith))

    def predicate(self, e: Any, positive: bool, strict: bool) -> Column:
        """A boolean. Where ``strict`` it is NULL for an error only; else NULL stands for false, and only where ``positive``."""
        if isinstance(e, (t.Both, t.Either)):
            left, right = (self.predicate(x, positive, strict) for x in (e.left, e.right))
            if not strict:
                return left & right if isinstance(e, t.Both) else left | right
            if isinstance(e, t.Both):
                return F.when(left.isNull(), F.lit(None).cast("boolean")).when(~left, F.lit(False)).otherwise(right)
            return F.when(left.isNull(), F.lit(None).cast("boolean")).when(left, F.lit(True)).otherwise(right)
        if isinstance(e, t.Not):
            return ~self.predicate(e.of, False, strict)
        if isinstance(e, t.Compare):
            return self.compare(e, positive, strict)
        v = self.value(e)
        if isinstance(e, t.IsNull):
            return v.col if v.wrong is None else F.when(~v.wrong, v.col)
        if v.kind == BOOL:
            out = v.col if positive and not strict else F.coalesce(v.col, F.lit(False))
        elif v.kind == INT:
            out = F.coalesce(v.col != 0, F.lit(False))
        else:
            out = F.lit(False)
        return out if v.wrong is None else F.when(~v.wrong, out)

    def compare(self, e: t.Compare, positive: bool, strict: bool) -> Column:
        a, b = self.value(e.left), self.value(e.right)
        plain = False
        if e.op in ("=", "!="):
            if NULL in (a.kind, b.kind) or a.kind != b.kind:
                out = a.col.isNull() & b.col.isNull()
            else:
                out = a.col.eqNullSafe(b.col)
            out = ~out if e.op == "!=" else out
        elif NULL in (a.kind, b.kind):
            out = F.lit(False)
        else:
            x, y = a.col, b.col
            if a.kind != b.kind:
                x, y = self.text(a), self.text(b)
                if BYTES in (a.kind, b.kind):
                    x, y = x.cast("binary"), y.cast("binary")
            out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op]
            plain = positive and not strict
            out = out if plain else F.coalesce(out, F.lit(False))
        wrong = self.either_wrong(a, b)
        return out if wrong is None else F.when(~wrong, out)

    @staticmethod
    def either_wrong(*values: Typed) -> Column | None:
        out = None
        for v in values:
            if v.wrong is not None:
                out = v.wrong if out is None else out | v.wrong
        return out

    @staticmethod
    def text(v: Typed) -> Column:
        return v.col if v.kind in (TEXT, UUID, BYTES) else v.col.cast("string")

    def value(self, e: Any) -> Typed:
        if isinstance(e, t.Col):
            return Typed(*self.resolve(e))
        if isinstance(e, t.Param):
            return constant(self.args[e.at])
        if isinstance(e, t.Lit):
            return constant(e.value)
        if isinstance(e, t.IsNull):
            v = self.value(e.of)
            return Typed(BOOL, v.col.isNotNull() if e.negated else v.col.isNull(), v.wrong)
        if isinstance(e, t.Arith):
            return self.arith(e)
        strict = self.fallible(e)
        p = self.predicate(e, False, strict)
        return Typed(BOOL, p, p.isNull() if strict else None)

    def number(self, v: Typed) -> tuple[Column, Column | None]:
        """An operand as an integer, and where it isn't one."""
        if v.kind == INT:
            return v.col, None
        if v.kind == BOOL:
            return v.col.cast("bigint"), None
        if v.kind == NULL:
            return F.lit(None).cast("bigint"), None
        if v.kind == TEXT:
            n = F.when(v.col.rlike(WHOLE), v.col.try_cast("bigint"))
            return n, v.col.isNotNull() & n.isNull()
        return F.lit(None).cast("bigint"), v.col.isNotNull()

    def arith(self, e: t.Arith) -> Typed:
        a, b = self.value(e.left), self.value(e.right)
        (x, bad_x), (y, bad_y) = self.number(a), self.number(b)
        wrong = self.either_wrong(a, b)
        bad = None
        for one in (bad_x, bad_y):
            if one is not None:
                bad = one if bad is None else bad | one
        if bad is not None:  # NULL comes before wrong kinds
            bad = bad & a.col.isNotNull() & b.col.isNotNull()
            wrong = bad if wrong is None else wrong | bad
        return Typed(INT, wrap(e.op, x, y), wrong)
