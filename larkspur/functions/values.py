"""The dialect's kinds and how Python values enter and leave them."""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from typing import Any

from pyspark.sql import types as T

from larkspur.errors import TypeMismatch

INT, TEXT, BYTES, BOOL, UUID, NULL = "int", "text", "bytes", "bool", "uuid", "null"
#: Spellings of column types.
SPELLINGS = {"int": INT, "text": TEXT, "string": TEXT, "bool": BOOL, "bytes": BYTES, "blob": BYTES, "uuid": UUID}
SPARK_TYPES = {INT: T.LongType(), TEXT: T.StringType(), BYTES: T.BinaryType(), BOOL: T.BooleanType(), UUID: T.StringType()}
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)


def parse_uuid(text: str) -> uuid.UUID:
    """A UUID from its 36-character form, in any case."""
    if not isinstance(text, str) or not _UUID.fullmatch(text):
        raise TypeMismatch(f"not a UUID: {text!r}")
    return uuid.UUID(text)


def kind_of(value: Any) -> str:
    """The kind of a Python value; floats, nested values and integers beyond 64 bits have none."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return INT
    if isinstance(value, str):
        return TEXT
    if isinstance(value, (bytes, bytearray)):
        return BYTES
    if isinstance(value, uuid.UUID):
        return UUID
    raise TypeMismatch(f"no kind for {type(value).__name__}")


def fit(value: Any, kind: str, nullable: bool, name: str) -> Any:
    """The value as a cell of a column; a string becomes a UUID where the column asks for one."""
    if kind == UUID and isinstance(value, str):
        value = parse_uuid(value)
    got = kind_of(value)
    if got == NULL:
        if not nullable:
            raise TypeMismatch(f"column {name} is NOT NULL")
        return None
    if got != kind:
        raise TypeMismatch(f"column {name} is {kind}, not {got}")
    if got == TEXT:
        try:
            value.encode("utf-8")
        except UnicodeEncodeError as e:
            raise TypeMismatch(f"column {name}: text is not valid UTF-8") from e
    return bytes(value) if got == BYTES else value


def cell(value: Any) -> Any:
    """A value as Spark holds it."""
    return str(value) if isinstance(value, uuid.UUID) else bytes(value) if isinstance(value, bytearray) else value


def uncell(value: Any, kind: str) -> Any:
    """A value from Spark as Python callers get it."""
    if value is None:
        return None
    return uuid.UUID(value) if kind == UUID else bytes(value) if kind == BYTES else value


def row_cost(row: list[Any], indexes: int) -> int:
    """Bytes that a row counts for: 32 a cell, its payloads, 64 for itself and 48 for each index."""
    payload = sum(len(v.encode("utf-8", "surrogatepass")) if isinstance(v, str) else len(v) for v in row if isinstance(v, (str, bytes)))
    return 32 * len(row) + payload + 64 + 48 * indexes


class Uuid7:
    """Time-ordered UUIDs of version 7, each above the one before: 48 bits of milliseconds, a 12-bit counter, 62 random bits."""

    def __init__(self) -> None:
        self._lock, self._ms, self._count = threading.Lock(), 0, 0

    def __call__(self) -> uuid.UUID:
        with self._lock:
            now = time.time_ns() // 1_000_000
            if now > self._ms:
                self._ms, self._count = now, 0
            else:
                self._count += 1
                if self._count > 0xFFF:
                    self._ms, self._count = self._ms + 1, 0
            tail = int.from_bytes(os.urandom(8)) & (1 << 62) - 1
            return uuid.UUID(int=self._ms << 80 | 7 << 76 | self._count << 64 | 2 << 62 | tail)


uuid7 = Uuid7()
