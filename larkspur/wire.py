"""JSON in and out."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from larkspur.errors import TypeMismatch

DEEPEST = 32


def plain(value: Any) -> Any:
    """A value as JSON has it: bytes in base 64, UUIDs as text."""
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    return str(value) if isinstance(value, uuid.UUID) else value


def dump(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=plain).encode("utf-8", "surrogatepass")


def rows_to_json(columns: Sequence[str], rows: Iterable[Sequence[Any]]) -> bytes:
    return dump({"columns": list(columns), "rows": [[plain(v) for v in r] for r in rows]})


def row_to_json_object(columns: Sequence[str], row: Sequence[Any]) -> bytes:
    """An object whose names may repeat, as columns may."""
    return b"{" + b",".join(dump(c) + b":" + dump(plain(v)) for c, v in zip(columns, row, strict=True)) + b"}"


def rows_to_json_objects(columns: Sequence[str], rows: Iterable[Sequence[Any]]) -> bytes:
    return b"[" + b",".join(row_to_json_object(columns, r) for r in rows) + b"]"


def exec_result_json(affected: int) -> bytes:
    return dump({"affected": affected})


def error_json(message: str) -> bytes:
    return dump({"error": message})


def args_from_json(text: str | bytes) -> list[Any]:
    """A JSON list of null, booleans, strings and integers."""

    def real(x: str) -> Any:
        raise TypeMismatch(f"not an integer: {x}")

    def constant(x: str) -> Any:
        raise TypeMismatch(x)

    depth = deepest = 0
    body = text.decode() if isinstance(text, bytes) else text
    quoted = escaped = False
    for ch in body:
        if quoted:
            quoted = escaped or ch != '"'
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif ch in "]}":
            depth -= 1
    if deepest > DEEPEST:
        raise TypeMismatch("arguments are nested too deeply")
    try:
        out = json.loads(body, parse_float=real, parse_constant=constant)
    except ValueError as e:
        raise TypeMismatch(f"arguments are not JSON: {e}") from e
    if not isinstance(out, list):
        raise TypeMismatch("arguments are a JSON list")
    for v in out:
        if not (v is None or isinstance(v, (bool, str)) or isinstance(v, int) and -(2**63) <= v < 2**63):
            raise TypeMismatch(f"not an argument: {str(v)[:40]}")
    return out


def query_args(text: str) -> list[Any]:
    """Arguments in text: none if empty, a JSON list if it begins as one, else one string."""
    return [] if text == "" else args_from_json(text) if text[0] == "[" else [text]
