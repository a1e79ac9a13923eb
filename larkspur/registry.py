"""Engines by name, for adapters that are set up apart from them."""

from __future__ import annotations

import threading

from larkspur.engine import Engine

_lock = threading.Lock()
_engines: dict[str, tuple[int, Engine]] = {}
_slots = 0


def register(name: str, engine: Engine) -> int:
    """Puts an engine under a name, in place of any other; returns its slot."""
    global _slots
    with _lock:
        _slots += 1
        _engines[name] = (_slots, engine)
        return _slots


def lookup(name: str) -> Engine | None:
    return _engines[name][1] if name in _engines else None


def lookup_slot(name: str) -> tuple[int, Engine] | None:
    return _engines.get(name)


def deregister_if(name: str, slot: int) -> bool:
    """Takes an engine away if it is still the one of this slot."""
    with _lock:
        if name in _engines and _engines[name][0] == slot:
            del _engines[name]
            return True
        return False
