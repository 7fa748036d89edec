"""What Python workers remember between tasks, and when they let it go.

Spark hands a worker from one stage to the next. What an operator's tasks remember (hashes of words, ids of
pieces, tables of a model) helps later tasks of the same operator alone, so a task of another one frees it first.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: Longer pieces and words are not remembered, so that a memo's entries bound its bytes.
LONG = 64

_kept: dict = {}


def _trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function outside glibc
        pass


def turn(owner: str, free) -> None:
    """Says that this worker's task, which starts, belongs to `owner`, whose memo `free` empties; frees those of others."""
    others = [x for x in _kept if x != owner]
    for x in others:
        _kept.pop(x)()
    _kept[owner] = free
    if others:
        gc.collect()
    _trim()
