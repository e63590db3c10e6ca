"""Memory of Python workers: what a task frees goes back to the machine, since workers outlive tasks and share an executor's bound."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

# Fixed values of the C library's mallopt.
TRIM_THRESHOLD, MMAP_THRESHOLD, ARENA_MAX = -1, -3, -8


@functools.cache
def thrifty() -> bool:
    """Large blocks are mapped one by one and unmapped when freed; False where the C library has no such settings."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        library = ctypes.CDLL(None)
        return all([library.mallopt(TRIM_THRESHOLD, 4 << 20), library.mallopt(MMAP_THRESHOLD, 8 << 20), library.mallopt(ARENA_MAX, 2)])
    except (AttributeError, OSError):
        return False
