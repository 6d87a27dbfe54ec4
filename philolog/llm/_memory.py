"""Memory of Python workers, which live on after their tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Returns what a task has freed to the system: a worker would keep it, beside its executor's own memory, for as long as it waits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
