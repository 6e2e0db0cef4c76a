"""Memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa


def free_memory() -> None:
    """Return what this worker has freed to the system: Spark reuses workers,
    and the pages of one batch would stay beside those of the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):       # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
