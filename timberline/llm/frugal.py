"""Keeping Python workers small: memory that a task no longer needs goes back to the system."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Seconds between two releases within a task.
EVERY = 2.0


def release() -> None:
    """Give freed memory back: Spark keeps workers for later tasks, and with them what their allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over batches, with a release now and then and at its end."""

    def run(batches: Iterator) -> Iterator:
        last = time.monotonic()
        for out in work(batches):
            yield out
            if time.monotonic() - last > EVERY:
                release()
                last = time.monotonic()
        release()

    return run
