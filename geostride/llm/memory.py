"""Memory of Python workers. A worker outlives its task; what the allocators keep for later would add up over stages."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa


def release() -> None:
    """Give unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(function):
    """A generator over batches that gives memory back at the end of its task."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def released_group(function):
    """The same for a function of one group."""

    @functools.wraps(function)
    def run(frame):
        try:
            return function(frame)
        finally:
            release()

    return run
