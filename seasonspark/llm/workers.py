"""Memory of Python workers, which Spark keeps from task to task."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return what is free to the system; Arrow's pool and malloc else hold it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Run, *, tokenizes: bool = False) -> Run:
    """``run`` for ``mapInArrow`` that leaves no free memory behind in the worker.

    A task that does not tokenize first drops the encoders, with the words they remember, that an earlier one left.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("seasonspark.llm.tokens")
        if tokens is not None and not tokenizes and tokens._encoders:
            tokens._encoders.clear()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
