"""What a task does with its batches beside their content."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after whose last batch Arrow gives back what it keeps for reuse: workers live on between tasks."""
    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped
