"""Memory of Python worker processes, which Spark keeps and uses again for the tasks of later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


_forget: list[Callable[[], None]] = []


def keeps(forget: Callable[[], None]) -> None:
    """Says how to empty a cache that this worker keeps from task to task; tasks of other operators do so as they begin."""
    _forget.append(forget)


def give_back() -> None:
    """Hand memory that this process has freed back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another libc: it keeps what it has


def emptied(run: Run) -> Run:
    """``run`` in a worker that empties its caches once a task is through, so that it idles without them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for forget in _forget:
            forget()
        give_back()

    return task


def frugal(run: Run) -> Run:
    """``run`` in a worker without the caches of other operators; once a task is through, what it freed is handed back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forget in _forget:
            forget()
        if _forget:
            give_back()  # before this task takes memory of its own
        yield from run(batches)
        give_back()

    return task
