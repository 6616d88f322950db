"""Python workers are reused from task to task: what they hold is kept small and given back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def small(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def large(batches, column: str, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of the column."""
    held: list[pa.RecordBatch] = []
    used = 0
    for batch in batches:
        held.append(batch)
        used += batch[column].nbytes
        if used >= size:
            yield pa.concat_batches(held)
            held, used = [], 0
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(*clears: Callable[[], None]):
    """Of a function over the batches of a task: when the task ends, memos are cleared and memory is given back."""

    def wrap(function):
        @functools.wraps(function)
        def run(*args, **kwargs):
            try:
                yield from function(*args, **kwargs)
            finally:
                for clear in clears:
                    clear()
                give_back()

        return run

    return wrap
