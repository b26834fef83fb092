"""What an executor's Python process holds, and how it gives memory back.

Spark reuses these processes for other stages, other operators and other queries. So state that outlasts a
task belongs to one operator at a time, rows are worked on in pieces bounded by bytes, and memory that the
allocators keep goes back to the system when a task ends and, within it, after every ``EVERY`` bytes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute

#: Bytes of input in a piece, and bytes of input after which unused memory is returned.
PIECE, EVERY = 2 << 20, 32 << 20

_held: dict = {}
_owner: list = [None]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: its allocator decides
        return None


def give_back() -> None:
    """Returns what the allocators keep to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """``make()``, kept in this process as long as its tasks are those of ``owner``."""
    if _owner[0] != owner:
        _held.clear()
        _owner[0] = owner
        give_back()
    if key not in _held:
        _held[key] = make()
    return _held[key]


def sizes(column: pa.Array) -> list[int]:
    """Bytes of each value of a string or binary column; 0 for null."""
    out = pa.compute.binary_length(column)
    return pa.compute.fill_null(out, 0).to_pylist()


def spans(sizes: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of about ``most`` bytes: a very long value comes alone, or ends its run."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n + 16
    if at < len(sizes):
        yield at, len(sizes)


def pieces(owner: str, parts: Iterator[pa.RecordBatch], *columns: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``parts`` in pieces of about ``most`` bytes of ``columns``."""
    held(owner, None, bool)
    since = 0
    try:
        for p in parts:
            if not len(p):
                continue
            n = [sum(x) for x in zip(*(sizes(p.column(c)) for c in columns), strict=True)]
            for a, b in spans(n, most):
                yield p.slice(a, b - a)
                since += sum(n[a:b])
                if since >= EVERY:
                    since = 0
                    give_back()
            del p, n
    finally:
        give_back()


def guarded(owner: str, parts: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``parts`` in pieces of about ``most`` bytes over all columns."""
    held(owner, None, bool)
    since = 0
    try:
        for p in parts:
            if not len(p):
                continue
            rows = max(1, int(len(p) * most / max(p.nbytes, 1)))
            for a in range(0, len(p), rows):
                yield p.slice(a, rows)
            since += p.nbytes
            del p
            if since >= EVERY:
                since = 0
                give_back()
    finally:
        give_back()
