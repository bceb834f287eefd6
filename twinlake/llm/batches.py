"""Arrow batches in pieces, so that what a Python worker holds does not depend on how long the texts are."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = re.compile(rb"[\t\n\x0b\x0c\r ]")
#: Bytes of the measured columns in a piece, but for a single row that is longer.
TOGETHER = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in order, in pieces of about TOGETHER bytes of some string or binary columns.

    When the batches end, memory that was freed goes back to the system: the
    worker process is used again, by other stages.
    """
    for b in batches:
        sizes = np.zeros(b.num_rows, np.int64)
        for c in columns:
            sizes += pc.fill_null(pc.cast(pc.binary_length(b.column(c)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // TOGETHER
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
        for low, high in zip(heads, [*heads[1:], b.num_rows], strict=True):
            yield b.slice(low, high - low)
    release()


def segments(text: bytes, most: int = TOGETHER) -> list[bytes]:
    """text in segments of about `most` bytes, cut behind ASCII white space; a longer stretch without any is one segment."""
    out, at = [], 0
    while len(text) - at > most:
        found = _SPACE.search(text, at + most - 1)
        if found is None:
            break
        out.append(text[at : found.end()])
        at = found.end()
    return [*out, text[at:]] if at < len(text) or not out else out


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
