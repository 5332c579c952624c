"""What the operators of this subpackage share: reading text columns as bytes, and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import cut, shared_dir, staged  # noqa: F401

#: Text handled at once inside a task.
PART_BYTES = 1 << 20


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in this Python worker from one task to the next. What others kept there is forgotten."""
    for other in [name for name in _KEPT if name != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def tidy(owner: str) -> Callable:
    """For a task's function over batches: begin without what other operators kept, and end by giving freed memory back, as workers live on."""

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept(owner)
            yield from run(batches)
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

        return task

    return wrap


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus. A null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(0))


def carried(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """The columns that go to Python, and how a batch gives its texts there.

    Where the id column is a struct that holds the text, whole rows are carried by it and the text doesn't travel twice.
    """
    kind = df.schema[id_col].dataType
    if isinstance(kind, StructType) and text_col in kind.names:
        at = kind.names.index(text_col)
        return df.select(id_col), lambda batch: pc.struct_field(batch[0], [at])
    return df.select(id_col, text_col), lambda batch: batch[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each row starts in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), starts


def parts(column: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, bytes, starts) with about size bytes, one row at least."""
    data, starts = utf8(column)
    at = 0
    while at < len(column):
        end = min(len(column), max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1))
        yield at, end, data[starts[at] : starts[end]], starts[at : end + 1] - starts[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half the bits of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of a byte string, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._up) < n + 1:
            size = 1 << max(16, int(n + 1).bit_length())
            for name, base in (("_up", self.BASE), ("_down", pow(self.BASE, -1, 1 << 64))):
                powers = np.ones(1, np.uint64)
                while len(powers) < size:
                    powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), 1 << 64))])
                setattr(Rolling, name, powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each data[start:end]; equal bytes give equal hashes wherever they are."""
        return mix((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of size bytes, by start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)
