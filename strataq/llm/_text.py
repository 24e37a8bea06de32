"""Vectorised text handling for the Arrow-backed operators.

Words are maximal runs of characters other than space and 0x09-0x0D.  Work is
done on slices of a bounded number of text bytes, so that the memory of a
Python worker does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes of ``column`` each (a longer row stands alone)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def settle() -> None:
    """Gives freed memory back to the system, as a worker stays for tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def texts(column: pa.Array) -> pa.Array:
    """The column as strings, with null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def words_of(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the number of words of each text. Lower-cases A-Z only."""
    column = texts(column)
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    flat = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    starts = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(full), before[starts[1:]] - before[starts[:-1]]


def codes_of(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's place in the list of distinct words, and that list."""
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: list[str], known: dict[str, int] | None = None) -> np.ndarray:
    """64-bit hashes of words."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in distinct), dtype=np.uint64, count=len(distinct))


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the number of words of each text."""
    words, counts = words_of(column)
    codes, distinct = codes_of(words)
    return (word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)), counts


def combine(*parts: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit hash of aligned hash arrays."""
    acc = parts[0]
    for x in parts[1:]:
        acc = mix(acc) * _GOLDEN + x
    return mix(acc)
