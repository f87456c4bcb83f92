"""Whole texts as numpy arrays: words, word hashes and window hashes, a few MB at a time.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text. Every function
here is a pure function of the text, so a recomputed task yields the same rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# odd multipliers of 64 bits for polynomial hashes; any odd numbers with mixed bits would do
P_BYTE = np.uint64(0x9E3779B97F4A7C15)
P_WORD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * P_BYTE)


@dataclass
class Texts:
    """Consecutive texts in one byte buffer; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def one(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The buffers of a string or binary column, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[at[0] : at[-1]], at - at[0])


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches again, cut so that a slice holds about ``most`` bytes of text (one text at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        whole = texts_of(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < whole.n:
            last = int(np.searchsorted(whole.bounds, whole.bounds[first] + most, side="right")) - 1
            last = min(max(last, first + 1), whole.n)
            part = Texts(whole.data[whole.bounds[first] : whole.bounds[last]], whole.bounds[first : last + 1] - whole.bounds[first])
            yield batch.slice(first, last - first), part
            first = last


@dataclass
class Words:
    """The words of some texts: [start, end) in the buffer; words of text i are ``at[i]:at[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def words_of(texts: Texts, is_space: np.ndarray = IS_SPACE) -> Words:
    solid = ~is_space[texts.data]
    if not len(solid):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(texts.n + 1, np.int64))
    inner = np.ones(len(solid) + 1, dtype=bool)  # may a word go on from the byte before?
    inner[texts.bounds] = False
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~(solid[:-1] & inner[1:-1])
    ends[:-1] &= ~(solid[1:] & inner[1:-1])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, texts.bounds))


def word_hashes(data: np.ndarray, words: Words, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every word; ``fold`` maps bytes first (LOWER for case folding)."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    length = words.end - words.start
    powers = np.cumprod(np.full(int(length.max()) + 1, P_BYTE))
    values = BYTE_VALUES if fold is None else BYTE_VALUES[fold]
    order = np.concatenate(([0], np.cumsum(length)))[:-1]
    inside = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(order, length)
    picked = data[np.repeat(words.start, length) + inside]
    total = np.add.reduceat(values[picked] * powers[inside], order)
    return mix(total + length.astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int, multiplier: np.uint64 = P_WORD) -> np.ndarray:
    """Of every window of ``size`` neighbouring hashes: its polynomial hash, mixed.

    Window i covers hashes[i:i + size]; there are max(0, n - size + 1) of them. Windows are
    put together from windows of powers of two, so the cost is log(size) passes.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    done, part, span = 0, hashes, 1
    power, factor, rest = int(multiplier), 1, size
    while rest:
        if rest & 1:
            total = total + part[done : done + n] * np.uint64(factor)
            factor = factor * power % 2**64
            done += span
        rest >>= 1
        if rest:
            part = part[: len(part) - span] + part[span:] * np.uint64(power)
            power = power * power % 2**64
            span *= 2
    return mix(total)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every window of ``size`` neighbours."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    part, span = values, 1
    while span * 2 <= size:
        part = np.minimum(part[: len(part) - span], part[span:])
        span *= 2
    return np.minimum(part[:n], part[size - span : size - span + n])


def give_back() -> None:
    """Return to the system what this process has freed, which Arrow and the C library keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def map_arrow(frame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema):
    """``frame.mapInArrow`` under a name that says what the operators here rely on: ``work`` sees
    a partition as an iterator and holds one slice of it at a time. After the partition the worker
    gives back its memory: Spark keeps more workers than run at once, one stage after another."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return frame.mapInArrow(whole, schema)
