"""Vectorised text kernels over whole Arrow batches.

A batch's strings are one byte buffer with offsets. Words are maximal runs of
bytes other than space and 0x09-0x0D, which in UTF-8 are the words of
``[^\\x20\\x09-\\x0D]+``. Each word becomes one 64-bit hash; shingles, windows
and sets are then arithmetic on arrays. Work goes through the buffer in slices
cut at white space, so memory follows the slice and not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end


def _cuts(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    start, size = 0, len(data)
    while start < size:
        end = min(size, start + limit)
        while end < size:
            found = np.flatnonzero(SPACE[data[max(start, end - 4096) : end]])
            if len(found):
                end = max(start, end - 4096) + int(found[-1]) + 1
                break
            end = min(size, end + limit)
        yield start, end
        start = end


#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def eight_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-byte words of the runs [start, end), the last filled with zeros; number of each within its run; words per run)."""
    n = (ends - starts + 7) >> 3
    at_every_byte = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * place
    return at_every_byte[at] & _KEEP[np.minimum(np.repeat(ends, n) - at, 8)], place, n


def runs_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash for each byte run [start, end).

    Every eight bytes are mixed with their place before they are added up, so
    that no arrangement of equal parts cancels out, as it may in a polynomial
    modulo a power of two.
    """
    if not len(starts):
        return np.zeros(0, U64)
    value, place, n = eight_bytes(data, starts, ends)
    with np.errstate(over="ignore"):
        value = mix(value ^ U64(0x8CB92BA72F3D8DD7 + seed)) ^ (place.astype(U64) * U64(0x9E3779B97F4A7C15))
        value *= U64(0xD6E8FEB86659FD93)
        value ^= value >> U64(32)
        out = np.zeros(len(starts), U64)
        full = n > 0
        if full.any():
            out[full] = np.add.reduceat(value, (np.cumsum(n) - n)[full])
        return mix(out + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> bool:
    """Whether every run has the bytes of its other run."""
    if ((ends - starts) != (other_ends - other_starts)).any():
        return False
    return bool((eight_bytes(data, starts, ends)[0] == eight_bytes(data, other_starts, other_ends)[0]).all())


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one run of each content, number of the content of every run); equal hashes are confirmed by the bytes."""
    hashes = runs_hashed(data, starts, ends)
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if not equal_runs(data, starts, ends, starts[at][inverse], ends[at][inverse]):
        raw, seen = data.tobytes(), {}
        inverse = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        at = np.unique(inverse, return_index=True)[1]
    return at, inverse


class Words:
    """Words of a batch: ``hashes``, ``starts`` and ``ends`` in bytes, and ``first``, each row's first word (one more entry than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        hashes, starts, ends = [], [], []
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        for lo, hi in _cuts(data, SLICE_BYTES):
            part = data[lo:hi]
            if lower:
                part = LOWER[part]
            blank = SPACE[part]
            before = np.empty(len(part), dtype=bool)
            before[0] = True
            before[1:] = blank[:-1]
            before |= edge[lo:hi]
            s = np.flatnonzero(~blank & before)
            after = np.empty(len(part), dtype=bool)
            after[-1] = True
            after[:-1] = blank[1:]
            after |= edge[lo + 1 : hi + 1]
            e = np.flatnonzero(~blank & after) + 1
            if hashed:
                hashes.append(runs_hashed(part, s, e))
            starts.append(s + lo)
            ends.append(e + lo)
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, first: np.ndarray, size: int, short_whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of ``size`` words, in order.

    With ``short_whole`` a row of fewer words gives its whole sequence once.
    """
    counts = np.diff(first)
    factor = salts(size, 0x5EED)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        combined = np.zeros(n, U64)
        for k in range(size):
            combined += hashes[k : k + n] * factor[k]
        rows = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
        number = np.maximum(counts - size + 1, 0)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number) + first[:-1][rows]
        out = mix(combined[at] + U64(size))
        if short_whole:
            for r in np.flatnonzero((counts > 0) & (counts < size)):
                w = hashes[first[r] : first[r + 1]]
                value = mix(np.array([(w * factor[: len(w)]).sum(dtype=U64) + U64(len(w))], U64))
                out, rows = np.append(out, value), np.append(rows, r)
    return out, rows


def sort_rows(values: np.ndarray, lengths: np.ndarray) -> None:
    """Sort each of the consecutive runs of ``values`` in place: many short sorts are far cheaper than one by two keys."""
    end = np.cumsum(lengths)
    for s, e in zip((end - lengths).tolist(), end.tolist(), strict=True):
        if e - s > 1:
            values[s:e].sort()


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, by row and then by value."""
    if len(rows) and (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
    values = values.copy()
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    sort_rows(values, np.diff(np.append(starts, len(rows))))
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list<int64> column of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == U64 else values, pa.int64()))


def release() -> None:
    """Give memory that arrays no longer use back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a task's batches, with ``release`` once it has ended and its own variables are gone too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
