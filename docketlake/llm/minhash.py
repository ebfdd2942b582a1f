"""MinHash signatures in bands, for whole batches of sets."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from docketlake.llm import kernels as K

#: Members worked on at once, which bounds memory.
CHUNK = 1 << 17
_EMPTY = 1 << 40


def tune(threshold: float, recall: float, max_bands: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose ``recall`` at the threshold takes at most ``max_bands`` bands."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
        if bands <= max_bands:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError("no banding reaches this recall within max_bands")
    return best


@lru_cache(maxsize=8)
def _borrowed(k: int, seed: int) -> np.ndarray:
    """For each of ``k`` bins the order in which it looks at all bins when it is empty."""
    return np.argsort(K.salts(k * k, seed).reshape(k, k), axis=1)


def signatures(members: np.ndarray, lengths: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(sets, k) minima by one permutation: a member falls into one of ``k`` bins by its high bits and competes there by its low ones.

    An empty bin takes the minimum of the first full one in an order of its
    own, which is the same for all sets, so that two sets agree in any bin as
    often as their Jaccard index says. ``lengths`` are over 0.
    """
    n = len(lengths)
    out = np.empty((n, k), np.int64)
    order = _borrowed(k, seed)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        part = members[base : int(ends[end - 1])]
        rows = end - start
        cell = ((part >> K.U64(32)) * K.U64(k)) >> K.U64(32)
        cell += np.repeat(np.arange(rows, dtype=K.U64) * K.U64(k), lengths[start:end])
        flat = np.full(rows * k, _EMPTY)
        np.minimum.at(flat, cell.astype(np.int64), (part & K.U64(0xFFFFFFFF)).astype(np.int64))
        table = flat.reshape(rows, k)
        filled = table.copy()
        r, b = np.nonzero(table == _EMPTY)
        for turn in range(k):
            if not len(r):
                break
            value = table[r, order[b, turn]]
            full = value != _EMPTY
            filled[r[full], b[full]] = value[full]
            r, b = r[~full], b[~full]
        out[start:end] = filled
        start = end
    return out


def band_keys(members: np.ndarray, lengths: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """A 64-bit key for each set and band; ``members`` are well mixed hashes, ``lengths`` (all over 0) their runs."""
    signature = signatures(members, lengths, bands * rows, seed).astype(K.U64)
    keys = np.empty((len(lengths), bands), K.U64)
    odd = K.salts(rows + bands, seed + 1)
    with np.errstate(over="ignore"):
        for b in range(bands):
            value = np.full(len(lengths), odd[rows + b], K.U64)
            for r in range(rows):
                value += signature[:, b * rows + r] * odd[r]
                value = K.mix(value)
            keys[:, b] = value
    return keys
