"""Exact Jaccard verification of pairs of texts by the sets of their shingles.

Pairs are joined to their texts and the sets are built where they are compared:
a text is several times smaller than the hashes of its shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernels as K

#: Bytes of text compared at once.
STEP_BYTES = 1 << 20

#: (members, row of each) of the sets of a string column, by row and then by member.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def common_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``n`` rows the members in common, in a, and in b."""
    na, nb = np.bincount(a[1], minlength=n), np.bincount(b[1], minlength=n)
    both = na + nb
    start = np.cumsum(both) - both
    values = np.empty(len(a[0]) + len(b[0]), K.U64)
    values[np.arange(len(a[0])) + np.repeat(start - (np.cumsum(na) - na), na)] = a[0]
    values[np.arange(len(b[0])) + np.repeat(start + na - (np.cumsum(nb) - nb), nb)] = b[0]
    K.sort_rows(values, both)
    rows = np.repeat(np.arange(n), both)
    same = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[1:][same], minlength=n), na, nb


def parities(members: np.ndarray, rows: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Sketches of ``n`` sets, a row of 64-bit words each: bit i is the parity of the members that hash to i.

    Two sketches differ in at most as many bits as the sets do in members, so
    sets that are similar enough never look too different.
    """
    out = np.empty((n, bits // 64), np.int64)
    first = np.searchsorted(rows, np.arange(n + 1))
    for a in range(0, n, 1024):  # bounds the table of bits
        b = min(n, a + 1024)
        part = slice(first[a], first[b])
        at = (rows[part] - a) * bits + (members[part] % K.U64(bits)).astype(np.int64)
        odd = np.bincount(at, minlength=(b - a) * bits).astype(np.uint8) & 1
        out[a:b] = np.packbits(odd.reshape(b - a, bits), axis=1).view(np.int64)
    return out


def similar_pairs(pairs: DataFrame, texts: DataFrame, sets: Sets, threshold: tuple[int, int]) -> DataFrame:
    """Of ``pairs`` (a, b), those whose ``texts`` (node, text; written) have sets with a Jaccard index of at least p / q."""
    p, q = threshold

    @K.releasing
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ends = K.buffers(left)[1] + K.buffers(right)[1]
            for a, b in K.row_slices(ends, STEP_BYTES):
                common, na, nb = common_counts(sets(left.slice(a, b - a)), sets(right.slice(a, b - a)), b - a)
                passed = (common > 0) & ((p + q) * common >= p * (na + nb))
                yield batch.select([0, 1]).slice(a, b - a).filter(pa.array(passed))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(keep, T.StructType([pairs.schema["a"], pairs.schema["b"]]))
