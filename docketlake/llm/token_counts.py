"""Token counts of whole texts, lengths only.

A text is cut at ASCII white space. That is a safe boundary for a tokenizer
that drops white space before merging: no token, normalisation rule or special
string spans one, so the counts of the pieces add up to that of the text; a
tokenizer that keeps white space is refused when its file is loaded. Pieces
that a worker has met are looked up by their bytes, the others are encoded in
batches balanced by bytes.

Null text counts as empty (0 bytes, 0 tokens); rows are kept as they are,
repeated or not; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm import kernels as K

#: Bytes that a worker may use to remember pieces, and what one takes beside its text.
REMEMBERED_BYTES, PIECE_BYTES = 48 << 20, 120
#: Bytes of distinct pieces handed to the library at once.
ENCODE_BYTES = 1 << 20
#: Bytes of text, and words, in one step of a worker.
STEP_BYTES, STEP_WORDS = 2 << 20, 1 << 18
_PROBES = ["a", "b", "The", "12", "'s", "!", "#$", "\u00e9", "\u4f60", "\u00df", "x1", "\U0001f600", "<|endoftext|>"]


def _drops_white_space(tokenizer) -> bool:
    """Whether texts of two pieces get the ids of their pieces, whatever white space is between and around."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    one = {p: ids(p) for p in _PROBES}
    blanks = (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " \n ")
    return all(ids(blank + p + blank + q) == one[p] + one[q] for i, p in enumerate(_PROBES) for q in _PROBES for blank in blanks[i % 2 :: 2])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if not _drops_white_space(tokenizer):
        raise ValueError(f"{path}: this tokenizer keeps white space; its texts can't be cut there")
    return tokenizer


def encode_lengths(path: str, pieces: list[str]) -> np.ndarray:
    """Tokens of each piece, encoded in batches of about ENCODE_BYTES."""
    tokenizer, out, start, size = _tokenizer(path), [], 0, 0
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    for i, piece in enumerate(pieces):
        size += len(piece.encode())
        if size >= ENCODE_BYTES or i == len(pieces) - 1:
            out += [len(e) for e in encode(pieces[start : i + 1], add_special_tokens=False)]
            start, size = i + 1, 0
    return np.array(out, np.int64)


class _Counter:
    """Counts of texts; remembers the counts of pieces by their bytes, within a bound."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.used = 0

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each of some distinct pieces."""
        new = [p for p in pieces if p not in self.known]
        if new:
            self.used += sum(map(len, new)) + PIECE_BYTES * len(new)
            if self.used > REMEMBERED_BYTES:
                self.clear()
                new = pieces
            counts = encode_lengths(self.path, [p.decode("utf-8", "replace") for p in new])
            self.known.update(zip(new, counts.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = K.Words(data, offsets, hashed=False)
        raw = data.tobytes()
        total = np.zeros(len(words.starts) + 1, np.int64)
        for a in range(0, len(words.starts), STEP_WORDS):
            starts, ends = words.starts[a : a + STEP_WORDS], words.ends[a : a + STEP_WORDS]
            at, inverse = K.distinct_runs(data, starts, ends)
            total[a + 1 : a + 1 + len(starts)] = self.lengths([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[inverse]
        np.cumsum(total, out=total)
        return total[words.first[1:]] - total[words.first[:-1]]


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(tokenizer_path)
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            tokens = [counter.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in K.row_slices(offsets, STEP_BYTES)]
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield K.batch({"key": batch.column(0), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(n)})
        K.release()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
