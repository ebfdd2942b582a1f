"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

White space becomes the meta symbol, a dummy prefix is added, and symbol pairs
are merged best score first, leftmost first among equals, from an agenda of
adjacent pairs. No vocabulary piece goes on from another character into the
meta symbol (this is checked when the model is loaded), so merges never cross
the start of a word and each distinct word is merged once. Words new to a
worker are compared, a batch at a time, with the sentencepiece library; any
difference raises. Words met before are looked up by their bytes. Decoding is
the library's.

Null text counts as empty: its only id is the end id. Rows are kept as they
are; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm import kernels as K

META = "▁"
#: Bytes that a worker may use to remember words and their ids, and what a word takes beside these.
REMEMBERED_BYTES, WORD_BYTES = 48 << 20, 130
#: Bytes of text in one step of a worker, whose arrays and lists take some 45 times as much.
STEP_BYTES = 1 << 18
#: A longer text is cut at the starts of words into parts of about so many characters.
PART_CHARS = 1 << 18


def text_parts(text: str) -> list[str]:
    """Parts whose ids, one after the other, are those of the text: each cut drops the space that a part is given anyway."""
    parts, start = [], 0
    while len(text) - start > PART_CHARS:
        at = start + PART_CHARS
        while at < len(text) - 1 and not (text[at] in (" ", META) and text[at - 1] not in (" ", META)):
            at += 1
        if at >= len(text) - 1:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(sp.vocab_size())]
        self.ids = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not special[i]}
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        if any(META in piece.lstrip(META) for piece in self.ids):
            raise ValueError("a piece crosses the start of a word; words can't be merged on their own")

    def merge(self, word: str) -> list[int]:
        """Ids of one word, in which white space already is the meta symbol."""
        scores, ids = self.scores, self.ids
        symbols: list[str | None] = list(word)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            score = scores.get(pair := symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                score = scores.get(both := pair + symbols[k])
                if score is not None:
                    heapq.heappush(agenda, (-score, i, k, both))
            h = left[i]
            if h >= 0:
                score = scores.get(both := symbols[h] + pair)
                if score is not None:
                    heapq.heappush(agenda, (-score, h, i, both))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (known := ids.get(s)) is not None:
                    out.append(known)
                else:
                    out += [self.bytes[b] for b in s.encode()]
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, each starting with a space, checked against the library."""
        merged = [self.merge(w.replace(" ", META)) for w in words]
        checked = [i for i, w in enumerate(words) if len(w) > 1]
        for i, ids in zip(checked, self.library.encode([words[i][1:] for i in checked], num_threads=1), strict=True):
            if ids != merged[i]:
                raise ValueError(f"the agenda and the library differ on {words[i]!r}")
        return merged

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text with the end id."""
        column = pa.array([text or ""])
        ids, counts = Encoder(self).encode(column)
        return [*ids[: counts[0]].tolist(), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Encoder:
    """Encodes batches; remembers the ids of the words it has met, up to a bound."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.used = 0
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each of some distinct words stand: a number into ``starts``."""
        new = [w for w in words if w not in self.slots]
        if new:
            merged = self.codec.words([w.decode() for w in new])
            lengths = np.fromiter(map(len, merged), np.int64, len(merged))
            self.used += sum(map(len, new)) + WORD_BYTES * len(new) + 4 * int(lengths.sum())
            if self.used > REMEMBERED_BYTES and self.slots:
                self.clear()
                return self.places(words)
            self.slots.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in merged for i in ids), np.int32, int(lengths.sum()))])
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids without end ids, ids per row)."""
        if len(column) == 1 and len(column[0].as_py() or "") > PART_CHARS:
            parts = [self._encode([t])[0] for t in text_parts(column[0].as_py())]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self._encode(column.to_pylist())

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" " + t.replace(META, " ") if t else "" for t in texts]
        raw = "".join(texts).encode()
        data = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        blank = data == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        at, inverse = K.distinct_runs(data, starts, ends)
        slot = self.places([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[inverse]
        begin, length = self.starts[slot], self.starts[slot + 1] - self.starts[slot]
        total = np.concatenate([[0], np.cumsum(length)])
        flat_at = np.arange(total[-1]) - np.repeat(total[:-1], length) + np.repeat(begin, length)
        bounds = total[np.searchsorted(starts, offsets)]
        return self.ids[flat_at], np.diff(bounds)


def _decimals(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id as decimal bytes with a space after it: (table, lengths)."""
    texts = [f"{i} ".encode() for i in range(vocabulary)]
    width = max(map(len, texts))
    table = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(vocabulary, width)
    return table, np.fromiter(map(len, texts), np.int64, vocabulary)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", with_output: bool = False) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 of every row; with ``with_output`` also ids and decoded."""

    @K.releasing
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = codec(model_path)
        encoder = Encoder(sp)
        table, widths = _decimals(sp.library.vocab_size())
        columns = np.arange(table.shape[1])
        for batch in batches:
            _, offsets = K.buffers(batch.column(1))
            for a, b in K.row_slices(offsets, STEP_BYTES):
                keys, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                flat, counts = encoder.encode(texts)
                last = np.cumsum(counts)
                all_ids = np.insert(flat, last, sp.end)
                n = counts + 1
                until = np.cumsum(n)
                digits = table[all_ids]
                packed = digits[columns < widths[all_ids][:, None]].tobytes()
                byte_until = np.cumsum(widths[all_ids])[until - 1].tolist()
                values, ids_hash, decoded_hash, outs, ids_out, begin, byte_begin = all_ids.tolist(), [], [], [], [], 0, 0
                for end, byte_end in zip(until.tolist(), byte_until, strict=True):
                    ids_hash.append(hashlib.sha256(packed[byte_begin : byte_end - 1]).hexdigest())
                    decoded = sp.decode(values[begin:end])
                    decoded_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_output:
                        outs.append(decoded)
                        ids_out.append(values[begin:end])
                    begin, byte_begin = end, byte_end
                made = {"key": keys, "n_tokens": pa.array(n), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(decoded_hash, pa.string())}
                if with_output:
                    made |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(outs, pa.string())}
                yield K.batch(made)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output
    return rows.mapInArrow(encode, schema).withColumnRenamed("key", key)
