"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line of at least MIN_WORDS words. Equal paragraphs collapse
first; the others have MinHash signatures of their word 5-shingles, in bands
tuned for high recall. Paragraphs that share a band are joined, verified by the
exact Jaccard index, and clustered; the first (document id, word) of a cluster
stays and the others are removed.

Passages also repeat inside of otherwise different paragraphs. For these, blocks
of MIN_WORDS words are chosen by winnowing: of the blocks that start at any
MIN_WORDS words in a row the one of the smallest hash. Two documents that share
any run of twice MIN_WORDS words, wherever it stands, choose the same block in
it. Blocks cluster by equality of 128 bits, and each is extended to both sides
over the words that are equal at the occurrence that stays.

A document's removed spans are merged; documents without one have no row. Words
are ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z. Null and empty texts have no
paragraphs; rows with a null id are left out, as they can't be named. Of rows
that repeat an id the smallest text is the document. An empty table gives an
empty result.

A block of 25 words has 21 shingles, so at a Jaccard index of 0.8 it could only
differ in its first or last two words; bands over blocks would find nothing
that equality and extension don't. Near copies of passages are found where they
are paragraphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernels as K
from docketlake.llm.frames import anonymous
from docketlake.llm.minhash import band_keys, tune
from docketlake.llm.resolve import resolve
from docketlake.llm.sets import parities, similar_pairs
from docketlake.llm.storage import discard, numbered, small_side, staged

SHINGLE = 5
THRESHOLD = (4, 5)
MIN_WORDS = 25
RECALL, MAX_BANDS = 0.99, 12
#: Bits of a set's sketch, and the columns of its words.
SKETCH_BITS = 256
SKETCH = tuple(f"s{i}" for i in range(SKETCH_BITS // 64))
STEP_BYTES = 2 << 20

#: Prefix hashes are polynomials modulo this prime; a power of two would let arrangements of equal parts cancel out.
_PRIME = (1 << 61) - 1
_BASES = (0x1A5C7D3E9B2F4861, 0x0E3B97F4A7C15D29)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & K.U64(_PRIME)) + (x >> K.U64(61))
    return np.where(x >= K.U64(_PRIME), x - K.U64(_PRIME), x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 31 bits."""
    half, low = K.U64(31), K.U64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return _reduced(_reduced(al * bl) + K.U64(2) * (ah * bh) + (middle >> K.U64(30)) + ((middle & K.U64((1 << 30) - 1)) << half))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime."""
    if base not in _tables or len(_tables[base][0]) < n:
        made = []
        for b in (base % _PRIME, pow(base, -1, _PRIME)):
            table = np.ones(1, K.U64)
            while len(table) < max(n, 1 << 16):
                table = np.concatenate([table, _product(table, K.U64(pow(b, len(table), _PRIME)))])
            made.append(table)
        _tables[base] = made[0], made[1]
    return _tables[base]


class Units:
    """Paragraphs and blocks of a buffer of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = K.Words(data, offsets, lower=True)
        n = len(w.hashes)
        self.row = w.rows()
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        new_line = np.ones(n, dtype=bool)
        if n:
            new_line[1:] = (breaks[w.starts[1:]] > breaks[w.ends[:-1]]) | (self.row[1:] != self.row[:-1])
        self.line_first = np.append(np.flatnonzero(new_line), n)
        self.line_words = np.diff(self.line_first)
        self._prefix = []
        for base in _BASES:
            terms = _product(_reduced(w.hashes), _powers(base, n + 1)[0][:n])
            # Sums of both halves of the terms, exact below 2**32 words.
            parts = np.zeros((2, n + 1), K.U64)
            np.cumsum(terms >> K.U64(32), out=parts[0, 1:])
            np.cumsum(terms & K.U64(0xFFFFFFFF), out=parts[1, 1:])
            self._prefix.append(parts)

    def keys(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for each run of words."""
        out = []
        with np.errstate(over="ignore"):
            length = (ends - starts).astype(K.U64) * K.U64(0xA24BAED4963EE407)
            for parts, base in zip(self._prefix, _BASES, strict=True):
                high, low = parts[:, ends] - parts[:, starts]
                # high * 2**32 modulo the prime, its upper bits coming round
                total = _reduced(_reduced((high & K.U64((1 << 29) - 1)) << K.U64(32)) + (high >> K.U64(29)) + _reduced(low))
                out.append(K.mix(_product(total, _powers(base, parts.shape[1])[1][starts]) + length))
        return out[0], out[1]

    def paragraphs(self, least: int) -> np.ndarray:
        return np.flatnonzero(self.line_words >= least)

    def shingles(self, lines: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes, number of each) of the lines, which have at least ``size`` words."""
        hashes, owner = K.windows(self.words.hashes, self.line_first, size)
        wanted = np.zeros(len(self.line_words), dtype=bool)
        wanted[lines] = True
        keep = wanted[owner]
        return hashes[keep], np.maximum(self.line_words[lines] - size + 1, 0)

    def blocks(self, size: int) -> np.ndarray:
        """First words of the chosen blocks."""
        starts = np.arange(len(self.row))
        starts = starts[starts + size <= self.words.first[1:][self.row]]
        if not len(starts):
            return starts
        # Texts stand ``size`` places apart, so that no window sees two.
        place = starts + self.row[starts] * size
        place -= place[0]
        most = K.U64(0xFFFFFFFFFFFFFFFF)
        value = np.full(int(place[-1]) + 2 * size, most, K.U64)
        value[place] = self.keys(starts, starts + size)[0] >> K.U64(1)
        low = _sliding(value, size, np.minimum)
        # A start is chosen if it is the least of some window that holds it.
        low[low == most] = 0
        padded = np.concatenate([np.zeros(size - 1, K.U64), low])
        best = _sliding(padded, size, np.maximum)
        return starts[best[place] == value[place]]


def _sliding(values: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """f over values[i : i + size] for each i; shorter at the end."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[:-step] = f(out[:-step], out[step:])
        have += step
    return out


def _steps(column: pa.Array) -> Iterator[tuple[int, int, Units]]:
    data, offsets = K.buffers(column)
    for a, b in K.row_slices(offsets, STEP_BYTES):
        yield a, b, Units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, first, words, k1, k2 of every paragraph and block, again (its text has had an equal one), and the paragraphs' set sizes, sketches and band keys (null for a block)."""
    names = ["n", *SKETCH, *[f"b{i}" for i in range(bands)]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, units in _steps(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                lines = units.paragraphs(MIN_WORDS)
                members, n = units.shingles(lines, SHINGLE)
                bands_of = band_keys(members, n, bands, rows) if len(lines) else np.zeros((0, bands), K.U64)
                members, owner = K.distinct(members, np.repeat(np.arange(len(lines)), n))
                traits = np.column_stack([np.bincount(owner, minlength=len(lines)), parities(members, owner, len(lines), SKETCH_BITS), bands_of.view(np.int64)])
                blocks = units.blocks(MIN_WORDS)
                starts = np.concatenate([units.line_first[lines], blocks])
                words = np.concatenate([units.line_words[lines], np.full(len(blocks), MIN_WORDS)])
                k1, k2 = units.keys(starts, starts + words)
                k1[len(lines) :] ^= K.U64(0xB10C)  # a block isn't equal to a paragraph
                row = units.row[starts]
                order = np.lexsort((starts, k2, k1, row))
                again = np.zeros(len(order), dtype=bool)
                again[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
                made = {
                    "id": ids.take(pa.array(row)), "first": pa.array((starts - units.words.first[row]).astype(np.int32)), "words": pa.array(words.astype(np.int32)),
                    "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "again": pa.array(again),
                }
                for i, c in enumerate(names):
                    made[c] = pa.concat_arrays([pa.array(np.ascontiguousarray(traits[:, i])), pa.nulls(len(blocks), pa.int64())])
                yield K.batch(made)
        K.release()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, first int, words int, k1 long, k2 long, again boolean, " + ", ".join(f"{c} long" for c in names))


def paragraph_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the paragraphs ``wanted`` (node, id, first)."""
    lists = staged(wanted.groupBy("id").agg(F.collect_list("node").alias("node"), F.collect_list("first").alias("firsts")), "lists")
    picked = docs.join(small_side(lists), "id").select("text", "node", "firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for a, b in K.row_slices(offsets, STEP_BYTES):
                part = data[offsets[a] : offsets[b]]
                units, raw = Units(part, offsets[a : b + 1] - offsets[a]), part.tobytes()
                nodes, firsts = (batch.column(i).slice(a, b - a) for i in (1, 2))
                row = np.repeat(np.arange(b - a), firsts.value_lengths().to_numpy(zero_copy_only=False))
                starts = units.words.first[row] + firsts.flatten().to_numpy()
                lasts = units.line_first[np.searchsorted(units.line_first, starts, side="right")] - 1
                texts = [raw[s:e].decode() for s, e in zip(units.words.starts[starts].tolist(), units.words.ends[lasts].tolist(), strict=True)]
                yield K.batch({"node": nodes.flatten(), "text": pa.array(texts, pa.string())})
        K.release()

    return picked.mapInArrow(cut, "node long, text string")


def _most(allowed: np.ndarray, equal: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The most words up to ``allowed`` at which ``equal``, which holds up to some number of words, still holds."""
    low, high = np.zeros_like(allowed), allowed.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        holds = equal(middle)
        low, high = np.where(holds, middle, low), np.where(holds, high, middle - 1)
    return low


def matches(text: pa.Array, kept: pa.Array, row: np.ndarray, first: np.ndarray, keep_first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words to the left, words to the right) by which the equal blocks at ``first`` of text and ``keep_first`` of kept, both in ``row``, extend; 0 where they aren't equal."""
    a, b = (Units(*K.buffers(column)) for column in (text, kept))
    x, y = a.words.first[row] + first, b.words.first[row] + keep_first
    left, right = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    room = np.minimum(a.words.first[row + 1] - x, b.words.first[row + 1] - y) - size
    at = np.flatnonzero(room >= 0)

    def same(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        p, q = a.keys(x[at] + s, x[at] + e), b.keys(y[at] + s, y[at] + e)
        return (p[0] == q[0]) & (p[1] == q[1])

    none = np.zeros(len(at), np.int64)
    at = at[same(none, none + size)]
    none = np.zeros(len(at), np.int64)
    left[at] = _most(np.minimum(first, keep_first)[at].astype(np.int64), lambda n: same(-n, none))
    right[at] = _most(room[at], lambda n: same(none, size + n))
    return left, right


def extended(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (id, first, words, keep_id, keep_first of repeated blocks) extended over all equal words around them."""
    pairs = staged(found.groupBy("id", "keep_id").agg(F.collect_list(F.struct("first", "keep_first")).alias("at")), "pairs")
    ends = staged(pairs.select(F.explode(F.array("id", "keep_id")).alias("id")).distinct(), "ends")
    texts = staged(docs.join(small_side(ends), "id", "left_semi"), "sides")
    kept = texts.select(F.col("id").alias("keep_id"), F.col("text").alias("kept"))
    joined = pairs.join(texts, "id").join(kept, "keep_id").select("id", "keep_id", "at", "text", "kept")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.row_slices(K.buffers(batch.column(3))[1] + K.buffers(batch.column(4))[1], STEP_BYTES):
                ids, keep_ids, at, text, kept = (c.slice(a, b - a) for c in batch.columns)
                row = np.repeat(np.arange(b - a), at.value_lengths().to_numpy(zero_copy_only=False))
                first, keep_first = (c.to_numpy() for c in at.flatten().flatten())
                left, right = matches(text, kept, row, first, keep_first, MIN_WORDS)
                spans = np.unique(np.stack([row, first - left, MIN_WORDS + left + right, keep_first - left]), axis=1)
                row, first, words, keep_first = spans
                yield K.batch({
                    "id": ids.take(pa.array(row)), "first": pa.array(first.astype(np.int32)), "words": pa.array(words.astype(np.int32)),
                    "keep_id": keep_ids.take(pa.array(row)), "keep_first": pa.array(keep_first.astype(np.int32)),
                })
        K.release()

    kind = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(extend, f"id {kind}, first int, words int, keep_id {kind}, keep_first int")


def paragraph_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = K.Words(*K.buffers(column), lower=True)
    return K.distinct(*K.windows(words.hashes, words.first, SHINGLE))


def named_texts(docs: DataFrame) -> DataFrame:
    """One row (id, text) per id that isn't null: the smallest text where rows repeat an id."""
    docs = docs.filter(F.col("id").isNotNull())
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs
    return docs.groupBy("id").agg(F.min("text").alias("text"))


def repeated_units(docs: DataFrame) -> DataFrame:
    """id, first, words, keep_id, keep_first of every paragraph or passage of ``docs`` (id, text; ids are unique) that stays elsewhere."""
    bands, rows = tune(THRESHOLD[0] / THRESHOLD[1], RECALL, MAX_BANDS)
    names = [f"b{i}" for i in range(bands)]
    units = staged(signatures(docs, bands, rows), "units")

    # Paragraphs: distinct ones, then bands.
    lines = units.filter(F.col("b0").isNotNull())
    columns = ["n", *SKETCH, *names]
    # Of equal paragraphs of one text the first counts.
    distinct = lines.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min_by("first", F.when(~F.col("again"), F.col("id"))).alias("first"), *[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("rows"))
    distinct = numbered(distinct, "distinct")
    keyed = distinct.select("node", F.explode(F.array(*names)).alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    buckets = staged(keyed.join(shared, "key"), "buckets")
    active = distinct.select("node", "id", "first", "n", F.array(*SKETCH).alias("sketch")).join(buckets.select("node").distinct(), "node")
    active = staged(active, "active")

    def texts(nodes: DataFrame) -> DataFrame:
        return staged(paragraph_texts(docs, active.select("node", "id", "first").join(nodes, "node")), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        return similar_pairs(pairs, texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), paragraph_sets, THRESHOLD)

    labels = resolve(buckets, THRESHOLD, verify, active, sets=paragraph_sets, texts=texts)
    discard(shared, buckets, active)
    in_component = staged(distinct.select("node", "k1", "k2", "id", "first").join(small_side(labels), "node").drop("node"), "in_component")
    stays = in_component.groupBy("component").agg(F.min(F.struct("id", "first")).alias("stays"))
    moved = in_component.join(stays, "component").select("k1", "k2", F.col("stays.id").alias("to_id"), F.col("stays.first").alias("to_first"))
    again = distinct.filter("rows > 1").select("k1", "k2", F.col("id").alias("keep_id"), F.col("first").alias("keep_first"))
    again = again.join(in_component.select("k1", "k2"), ["k1", "k2"], "left_anti")
    kept_lines = staged(moved.select("k1", "k2", F.col("to_id").alias("keep_id"), F.col("to_first").alias("keep_first")).unionByName(again), "kept")
    discard(distinct, in_component, labels)

    # Blocks: those that occur again.
    blocks = units.filter(F.col("b0").isNull())
    twice = staged(blocks.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id"), F.min_by("first", F.when(~F.col("again"), F.col("id"))).alias("keep_first")).filter("n > 1").drop("n"), "twice")

    def elsewhere(of: DataFrame, kept: DataFrame) -> DataFrame:
        rows = of.select("id", "first", "words", "k1", "k2").join(kept, ["k1", "k2"])
        return rows.filter((F.col("id") != F.col("keep_id")) | (F.col("first") != F.col("keep_first"))).select("id", "first", "words", "keep_id", "keep_first")

    of_lines = elsewhere(units.filter(F.col("b0").isNotNull()), kept_lines)
    return of_lines.unionByName(extended(docs, elsewhere(blocks, twice)))


def merged(row: np.ndarray, first: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, until) of the spans of each row where they touch or overlap put together, in order."""
    if not len(row):
        return row, first, until
    order = np.lexsort((first, row))
    row, first, until = row[order].astype(np.int64), first[order].astype(np.int64), until[order].astype(np.int64)
    # Rows stand so far apart that the furthest end so far tells where a new span starts.
    apart = int(until.max()) + 2
    start, end = first + row * apart, np.maximum.accumulate(until + row * apart)
    new = np.ones(len(row), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], first[new], end[last] - row[last] * apart


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("until", T.IntegerType())])))
def _merged(spans: pa.Array) -> pa.Array:
    counts = spans.value_lengths().to_numpy(zero_copy_only=False)
    first, until = (c.to_numpy() for c in spans.flatten().flatten())
    row, first, until = merged(np.repeat(np.arange(len(spans)), counts), first, until)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(spans)))]).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(until.astype(np.int32))], names=["first", "until"])
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, spans (first word, word after the last) to remove, n_words in them, and kept_in, the documents that keep the text."""
    found = repeated_units(named_texts(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))))
    span = F.struct(F.col("first"), (F.col("first") + F.col("words")).alias("until"))
    per_doc = found.groupBy("id").agg(F.collect_set(span).alias("spans"), F.sort_array(F.collect_set("keep_id")).alias("kept_in"))
    spans = per_doc.select("id", _merged("spans").alias("spans"), "kept_in")
    n_words = F.aggregate("spans", F.lit(0), lambda n, s: n + s["until"] - s["first"])
    return spans.select(F.col("id").alias(key), "spans", n_words.cast("long").alias("n_words"), "kept_in")


@F.arrow_udf(T.StringType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    data, offsets = K.buffers(text)
    words, out, raw = K.Words(data, offsets, hashed=False), [], data.tobytes()
    for row, (t, marks) in enumerate(zip(text.to_pylist(), spans.to_pylist(), strict=True)):
        if t is None or not marks:
            out.append(t)
            continue
        at, first, parts = int(offsets[row]), int(words.first[row]), []
        for s in marks:
            parts.append(raw[at : int(words.starts[first + s["first"]])])
            at = int(words.ends[first + s["until"] - 1])
        out.append(b"".join([*parts, raw[at : int(offsets[row + 1])]]).decode())
    return pa.array(out, text.type)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the repeated spans in their texts; all rows and columns stay. Rows that repeat an id with another text than the smallest stay as they are."""
    spans = staged(repeated_spans(docs, text, key).select(F.col(key).alias("__id"), F.col("spans").alias("__spans")), "spans")
    inner, named = anonymous(docs)
    rows = inner.select(named[key].alias("id"), F.coalesce(named[text].cast("string"), F.lit("")).alias("text"))
    marked = spans.join(named_texts(rows).select(F.col("id").alias("__id"), F.xxhash64("text").alias("__of")), "__id")
    joined = inner.join(marked, (named[key] == F.col("__id")) & (F.xxhash64(named[text].cast("string")) == F.col("__of")), "left")
    return joined.select(*[_cut(c.cast("string"), F.col("__spans")).alias(name) if name == text else c.alias(name) for name, c in named.items()])
