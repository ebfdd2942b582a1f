"""Fuzzy line deduplication: one line is kept of each component of similar lines.

Equal lines collapse first, by 128 bits over the whole line. Each distinct
line has a MinHash signature of its character shingles; lines that share a band
are candidates, are verified by the exact Jaccard index of their shingle sets,
and form components by distributed union-find (module ``resolve``). Of each
component the occurrence with the smallest (document id, line number) stays.

Lines are cut at \\n; a line without a word is layout and always stays. A line
shorter than a shingle is one shingle. Null text counts as empty. A document
with a null id is left alone, as its lines can't be named; rows that repeat an
id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernels as K
from docketlake.llm.frames import anonymous
from docketlake.llm.minhash import band_keys, tune
from docketlake.llm.resolve import TINY, resolve
from docketlake.llm.sets import Sets, parities, similar_pairs
from docketlake.llm.storage import discard, numbered, small_side, staged

SHINGLE = 5
THRESHOLD = (4, 5)
RECALL, MAX_BANDS = 0.99, 12
#: Bits of a set's sketch, and the columns of its words.
SKETCH_BITS = 256
SKETCH = tuple(f"s{i}" for i in range(SKETCH_BITS // 64))
STEP_BYTES = 1 << 18
#: Band keys that a task sorts at once; bits of a chunk of the filter of places.
KEYS, CHUNK_BITS = 1 << 19, 1 << 21


def digests(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a cryptographic digest of each line."""
    joined = b"".join([hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest() for line in lines])
    both = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Lines:
    """Lines of a list of texts: ``row``, ``number`` in the row, ``starts`` and ``ends`` in ``codes``, and ``worded``."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(self.codes == 10)
        self.starts = np.concatenate([[0], breaks + 1])
        self.ends = np.append(breaks, len(self.codes))
        counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        solid = np.concatenate([[0], np.cumsum(~((self.codes == 32) | ((self.codes >= 9) & (self.codes <= 13))))])
        self.worded = solid[self.ends] > solid[self.starts]
        self._lines = joined.split("\n")

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each of the lines ``at``."""
        return digests([self._lines[i] for i in at.tolist()])

    def shingles(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes of the lines ``at``, number of each line's); repeats within a line are not removed."""
        s, e = self.starts[at], self.ends[at]
        n = np.maximum(e - s - size + 1, 1)
        begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        factor = K.salts(size, 0x11AE)
        with np.errstate(over="ignore"):
            codes = np.concatenate([self.codes, np.zeros(size, np.uint32)]).astype(K.U64) + K.U64(1)
            every = codes[: len(self.codes) + 1] * factor[0]
            for k in range(1, size):
                every += codes[k : k + len(self.codes) + 1] * factor[k]
            h = every[begin]
            place = np.cumsum(n) - n
            for i in np.flatnonzero(e - s < size).tolist():  # the whole line is its one shingle
                line = codes[s[i] : e[i]]
                h[place[i]] = (line * factor[: len(line)]).sum(dtype=K.U64) + K.U64(len(line))
            return K.mix(h), n


def _text_steps(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = K.buffers(column)
    for a, b in K.row_slices(offsets, STEP_BYTES):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def _first_lines(texts: list[str]) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines, and of the first occurrence of each worded line of a text its place in them, both halves of its digest and its occurrences in the text."""
    lines = Lines(texts)
    at = np.flatnonzero(lines.worded)
    k1, k2 = lines.keys(at)
    order = np.lexsort((lines.number[at], k2, k1, lines.row[at]))
    r, x, y = lines.row[at][order], k1[order], k2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    firsts = np.flatnonzero(new)
    return lines, at[order[firsts]], x[firsts], y[firsts], np.diff(np.append(firsts, len(order)))


def line_places(docs: DataFrame) -> DataFrame:
    """id, line, k1, k2 and copies of the first occurrence of each worded line of a row; copies counts its occurrences there."""

    @K.releasing
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _text_steps(batch.column(1)):
                lines, at, k1, k2, copies = _first_lines(texts)
                ids = batch.column(0).slice(a, b - a).take(pa.array(lines.row[at]))
                yield K.batch({"id": ids, "line": pa.array(lines.number[at].astype(np.int32)), "k1": pa.array(k1), "k2": pa.array(k2), "copies": pa.array(copies.astype(np.int32))})

    return docs.mapInArrow(name, f"id {docs.schema['id'].dataType.simpleString()}, line int, k1 long, k2 long, copies int")


def line_signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, line, k1, k2, set size n, words of the set's sketch and a key per band of the first occurrence of each worded line of a row."""
    names = [f"b{i}" for i in range(bands)]

    @K.releasing
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _text_steps(batch.column(1)):
                lines, at, k1, k2, _ = _first_lines(texts)
                if not len(at):
                    continue
                members, n = lines.shingles(at, shingle)
                keys = band_keys(members, n, bands, rows)
                members, owner = K.distinct(members, np.repeat(np.arange(len(n)), n))
                sketch = parities(members, owner, len(n), SKETCH_BITS)
                ids = batch.column(0).slice(a, b - a).take(pa.array(lines.row[at]))
                made = {"id": ids, "line": pa.array(lines.number[at].astype(np.int32)), "k1": pa.array(k1), "k2": pa.array(k2), "n": pa.array(np.bincount(owner, minlength=len(n)))}
                made |= {c: pa.array(np.ascontiguousarray(sketch[:, i])) for i, c in enumerate(SKETCH)}
                yield K.batch(made | {c: pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i, c in enumerate(names)})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, line int, k1 long, k2 long, n long, " + ", ".join(f"{c} long" for c in (*SKETCH, *names)))


def place_hashes(ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A hash of each place in a document, from a hash of its id and the number of its line."""
    with np.errstate(over="ignore"):
        return K.mix(ids.view(K.U64) ^ K.mix(lines.astype(K.U64) + K.U64(1)))


def _filter_bits(places: np.ndarray, chunks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chunk of the filter that each place belongs to, and its bits there."""
    with np.errstate(over="ignore"):
        bits = K.mix(places + K.U64(0x9E3779B97F4A7C15))
    return ((places >> K.U64(32)) * K.U64(chunks)) >> K.U64(32), [(bits >> K.U64(21 * i)) & K.U64(CHUNK_BITS - 1) for i in range(3)]


def place_filter(places: DataFrame, rows: int) -> bytes:
    """A Bloom filter of ``places`` (id, line), in chunks that are built apart: two bytes a place."""
    chunks = max(1, -(-rows * 16 // CHUNK_BITS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = place_hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield K.batch({"chunk": pa.array(_filter_bits(place, chunks)[0].astype(np.int32)), "place": pa.array(place.view(np.int64))})

    def build(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        made = np.zeros(CHUNK_BITS, np.uint8)
        for bit in _filter_bits(table.column("place").to_numpy().view(K.U64), chunks)[1]:
            made[bit] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(made, bitorder="little").tobytes()])})

    dealt = places.select(F.xxhash64("id"), "line").mapInArrow(deal, "chunk int, place long")
    found = {r["chunk"]: bytes(r["bits"]) for r in dealt.groupBy("chunk").applyInArrow(build, "chunk int, bits binary").collect()}
    return b"".join(found.get(c, bytes(CHUNK_BITS // 8)) for c in range(chunks))


def line_texts(docs: DataFrame, wanted: DataFrame, unique: bool) -> DataFrame:
    """(node, text) of the lines ``wanted`` (node, id, line, k1; written); where ids are ``unique``, each is found once.

    Documents stay where they are: a filter of the places goes to them, and only
    the lines that it lets through are joined, which leaves the wanted ones.
    """
    bits = docs.sparkSession.sparkContext.broadcast(place_filter(wanted, wanted.count()))

    @K.releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        chunks = len(table) * 8 // CHUNK_BITS
        for batch in batches:
            for a, b in K.row_slices(K.buffers(batch.column(1))[1], STEP_BYTES):
                data, offsets = K.buffers(batch.column(1).slice(a, b - a))
                breaks = np.flatnonzero(data == 10)
                first = np.searchsorted(breaks, offsets)
                counts = np.diff(first) + 1
                row = np.repeat(np.arange(b - a), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                chunk, probes = _filter_bits(place_hashes(batch.column(2).slice(a, b - a).to_numpy()[row], number), chunks)
                passed = np.ones(len(row), dtype=bool)
                for bit in probes:
                    at = chunk * K.U64(CHUNK_BITS) + bit
                    passed &= (table[at >> K.U64(3)] >> (at & K.U64(7)).astype(np.uint8)) & 1 == 1
                row, number = row[passed], number[passed]
                at = first[row] + number
                inner = np.append(breaks, 0)  # where a row's first line starts or its last one ends, its offsets count
                starts = np.where(number == 0, offsets[row], inner[at - 1] + 1)
                ends = np.where(number == counts[row] - 1, offsets[row + 1], inner[np.minimum(at, len(breaks))])
                raw = data.tobytes()
                found = [raw[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = batch.column(0).slice(a, b - a).take(pa.array(row))
                yield K.batch({"id": ids, "line": pa.array(number.astype(np.int32)), "k1": pa.array(digests(found)[0]), "text": pa.array(found, pa.string())})

    kind = docs.schema["id"].dataType.simpleString()
    found = docs.select("id", "text", F.xxhash64("id")).mapInArrow(cut, f"id {kind}, line int, k1 long, text string")
    found = found.join(wanted, ["id", "line", "k1"]).select("node", "text")  # k1 differs in a row that only shares the id
    return found if unique else found.dropDuplicates(["node"])


def band_buckets(distinct: DataFrame, names: list[str], keys: int = KEYS) -> DataFrame:
    """(key, node) for each key in the columns ``names`` of ``distinct`` (node) that several nodes have.

    A task sorts ``keys`` keys at once and packs them by ranges; those that it
    finds twice go through at once, and one mark tells the range of them. So a
    range sees a frequent key once from each such run, and keys never are rows
    of their own before it is known that they are shared.
    """
    parts = max(1, -(-distinct.count() * len(names) // keys))

    def runs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both by key, where each key's run starts, and how long it is."""
        order = np.argsort(key)
        key, node = key[order], node[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key, node, starts, np.diff(np.append(starts, len(key)))

    def packed(part: np.ndarray, sure: bool, key: list[np.ndarray], node: list[np.ndarray]) -> pa.RecordBatch:
        blobs = {c: pa.array([x.tobytes() for x in of], pa.binary()) for c, of in (("keys", key), ("nodes", node))}
        return K.batch({"part": pa.array(part.astype(np.int32)), "sure": pa.array([sure] * len(part), pa.bool_()), **blobs})

    @K.releasing
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sorted_out() -> Iterator[pa.RecordBatch]:
            key, node, starts, lengths = runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            twice = np.repeat(lengths > 1, lengths)
            if twice.any():
                yield packed(np.array([int(key[0]) % parts]), True, [key[twice]], [node[twice]])
            key, node = key[starts], np.where(lengths > 1, -1, node[starts])
            part = ((key >> K.U64(32)) * K.U64(parts)) >> K.U64(32)
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            yield packed(part[at], False, np.split(key, at[1:]), np.split(node, at[1:]))

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            node = batch.column(0).to_numpy()
            held += [(batch.column(i + 1).to_numpy().view(K.U64), node) for i in range(len(names))] if len(node) else []
            if sum(len(node) for _, node in held) >= keys:
                yield from sorted_out()
                held.clear()
        if held:
            yield from sorted_out()

    def gather(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sure = table.column("sure").to_numpy()
        of = lambda c, kind, which: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in table.column(c).filter(pa.array(which)).to_pylist()]])
        key, node, _, lengths = runs(of("keys", K.U64, ~sure), of("nodes", np.int64, ~sure))
        again = np.repeat(lengths > 1, lengths) & (node >= 0)
        both = np.concatenate([key[again], of("keys", K.U64, sure)]), np.concatenate([node[again], of("nodes", np.int64, sure)])
        return pa.table({"key": both[0].view(np.int64), "node": both[1]})

    dealt = distinct.select("node", *names).mapInArrow(deal, "part int, sure boolean, keys binary, nodes binary")
    return dealt.groupBy("part").applyInArrow(gather, "key long, node long")


def line_sets(shingle: int) -> Sets:
    def build(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = Lines(column.to_pylist())
        at = np.arange(len(column))
        members, n = lines.shingles(at, shingle)
        return K.distinct(members, np.repeat(at, n))

    return build


def line_components(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[DataFrame, DataFrame]:
    """(places, kept): every distinct line of each row of ``docs`` (id, text), and for each that isn't alone, by k1 and k2, the occurrence (to_id, to_line, with its own to_k1 and to_k2) that stays."""
    bands, rows = tune(threshold[0] / threshold[1], recall, max_bands)
    names = [f"b{i}" for i in range(bands)]
    docs = docs.filter(F.col("id").isNotNull())
    places = staged(line_places(docs), "places")
    # Where rows repeat an id, the order by line needs structs, which aggregate by sorting.
    unique = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    first = [F.min("id").alias("id"), F.min_by("line", "id" if unique else F.struct("id", "line")).alias("line")]
    columns = ["n", *SKETCH, *names]
    # Equal lines agree in these columns; a maximum takes half the room of a first value in the aggregation's buffers.
    signatures = line_signatures(docs, shingle, bands, rows)
    distinct = numbered(signatures.groupBy("k1", "k2").agg(*first, *[F.max(c).alias(c) for c in columns], F.count(F.lit(1)).alias("rows")), "distinct")

    buckets = staged(band_buckets(distinct, names), "buckets")
    active = distinct.select("node", "id", "line", "k1", "n", F.array(*SKETCH).alias("sketch")).join(buckets.select("node").distinct(), "node")
    active = staged(active, "active")

    held: list[DataFrame] = []

    def texts(nodes: DataFrame) -> DataFrame:
        """Texts of ``nodes``. All that is asked for after the first time are nodes of larger buckets, so one pass over the documents finds both."""
        if held:
            held.append(staged(held[0].join(small_side(staged(nodes, "nodes")), "node"), "some"))
            return held[-1]
        large = buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > TINY), "key")
        asked = nodes.unionByName(large.select("node")).distinct()
        wanted = staged(active.select("node", "id", "line", "k1").join(asked, "node"), "wanted")
        held.append(staged(line_texts(docs, wanted, unique), "texts", lasting=True))
        return held[0]

    def verify(pairs: DataFrame) -> DataFrame:
        return similar_pairs(pairs, texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), line_sets(shingle), threshold)

    labels = resolve(buckets, threshold, verify, active, sets=line_sets(shingle), texts=texts)
    discard(buckets, active, *held)
    place = F.struct("id", "line", "k1", "k2")
    in_component = staged(distinct.select("node", "k1", "k2", "id", "line").join(small_side(labels), "node").drop("node"), "in_component")
    stays = in_component.groupBy("component").agg(F.min(place).alias("stays"))
    moved = in_component.join(stays, "component").select("k1", "k2", *[F.col(f"stays.{c}").alias(f"to_{c}") for c in ("id", "line", "k1", "k2")])
    again = distinct.filter("rows > 1").select("k1", "k2", "id", "line").join(in_component.select("k1", "k2"), ["k1", "k2"], "left_anti")
    kept = staged(moved.unionByName(again.select("k1", "k2", *[F.col(c).alias(f"to_{c}") for c in ("id", "line", "k1", "k2")])), "kept")
    discard(distinct, in_component, labels)
    return places, kept


def removed_lines(docs: DataFrame, **parameters) -> DataFrame:
    """(id, n_lines, n_kept, removed) per document of ``docs`` (id, text) with a worded line; removed lists the distinct lines, by first place, that go in all their places but the one kept.

    ``stays`` tells for a listed line whether its first place stays, ``k1`` is half of its digest.
    """
    places, kept = line_components(docs, **parameters)
    same = [F.col(f"to_{c}") == F.col(c) for c in ("id", "line", "k1", "k2")]
    here = F.col("to_k1").isNull() | (same[0] & same[1] & same[2] & same[3])
    # Only lines that go in some place are listed, so the lists are built from few rows.
    rows = places.join(kept, ["k1", "k2"], "left").select("id", "line", "k1", "copies", here.alias("stays")).filter(~F.col("stays") | (F.col("copies") > 1))
    gone = rows.groupBy("id").agg(F.count_if(~F.col("stays")).alias("n_gone"), F.sort_array(F.collect_list(F.struct("line", "stays", "k1"))).alias("removed"))
    totals = places.groupBy("id").agg(F.sum("copies").cast("long").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"))
    nothing = F.array().cast(gone.schema["removed"].dataType)
    return totals.join(gone, "id", "left").select("id", "n_lines", (F.col("n_distinct") - F.coalesce("n_gone", F.lit(0))).alias("n_kept"), F.coalesce("removed", nothing).alias("removed"))


@F.arrow_udf(T.StringType())
def _rebuilt(text: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for t, marks in zip(text.to_pylist(), removed.to_pylist(), strict=True):
        if t is None or not marks:
            out.append(t)
            continue
        lines = t.split("\n")
        marks = [m for m in marks if m["line"] < len(lines)]
        keys, _ = digests([lines[m["line"]] for m in marks])
        # A mark whose digest differs belongs to another row of the same id.
        stays = {lines[m["line"]]: m["line"] if m["stays"] else -1 for m, k in zip(marks, keys.tolist(), strict=True) if k == m["k1"]}
        out.append("\n".join(line for i, line in enumerate(lines) if stays.get(line, i) == i))
    return pa.array(out, text.type)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **parameters) -> DataFrame:
    """``docs`` with their repeated lines taken out, and n_lines, n_kept (lines with a word, before and after).

    All rows stay, even those left without a line; columns named n_lines or
    n_kept are replaced.
    """
    marks = removed_lines(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), **parameters)
    marks = staged(marks.select(F.col("id").alias("__id"), F.col("n_lines").alias("__n"), F.col("n_kept").alias("__k"), F.col("removed").alias("__r")), "marks")
    inner, named = anonymous(docs)
    joined = inner.join(marks, named[key] == F.col("__id"), "left")
    columns = [_rebuilt(c.cast("string"), F.col("__r")).alias(name) if name == text else c.alias(name) for name, c in named.items() if name not in ("n_lines", "n_kept")]
    return joined.select(*columns, F.coalesce("__n", F.lit(0)).alias("n_lines"), F.coalesce("__k", F.lit(0)).alias("n_kept"))
