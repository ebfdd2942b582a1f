"""N-gram Jaccard self-join by grouped prefixes, exact.

A document's set holds the hashes of its distinct word n-grams. Under one order
of all n-grams, two sets with a Jaccard index of at least t share a member of
their prefixes of |x| - ceil(t |x|) + 1 members. Documents with one and the same
set are a class; classes with identical prefix and size collapse into a group;
groups that share a prefix member and whose sizes and positions allow the index
are candidates, and are expanded into their members, which are screened by
sketches of their sets (without loss) and then verified on the whole sets
(module ``resolve``; links are found without testing all pairs of a large group
of copies). Texts are fetched again only for pairs that the sketches allow.

Any order is exact. N-grams that are frequent come last, so that prefixes hold
rare ones; the list of the most frequent is bounded, is counted over all
documents, and is only a hint.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. With fewer words than
n the whole sequence is the one member; without words the set is empty and
links with nothing. A row with a null id is measured but has no component of
its own: it takes that of its class. Classes are named by 128 bits over the
set, so rows that repeat an id are judged each by its own text. Null text
counts as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm import kernels as K
from docketlake.llm.resolve import at_least, resolve, sketches_allow
from docketlake.llm.sets import Sets, parities, similar_pairs
from docketlake.llm.storage import discard, numbered, small_side, staged

#: Bound of the list of frequent n-grams (8 bytes each), and the count in one step of a task from which one is reported.
FREQUENT, REPORTED = 1 << 16, 4
#: Bytes of text that a worker counts n-grams over, and in one step of all it does: a step's arrays take many times as much.
COUNT_BYTES, STEP_BYTES = 8 << 20, 1 << 20
#: Bits of a set's sketch, and of the finer one that sets of more members than that have beside it: a sketch tells sets apart up to about twice its bits.
SKETCH_BITS, FINE_BITS = 2048, 16384


def text_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, row) of the texts' sets, by row and then by member."""
    words = K.Words(data, offsets, lower=True)
    return K.distinct(*K.windows(words.hashes, words.first, size, short_whole=True))


def _steps(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.buffers(column)
    for a, b in K.row_slices(offsets, STEP_BYTES):
        yield a, b, *text_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def frequent_grams(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent n-grams of all documents, at most FREQUENT, sorted."""

    @K.releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.row_slices(K.buffers(batch.column(0))[1], COUNT_BYTES):
                members = [members for _, _, members, _ in _steps(batch.column(0).slice(a, b - a), size)]
                values, n = np.unique(np.concatenate(members), return_counts=True)
                often = n >= REPORTED
                yield K.batch({"gram": pa.array(values[often].view(np.int64)), "n": pa.array(n[often])})

    counted = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT)
    return np.sort(np.array([r[0] for r in top.select("gram").collect()], np.int64).view(K.U64))


def set_keys(members: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each of the consecutive sets of ``n`` members."""
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    keys = np.zeros(len(n), K.U64), np.zeros(len(n), K.U64)
    with np.errstate(over="ignore"):
        for key, salt in zip(keys, K.salts(2, 0xC1A55), strict=True):
            if full.any():
                key[full] = K.mix(np.add.reduceat(K.mix(members ^ salt), starts) + n[full].astype(K.U64))
    return keys[0].view(np.int64), keys[1].view(np.int64)


def profile(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """id, n, k1, k2 (128 bits that stand for the set), prefix and sketch of each of ``docs`` (id, text)."""
    p, q = threshold
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, size))

    @K.releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            for a, b, members, rows in _steps(batch.column(1), size):
                n = np.bincount(rows, minlength=b - a)
                starts = np.cumsum(n) - n
                place = np.searchsorted(often, members)
                is_often = np.zeros(len(members), dtype=bool)
                inside = place < len(often)
                is_often[inside] = often[place[inside]] == members[inside]
                # Rare members first; both kinds keep their order.
                rare = np.concatenate([[0], np.cumsum(~is_often)])
                rare_in_row = rare[starts + n] - rare[starts]
                first = starts[rows]
                place_rare = first + rare[:-1] - rare[first]
                place_often = first + rare_in_row[rows] + (np.arange(len(members)) - first) - (rare[:-1] - rare[first])
                ordered = np.empty_like(members)
                ordered[np.where(is_often, place_often, place_rare)] = members
                # |x| - ceil(t |x|) + 1 members, none of an empty set
                length = np.where(n > 0, n - (p * n + q - 1) // q + 1, 0)
                at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts, length)
                k1, k2 = set_keys(members, n)
                sketch = parities(members, rows, b - a, SKETCH_BITS)
                yield K.batch({
                    "id": batch.column(0).slice(a, b - a), "n": pa.array(n), "k1": pa.array(k1), "k2": pa.array(k2), "prefix": K.list_column(ordered[at], length),
                    "sketch": K.list_column(sketch.ravel(), np.full(b - a, sketch.shape[1])),
                })

    return docs.select("id", "text").mapInArrow(measure, f"id {docs.schema['id'].dataType.simpleString()}, n long, k1 long, k2 long, prefix array<long>, sketch array<long>")


def class_texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, text, n, sketch) of the classes ``wanted`` (node, id, k1, k2): of the rows with that id the one whose set has that name; only large sets have the finer sketch."""

    @K.releasing
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, members, rows in _steps(batch.column(1), size):
                n = np.bincount(rows, minlength=b - a)
                k1, k2 = set_keys(members, n)
                large = n > SKETCH_BITS
                inside = large[rows]
                sketch = parities(members[inside], (np.cumsum(large) - 1)[rows[inside]], int(large.sum()), FINE_BITS)
                fine = K.list_column(sketch.ravel(), np.where(large, FINE_BITS // 64, 0))
                yield K.batch({"k1": pa.array(k1), "k2": pa.array(k2), "text": batch.column(1).slice(a, b - a), "n": pa.array(n), "sketch": fine})

    ids = staged(wanted.select("id").distinct(), "ids")
    rows = docs.select("id", "text").join(small_side(ids), "id", "left_semi")
    named = rows.mapInArrow(name, "k1 long, k2 long, text string, n long, sketch array<long>").dropDuplicates(["k1", "k2"])
    return named.join(wanted.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "text", "n", "sketch")


def screened(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of ``pairs`` (a, b) those that finer sketches, where both sets have one, allow; texts of large sets are long, so they should travel for few pairs."""
    end = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    without = (F.size("a_sketch") == 0) | (F.size("b_sketch") == 0)
    return pairs.join(end("a"), "a").join(end("b"), "b").filter(without | sketches_allow(threshold, "a_", "b_")).select("a", "b")


def shingle_sets(size: int) -> Sets:
    def build(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return text_sets(*K.buffers(column), size)

    return build


def ngram_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_shingles and component_id of every row of ``docs``; ``threshold`` = (p, q) stands for p / q."""
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    profiles = staged(profile(docs, size, threshold), "profiles")
    named = profiles.filter((F.col("n") > 0) & F.col("id").isNotNull())
    g = F.xxhash64("prefix", "n").alias("g")
    classes = numbered(named.groupBy("n", "k1", "k2").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first(g).alias("g")), "classes")
    groups = staged(classes.groupBy("g", "n").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("node")), "groups")

    # Postings of a group's prefix say where in the prefix a member stands. A group of one class goes by its node, others by g and a negative n.
    alone = F.col("members") == 1
    prefixes = named.groupBy(g, "n").agg(F.first("prefix").alias("prefix")).join(groups, ["g", "n"])
    prefixes = staged(prefixes.select(F.when(alone, F.col("node")).otherwise(F.col("g")).alias("ref"), F.when(alone, F.col("n")).otherwise(-F.col("n")).alias("n"), "prefix"), "prefixes")
    postings = prefixes.select("ref", "n", F.posexplode("prefix").alias("pos", "key"))
    shared = staged(postings.groupBy("key").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("key"), "shared")
    met = staged(postings.join(shared, "key"), "postings")
    single = met.filter("n > 0").select("key", F.col("ref").alias("node"), "n", "pos")
    several = met.filter("n < 0").select("key", F.col("ref").alias("g"), (-F.col("n")).alias("n"), "pos")
    within = groups.filter("members > 1").select(F.xxhash64("g", "n", F.lit("group")).alias("key"), "g", "n", F.lit(0).alias("pos"))
    members = classes.select("g", "n", "node").join(groups.filter("members > 1").select("g", "n"), ["g", "n"])
    expanded = single.unionByName(several.unionByName(within).join(members, ["g", "n"]).select("key", "node", "n", "pos"))
    buckets = staged(expanded, "buckets")
    discard(groups, prefixes, shared, met)

    def may_link(x: str, y: str) -> Column:
        n, m, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
        return at_least(threshold, F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1), n, m)

    active = staged(classes.select("node", "id", "k1", "k2", "n", "sketch").join(buckets.select("node").distinct(), "node"), "active")

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = staged(active.select("node", "id", "k1", "k2").join(ends, "node"), "wanted")
        texts = staged(class_texts(docs, wanted, size), "texts")
        return similar_pairs(staged(screened(pairs, texts, threshold), "screened"), texts, shingle_sets(size), threshold)

    labels = resolve(buckets, threshold, verify, active, may_link)
    discard(buckets, active)
    labels = small_side(labels)
    smallest = classes.join(labels, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = classes.select("node", "k1", "k2", "id").join(labels, "node", "left").join(smallest, "component", "left")
    by_class = staged(by_class.select("k1", "k2", F.coalesce("component_id", "id").alias("component_id")), "by_class")
    joined = profiles.select("id", "n", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
