"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the pairs
of codewords are the cells of a product grid, and every vector is indexed in
its cell. From a vector the cells are visited by multi-sequence order, nearest
sum of half distances first, up to a number of cells fixed so that vectors at
the threshold are met with the target recall. That number and the codebooks
come from a bounded sample; the index holds every row. What is met within the
same label is verified by cosine in double precision.

Equal vectors of one label collapse into a class with a count. Cells are cut
into blocks of bounded size, so a task never holds more than two blocks, and
passes on sums and a spanning forest of its links instead of the links.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label or id, link with nothing (their component is their own
id). Vectors of different length never link. Rows that repeat an id with one
vector count as further vectors. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.components import connected_components
from docketlake.llm.storage import staged

THRESHOLD = 0.93
TARGET_RECALL = 0.995
#: Rows the codebooks and the number of visited cells are fitted to, at most.
SAMPLE = 4096
#: Vectors a cell should hold for one label, and bounds of a half's codebook.
PER_CELL, MAX_CODEWORDS = 16, 1024
#: Vectors of a block: a task compares one block of visitors with one of residents.
BLOCK = 1024
ROUNDS = 8


def unit_rows(flat: np.ndarray, width: int) -> np.ndarray:
    x = np.asarray(flat, np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres of the rows of ``x``; at most as many as there are distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        nearest = _distances(x, centres).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        full = count > 0
        centres[full] = sums[full] / count[full][:, None]
    return centres


class Grid:
    """Two codebooks and the order in which a vector visits their product."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.visits = first, second, 1

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to both codebooks, with rows cut or filled with zeros to the fitted width."""
        if x.shape[1] < self.width:
            x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        half = self.first.shape[1]
        return _distances(x[:, :half], self.first), _distances(x[:, half : self.width], self.second)

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first: the first column is a row's own cell.

        In the multi-sequence order a cell (i, j), by rank in its two lists, comes
        after all (i', j') with i' <= i and j' <= j. So the first n cells are
        among those with (i + 1) (j + 1) <= n, and of these the n smallest sums
        are taken; ties go by rank.
        """
        d1, d2 = self.halves(x)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        i, j = np.meshgrid(np.arange(d1.shape[1]), np.arange(d2.shape[1]), indexing="ij")
        reachable = ((i + 1) * (j + 1) <= n).ravel()
        i, j = i.ravel()[reachable], j.ravel()[reachable]
        sums = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        n = min(n, len(i))
        best = np.argsort(sums, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(o1, i[best], 1) * self.second.shape[0] + np.take_along_axis(o2, j[best], 1)


def fit_grid(sample: np.ndarray, rows: int, labels: int, threshold: float, recall: float) -> Grid:
    """Codebooks fitted to unit vectors, and the visits that reach the recall for vectors at the threshold.

    Visits are found on the sample's own vectors, each turned in a random
    direction by exactly the threshold's angle: the hardest links there are.
    """
    half = sample.shape[1] // 2
    k = int(np.clip(np.ceil(np.sqrt(rows / max(1, labels) / PER_CELL)), 1, min(MAX_CODEWORDS, max(1, len(sample) // 8))))
    grid = Grid(codebook(sample[:, :half], k, 1), codebook(sample[:, half:], k, 2))
    cells = len(grid.first) * len(grid.second)
    if cells == 1:
        return grid
    rng = np.random.default_rng(3)
    x = sample[rng.permutation(len(sample))[:1024]]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    turned = threshold * x + np.sqrt(1 - threshold**2) * noise / np.where(length > 0, length, 1)
    own = grid.cells(turned, 1)[:, :1]
    n = 1
    while True:
        n = min(cells, n * 2)
        met = grid.cells(x, n) == own
        rank = np.where(met.any(axis=1), met.argmax(axis=1), cells)
        if n == cells or (rank < n).mean() >= recall:
            order = np.sort(rank)
            grid.visits = int(min(n, order[min(len(order) - 1, int(np.ceil(recall * len(order))) - 1)] + 1))
            return grid


def _matrix(column: pa.Array) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False), int(column.value_lengths()[0].as_py()))


#: More than single precision can be off for unit vectors.
MARGIN = 1e-3


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` (unit vectors) have a cosine of at least the threshold: screened in single precision, decided in double."""
    links = x.astype(np.float32) @ y.astype(np.float32).T >= threshold - MARGIN
    i, j = np.nonzero(links)
    for start in range(0, len(i), 1 << 15):
        a, b = i[start : start + (1 << 15)], j[start : start + (1 << 15)]
        links[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return links


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), over the bipartite ``links``, for nodes with a link."""
    big = np.iinfo(np.int64).max
    of_left, of_right = left.copy(), right.copy()
    while True:
        to_right = np.minimum(of_right, np.where(links, of_left[:, None], big).min(axis=0))
        to_left = np.minimum(of_left, np.where(links, to_right[None], big).min(axis=1))
        if (to_right == of_right).all() and (to_left == of_left).all():
            break
        of_left, of_right = to_left, to_right
    a, b = links.any(axis=1), links.any(axis=0)
    return np.concatenate([left[a], right[b]]), np.concatenate([of_left[a], of_right[b]])


def classes_of(vectors: DataFrame) -> DataFrame:
    """(node, label, dim, embedding, copies): distinct usable vectors per label; node is the smallest id."""
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.filter(usable & finite & F.exists("embedding", lambda v: v != 0))
    return rows.groupBy("label", "embedding").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding"))


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, n_links, component_id and kept of every row of ``vectors``."""
    spark = vectors.sparkSession
    # Vectors travel as they are stored; adding 0 makes -0.0 and 0.0 equal.
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    plain = F.transform(F.col(embedding), lambda v: v.cast(kind) + F.lit(0).cast(kind))
    rows = vectors.select(F.col(key).cast("long").alias("id"), plain.alias("embedding"), F.col(label).cast("string").alias("label"))
    classes = staged(classes_of(rows), "classes")
    total, labels, width = classes.agg(F.count(F.lit(1)), F.approx_count_distinct("label"), F.max("dim")).first()
    if not total:
        return vectors.select(F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    hashed = classes.select(F.xxhash64("node").alias("h"), "node", "embedding")
    chosen = hashed.select("h").orderBy("h").limit(SAMPLE).collect()
    sample = sorted(hashed.filter(F.col("h") <= chosen[-1]["h"]).limit(2 * SAMPLE).select("h", "embedding").collect())
    sample = [(r["embedding"],) for r in sample]
    units = [unit_rows(np.array(r[0]), len(r[0]))[0] for r in sample]
    width = max(2, width if width == len(units[0]) else max(map(len, units)))
    fitted = spark.sparkContext.broadcast(fit_grid(np.stack([np.pad(u, (0, width - len(u))) for u in units]), total, labels, threshold, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = fitted.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                dims = part.column(2).to_numpy()
                visits = [None] * part.num_rows
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    for i, v in zip(at, grid.cells(_matrix(part.column(3).take(pa.array(at))), grid.visits).tolist(), strict=True):
                        visits[i] = v
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*part.schema.names, "visits"])

    placed = classes.select("node", "label", "dim", "embedding", "copies")
    placed = staged(placed.mapInArrow(place, f"node long, label string, dim int, embedding array<{kind}>, copies long, visits array<int>"), "placed")

    # Blocks of a cell's residents, and of the visitors to a cell: numbered by hash, as many as the counts ask for.
    resident = F.element_at("visits", 1)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    visiting = placed.select("label", "dim", F.explode("visits").alias("cell"))
    sizes = placed.groupBy("label", "dim", resident.alias("cell")).agg(blocks(F.count(F.lit(1))).alias("resident_blocks"))
    visitors = visiting.groupBy("label", "dim", "cell").agg(blocks(F.count(F.lit(1))).alias("visitor_blocks"))
    cells = staged(sizes.join(visitors, ["label", "dim", "cell"]), "cells")
    number = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    common = ["node", "embedding", "copies", "visits"]
    residents = placed.withColumn("cell", resident).join(cells, ["label", "dim", "cell"]).withColumns({"rb": number(F.col("resident_blocks"), 1), "vb": F.explode(F.sequence(F.lit(0), F.col("visitor_blocks") - 1))})
    guests = placed.withColumn("cell", F.explode("visits")).join(cells, ["label", "dim", "cell"]).withColumns({"vb": number(F.col("visitor_blocks"), 2), "rb": F.explode(F.sequence(F.lit(0), F.col("resident_blocks") - 1))})
    group = ["label", "dim", "cell", "rb", "vb"]
    columns = lambda df, side: df.select(*[F.col(c).cast("long") if c in ("rb", "vb") else F.col(c) for c in group], F.lit(side).alias("resident"), *common)

    def compare(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("resident").to_numpy(zero_copy_only=False).astype(bool)
        empty = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if side.all() or not side.any():
            return empty
        here, guest = table.filter(pa.array(side)), table.filter(pa.array(~side))
        part = lambda t, c: t.column(c).combine_chunks()
        x, y = _matrix(part(guest, "embedding")), _matrix(part(here, "embedding"))
        gid, hid = (part(t, "node").to_numpy() for t in (guest, here))
        gn, hn = (part(t, "copies").to_numpy() for t in (guest, here))
        links = _linked(x, y, threshold) & (gid[:, None] != hid[None])
        if not links.any():
            return empty
        # A link counts for the visitor; for the resident it counts here only if it doesn't visit the visitor's cell itself.
        visits = part(here, "visits")
        seen = visits.flatten().to_numpy().reshape(len(hid), -1)
        own = part(guest, "visits").flatten().to_numpy().reshape(len(gid), -1)[:, 0]
        cells_met, at = np.unique(own, return_inverse=True)
        returned = np.stack([(seen == c).any(axis=1) for c in cells_met])[at]
        for_guest = (links * hn[None]).sum(axis=1)
        for_here = ((links & ~returned) * gn[:, None]).sum(axis=0)
        node, least = _forest(links, gid, hid)
        split = node != least
        return pa.table({
            "node": np.concatenate([gid, hid, node[split]]),
            "n": np.concatenate([for_guest, for_here, np.zeros(split.sum(), np.int64)]).astype(np.int64),
            "other": pa.concat_arrays([pa.nulls(len(gid) + len(hid), pa.int64()), pa.array(least[split])]),
        })

    both = columns(residents, True).unionByName(columns(guests, False))
    found = staged(both.groupBy(*group).applyInArrow(compare, "node long, n long, other long"), "found")
    counts = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    labels_of = connected_components(found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    # Rows find their class by two hashes of the vector instead of the vector.
    named_by = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")]
    per_class = classes.select("label", *named_by, "node", "copies").join(counts, "node", "left").join(labels_of, "node", "left")
    per_class = per_class.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    per_class = staged(per_class, "per_class")
    named = rows.select("id", "label", *named_by).join(per_class, ["label", "h1", "h2"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return named.select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
