"""From buckets of candidates to components of verified links.

Nodes that share a bucket are candidates. To test every pair within a bucket
would be quadratic in copies, so only buckets of a few nodes are tested pair by
pair at once. Of a larger one every node is tested against one hub, what passes
is linked, and buckets whose nodes are all in one component are dropped. What
is left is tested pair by pair, between components only: two candidates that
are similar end in one component, whichever step joins them. Buckets of many
nodes go through this in blocks of bounded size, and nodes of a bucket's
largest component meet only those outside of it. Blocks of short texts verify
them at once and pass on a spanning forest of the links. Blocks of long texts
hold sketches of their sets instead: they first pass on a spanning forest of
the pairs that the sketches allow, to be verified, and only then the allowed
pairs between what are still different components. Sketches lose no link.

Nodes are numbers of distinct contents, so ties can't arise; an empty table of
buckets gives no labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.components import connected_components
from docketlake.llm.sets import Sets
from docketlake.llm.storage import discard, discard_since, staged, written

#: Further hub rounds run while pairs left outnumber bucket rows by this factor.
PAIRS_PER_ROW = 256
MAX_HUB_ROUNDS = 3
#: Buckets of at most TINY nodes are tested at once; those of more than SMALL are compared in blocks of at most BLOCK, or TEXT_BLOCK where these hold texts.
TINY, SMALL, BLOCK, TEXT_BLOCK = 6, 64, 1024, 256

#: Of pairs (a, b) those that are links.
Verify = Callable[[DataFrame], DataFrame]


def _relabel(labels: DataFrame | None, found: DataFrame, rows: int) -> DataFrame:
    """Labels (node, component) after links (a, b) between nodes: only what they join is worked on."""
    if labels is None:
        return staged(connected_components(found), "labels", rows)
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = ends.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    known = staged(labels.unionByName(fresh), "known", rows)
    end = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    joins = found.join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = staged(connected_components(joins), "merged", rows)
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    out = staged(known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels", rows)
    discard(labels, known, merged)
    return out


def block_links(members: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether the sets ``left`` and ``right`` of a group are similar, for pairs of different labels; counts members in common by products of 0/1 tables."""
    p, q = threshold
    size = np.bincount(rows, minlength=len(label))
    values, number = np.unique(members, return_inverse=True)
    shared = np.bincount(number, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    rows, column = rows[keep], column[number[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        inside = (column >= start) & (column < start + 4096)
        table = np.zeros((len(label), 4096), np.float32)
        table[rows[inside], column[inside] - start] = 1
        common += table[left] @ table[right].T
    total = size[left][:, None] + size[right][None]
    return (common > 0) & ((p + q) * common.astype(np.int64) >= p * total) & (label[left][:, None] != label[right][None])


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of at most one link per place, which together join all that the links join: a breadth-first forest over them."""
    parent, out = np.full(n, -1), []
    columns, rows = links.T.copy(), links
    at_left, at_right = np.full(n, -1), np.full(n, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    linked = np.zeros(n, dtype=bool)
    linked[left[links.any(axis=1)]] = linked[right[links.any(axis=0)]] = True
    for root in np.flatnonzero(linked).tolist():
        if parent[root] >= 0:
            continue
        parent[root], queue = root, [root]
        for x in queue:
            near = [right[rows[at_left[x]]]] if at_left[x] >= 0 else []
            near += [left[columns[at_right[x]]]] if at_right[x] >= 0 else []
            for y in np.unique(np.concatenate(near)).tolist():
                if parent[y] < 0:
                    parent[y] = x
                    queue.append(y)
                    out.append((x, y))
    ends = np.array(out, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def sketch_links(sketch: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether sizes and sketches allow the sets ``left`` and ``right`` to be similar, for pairs of different labels."""
    p, q = threshold
    out = np.zeros((len(left), len(right)), dtype=bool)
    for start in range(0, len(left), 32):
        part = left[start : start + 32]
        apart = np.bitwise_count(sketch[part][:, None] ^ sketch[right][None]).sum(axis=2, dtype=np.int64)
        total = size[part][:, None] + size[right][None]
        out[start : start + 32] = ((p + q) * ((total - apart) // 2) >= p * total) & (label[part][:, None] != label[right][None])
    return out


def _blocked(rows: DataFrame, threshold: tuple[int, int], sets: Sets | None, every_pair: bool) -> DataFrame:
    """(a, b) over large buckets (key, size, most, top, node, label), block by block.

    With ``sets`` and a column text, a spanning forest of the links; without,
    with columns n and sketch, a spanning forest of the pairs that these allow,
    or with ``every_pair`` all of them.
    """

    def compare(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        own, label, node = column("own").to_numpy(), column("label").to_numpy(), column("node").to_numpy()
        i, j = column("i")[0].as_py(), column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right) and (label != label[0]).any():
            if sets is not None:
                links = block_links(*sets(column("text")), left, right, label, threshold)
            else:
                sketch = column("sketch").flatten().to_numpy().view(np.uint64).reshape(len(own), -1)
                links = sketch_links(sketch, column("n").to_numpy(), left, right, label, threshold)
            if every_pair:
                x, y = np.nonzero(links)
                a, b = left[x], right[y]
                once = (a < b) if i == j else np.ones(len(a), dtype=bool)
                a, b = a[once], b[once]
            else:
                a, b = spanning(links, left, right, len(own))
        a, b = node[a], node[b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    carried, block = (["n", "sketch"], BLOCK) if sets is None else (["text"], TEXT_BLOCK)
    # Blocks 0 to nd - 1 hold the largest component, which meets only the nr blocks of the rest.
    top = F.col("label") == F.col("top")
    nd, nr = F.ceil(F.col("most") / block).cast("int"), F.ceil((F.col("size") - F.col("most")) / block).cast("int")
    h = F.xxhash64("node")
    own = F.when(top, F.pmod(h, nd)).otherwise(nd + F.pmod(h, nr)).cast("int")
    placed = rows.select("key", "node", "label", *carried, own.alias("own"), F.explode(F.sequence(F.when(top, nd).otherwise(0), nd + nr - 1)).alias("other"))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", *carried)
    return placed.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def resolve(buckets: DataFrame, threshold: tuple[int, int], verify: Verify, content: DataFrame, may_link: Callable[[str, str], Column] | None = None, sets: Sets | None = None, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of all nodes with a link.

    ``buckets`` (a written table): key, node (a long) and what ``may_link``
    needs, which takes prefixes of the columns of two bucket rows and gives a
    cheap necessary condition; ``verify`` tells which pairs are links;
    ``content`` (written too) has each node's n and sketch, the size and the
    sketch of its set; where texts are short, ``sets`` makes the sets of a
    column of them and ``texts`` finds those of a table of nodes.
    """
    extra = [c for c in buckets.columns if c not in ("key", "node")]
    condition = may_link or (lambda x, y: F.lit(True))
    rows, labels = buckets.count(), None
    content = content.select("node", "n", "sketch")
    ordered = [F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")]
    side = lambda of, x: of.select("key", *[F.col(c).alias(f"{x}{c}") for c in of.columns if c != "key"])

    def link(pairs: DataFrame, also: DataFrame | None = None) -> None:
        """Screen the pairs by the sketches, verify them, add the links (``also`` are some), and merge labels."""
        nonlocal labels
        end = lambda x: content.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
        allowed = staged(pairs.distinct().join(end("a"), "a").join(end("b"), "b").filter(sketches_allow(threshold, "a_", "b_")).select("a", "b"), "allowed")
        mark = written()
        found = verify(allowed)
        found = staged(found if also is None else found.unionByName(also), "links")
        discard_since(mark, found)
        labels = _relabel(labels, found, rows)
        discard(allowed, found)

    def hubs(of: DataFrame, turn: int) -> DataFrame:
        """The smallest node of each bucket, in later rounds the one of the smallest hash, as columns y_."""
        rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        picked = [(F.min("node") if c == "node" and turn == 0 else F.min_by(c, rank)).alias(f"y_{c}") for c in of.columns if c in ("node", "label", *extra)]
        return of.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *picked)

    def still_open(of: DataFrame) -> tuple[DataFrame | None, int]:
        """``of`` with label, and size, top and most of the largest component, in buckets with several components; and the pairs between these."""
        labelled = staged(of.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled", rows)
        per_label = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        per_key = per_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max("n").alias("most"), F.max_by("label", "n").alias("top"))
        pairs = ((F.col("size") * F.col("size") - F.col("squares")) / 2).alias("pairs")
        keys = staged(per_key.filter("labels > 1").select("key", "size", "most", "top", pairs), "open", rows)
        left = keys.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        kept = staged(labelled.join(keys.drop("pairs"), "key"), "open_rows", rows) if left else None
        discard(labelled, keys)
        return kept, left

    # Tiny buckets pair by pair, the others against their hubs; of a pair of nodes one is the hub.
    met = staged(side(buckets, "x_").join(hubs(buckets, 0), "key"), "met", rows)
    to_hub = met.filter((F.col("x_node") != F.col("y_node")) & condition("x_", "y_")).select(*ordered)
    tiny = met.filter(F.col("size").between(3, TINY)).select("key", *[F.col(f"x_{c}").alias(c) for c in ("node", *extra)])
    among = side(tiny, "x_").join(side(tiny, "y_"), "key").filter((F.col("x_node") < F.col("y_node")) & condition("x_", "y_")).select(*ordered)
    link(to_hub.unionByName(among))
    rest = staged(met.filter(F.col("size") > TINY).select("key", *[F.col(f"x_{c}").alias(c) for c in ("node", *extra)]), "rest", rows)
    discard(met)
    turn = 0
    while True:
        turn += 1
        now, left = still_open(rest)
        if now is None:
            discard(rest)
            return labels
        if left <= PAIRS_PER_ROW * rows or turn >= MAX_HUB_ROUNDS:
            break
        of = now.select("key", "node", "label", *extra)
        link(side(of, "x_").join(hubs(of, turn), "key").filter((F.col("x_label") != F.col("y_label")) & condition("x_", "y_")).select(*ordered))
        discard(now)

    few = now.filter(F.col("size") <= SMALL).select("key", "node", "label", *extra)
    between = (F.col("x_node") < F.col("y_node")) & (F.col("x_label") != F.col("y_label")) & condition("x_", "y_")
    # Sketches go along, so that a bucket makes no rows of its pairs but those that they allow.
    few = staged(few.join(content.select(*[c for c in content.columns if c == "node" or c not in few.columns]), "node"), "few", rows)
    among = side(few, "x_").join(side(few, "y_"), "key").filter(between & sketches_allow(threshold, "x_", "y_")).select(*ordered)
    of_many = now.filter(F.col("size") > SMALL).select("key", "size", "most", "top", "node", "label")
    if sets is not None:
        held = of_many.join(texts(of_many.select("node").distinct()), "node")
        link(among, _blocked(held, threshold, sets, False))
        discard(now, few, rest)
        return labels
    held = lambda df: df.join(content, "node")
    many = staged(of_many.select("key", "node"), "many", rows)
    link(among.unionByName(_blocked(held(of_many), threshold, None, False)))
    discard(now, few, rest)
    now, left = still_open(many)
    if now is not None:
        link(_blocked(held(now), threshold, None, True))
    discard(now, many)
    return labels


def at_least(threshold: tuple[int, int], common: Column, a: Column, b: Column) -> Column:
    """common / (a + b - common) >= p / q in integers, for ``threshold`` = (p, q)."""
    p, q = threshold
    return (p + q) * common >= p * (a + b)


def sketches_allow(threshold: tuple[int, int], x: str, y: str) -> Column:
    """Whether sizes and sketches of two nodes, columns with these prefixes, allow the index."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    apart = F.aggregate(F.zip_with(f"{x}sketch", f"{y}sketch", lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, v: total + v)
    return at_least(threshold, F.least(n, m), n, m) & at_least(threshold, F.floor((n + m - apart) / 2), n, m)
