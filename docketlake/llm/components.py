"""Connected components, distributed.

Edges are first contracted within tasks of bounded size to stars around the
smallest node of each local component. Where more than one task is needed,
large-star and small-star steps alternate with that until the edges are stars
around the smallest node of each component. A step is a grouped minimum and a
join, so a node with very many edges is aggregated before the shuffle and its
join partition can be split; rows never exceed the edges. Steps are written to
the shared folder, which bounds the lineage, and a step's input is deleted when
the next is written. Steps go on until all are stars; every step that changes
something gives some node a smaller neighbour, so they end.

Ties don't arise, as nodes are compared whole; an empty table of edges gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.storage import discard, staged

#: Edges that a task contracts at once.
EDGES = 1 << 17


def _values(column: pa.Array) -> list:
    """The values of a column, those of a struct as tuples."""
    return list(zip(*(_values(c) for c in column.flatten()), strict=True)) if pa.types.is_struct(column.type) else column.to_pylist()


def local_stars(u: list, v: list) -> list[tuple[int, int]]:
    """For each node but the smallest of its component over the edges (u, v): where the node stands in u + v, and where its smallest one."""
    parent: dict = {}

    def find(x):
        while (p := parent[x]) != x:
            parent[x] = x = parent[p]
        return x

    place = {}
    for i, x in enumerate(u + v):
        if x not in place:
            place[x], parent[x] = i, x
    for a, b in zip(u, v, strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, place[r]) for x, i in place.items() if (r := find(x)) != x]


def _contracted(edges: DataFrame) -> DataFrame:
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            u, v = (table.column(i).chunk(0) for i in (0, 1))
            found = local_stars(_values(u), _values(v))
            both = pa.concat_arrays([u, v])
            return pa.RecordBatch.from_arrays([both.take(pa.array([p[i] for p in found], pa.int64())) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= EDGES:
                yield stars()
                held.clear()
        if held:
            yield stars()

    node = edges.schema["u"].dataType
    return edges.mapInArrow(contract, T.StructType([T.StructField("u", node), T.StructField("v", node)]))


def _star(pairs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(v, m) for each pair (u, v) with m the smallest of u and all its partners; and the table of minima."""
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima", rows)
    return pairs.join(least, "u"), least


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) to (node, component): a row per node with an edge, component its smallest reachable node.

    Null ends and loops are ignored; edges may repeat. Nodes may have any type
    with an order, or be structs of such.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = staged(e, name)
    while rows := e.count():
        tasks = -(-rows // EDGES)
        stars = staged(_contracted(e.coalesce(tasks)), name, rows)
        discard(e)
        e = stars
        if tasks == 1:
            break
        rows, nodes = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        # Done when each node has one edge and no node is both below and above another: all are stars.
        if rows == nodes and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _star(both, rows)
        large = staged(joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name, rows)
        discard(e, least)
        joined, least = _star(large, rows)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        e = staged(small, name, rows)
        discard(large, least)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
