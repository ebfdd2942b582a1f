"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. A source's budget is first met in whole
passes, then in proportion over its lengths; what is left goes to a bounded
knapsack over the remaining counts by length, whose dynamic program is exact.
Of the documents of one length those with the smallest seeded hashes are taken,
so reruns agree.

A document with null text has length 0 and is never taken. Null is a source of
its own. Rows that agree in id and text share one decision. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.frames import anonymous
from docketlake.llm.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = 20240817
#: Words that the dynamic program may have to fit: bounds its table.
CAPACITY = 1 << 16
#: Documents of each short length that the proportional fill leaves to it.
GIVEN_BACK = 4
_HASH_BUCKETS_SHIFT = 56


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Weights repeat over the sources by code point, null last. All sizes are
    shared by weight; a share stops at ``passes`` times its source and the
    excess goes to the others by weight. That fixes one level for all: ordered
    by the level at which each source fills up, the first that doesn't fill at
    the level of those not yet filled sets it. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(passes))
    s = s.withColumn("fills_at", F.col("cap") / F.col("w"))
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    final = F.min(F.when(F.col("fills_at") >= F.col("level"), F.struct("fills_at", "level"))).over(everything)["level"]
    return s.withColumn("final", final).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, target: float, passes: int = MAX_PASSES) -> tuple[int, np.ndarray]:
    """(whole passes, extra documents per length) whose words come close to ``target`` from below.

    Closest, if the proportional fill leaves at most CAPACITY words; otherwise
    closest of what the counts left after the longest lengths allow.
    """
    sizes, counts = [int(s) for s in sizes], [int(c) for c in counts]
    total, extra = sum(s * c for s, c in zip(sizes, counts, strict=True)), [0] * len(sizes)
    budget = min(round(target), passes * total)
    if not total or budget <= 0:
        return 0, np.array(extra, np.int64)
    whole, rest = divmod(budget, total)
    if rest:
        extra = [c * rest // total if s else 0 for s, c in zip(sizes, counts, strict=True)]
        rest -= sum(s * k for s, k in zip(sizes, extra, strict=True))
        for slack in (CAPACITY // 2, 0):  # longest first, down to what the table holds
            for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
                if rest <= CAPACITY or not sizes[i]:
                    break
                k = min(counts[i] - extra[i], max(0, rest - slack) // sizes[i])
                extra[i] += k
                rest -= k * sizes[i]
        for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: sizes[i]):  # some short ones back, for the program to choose from
            k = min(extra[i], GIVEN_BACK)
            if rest + k * sizes[i] > CAPACITY:
                break
            extra[i] -= k
            rest += k * sizes[i]
        for i, k in _knapsack(sizes, [c - k for c, k in zip(counts, extra, strict=True)], min(rest, CAPACITY)):
            extra[i] += k
    return whole, np.array(extra, np.int64)


def _knapsack(sizes: list[int], counts: list[int], budget: int) -> list[tuple[int, int]]:
    """(item, copies) pairs whose size is the largest reachable sum up to ``budget``.

    Counts are split into powers of two, each used at most once; a sum keeps
    the part that first reached it, which leads back to sums of earlier parts.
    """
    parent = np.full(budget + 1, -1, np.int64)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in sorted((i for i in range(len(sizes)) if 0 < sizes[i] <= budget), key=lambda i: sizes[i]):
        left, step = min(counts[i], budget // sizes[i]), 1
        while left > 0 and not reached[budget]:
            step = min(step, left)
            amount = step * sizes[i]
            new = reached[: budget + 1 - amount] & ~reached[amount:]
            parent[amount:][new] = len(parts)
            reached[amount:] |= new
            parts.append((i, step))
            left -= step
            step *= 2
    chosen, at = [], int(np.flatnonzero(reached)[-1])
    while at:
        i, step = parts[parent[at]]
        chosen.append((i, step))
        at -= step * sizes[i]
    return chosen


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size", kind="stable")
    whole, extra = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), float(group["target"].iloc[0]))
    return pd.DataFrame({"skey": group["skey"], "size": group["size"], "n": group["n"], "source_size": group["source_size"], "target": group["target"], "whole": whole, "extra": extra})


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, with_text: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words taken, repeats counted).

    Columns of these names are replaced. The plan has a row per source and
    length; documents are joined to it once. Texts are counted once for the
    plan, and once more for the result; without the column of texts
    (``with_text``) only once, and what is counted is written.
    """
    results = ["size", "source_size", "target", "taken"]
    inner, named = anonymous(docs)
    added = {
        "source": named[source].cast("string"),
        "skey": F.coalesce(F.concat(F.lit("="), named[source].cast("string")), F.lit("")),
        "size": word_count(named[text].cast("string")),
        "__h": F.xxhash64(F.lit(seed), named[key], named[text]),
    }
    rows = inner.withColumns(added)
    if with_text:
        slim = staged(rows.select(*added), "sizes")
    else:
        named = {name: c for name, c in named.items() if name != text}
        slim = rows = staged(rows.select(*named.values(), *added), "sizes")
    counted = slim.withColumn("b", F.shiftright("__h", _HASH_BUCKETS_SHIFT)).groupBy("skey", "size", "b").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("source"))
    counted = staged(counted, "lengths")
    sizes = counted.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = staged(source_targets(sizes), "targets").withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    by_length = counted.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(targets.drop("source"), "skey")
    plan = by_length.groupBy("skey").applyInPandas(_fit_source, "skey string, size long, n long, source_size long, target double, whole long, extra long")
    plan = staged(plan, "plan")

    # The extra-th smallest hash of each length that is taken in part: first its bucket, then its rank in there.
    partial = plan.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select("skey", "size", "extra")
    upto = Window.partitionBy("skey", "size").orderBy("b")
    cumulated = counted.join(partial, ["skey", "size"]).withColumn("upto", F.sum("n").over(upto))
    edge = cumulated.filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra")))
    edge = edge.select("skey", "size", "b", (F.col("extra") - F.col("upto") + F.col("n")).alias("rank"))
    at_edge = slim.select("skey", "size", "__h", F.shiftright("__h", _HASH_BUCKETS_SHIFT).alias("b")).join(edge, ["skey", "size", "b"])
    ranked = at_edge.withColumn("r", F.row_number().over(Window.partitionBy("skey", "size", "b").orderBy("__h")))
    threshold = ranked.filter(F.col("r") == F.col("rank")).select("skey", "size", F.col("__h").alias("threshold"))
    plan = staged(plan.join(threshold, ["skey", "size"], "left"), "thresholds")

    extra = (F.col("extra") == F.col("n")) | (F.col("__h") <= F.col("threshold"))
    copies = F.col("whole") + F.when((F.col("extra") > 0) & extra, 1).otherwise(0)
    joined = rows.join(plan, ["skey", "size"])
    return joined.select(*[c.alias(name) for name, c in named.items() if name not in results], "size", "source_size", "target", (copies * F.col("size")).alias("taken"))
