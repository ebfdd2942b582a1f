"""Distributions, rates and series over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.derive import METRICS, bin_rank, metric_label, quarter_key
from docketlake.schema import BINS, COMPLETENESS, OTHER, OUTCOMES, TOP_CATEGORIES, UNKNOWN


def tally() -> list[Column]:
    """count, approved and denied."""
    return [F.count(F.lit(1)).alias("count"), F.count_if(F.col("outcome") == "approved").alias("approved"), F.count_if(F.col("outcome") == "denied").alias("denied")]


def label_counts(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, label, count, approved, denied, newest): label is null where unknown.

    All metrics in one pass: a record becomes a row per metric, which the
    partial aggregation folds again before the shuffle.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), metric_label(m).alias("label")) for m in metrics]))
    long = df.select("outcome", "created_utc", rows.alias("m")).select("outcome", "created_utc", "m.metric", "m.label")
    return long.groupBy("metric", "label").agg(*tally(), F.max(F.coalesce("created_utc", F.lit(0))).alias("newest"))


def distributions(df: DataFrame, metrics: tuple[str, ...] = METRICS, hide_unknown: bool = False) -> DataFrame:
    """(metric, ord, label, count, approved, denied) for charts.

    A number has all its bins in order, empty ones too. A label has the nine
    most frequent (ties: newest record first, then name), the rest and a label
    "Other" as one "Other". "Unknown" comes last, if there is any and it isn't
    hidden.
    """
    counts = label_counts(df, metrics)
    sums = [F.sum(c).alias(c) for c in ("count", "approved", "denied")]
    parts = []
    if categorical := [m for m in metrics if m not in BINS]:
        named = counts.filter(F.col("metric").isin(*categorical) & F.col("label").isNotNull())
        order = Window.partitionBy("metric", F.col("label") == OTHER).orderBy(F.desc("count"), F.desc("newest"), "label")
        ranked = named.withColumn("rank", F.row_number().over(order))
        tail = (F.col("label") == OTHER) | (F.col("rank") > TOP_CATEGORIES)
        folded = ranked.select("metric", F.when(tail, TOP_CATEGORIES).otherwise(F.col("rank") - 1).alias("ord"), F.when(tail, OTHER).otherwise(F.col("label")).alias("label"), "count", "approved", "denied")
        parts.append(folded.groupBy("metric", "ord", "label").agg(*sums))
    if numeric := [m for m in metrics if m in BINS]:
        bins = df.sparkSession.createDataFrame([(m, i, b[0]) for m in numeric for i, b in enumerate(BINS[m])], "metric string, ord int, label string")
        joined = F.broadcast(bins).join(counts.filter(F.col("metric").isin(*numeric)), ["metric", "label"], "left")
        parts.append(joined.select("metric", "ord", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "approved", "denied")]))
    if not hide_unknown:
        parts.append(counts.filter(F.col("label").isNull()).select("metric", F.lit(99).alias("ord"), F.lit(UNKNOWN).alias("label"), "count", "approved", "denied"))
    return reduce(DataFrame.unionByName, parts)


def distribution(df: DataFrame, metric: str, hide_unknown: bool = False) -> DataFrame:
    """One metric's chart; ValueError for an unknown metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric!r}")
    return distributions(df, (metric,), hide_unknown)


def distribution_summary(df: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, unknown_count, n, total)."""
    per = label_counts(df, metrics).groupBy("metric").agg(F.sum(F.when(F.col("label").isNull(), F.col("count")).otherwise(0)).alias("unknown_count"), F.sum("count").alias("total"))
    return per.select("metric", "unknown_count", (F.col("total") - F.col("unknown_count")).alias("n"), "total")


def _rate(approved: Column, denied: Column) -> Column:
    return F.try_divide(approved, approved + denied)


def approval_rate(df: DataFrame) -> DataFrame:
    """One row: total, approved, denied, total_decided and rate, null where nothing is decided."""
    t = df.agg(*tally())
    return t.select(F.col("count").alias("total"), "approved", "denied", (F.col("approved") + F.col("denied")).alias("total_decided"), _rate(F.col("approved"), F.col("denied")).alias("rate"))


def approval_rate_by(df: DataFrame, group: str, hide_unknown: bool = False) -> DataFrame:
    """(ord, label, approved, denied, n, rate) of decided records; bins in order, labels by n, Unknown last.

    ``group`` is any metric; citation_bucket stands for citations.
    """
    metric = "citations" if group == "citation_bucket" else group
    if metric not in METRICS:
        raise ValueError(f"unknown group: {group!r}")
    decided = df.filter(F.col("outcome").isin(*OUTCOMES)).select("outcome", F.coalesce(metric_label(metric), F.lit(UNKNOWN)).alias("label"))
    decided = decided.filter(F.col("label") != UNKNOWN) if hide_unknown else decided
    rows = decided.groupBy("label").agg(*tally()).withColumn("n", F.col("count"))
    order = [bin_rank(F.col("label"), metric)] if metric in BINS else [F.col("label") == UNKNOWN, F.desc("n"), F.col("label")]
    ranked = rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)
    return ranked.select("ord", "label", "approved", "denied", "n", _rate(F.col("approved"), F.col("denied")).alias("rate"))


def quarter_series(df: DataFrame) -> DataFrame:
    """(quarter, count, approved, denied, rate) over time."""
    rows = df.groupBy(quarter_key(F.col("created_utc")).alias("quarter")).agg(*tally())
    return rows.select("quarter", "count", "approved", "denied", _rate(F.col("approved"), F.col("denied")).alias("rate")).orderBy("quarter")


def available_quarters(df: DataFrame) -> DataFrame:
    return df.select(quarter_key(F.col("created_utc")).alias("quarter")).distinct().orderBy(F.desc("quarter"))


def distinct_values(df: DataFrame, metric: str) -> DataFrame:
    """(ord, label, count): options of a filter. Bins in order, labels by frequency, Unknown last."""
    counts = label_counts(df, (metric,)).select(F.coalesce("label", F.lit(UNKNOWN)).alias("label"), "count", "newest")
    order = [bin_rank(F.col("label"), metric)] if metric in BINS else [F.col("label") == UNKNOWN, F.desc("count"), F.desc("newest"), F.col("label")]
    return counts.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1).select("ord", "label", "count")


def completeness(df: DataFrame) -> DataFrame:
    """(ord, field, known, total, rate): in how many records each field is known."""
    known = [F.count(metric_label(m)).alias(m) for m in COMPLETENESS]
    one = df.agg(F.count(F.lit(1)).alias("total"), *known)
    rows = one.select("total", F.posexplode(F.array(*[F.struct(F.lit(m).alias("field"), F.col(m).alias("known")) for m in COMPLETENESS])).alias("ord", "f"))
    return rows.select("ord", "f.field", "f.known", "total", F.try_divide(F.col("f.known"), F.col("total")).alias("rate"))


def partial_data(counts: dict) -> bool:
    """Whether a data-quality notice is due: candidates are still to be processed."""
    return bool(counts.get("is_partial"))
