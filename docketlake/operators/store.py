"""Keyed tables: merge by rewrite, selections against what is there, and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.derive import version_key
from docketlake.schema import CLASSIFIED_KEY

RAW_IMMUTABLE = ("created_utc",)
RAW_KEPT = ("op_comments",)


def latest_per_key(staged: DataFrame, keys: Sequence[str], order: str, first: Sequence[str] = (), ties: Sequence[str] = (), filled: bool = False) -> DataFrame:
    """One staged row per key: the last by ``order``, but with the earliest values of the columns ``first``.

    Of rows equal in ``order`` the smallest by ``ties`` counts, and then by all
    columns that have an order, so that no result depends on partitioning. With
    ``filled`` each column has its last (or earliest) value that isn't null, of
    the rows that have an ``order``; without, the value of the last (or first) row.
    """
    unordered = ("map<", "variant")
    rest = [f.name for f in staged.schema if f.name not in (*keys, order, *ties) and not any(u in f.dataType.simpleString() for u in unordered)]
    ordered = Window.partitionBy(*keys).orderBy(F.desc(order), *ties, *rest)
    whole = Window.partitionBy(*keys).orderBy(order, *ties, *rest).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = staged.withColumn("__rank", F.row_number().over(ordered))
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = lambda c: F.when(F.col(order).isNotNull(), F.col(c)) if filled else F.col(c)
    changed = [c for c in staged.columns if c in first or (filled and c not in (*keys, order, *ties))]
    out = out.withColumns({c: F.first(value(c), ignorenulls=filled).over(whole if c in first else every) for c in changed})
    return out.filter("__rank = 1").drop("__rank")


def merge(existing: DataFrame, staged: DataFrame, keys: Sequence[str], immutable: Sequence[str] = (), untouched: Sequence[str] = ()) -> DataFrame:
    """``existing`` with the rows of ``staged`` (one per key) put in or over it.

    Columns that ``staged`` lacks or are ``untouched`` stay; ``immutable`` ones
    stay where there was a row. One full outer join, on the keys.
    """
    e, s = existing.withColumn("__e", F.lit(True)).alias("e"), staged.withColumn("__s", F.lit(True)).alias("s")
    joined = e.join(s, [F.col(f"e.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    had, has = F.col("__e").isNotNull(), F.col("__s").isNotNull()

    def value(c: str):
        old = F.col(f"e.{c}")
        if c in untouched or c not in staged.columns:
            return old.alias(c)
        new = F.col(f"s.{c}")
        if c in keys:
            return F.coalesce(old, new).alias(c)
        return (F.when(had, old).otherwise(new) if c in immutable else F.when(has, new).otherwise(old)).alias(c)

    return joined.select(*[value(c) for c in existing.columns])


def merge_counts(existing: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(inserted, updated): keys of ``staged`` that are new and that are there already."""
    k = staged.select(*keys).distinct().join(existing.select(*keys).distinct().withColumn("__e", F.lit(True)), list(keys), "left")
    return k.agg(F.count_if(F.col("__e").isNull()).alias("inserted"), F.count("__e").alias("updated"))


def upsert_posts(existing: DataFrame, staged: DataFrame, order: str = "fetched_at") -> DataFrame:
    """Posts by id: the creation time never changes, and OP comments are set apart."""
    return merge(existing, latest_per_key(staged, ["id"], order, ["created_utc"]), ["id"], RAW_IMMUTABLE, RAW_KEPT)


def upsert_classified(existing: DataFrame, staged: DataFrame) -> DataFrame:
    return merge(existing, latest_per_key(staged, CLASSIFIED_KEY, "classified_at"), CLASSIFIED_KEY)


def set_op_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Point update from (id, op_comments)."""
    c = comments.select(F.col("id"), F.col("op_comments").alias("__c"), F.lit(True).alias("__h"))
    joined = posts.join(c, "id", "left")
    return joined.withColumn("op_comments", F.when(F.col("__h"), F.col("__c")).otherwise(F.col("op_comments"))).select(*posts.columns)


def clear(classified: DataFrame, backend: str | None = None, run_key: str | None = None, model: str | None = None) -> DataFrame:
    """What is left after deleting rows that match all that is given; nothing given deletes all."""
    gone = F.lit(True)
    for column, value in (("classifier_backend", backend), ("run_key", run_key), ("classifier_model", model)):
        gone = gone & F.col(column).eqNullSafe(value) if value else gone
    return classified.filter(~gone)


def renormalize(classified: DataFrame) -> DataFrame:
    """Labels computed anew from the raw texts: field, profession and firm."""
    from docketlake.functions.taxonomy import field_label, law_firm_label, profession_label

    return classified.withColumns({"field_normalized": field_label(F.col("field_raw")), "profession_normalized": profession_label(F.col("profession_raw")), "law_firm_normalized": law_firm_label(F.col("law_firm_raw"))})


def advance_watermark(state: DataFrame, seen: DataFrame, run_at: int) -> DataFrame:
    """Per subreddit the largest creation time so far; never goes back."""
    new = seen.groupBy("subreddit").agg(F.max("created_utc").alias("__new"))
    joined = state.join(new, "subreddit", "full_outer")
    return joined.select("subreddit", F.greatest("last_created_utc", "__new").alias("last_created_utc"), F.when(F.col("__new").isNotNull(), F.lit(run_at)).otherwise(F.col("last_run_at")).cast("long").alias("last_run_at"))


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return merge(meta, meta.sparkSession.createDataFrame([(key, value)], meta.schema), ["key"])


def candidates(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; no limit for None or 0."""
    out = posts.filter("is_candidate").orderBy(F.desc("created_utc"), "id")
    return out.limit(limit) if limit else out


def pending(posts: DataFrame, classified: DataFrame, run_key: str, prompt: str, schema: str, limit: int | None = None) -> DataFrame:
    """Candidates (with content_hash) that this run and version hasn't processed in their present content, newest first."""
    done = classified.filter((F.col("run_key") == run_key) & (F.col("prompt_version") == prompt) & (F.col("schema_version") == schema))
    todo = posts.filter("is_candidate").join(done.select(F.col("post_id").alias("id"), "content_hash"), ["id", "content_hash"], "left_anti")
    out = todo.orderBy(F.desc("created_utc"), "id")
    return out.limit(limit) if limit else out


def _status(name: str):
    return F.count_if(F.col("status") == name).alias(name)


def list_runs(classified: DataFrame, prompt: str | None = None, schema: str | None = None) -> DataFrame:
    """A row per run and version, latest first."""
    rows = classified
    for column, value in (("prompt_version", prompt), ("schema_version", schema)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    names = (("backend", "classifier_backend"), ("model", "classifier_model"), ("effort", "run_effort"), ("label", "run_label"))
    shown = [F.max(c).alias(n) for n, c in names]
    out = rows.groupBy("prompt_version", "schema_version", "run_key").agg(*shown, _status("ok"), _status("excluded"), _status("failed"), F.count_distinct("post_id").alias("posts"), F.max("classified_at").alias("last_classified_at"))
    return out.orderBy(F.desc("last_classified_at"), "prompt_version", "schema_version", "run_key")


def list_versions(classified: DataFrame) -> DataFrame:
    out = classified.groupBy("prompt_version", "schema_version").agg(F.max("classified_at").alias("last_classified_at"))
    return out.withColumn("version_key", version_key(F.col("prompt_version"), F.col("schema_version"))).orderBy(F.desc("last_classified_at"), "version_key")


def post_counts(posts: DataFrame) -> DataFrame:
    """One row: posts, candidates, and the first and last time."""
    return posts.agg(F.count(F.lit(1)).alias("post_count"), F.count_if("is_candidate").alias("candidate_count"), F.min("created_utc").alias("min_post_utc"), F.max("created_utc").alias("max_post_utc"))


def counts(posts: DataFrame, classified: DataFrame, prompt: str, schema: str, run_key: str | None = None) -> DataFrame:
    """One row of dataset counts. A run counts its rows; without one each post counts once, as ok before failed before excluded."""
    rows = classified.filter((F.col("prompt_version") == prompt) & (F.col("schema_version") == schema))
    if run_key is not None:
        rows = rows.filter(F.col("run_key") == run_key)
        by = rows.agg(_status("ok"), _status("excluded"), _status("failed"), F.max("classified_at").alias("max_classified_at"))
    else:
        per_post = rows.groupBy("post_id").agg(F.max(F.col("status") == "ok").alias("o"), F.max(F.col("status") == "failed").alias("f"), F.max("classified_at").alias("t"))
        by = per_post.agg(F.count_if("o").alias("ok"), F.count_if(~F.col("o") & ~F.col("f")).alias("excluded"), F.count_if(~F.col("o") & F.col("f")).alias("failed"), F.max("t").alias("max_classified_at"))
    p = post_counts(posts)
    processed = F.col("ok") + F.col("excluded") + F.col("failed")
    return p.crossJoin(F.broadcast(by)).select(  # two single rows
        "post_count", "candidate_count", F.col("ok").alias("classified_count"), F.col("failed").alias("failed_count"), F.col("excluded").alias("excluded_count"),
        processed.alias("active_processed_count"), F.greatest(F.col("candidate_count") - processed, F.lit(0)).alias("active_pending_count"),
        F.try_divide(processed, F.col("candidate_count")).alias("active_completion_rate"), (processed < F.col("candidate_count")).alias("is_partial"),
        "max_classified_at", "min_post_utc", "max_post_utc",
    )
