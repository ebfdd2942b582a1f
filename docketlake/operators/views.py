"""Views over records: versions, runs, the vote across runs, and re-filed cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.derive import version_key
from docketlake.functions.text import filled
from docketlake.schema import AUTHOR_SKIP, COMPOSITE


def of_version(df: DataFrame, key: str | None) -> DataFrame:
    """Records of a version "prompt/schema"; those without version always pass."""
    if not key:
        return df
    own = version_key(F.col("prompt_version"), F.col("schema_version"))
    return df.filter((own == "/") | (own == key))


def of_run(df: DataFrame, run: str) -> DataFrame:
    return df.filter(F.col("run") == run)


def vote(df: DataFrame, tie: tuple[str, ...] = ("run",)) -> DataFrame:
    """One whole record per post: of the most frequent outcome (null counts as one), the newest.

    Equal votes go to the outcome classified last, then by name (null first);
    within it to the newest record, then by ``tie``. One shuffle by post serves
    all windows; a post has as many rows as it has runs.
    """
    outcome = Window.partitionBy("id", "outcome")
    recency = F.coalesce("classified_at", F.lit(0))
    voted = df.repartition("id").withColumns({"__votes": F.count(F.lit(1)).over(outcome), "__recency": F.max(recency).over(outcome)})
    order = Window.partitionBy("id").orderBy(F.desc("__votes"), F.desc("__recency"), F.asc_nulls_first("outcome"), recency.desc(), *[F.asc(c) for c in tie])
    return voted.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__votes", "__recency", "__rank")


def select_view(df: DataFrame, run: str = COMPOSITE, tie: tuple[str, ...] = ("run",)) -> DataFrame:
    """The vote across runs, or one run's records. Sort with ``newest_first`` for display."""
    return of_run(df, run) if run and run != COMPOSITE else vote(df, tie)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("created_utc", F.lit(0)).desc(), "id")


def mark_refiled(df: DataFrame) -> DataFrame:
    """``df`` with refiled, refiled_url (on a denial whose author had a later approval: the earliest) and refile_approval (on that approval).

    Windows by author and time: from the newest back, the frame up to one second
    later finds the first later approval of each denial; the frame up to one
    second earlier tells an approval whether a denial looks forward to it, i.e.
    lies between it and the approval before. All frames grow from where they
    start, so an author's rows are gone through once each way. Authors that stand for many people are
    spread over partitions, as their rows can't match.
    """
    skip = F.col("author").isNull() | F.col("author").isin(*AUTHOR_SKIP)
    person = F.when(skip, F.concat(F.lit("\x00"), F.xxhash64("id").cast("string"))).otherwise(F.col("author"))
    when = F.coalesce("created_utc", F.lit(0))
    approved, denied = ~skip & (F.col("outcome") == "approved"), ~skip & (F.col("outcome") == "denied")
    base = df.withColumns({"__p": person, "__t": when})
    by_time = Window.partitionBy("__p").orderBy("__t")
    later = Window.partitionBy("__p").orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, -1)
    earlier = by_time.rangeBetween(Window.unboundedPreceding, -1)
    same_time = by_time.rangeBetween(0, 0)
    approval = F.when(approved, F.struct("__t", "id", "permalink"))
    seen = base.withColumns({
        "__next": F.min(approval).over(later),
        "__last_denial": F.max(F.when(denied, F.col("__t"))).over(earlier),
        "__last_approval": F.max(F.when(approved, F.col("__t"))).over(earlier),
        "__first_here": F.min(approval).over(same_time),
    })
    refiled = denied & F.col("__next").isNotNull()
    # A denial at or after the last earlier approval has this one as its first later one.
    matched = approved & F.col("__last_denial").isNotNull() & (F.col("__last_denial") >= F.coalesce("__last_approval", F.col("__last_denial"))) & (F.col("__first_here")["id"] == F.col("id"))
    return seen.withColumns({
        "refiled": F.when(F.coalesce(refiled, F.lit(False)), True),
        "refiled_url": F.when(refiled, F.col("__next")["permalink"]),
        "refile_approval": F.when(F.coalesce(matched, F.lit(False)), True),
    }).drop("__p", "__t", "__next", "__last_denial", "__last_approval", "__first_here")


def usable_author(author):
    """Whether an author is one person."""
    return (filled(author) != "") & ~filled(author).isin(*AUTHOR_SKIP)


def with_given_flags(df: DataFrame) -> DataFrame:
    """``df`` with the re-file flags it came with, null where it has none."""
    missing = {"refiled": "boolean", "refiled_url": "string", "refile_approval": "boolean"}
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items() if c not in df.columns})


def has_usable_author(df: DataFrame) -> bool:
    """Whether flags can be derived here; a public table keeps those it came with."""
    if "author" not in df.columns:
        return False
    return not df.filter(usable_author(F.col("author"))).isEmpty()
