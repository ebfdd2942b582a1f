"""Personal data in text: detectors, redaction, and counts per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.schema import WITHDRAWN

# Detectors, hard identifiers first. A-Z cases as given; "(?i)" where case doesn't matter.
HARD = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?<!\d)(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "uscis_receipt": r"(?i)\b(?:EAC|WAC|SRC|LIN|IOE|MSC|YSC|NBC)\s?\d{10}\b",
    "a_number": r"\bA[-#\s]?\d{8,9}\b",
}
LINKS = {
    "linkedin": r"(?i)linkedin\.com/(?:in|pub)/[\w-]+",
    "google_scholar": r"(?i)scholar\.google\.[a-z.]+/citations\?\S+",
    "orcid": r"(?i)orcid\.org/\d{4}-\d{4}-\d{4}-\d{3}[\dxX]",
    "researchgate": r"(?i)researchgate\.net/profile/[\w-]+",
    "github_profile": r"(?i)github\.com/[\w-]+(?:/[\w.-]+)?",
    "other_profile": r"(?i)\b(?:twitter\.com|x\.com|facebook\.com|instagram\.com)/[\w.]+",
}
DETECTORS = {**HARD, **LINKS}
REDACTED_KINDS = ("email", "phone", "ssn", "a_number")


def hits(text: Column, kind: str) -> Column:
    """All matches of a detector."""
    return F.regexp_extract_all(text, F.lit("(?U)" + DETECTORS[kind]), F.lit(0))


def redacted(kind: Column, found: Column) -> Column:
    """First and last two characters of what shouldn't be shown whole."""
    short = F.concat(F.left(found, F.lit(2)), F.lit("…"), F.right(found, F.lit(2)))
    return F.when(kind.isin(*REDACTED_KINDS) & (F.length(found) > 4), short).otherwise(found)


def find(df: DataFrame, key: str, text: Column, kinds: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """(key, kind, found): a row per match, in one pass over the text."""

    def labelled(kind: str) -> Column:
        return F.transform(hits(F.coalesce(text, F.lit("")), kind), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("found")))

    arrays = [labelled(k) for k in kinds]
    return df.select(F.col(key), F.explode(F.concat(*arrays)).alias("h")).select(key, "h.kind", "h.found")


def counts(df: DataFrame, text: Column, kinds: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """(kind, n) of every detector, zeros included; sums are partial before the one shuffle."""
    row = df.select(*[F.size(hits(F.coalesce(text, F.lit("")), k)).alias(k) for k in kinds])
    totals = row.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds])
    return totals.select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("kind", "n"))


def samples(df: DataFrame, key: str, text: Column, per_kind: int = 6) -> DataFrame:
    """The first matches of each kind by key, redacted."""
    from pyspark.sql import Window

    found = find(df, key, text)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(key, "found"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= per_kind).select("kind", "rank", key, redacted(F.col("kind"), F.col("found")).alias("shown"))


def author_counts(df: DataFrame) -> DataFrame:
    """(authors, deleted_authors, removed_bodies): distinct authors that are named, and posts whose author or text is withdrawn."""
    named = F.col("author").isNotNull() & (F.col("author") != "") & ~F.lower("author").isin("[deleted]", "none")
    return df.agg(
        F.count_distinct(F.when(named, F.col("author"))).alias("authors"),
        F.count_if(F.lower("author") == "[deleted]").alias("deleted_authors"),
        F.count_if(F.col("selftext").isin(*WITHDRAWN)).alias("removed_bodies"),
    )


def top_authors(df: DataFrame, author: str = "author", n: int = 8) -> DataFrame:
    """Most frequent authors; ties by name. The limit is the report's."""
    named = F.col(author).isNotNull() & (F.col(author) != "") & ~F.lower(author).isin("[deleted]", "none")
    return df.filter(named).groupBy(author).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), author).limit(n)


def publish_problems(df: DataFrame, key: str, text: Column) -> list[str]:
    """Why a table must not be published: forbidden columns, or hard identifiers in its text."""
    from docketlake.schema import PUBLIC_DROP

    problems = [f"forbidden columns: {sorted(set(PUBLIC_DROP) & set(df.columns))}"] if set(PUBLIC_DROP) & set(df.columns) else []
    found = counts(df, text, tuple(HARD)).filter("n > 0").orderBy("kind").collect()
    return problems + ["hard identifiers: " + ", ".join(f"{r['kind']} x{r['n']}" for r in found)] * bool(found)
