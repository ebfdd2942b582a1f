"""The analytic record: classified rows joined to their posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.derive import infer_premium
from docketlake.functions.text import filled
from docketlake.schema import PUBLIC_DROP

METRIC_COLUMNS = ("publications", "patents", "citations", "years_experience", "processing_days")


def ok_rows(classified: DataFrame, prompt: str | None = None, schema: str | None = None, run: str | None = None) -> DataFrame:
    """Rows with status ok, of one version and one run where these are given; plain predicates that reach the scan."""
    rows = classified.filter(F.col("status") == "ok")
    for column, value in (("prompt_version", prompt), ("schema_version", schema), ("run_key", run)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    return rows


def records(classified: DataFrame, posts: DataFrame, prompt: str | None = None, schema: str | None = None, run: str | None = None) -> DataFrame:
    """One record per ok row whose post exists. A metric is null where it isn't known; empty labels are null."""
    c, r = ok_rows(classified, prompt, schema, run).alias("c"), posts.alias("r")
    joined = c.join(r, F.col("c.post_id") == F.col("r.id"))
    label = lambda name: F.nullif(F.col(f"c.{name}"), F.lit("")).alias(name)
    metric = lambda name: F.when(F.coalesce(F.col(f"c.{name}_known"), F.lit(False)), F.col(f"c.{name}")).alias(name)
    days = F.when(F.coalesce(F.col("c.processing_days_known"), F.lit(False)), F.col("c.processing_days"))
    return joined.select(
        F.col("r.id").alias("id"), "r.created_utc", "r.title", "r.permalink", F.col("r.link_flair_text").alias("flair"), "r.selftext", "r.op_comments", "r.author",
        label("outcome"), label("degree"), label("field_normalized"), F.col("c.profession_raw").alias("profession_raw"), label("profession_normalized"), label("law_firm_normalized"),
        *[metric(m) for m in METRIC_COLUMNS],
        infer_premium(F.col("c.premium_processing"), days, F.col("c.was_rfed")).alias("premium_processing"),
        F.col("c.was_rfed").alias("was_rfed"), "c.rfe_date", "c.rfe_response_date", F.col("c.run_key").alias("run"), "c.prompt_version", "c.schema_version", "c.classified_at",
    )


def slim(df: DataFrame, public: bool = False) -> DataFrame:
    """The wire form: short names, metrics as struct<value, known>; without personal columns if public.

    Flags that need the author must be set before the public form is taken.
    """
    short = {"field_normalized": "field", "profession_normalized": "profession", "law_firm_normalized": "law_firm"}
    columns = [
        F.struct(F.col(c).alias("value"), F.col(c).isNotNull().alias("known")).alias(c) if c in METRIC_COLUMNS else F.col(c).alias(short.get(c, c))
        for c in df.columns
        if c not in ("refile_approval", "profession_raw")
    ]
    out = df.select(*columns)
    return out.drop(*PUBLIC_DROP) if public else out


def from_slim(df: DataFrame) -> DataFrame:
    """Records of the wire form; an absent pair is unknown."""
    long = {"field": "field_normalized", "profession": "profession_normalized", "law_firm": "law_firm_normalized"}
    kinds = {"years_experience": "double"}
    missing = [F.lit(None).cast(kinds.get(c, "long")).alias(c) for c in METRIC_COLUMNS if c not in df.columns]
    known = lambda c: F.when(F.coalesce(F.col(c)["known"], F.lit(False)), F.col(c)["value"]).alias(c)
    return df.select(*[known(c) if c in METRIC_COLUMNS else F.col(c).alias(long.get(c, c)) for c in df.columns], *missing)


def fingerprint(df: DataFrame, prefix: str = "") -> DataFrame:
    """One row with a 16-digit hash of all displayed values, whatever the order of rows.

    Rows are hashed where they are and combined by commutative sums (two of 64
    bits and a count), so nothing is gathered in one place.
    """
    shown = ["id", "outcome", "degree", "field_normalized", "profession_normalized", "law_firm_normalized", *METRIC_COLUMNS, "premium_processing", "was_rfed", "run"]
    shown += [c for c in ("title", "permalink", "flair", "created_utc", "selftext", "op_comments", "classified_at", "prompt_version", "schema_version", "rfe_date", "rfe_response_date", "refiled", "refiled_url") if c in df.columns]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in shown]), 256)
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")
    total = df.select(half(1).alias("a"), half(17).alias("b")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    text = F.concat_ws("|", F.lit(prefix), filled(F.col("a").cast("string")), filled(F.col("b").cast("string")), F.col("n").cast("string"))
    return total.select(F.left(F.sha2(text, 256), F.lit(16)).alias("fingerprint"))
