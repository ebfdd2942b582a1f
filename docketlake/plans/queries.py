"""Registered queries over the driver's tables, and the same in SQL.

The tables have no posts, so orders stand for posts and line items for
classified rows (a post has several, by run); text comes from templates and
from documents and conversations. Each query goes through the library's
operator; its SQL is written on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import derive, extract, jsonx, pii, prefilter, taxonomy
from docketlake.operators import comments, filters, records, stats, store, views
from docketlake.plans import pipeline
from docketlake.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# ---- binding ----------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bound_posts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = lambda c: F.col(c).cast("string")
    return o.select(
        text("o_orderkey").alias("id"), F.lit("s").alias("subreddit"), F.concat(F.lit("post "), text("o_orderkey")).alias("title"),
        F.when(F.col("o_orderkey") % 10 == 0, "[removed]").otherwise("body").alias("selftext"), F.col("o_orderstatus").alias("link_flair_text"),
        F.when(F.col("o_custkey") % 50 == 0, "[deleted]").otherwise(text("o_custkey")).alias("author"), F.concat(F.lit("/r/s/comments/"), text("o_orderkey"), F.lit("/")).alias("permalink"),
        F.unix_timestamp("o_orderdate").alias("created_utc"), (F.col("o_orderpriority") < "3").alias("is_candidate"), F.lit(None).cast("string").alias("op_comments"), F.col("o_orderpriority").alias("priority"),
    )


def bound_classified(spark: SparkSession, d: str) -> DataFrame:
    """Line items as classified rows, with their order's priority and their part's type and brand as labels."""
    line = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    value = {
        "publications": F.when(q % 5 != 0, F.floor(q / 2)),
        "patents": F.when(n != 7, (n - 1).cast("long")),
        "citations": F.when(q % 7 != 0, F.floor(q * q / 4)),
        "years_experience": F.when(F.col("l_tax") != 0, F.col("l_discount") * 200),
        "processing_days": F.when(n != 3, F.datediff("l_shipdate", "o_orderdate").cast("long")),
    }
    metrics = [x for m, v in value.items() for x in (v.alias(m), v.isNotNull().alias(f"{m}_known"))]
    return line.join(orders, "l_orderkey").join(part, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("post_id"), F.concat(F.lit("m"), n.cast("string")).alias("run_key"), F.when(n <= 5, "p3").otherwise("p2").alias("prompt_version"), F.lit("s3").alias("schema_version"),
        F.when((F.col("l_linestatus") == "O") | (n <= 4), "ok").when(n % 2 == 0, "failed").otherwise("excluded").alias("status"),
        F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "denied").alias("outcome"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("degree"), F.col("p_type").alias("field_normalized"), F.nullif("p_brand", F.lit("Brand#11")).alias("law_firm_normalized"),
        F.when(n % 4 == 1, "Software Engineer").when(n % 4 == 2, "Other").when(n % 4 == 3, "Postdoc/Researcher").alias("profession_normalized"),
        F.concat_ws("-", "l_partkey", "l_suppkey", q.cast("int")).alias("profession_raw"), *metrics,
        F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("premium_processing"), F.when(n % 5 == 1, True).when(n % 5 != 0, False).alias("was_rfed"),
        F.lit(None).cast("string").alias("rfe_date"), F.lit(None).cast("string").alias("rfe_response_date"), F.unix_timestamp("l_shipdate").alias("classified_at"),
        F.concat(F.lit("b"), (n % 2).cast("string")).alias("classifier_backend"), F.concat(F.lit("m"), n.cast("string")).alias("classifier_model"), F.lit("").alias("run_effort"), F.lit(None).cast("string").alias("run_label"),
    )


POSTS_SQL = """posts AS (SELECT o_orderkey::VARCHAR AS id, 'post ' || o_orderkey AS title, CASE WHEN o_orderkey % 10 = 0 THEN '[removed]' ELSE 'body' END AS selftext,
  o_orderstatus AS link_flair_text, CASE WHEN o_custkey % 50 = 0 THEN '[deleted]' ELSE o_custkey::VARCHAR END AS author, '/r/s/comments/' || o_orderkey || '/' AS permalink,
  epoch(o_orderdate)::BIGINT AS created_utc, o_orderpriority < '3' AS is_candidate, o_orderpriority AS priority FROM orders)"""
CLASSIFIED_SQL = """cls AS (SELECT l_orderkey::VARCHAR AS post_id, 'm' || l_linenumber AS run_key, CASE WHEN l_linenumber <= 5 THEN 'p3' ELSE 'p2' END AS prompt_version, 's3' AS schema_version,
  CASE WHEN l_linestatus = 'O' OR l_linenumber <= 4 THEN 'ok' WHEN l_linenumber % 2 = 0 THEN 'failed' ELSE 'excluded' END AS status,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'denied' END AS outcome, nullif(o_orderpriority, '5-LOW') AS degree, p_type AS field_normalized, nullif(p_brand, 'Brand#11') AS law_firm_normalized,
  CASE l_linenumber % 4 WHEN 1 THEN 'Software Engineer' WHEN 2 THEN 'Other' WHEN 3 THEN 'Postdoc/Researcher' END AS profession_normalized, l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS profession_raw,
  CASE WHEN l_quantity % 5 <> 0 THEN floor(l_quantity / 2)::BIGINT END AS publications, CASE WHEN l_linenumber <> 7 THEN (l_linenumber - 1)::BIGINT END AS patents,
  CASE WHEN l_quantity % 7 <> 0 THEN floor(l_quantity * l_quantity / 4)::BIGINT END AS citations, CASE WHEN l_tax <> 0 THEN l_discount * 200 END AS years_experience,
  CASE WHEN l_linenumber <> 3 THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::BIGINT END AS processing_days,
  CASE l_linenumber % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS premium_stored, CASE WHEN l_linenumber % 5 = 1 THEN TRUE WHEN l_linenumber % 5 <> 0 THEN FALSE END AS was_rfed,
  epoch(l_shipdate)::BIGINT AS classified_at, 'b' || (l_linenumber % 2) AS backend FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""
RECORDS_SQL = """rec AS (SELECT id, created_utc, author, permalink, outcome, degree, field_normalized, profession_raw, profession_normalized, law_firm_normalized, publications, patents, citations, years_experience, processing_days,
  CASE WHEN premium_stored IS NULL AND processing_days > 90 AND NOT coalesce(was_rfed, FALSE) THEN FALSE ELSE premium_stored END AS premium_processing, was_rfed, run_key AS run, prompt_version, schema_version, classified_at
  FROM cls JOIN posts ON id = post_id WHERE status = 'ok')"""
BASE = f"WITH {POSTS_SQL}, {CLASSIFIED_SQL}, {RECORDS_SQL}"
VOTE_SQL = """w AS (SELECT *, count(*) OVER (PARTITION BY id, outcome) AS votes, max(classified_at) OVER (PARTITION BY id, outcome) AS recency FROM rec),
 voted AS (SELECT * EXCLUDE (votes, recency, rk) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, recency DESC, outcome ASC NULLS FIRST, classified_at DESC, run, profession_raw) AS rk FROM w) WHERE rk = 1)"""
TIE = ("run", "profession_raw")


def bound_records(spark: SparkSession, d: str) -> DataFrame:
    return records.records(bound_classified(spark, d), bound_posts(spark, d))


def bound_view(spark: SparkSession, d: str) -> DataFrame:
    return views.select_view(bound_records(spark, d), tie=TIE)


TALLY = "count(*) AS count, count(*) FILTER (WHERE outcome = 'approved') AS approved, count(*) FILTER (WHERE outcome = 'denied') AS denied"
LABEL_SQL = {
    "outcome": "outcome", "degree": "degree", "field": "field_normalized", "profession": "profession_normalized", "law_firm": "law_firm_normalized",
    "premium": "CASE WHEN premium_processing THEN 'Premium' WHEN NOT premium_processing THEN 'Regular' END", "rfe": "CASE WHEN was_rfed THEN 'RFE''d' WHEN NOT was_rfed THEN 'No RFE' END",
}


def bin_sql(metric: str) -> str:
    from docketlake.schema import BINS

    rules = " ".join(f"WHEN {metric} >= {low} AND {metric} < {high} THEN '{label}'" for label, low, high in BINS[metric] if high is not None)
    return f"CASE WHEN {metric} IS NULL THEN NULL {rules} ELSE '{BINS[metric][-1][0]}' END"


def bins_values(metric: str) -> str:
    from docketlake.schema import BINS

    return ", ".join(f"({i}, '{b[0]}')" for i, b in enumerate(BINS[metric]))


def label_sql(metric: str) -> str:
    return LABEL_SQL.get(metric) or bin_sql(metric)


def categorical_sql(metric: str, source: str = "rec", hide: bool = False) -> str:
    """SELECT of a categorical chart."""
    unknown = f"UNION ALL SELECT 99::BIGINT, 'Unknown', count, approved, denied FROM (SELECT {TALLY} FROM {source} WHERE {label_sql(metric)} IS NULL) WHERE count > 0"
    return f"""SELECT '{metric}' AS metric, ord, label, count, approved, denied FROM (
      SELECT ord, label, sum(count)::BIGINT AS count, sum(approved)::BIGINT AS approved, sum(denied)::BIGINT AS denied FROM (
        SELECT CASE WHEN label = 'Other' OR rk > 9 THEN 9::BIGINT ELSE rk - 1 END AS ord, CASE WHEN label = 'Other' OR rk > 9 THEN 'Other' ELSE label END AS label, count, approved, denied FROM (
          SELECT *, row_number() OVER (PARTITION BY label = 'Other' ORDER BY count DESC, newest DESC, label) AS rk FROM (
            SELECT {label_sql(metric)} AS label, {TALLY}, max(created_utc) AS newest FROM {source} WHERE {label_sql(metric)} IS NOT NULL GROUP BY 1))) GROUP BY 1, 2
      {"" if hide else unknown})"""


def numeric_sql(metric: str, source: str = "rec", hide: bool = False) -> str:
    unknown = f"UNION ALL SELECT 99, 'Unknown', count, approved, denied FROM (SELECT {TALLY} FROM {source} WHERE {metric} IS NULL) WHERE count > 0"
    return f"""SELECT '{metric}' AS metric, ord::BIGINT AS ord, label, count, approved, denied FROM (
      SELECT ord, label, coalesce(count, 0) AS count, coalesce(approved, 0) AS approved, coalesce(denied, 0) AS denied
      FROM (VALUES {bins_values(metric)}) b(ord, label) LEFT JOIN (SELECT {bin_sql(metric)} AS label, {TALLY} FROM {source} WHERE {metric} IS NOT NULL GROUP BY 1) c USING (label)
      {"" if hide else unknown})"""


def chart(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.col("ord").cast("long"))


# ---- distributions and rates ------------------------------------------------

for _name, _metric, _hide in (
    ("dist_categorical_show", "degree", False), ("dist_categorical_hide", "degree", True), ("dist_longtail_other", "law_firm", False), ("dist_profession", "profession", False),
    ("dist_premium", "premium", False), ("dist_rfe", "rfe", False), ("dist_outcome", "outcome", False), ("dist_field", "field", False),
    ("dist_numeric_bins", "citations", False), ("dist_publication_bins", "publications", False), ("dist_patent_bins", "patents", True), ("dist_duration_bins", "processing_days", False), ("dist_years_float_bins", "years_experience", True),
):
    _sql = categorical_sql(_metric, hide=_hide) if _metric in LABEL_SQL else numeric_sql(_metric, hide=_hide)
    query(_name, f"{BASE} {_sql}")(lambda s, d, m=_metric, h=_hide: chart(stats.distribution(bound_records(s, d), m, h)))

_ALL_METRICS = [categorical_sql(m, "voted") for m in LABEL_SQL] + [numeric_sql(m, "voted") for m in ("publications", "patents", "citations", "years_experience", "processing_days")]


@query("dist_all_metrics", f"{BASE}, {VOTE_SQL} " + " UNION ALL ".join(f"({q})" for q in _ALL_METRICS))
def dist_all_metrics(s, d):
    return chart(stats.distributions(bound_view(s, d)))


@query("dist_summary", f"{BASE} SELECT 'citations' AS metric, count(*) FILTER (WHERE citations IS NULL) AS unknown_count, count(citations) AS n, count(*) AS total FROM rec UNION ALL SELECT 'degree', count(*) FILTER (WHERE degree IS NULL), count(degree), count(*) FROM rec")
def dist_summary(s, d):
    return stats.distribution_summary(bound_records(s, d), ("citations", "degree"))


RATE = "SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'approved') AS approved, count(*) FILTER (WHERE outcome = 'denied') AS denied, count(*) FILTER (WHERE outcome IN ('approved', 'denied')) AS total_decided, count(*) FILTER (WHERE outcome = 'approved') / nullif(count(*) FILTER (WHERE outcome IN ('approved', 'denied')), 0) AS rate"


@query("approval_rate", f"{BASE} {RATE} FROM rec")
def approval_rate(s, d):
    return stats.approval_rate(bound_records(s, d))


NOW = 1_000_000_000


@query("summary_range", f"{BASE}, {VOTE_SQL} {RATE} FROM voted WHERE created_utc BETWEEN {NOW - 365 * 86400} AND {NOW}")
def summary_range(s, d):
    return stats.approval_rate(filters.in_range(bound_view(s, d), *filters.window_from_range("12m", NOW)))


@query("summary_dates", f"{BASE} {RATE} FROM rec WHERE created_utc >= epoch(TIMESTAMP '1997-03-01') AND created_utc <= epoch(TIMESTAMP '1998-02-28 23:59:59')")
def summary_dates(s, d):
    return stats.approval_rate(filters.in_range(bound_records(s, d), *filters.resolve_window(None, "1997-03-01", "1998-02-28")))


def _group_sql(label: str, order: str, hide: bool = False) -> str:
    return f"""{BASE}, g AS (SELECT coalesce({label}, 'Unknown') AS label, count(*) FILTER (WHERE outcome = 'approved') AS approved, count(*) FILTER (WHERE outcome = 'denied') AS denied, count(*) AS n FROM rec WHERE outcome IN ('approved', 'denied') GROUP BY 1)
      SELECT row_number() OVER (ORDER BY {order}) - 1 AS ord, label, approved, denied, n, approved / n AS rate FROM g {"WHERE label <> 'Unknown'" if hide else ""}"""


BY_N = "label = 'Unknown', n DESC, label"
CITATION_ORDER = "list_position(['0', '1–10', '11–20', '21–30', '31–50', '51–100', '101–200', '201–500', '501+', 'Unknown'], label)"
for _name, _group, _sql in (
    ("approval_by_group", "degree", _group_sql("degree", BY_N)), ("approval_by_firm_hide", "law_firm", _group_sql("law_firm_normalized", BY_N, True)), ("approval_by_rfe", "rfe", _group_sql(LABEL_SQL["rfe"], BY_N)),
    ("approval_by_premium", "premium", _group_sql(LABEL_SQL["premium"], BY_N)), ("approval_by_bin", "citation_bucket", _group_sql(bin_sql("citations"), CITATION_ORDER)),
):
    query(_name, _sql)(lambda s, d, g=_group, h=_name.endswith("hide"): chart(stats.approval_rate_by(bound_records(s, d), g, h)))

QUARTER = "year(make_timestamp(created_utc * 1000000)) || '-Q' || quarter(make_timestamp(created_utc * 1000000))"


@query("quarter_series", f"{BASE} SELECT {QUARTER} AS quarter, {TALLY}, count(*) FILTER (WHERE outcome = 'approved') / nullif(count(*) FILTER (WHERE outcome IN ('approved', 'denied')), 0) AS rate FROM rec GROUP BY 1")
def quarter_series(s, d):
    return stats.quarter_series(bound_records(s, d))


@query("quarters_available", f"{BASE} SELECT DISTINCT {QUARTER} AS quarter FROM rec")
def quarters_available(s, d):
    return stats.available_quarters(bound_records(s, d))


@query("filter_quarters", f"{BASE} SELECT id, run, profession_raw, created_utc FROM rec WHERE {QUARTER} IN ('1996-Q1', '1998-Q4')")
def filter_quarters(s, d):
    return filters.in_quarters(bound_records(s, d), ["1996-Q1", "1998-Q4"]).select("id", "run", "profession_raw", "created_utc")


@query("distinct_values_cat", f"{BASE}, g AS (SELECT coalesce(degree, 'Unknown') AS label, count(*) AS count, max(created_utc) AS newest FROM rec GROUP BY 1) SELECT row_number() OVER (ORDER BY label = 'Unknown', count DESC, newest DESC, label) - 1 AS ord, label, count FROM g")
def distinct_values_cat(s, d):
    return chart(stats.distinct_values(bound_records(s, d), "degree"))


@query("distinct_values_num", f"{BASE}, g AS (SELECT coalesce({bin_sql('citations')}, 'Unknown') AS label, count(*) AS count FROM rec GROUP BY 1) SELECT row_number() OVER (ORDER BY {CITATION_ORDER}) - 1 AS ord, label, count FROM g")
def distinct_values_num(s, d):
    return chart(stats.distinct_values(bound_records(s, d), "citations"))


_FIELDS = ("degree", "field", "profession", "law_firm", "citations", "publications", "patents", "processing_days", "premium", "rfe")


@query("completeness", f"{BASE} SELECT ord::BIGINT AS ord, field, known, total, known / nullif(total, 0) AS rate FROM (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{m}' AS field, count({LABEL_SQL.get(m, m)}) AS known, count(*) AS total FROM rec" for i, m in enumerate(_FIELDS)) + ")")
def completeness(s, d):
    return chart(stats.completeness(bound_records(s, d)))


# ---- views ------------------------------------------------------------------

SHOWN = "id, outcome, run, classified_at, profession_raw, created_utc"
_shown = SHOWN.split(", ")


@query("composite_vote", f"{BASE}, {VOTE_SQL} SELECT {SHOWN} FROM voted")
def composite_vote(s, d):
    return bound_view(s, d).select(*_shown)


@query("single_run_view", f"{BASE} SELECT {SHOWN} FROM rec WHERE run = 'm2'")
def single_run_view(s, d):
    return views.select_view(bound_records(s, d), "m2").select(*_shown)


@query("version_view", f"{BASE} SELECT {SHOWN} FROM rec WHERE prompt_version = 'p2'")
def version_view(s, d):
    return views.of_version(bound_records(s, d), "p2/s3").select(*_shown)


# The earliest later approval of each denial, by a lateral search; its approval is flagged.
REFILE_SQL = f"""{BASE}, {VOTE_SQL}, p AS (SELECT * FROM voted WHERE author <> '[deleted]'),
 m AS (SELECT x.id, arg_min(a.id, (a.created_utc, a.id)) AS next_id, arg_min(a.permalink, (a.created_utc, a.id)) AS url FROM p x JOIN p a ON a.author = x.author AND a.outcome = 'approved' AND a.created_utc > x.created_utc WHERE x.outcome = 'denied' GROUP BY x.id)"""


@query("refile_forward_asof", f"{REFILE_SQL} SELECT id, TRUE AS refiled, url AS refiled_url FROM m")
def refile_forward_asof(s, d):
    return views.mark_refiled(bound_view(s, d)).filter("refiled").select("id", "refiled", "refiled_url")


@query("refile_approval_flag", f"{REFILE_SQL} SELECT DISTINCT next_id AS id, TRUE AS refile_approval FROM m")
def refile_approval_flag(s, d):
    return views.mark_refiled(bound_view(s, d)).filter("refile_approval").select("id", "refile_approval")


@query("active_records_join", f"{BASE} SELECT id, run, profession_raw, premium_processing, processing_days FROM rec WHERE prompt_version = 'p3' AND schema_version = 's3' AND run = 'm1'")
def active_records_join(s, d):
    out = records.records(bound_classified(s, d), bound_posts(s, d), "p3", "s3", "m1")
    return out.select("id", "run", "profession_raw", "premium_processing", "processing_days")


@query("all_versions_join", f"{BASE} SELECT id, run, prompt_version, profession_raw, citations, years_experience FROM rec")
def all_versions_join(s, d):
    return bound_records(s, d).select("id", "run", "prompt_version", "profession_raw", "citations", "years_experience")


# ---- filters ----------------------------------------------------------------


@query("facet_filter", f"{BASE} SELECT {SHOWN} FROM rec WHERE degree IN ('1-URGENT', '2-HIGH') AND {bin_sql('citations')} IN ('11–20', '501+')")
def facet_filter(s, d):
    return filters.in_facets(bound_records(s, d), {"degree": ["1-URGENT", "2-HIGH"], "citations": ["11–20", "501+"], "rfe": []}).select(*_shown)


@query("facet_unknown", f"{BASE} SELECT {SHOWN} FROM rec WHERE (degree IS NULL OR degree = '3-MEDIUM') AND processing_days IS NULL")
def facet_unknown(s, d):
    return filters.in_facets(bound_records(s, d), {"degree": ["Unknown", "3-MEDIUM"], "processing_days": ["Unknown"]}).select(*_shown)


_TOP = ["Brand#12", "Brand#13", "Brand#21"]


@query("other_tail", f"{BASE} SELECT {SHOWN} FROM rec WHERE law_firm_normalized IS NOT NULL AND law_firm_normalized NOT IN ('Brand#12', 'Brand#13', 'Brand#21')")
def other_tail(s, d):
    return filters.other_tail(bound_records(s, d), "law_firm", _TOP).select(*_shown)


@query("page_of_posts", f"{BASE}, {VOTE_SQL} SELECT id, created_utc FROM voted ORDER BY created_utc DESC, id LIMIT 25 OFFSET 50")
def page_of_posts(s, d):
    return filters.page(bound_view(s, d), 2).select("id", "created_utc")


@query("records_limit", f"{BASE}, {VOTE_SQL} SELECT id, created_utc FROM voted ORDER BY created_utc DESC, id LIMIT 1000")
def records_limit(s, d):
    return filters.first_records(bound_view(s, d)).select("id", "created_utc")


# ---- store ------------------------------------------------------------------


@query("candidates_topk", f"WITH {POSTS_SQL} SELECT id, created_utc FROM posts WHERE is_candidate ORDER BY created_utc DESC, id LIMIT 100")
def candidates_topk(s, d):
    return store.candidates(bound_posts(s, d), 100).select("id", "created_utc")


HASH_SQL = "sha256(trim(title) || chr(10) || selftext || chr(10) || link_flair_text || chr(10))"


@query("content_hash", f"WITH {POSTS_SQL} SELECT id, {HASH_SQL} AS content_hash FROM posts")
def content_hash(s, d):
    c = [F.col(x) for x in ("title", "selftext", "link_flair_text", "op_comments")]
    return bound_posts(s, d).select("id", derive.content_hash(*c).alias("content_hash"))


@query("pending_anti_join", f"WITH {POSTS_SQL}, {CLASSIFIED_SQL}, h AS (SELECT *, {HASH_SQL} AS content_hash FROM posts WHERE is_candidate) SELECT id, content_hash FROM h WHERE NOT EXISTS (SELECT 1 FROM cls WHERE post_id = id AND run_key = 'm1' AND prompt_version = 'p3' AND NOT id LIKE '%7')")
def pending_anti_join(s, d):
    from docketlake.operators.classify import with_hash

    posts = with_hash(bound_posts(s, d))
    done = bound_classified(s, d).join(posts.select(F.col("id").alias("post_id"), "content_hash"), "post_id")
    done = done.withColumn("content_hash", F.when(F.col("post_id").endswith("7"), "old").otherwise(F.col("content_hash")))  # content that has changed
    return store.pending(posts, done, "m1", "p3", "s3").select("id", "content_hash")


def _staged_posts(s, d) -> DataFrame:
    """Every third order again with new values, and as many that are new; some twice, the later fetch counting."""
    p = bound_posts(s, d).select("id", "title", "created_utc", "op_comments", F.lit(1).cast("long").alias("fetched_at"))
    again = p.filter(F.col("id").cast("long") % 3 == 0).withColumns({"title": F.concat(F.lit("new "), "title"), "created_utc": F.col("created_utc") + 5, "fetched_at": F.lit(2).cast("long")})
    fresh = again.withColumn("id", F.concat(F.lit("n"), "id"))
    twice = fresh.filter(F.col("created_utc") % 2 == 0).withColumns({"title": F.concat(F.lit("last "), "title"), "created_utc": F.col("created_utc") + 9, "fetched_at": F.lit(3).cast("long")})
    return again.unionByName(fresh).unionByName(twice)


@query("upsert_raw_merge", f"""WITH {POSTS_SQL}, s AS (SELECT id, 'new ' || title AS title, created_utc + 5 AS created_utc FROM posts WHERE id::BIGINT % 3 = 0)
  SELECT p.id, coalesce(s.title, p.title) AS title, p.created_utc, CASE WHEN s.id IS NULL THEN 1 ELSE 2 END::BIGINT AS fetched_at FROM posts p LEFT JOIN s USING (id)
  UNION ALL SELECT 'n' || id, CASE WHEN created_utc % 2 = 0 THEN 'last ' ELSE '' END || title, created_utc, CASE WHEN created_utc % 2 = 0 THEN 3 ELSE 2 END::BIGINT FROM s""")
def upsert_raw_merge(s, d):
    existing = bound_posts(s, d).select("id", "title", "created_utc", "op_comments", F.lit(1).cast("long").alias("fetched_at"))
    return store.upsert_posts(existing, _staged_posts(s, d)).select("id", "title", "created_utc", "fetched_at")


@query("upsert_counts", f"WITH {POSTS_SQL} SELECT count(*) AS inserted, count(*) AS updated FROM posts WHERE id::BIGINT % 3 = 0")
def upsert_counts(s, d):
    return store.merge_counts(bound_posts(s, d), _staged_posts(s, d), ["id"])


@query("upsert_cls_merge", f"""WITH {POSTS_SQL}, {CLASSIFIED_SQL}, e AS (SELECT post_id, run_key, max(classified_at) AS classified_at, min(status) AS status FROM cls GROUP BY 1, 2)
  SELECT post_id, run_key, CASE WHEN run_key = 'm1' THEN classified_at + 1 ELSE classified_at END AS classified_at, CASE WHEN run_key = 'm1' THEN 'failed' ELSE status END AS status FROM e""")
def upsert_cls_merge(s, d):
    existing = bound_classified(s, d).groupBy("post_id", "run_key").agg(F.max("classified_at").alias("classified_at"), F.min("status").alias("status"))
    existing = existing.withColumns({c: F.lit("x") for c in ("content_hash", "prompt_version", "schema_version")})
    new = existing.filter("run_key = 'm1'").withColumns({"classified_at": F.col("classified_at") + 1, "status": F.lit("failed")})
    return store.upsert_classified(existing, new).select("post_id", "run_key", "classified_at", "status")


@query("clear_rows", f"WITH {CLASSIFIED_SQL} SELECT post_id, run_key, profession_raw FROM cls WHERE NOT (backend = 'b1' AND run_key = 'm3')")
def clear_rows(s, d):
    return store.clear(bound_classified(s, d), backend="b1", run_key="m3").select("post_id", "run_key", "profession_raw")


@query("set_op_comments", f"WITH {POSTS_SQL} SELECT id, CASE WHEN id::BIGINT % 4 = 0 THEN 'said ' || id END AS op_comments FROM posts")
def set_op_comments(s, d):
    p = bound_posts(s, d)
    new = p.filter(F.col("id").cast("long") % 4 == 0).select("id", F.concat(F.lit("said "), "id").alias("op_comments"))
    return store.set_op_comments(p, new).select("id", "op_comments")


@query("watermark", f"WITH {POSTS_SQL}, m AS (SELECT author AS subreddit, max(created_utc) AS new FROM posts GROUP BY 1) SELECT subreddit, greatest(new, 900000000) AS last_created_utc, 7::BIGINT AS last_run_at FROM m")
def watermark(s, d):
    seen = bound_posts(s, d).withColumn("subreddit", F.col("author"))
    state = seen.select("subreddit").distinct().withColumns({"last_created_utc": F.lit(900_000_000).cast("long"), "last_run_at": F.lit(1).cast("long")})
    return store.advance_watermark(state, seen, 7)


STATUS_SQL = "count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) FILTER (WHERE status = 'failed') AS failed"


@query("list_runs", f"WITH {CLASSIFIED_SQL} SELECT prompt_version, schema_version, run_key, max(backend) AS backend, {STATUS_SQL}, count(DISTINCT post_id) AS posts, max(classified_at) AS last_classified_at FROM cls GROUP BY 1, 2, 3")
def list_runs(s, d):
    return store.list_runs(bound_classified(s, d)).drop("model", "effort", "label")


@query("list_versions", f"WITH {CLASSIFIED_SQL} SELECT prompt_version, schema_version, prompt_version || '/' || schema_version AS version_key, max(classified_at) AS last_classified_at FROM cls GROUP BY 1, 2")
def list_versions(s, d):
    return store.list_versions(bound_classified(s, d))


COUNTS_SQL = """SELECT post_count, candidate_count, ok AS classified_count, failed AS failed_count, excluded AS excluded_count, ok + failed + excluded AS active_processed_count, greatest(candidate_count - ok - failed - excluded, 0) AS active_pending_count,
  (ok + failed + excluded) / nullif(candidate_count, 0) AS active_completion_rate, ok + failed + excluded < candidate_count AS is_partial, max_classified_at, min_post_utc, max_post_utc
  FROM c, (SELECT count(*) AS post_count, count(*) FILTER (WHERE is_candidate) AS candidate_count, min(created_utc) AS min_post_utc, max(created_utc) AS max_post_utc FROM posts)"""


@query("counts_run", f"WITH {POSTS_SQL}, {CLASSIFIED_SQL}, c AS (SELECT {STATUS_SQL}, max(classified_at) AS max_classified_at FROM cls WHERE prompt_version = 'p3' AND run_key = 'm5') {COUNTS_SQL}")
def counts_run(s, d):
    return store.counts(bound_posts(s, d), bound_classified(s, d), "p3", "s3", "m5")


@query("counts_composite", f"""WITH {POSTS_SQL}, {CLASSIFIED_SQL}, pp AS (SELECT post_id, bool_or(status = 'ok') AS o, bool_or(status = 'failed') AS f, max(classified_at) AS t FROM cls WHERE prompt_version = 'p2' GROUP BY 1),
  c AS (SELECT count(*) FILTER (WHERE o) AS ok, count(*) FILTER (WHERE NOT o AND f) AS failed, count(*) FILTER (WHERE NOT o AND NOT f) AS excluded, max(t) AS max_classified_at FROM pp) {COUNTS_SQL}""")
def counts_composite(s, d):
    return store.counts(bound_posts(s, d), bound_classified(s, d), "p2", "s3")


@query("table_counts", f"WITH {POSTS_SQL} SELECT count(*) AS post_count, count(*) FILTER (WHERE is_candidate) AS candidate_count, min(created_utc) AS min_post_utc, max(created_utc) AS max_post_utc FROM posts")
def table_counts(s, d):
    return store.post_counts(bound_posts(s, d))


@query("ingest_dedup", "SELECT l_orderkey AS id, max(l_linenumber) AS fetched_at, arg_max(l_partkey, l_linenumber) AS title, arg_min(epoch(l_shipdate), l_linenumber)::BIGINT AS created_utc FROM lineitem GROUP BY 1")
def ingest_dedup(s, d):
    """Line items as an order's post fetched again and again: the last one's text, the first one's time, of those that have one. Of those fetched at once, the first in the file."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    second = F.rint(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).cast("long")
    fetched = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("fetched_at"), F.col("l_partkey").alias("title"), second.alias("created_utc"), *place)
    return store.latest_per_key(fetched, ["id"], "fetched_at", ["created_utc"], ["file", "row"], filled=True).drop("file", "row")


# ---- text -------------------------------------------------------------------

RAW_FIELDS = ("Machine Learning", "VLSI circuits", "cloud security", "Clinical oncology", "AI", "ai/robotics", "Quantum optics", "chemical engineering", "polymer metallurgy", "applied math", "Actuarial finance", "Aerospace", "petroleum geology", "Education", "Poetry", "email marketing", "")
RAW_PROFESSIONS = ("PhD student in physics", "Asst. Professor", "ML Engineer", "Solar Developer", "Senior SWE", "Post-Doc", "R&D lead", "Resident physician", "Civil Engineer", "Founder & CEO", "Supply-chain manager", "MSc", "Cook", "N/A", "unknown", "")
RAW_FIRMS = ("DIY", "self-petitioned", "WeGreened (Chen)", "EP", "Ellis Porter LLC", "Raju Law Firm", "Columbo & Hurd", "C & H", "Sedaghat", "Arkell", "Peak Immigration", "Ashoori Law Firm", "Ashoori", "ABC Legal, PLLC", "Smith and Associates", "Law Offices", "none", "N/A", "")


def _texts(s, d, values: tuple[str, ...]) -> DataFrame:
    """Customers, each with one of the texts."""
    chosen = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", chosen.alias("raw"))


def _texts_sql(values: tuple[str, ...]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"t AS (SELECT c_custkey, ([{listed}])[c_custkey % {len(values)} + 1] AS raw FROM customer)"


def _case(text: str, rules) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules)


_SAYS_NOTHING = ", ".join(f"'{w}'" for w in taxonomy.SAYS_NOTHING)


@query("normalize_field", f"WITH {_texts_sql(RAW_FIELDS)} SELECT c_custkey, raw, CASE WHEN raw = '' THEN NULL {_case('(chr(32) || lower(raw) || chr(32))', taxonomy.FIELD_KEYWORDS.items())} ELSE 'Other' END AS label FROM t")
def normalize_field(s, d):
    return _texts(s, d, RAW_FIELDS).withColumn("label", taxonomy.field_label(F.col("raw")))


@query("normalize_profession", f"WITH {_texts_sql(RAW_PROFESSIONS)}, u AS (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS w FROM t) SELECT c_custkey, raw, CASE WHEN raw = '' OR w IN ({_SAYS_NOTHING}) THEN NULL {_case('(chr(32) || w || chr(32))', taxonomy.PROFESSION_KEYWORDS)} ELSE 'Other' END AS label FROM u")
def normalize_profession(s, d):
    return _texts(s, d, RAW_PROFESSIONS).withColumn("label", taxonomy.profession_label(F.col("raw")))


_ENDINGS = "|".join(taxonomy.FIRM_ENDINGS)


@query("normalize_law_firm", f"""WITH {_texts_sql(RAW_FIRMS)}, u AS (SELECT *, trim(regexp_replace(replace(lower(raw), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS w, trim(regexp_replace(lower(raw), '[.,]', '', 'g')) AS low FROM t),
  v AS (SELECT *, regexp_replace(low, '( +({_ENDINGS}))+$', '') AS core FROM u)
  SELECT c_custkey, raw, CASE WHEN raw = '' OR w IN ({_SAYS_NOTHING}) THEN NULL {_case('(chr(32) || w || chr(32))', taxonomy.FIRM_ALIASES.items())} WHEN core = low OR core = '' THEN raw
    ELSE array_to_string([CASE WHEN length(x) <= 3 THEN upper(x) ELSE upper(x[1]) || x[2:] END FOR x IN string_split(trim(core), ' ')], ' ') END AS label FROM v""")
def normalize_law_firm(s, d):
    return _texts(s, d, RAW_FIRMS).withColumn("label", taxonomy.law_firm_label(F.col("raw")))


TITLES = ("I-140 approved!", "NIW denied after RFE", "I-485 approved", "i485 and niw approved", "NVC visa interview approved", "Question about letters", "My case", "Timeline", "EB2 petition rejected")
BODIES = ("my petition got approved in 88 days", "The approval process", "I-485 was approved today", "was approved without RFE", "[removed]", "case has been denied. i 485 niw", "")
FLAIRS = ("APPROVED", " denial ", "Question", "I-140", "", "Approval")


def _post_texts(s, d) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda v, at: F.element_at(F.array(*[F.lit(x) for x in v]), (at % len(v) + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", pick(TITLES, k).alias("title"), pick(BODIES, F.floor(k / 3)).alias("body"), pick(FLAIRS, F.floor(k / 5)).alias("flair"))


def _listed(v: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"


POST_TEXT_SQL = f"t AS (SELECT c_custkey, ({_listed(TITLES)})[c_custkey % {len(TITLES)} + 1] AS title, ({_listed(BODIES)})[(c_custkey // 3) % {len(BODIES)} + 1] AS body, ({_listed(FLAIRS)})[(c_custkey // 5) % {len(FLAIRS)} + 1] AS flair FROM customer)"


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_P = prefilter


@query("prefilter_reason", f"""WITH {POST_TEXT_SQL}, u AS (SELECT c_custkey, title, CASE WHEN body IN ('[removed]', '[deleted]') THEN '' ELSE body END AS body, upper(trim(flair)) AS flair FROM t)
  SELECT c_custkey, reason, reason LIKE 'flair:%' OR reason LIKE 'kw:%' AS is_candidate FROM (SELECT c_custkey, CASE WHEN flair IN ('APPROVED', 'APPROVAL', 'DENIED', 'DENIAL') THEN 'flair:' || flair
    WHEN {_m('title', _P.OUTCOME)} AND {_m('title', _P.STATUS_ADJUSTMENT)} AND NOT {_m('title', _P.CONTEXT)} THEN 'excluded:i485' WHEN {_m('title', _P.OUTCOME)} AND {_m('title', _P.CONSULAR)} AND NOT {_m('title', _P.CONTEXT)} THEN 'excluded:nvc'
    WHEN {_m('title', _P.OUTCOME)} THEN 'kw:title' WHEN {_m('body', _P.BODY_DECISION)} AND {_m('body', _P.STATUS_ADJUSTMENT)} AND NOT {_m('body', _P.CONTEXT)} THEN 'excluded:i485' WHEN {_m('body', _P.BODY_DECISION)} THEN 'kw:body' ELSE 'no_signal' END AS reason FROM u)""")
def prefilter_reason(s, d):
    out = _post_texts(s, d).withColumn("reason", prefilter.prefilter_reason(F.col("title"), F.col("body"), F.col("flair")))
    return out.select("c_custkey", "reason", prefilter.is_candidate(F.col("reason")).alias("is_candidate"))


def _story() -> Column:
    """Template text of a case, all parts by the customer's number."""
    k = F.col("c_custkey")
    part = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.floor(k / n) % len(v) + 1).cast("int"))
    return F.concat(
        part(1, "PhD in ", "Master's in ", "Ph.D postdoc, ", "M.D. ", "B.Tech "), part(2, "machine learning", "materials", "law", "robotics"), F.lit(". NIW "), part(3, "approved in ", "denied in ", "pending "), (k % 400).cast("string"), part(5, " days", " months"),
        F.lit(". "), part(7, "no", "12", "3+", "zero", "many"), F.lit(" citations, "), (k % 30).cast("string"), part(4, " peer-reviewed papers", " patents", " expert letters"), F.lit(". "), (k % 15).cast("string"), part(6, ".5 years of experience", "+ years work", " cats"),
        F.lit(". "), part(8, "Premium processing", "no premium", "PP", "regular processing", "slow"), F.lit(", "), part(9, "no RFE", "got RFE", "without an RFE", "fine"), F.lit(". "), part(10, "DIY", "used WeGreened", "Chen Associates", "a friend"), F.lit("; role: "), part(11, "Data Scientist", "cook", "engineer"),
        part(12, ". RD: 2023-01-05 AD: 2023-04-01", ". I-485", ""),
    )


def _story_sql() -> str:
    part = lambda n, *v: f"({_listed(v)})[(c_custkey // {n}) % {len(v)} + 1]"
    return "t AS (SELECT c_custkey, " + " || ".join([
        part(1, "PhD in ", "Master's in ", "Ph.D postdoc, ", "M.D. ", "B.Tech "), part(2, "machine learning", "materials", "law", "robotics"), "'. NIW '", part(3, "approved in ", "denied in ", "pending "), "(c_custkey % 400)::VARCHAR", part(5, " days", " months"),
        "'. '", part(7, "no", "12", "3+", "zero", "many"), "' citations, '", "(c_custkey % 30)::VARCHAR", part(4, " peer-reviewed papers", " patents", " expert letters"), "'. '", "(c_custkey % 15)::VARCHAR", part(6, ".5 years of experience", "+ years work", " cats"),
        "'. '", part(8, "Premium processing", "no premium", "PP", "regular processing", "slow"), "', '", part(9, "no RFE", "got RFE", "without an RFE", "fine"), "'. '", part(10, "DIY", "used WeGreened", "Chen Associates", "a friend"), "'; role: '", part(11, "Data Scientist", "cook", "engineer"),
        part(12, ". RD: 2023-01-05 AD: 2023-04-01", ". I-485", ""),
    ]) + " AS text FROM customer)"


def _stories(s, d) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", _story().alias("text"))


def _g(pattern: str, kind: str = "BIGINT") -> str:
    return f"TRY_CAST(nullif(regexp_extract(text, '{pattern}', 1, 'i'), '') AS {kind})"


def _count_sql(noun: str) -> str:
    return f"CASE WHEN {_m('text', rf'\b(no|zero)\s+{noun}')} THEN 0 ELSE {_g(rf'(\d+)\s*\+?\s*(?:peer[\s-]?reviewed\s*)?{noun}')} END"


_E = extract


@query("extract_counts", f"WITH {_story_sql()} SELECT c_custkey, {_count_sql(_E.CITATIONS)} AS citations, {_count_sql(_E.PUBLICATIONS)} AS publications, {_count_sql(_E.PATENTS)} AS patents, {_count_sql(_E.LETTERS)} AS letters FROM t")
def extract_counts(s, d):
    t = F.col("text")
    found = [extract.count_before(t, p).alias(n) for n, p in (("citations", _E.CITATIONS), ("publications", _E.PUBLICATIONS), ("patents", _E.PATENTS), ("letters", _E.LETTERS))]
    return _stories(s, d).select("c_custkey", *found)


@query("extract_years", f"WITH {_story_sql()} SELECT c_custkey, {_g(_E.YEARS, 'DOUBLE')} AS years FROM t")
def extract_years(s, d):
    return _stories(s, d).select("c_custkey", extract.years_of_experience(F.col("text")).alias("years"))


@query("extract_timeline", f"""WITH {_story_sql()}, u AS (SELECT *, coalesce({_g(_E.IN_DAYS)}, 30 * {_g(_E.IN_MONTHS)}) AS stated, {_g(_E.RECEIVED, 'VARCHAR')} AS r, {_g(_E.DECIDED, 'VARCHAR')} AS a FROM t)
  SELECT c_custkey, coalesce(stated, CASE WHEN date_diff('day', r::DATE, a::DATE) >= 0 THEN date_diff('day', r::DATE, a::DATE) END)::BIGINT AS days, CASE WHEN stated IS NOT NULL THEN 'stated_duration' WHEN r IS NOT NULL AND a IS NOT NULL THEN 'dates' END AS source FROM u""")
def extract_timeline(s, d):
    days, source = derive.processing_days(F.col("t"))
    return _stories(s, d).withColumn("t", extract.timeline(F.col("text"))).select("c_custkey", days.alias("days"), source.alias("source"))


def _first_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{value}'" for condition, value in rules) + " END"


@query("extract_degree", f"WITH {_story_sql()} SELECT c_custkey, {_first_sql([(_m('text', p), n) for n, p in _E.DEGREE_PATTERNS])} AS degree, {_first_sql([(f'contains(lower(text), {chr(39)}{x}{chr(39)})', x) for x in _E.FIELD_TERMS])} AS field FROM t")
def extract_degree(s, d):
    return _stories(s, d).select("c_custkey", extract.degree(F.col("text")).alias("degree"), extract.field(F.col("text")).alias("field"))


@query("extract_flags", f"""WITH {_story_sql()} SELECT c_custkey, CASE WHEN {_m('text', _E.PREMIUM)} THEN TRUE WHEN {_m('text', _E.REGULAR)} THEN FALSE END AS premium, CASE WHEN {_m('text', _E.NO_RFE)} THEN FALSE WHEN {_m('text', _E.RFE)} THEN TRUE END AS rfed,
  CASE WHEN {_m('text', _E.DIY)} THEN 'DIY' ELSE nullif(regexp_extract(text, '{_E.FIRM}', 1, 'i'), '') END AS firm, trim(regexp_extract(text, '{_E.PROFESSION_STATED}', 1, 'i')) AS profession FROM t""")
def extract_flags(s, d):
    t = F.col("text")
    return _stories(s, d).select("c_custkey", extract.premium(t).alias("premium"), extract.had_rfe(t).alias("rfed"), extract.law_firm(t).alias("firm"), extract.profession(t).alias("profession"))


@query("extract_outcome", f"""WITH {_story_sql()}, u AS (SELECT *, CASE WHEN {_m('text', _E.DENIED)} THEN 'denied' WHEN {_m('text', _E.APPROVED)} THEN 'approved' END AS o FROM t),
  v AS (SELECT *, o IS NOT NULL AND {_m('text', _E.CONTEXT)} AND NOT {_m('text', _E.OTHER_FORM)} AS decision FROM u) SELECT c_custkey, decision, CASE WHEN decision THEN o END AS outcome FROM v""")
def extract_outcome(s, d):
    f = extract.heuristic_extract(F.lit(""), F.col("text"))
    return _stories(s, d).withColumn("f", f).select("c_custkey", F.col("f.is_niw_i140_decision").alias("decision"), "f.outcome")


@query("classify_heuristic")
def classify_heuristic(s, d):
    from docketlake.operators.classify import heuristic_rows, with_hash

    posts = _stories(s, d).select(F.col("c_custkey").cast("string").alias("id"), F.lit("case").alias("title"), F.col("text").alias("selftext"), F.lit(None).cast("string").alias("link_flair_text"), F.lit(None).cast("string").alias("op_comments"))
    return heuristic_rows(with_hash(posts), 1)


COMMENT_SQL = """c AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM conversations WHERE text IS NOT NULL),
  o AS (SELECT c.conv_id, c.turn, CASE WHEN p.body IS NOT NULL AND p.body <> '' THEN 'Parent comment (' || p.role || '): ' || p.body || chr(10) || 'OP reply: ' || c.body ELSE 'OP comment: ' || c.body END AS line
        FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.role = 'user' AND c.body <> '')"""


@query("comment_context_concat", f"WITH {COMMENT_SQL}, k AS (SELECT DISTINCT conv_id FROM conversations) SELECT k.conv_id::VARCHAR AS id, coalesce(left(t, 4000), '') AS op_comments FROM k LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) || '---' || chr(10) ORDER BY turn) AS t FROM o GROUP BY 1) USING (conv_id)")
def comment_context_concat(s, d):
    c = table(s, d, "conversations").filter(F.col("text").isNotNull())
    turn = F.col("turn")
    said = c.select(F.col("conv_id").cast("string").alias("post_id"), F.concat(F.lit("c"), turn.cast("string")).alias("id"), F.col("role").alias("author"), F.col("text").alias("body"), F.concat(F.lit("t1_c"), (turn - 1).cast("string")).alias("parent_id"), turn.cast("long").alias("created_utc"))
    posts = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.lit("user").alias("author")).distinct()
    return comments.op_comments(posts, said)


_PII_ASCII = ("email", "linkedin", "github_profile", "other_profile")


@query("pii_counts", "WITH " + ", ".join(f"{k} AS (SELECT '{k}' AS kind, sum(len(regexp_extract_all(coalesce(text, ''), '{pii.DETECTORS[k]}')))::BIGINT AS n FROM documents)" for k in _PII_ASCII) + " " + " UNION ALL ".join(f"SELECT * FROM {k}" for k in _PII_ASCII))
def pii_counts(s, d):
    return pii.counts(table(s, d, "documents"), F.col("text"), _PII_ASCII)


@query("pii_email", f"SELECT doc_id, unnest(regexp_extract_all(text, '{pii.HARD['email']}')) AS found FROM documents")
def pii_email(s, d):
    return pii.find(table(s, d, "documents"), "doc_id", F.col("text"), ("email",)).select("doc_id", "found")


# DuckDB has no look-behind: a match must follow the start or a character that is no digit, and numbers that touch are told apart by doubling what stands between.
@query("pii_phone", "SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9])((?:\\(\\([0-9]{3}\\)\\)(?:\\s\\s)?|[0-9]{3}(?:--|\\.\\.|\\s\\s))[0-9]{3}(?:--|\\.\\.|\\s\\s)[0-9]{4})(?:[^0-9]|$)', 1)) AS doubled FROM documents")
def pii_phone(s, d):
    found = pii.find(table(s, d, "documents"), "doc_id", F.col("text"), ("phone",))
    return found.select("doc_id", F.regexp_replace("found", "([^0-9])", "$1$1").alias("doubled"))


@query("pii_samples")
def pii_samples(s, d):
    return pii.samples(table(s, d, "documents"), "doc_id", F.col("text"))


@query("top_authors", f"WITH {POSTS_SQL} SELECT author, count(*) AS n FROM posts WHERE author <> '[deleted]' GROUP BY 1 ORDER BY n DESC, author LIMIT 8")
def top_authors(s, d):
    return pii.top_authors(bound_posts(s, d))


# ---- output -----------------------------------------------------------------


@query("slim_pairs", f"{BASE} SELECT id, run, profession_raw, law_firm_normalized AS law_firm, citations, citations IS NOT NULL AS citations_known, years_experience, years_experience IS NOT NULL AS years_known FROM rec")
def slim_pairs(s, d):
    wire = records.slim(bound_records(s, d).withColumn("rfe_date", F.col("profession_raw")))
    return wire.select("id", "run", F.col("rfe_date").alias("profession_raw"), "law_firm", F.col("citations.value").alias("citations"), F.col("citations.known").alias("citations_known"), F.col("years_experience.value").alias("years_experience"), F.col("years_experience.known").alias("years_known"))


@query("slim_round_trip", f"{BASE} SELECT id, run, publications, patents, processing_days FROM rec")
def slim_round_trip(s, d):
    wire = sinks.wire_json(records.slim(bound_records(s, d)))
    return records.from_slim(sinks.parse_wire(wire.select("json"))).select("id", "run", "publications", "patents", "processing_days")


def _number_sql(c: str) -> str:
    return f"coalesce({c}::VARCHAR, '')"


@query("csv_rows", f"""{BASE}, {VOTE_SQL} SELECT id, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d') || ',' || coalesce(outcome, '') || ',' || coalesce(degree, '') || ',' || coalesce(field_normalized, '') || ',' || coalesce(profession_normalized, '') || ',' || coalesce(law_firm_normalized, '') || ',' ||
  {_number_sql('citations')} || ',' || {_number_sql('publications')} || ',' || {_number_sql('patents')} || ',' || {_number_sql('round(years_experience)::BIGINT')} || ',' || {_number_sql('processing_days')} || ',' || coalesce({LABEL_SQL['premium']}, '') || ',' ||
  CASE WHEN was_rfed THEN 'Yes' WHEN NOT was_rfed THEN 'No' ELSE '' END || ',,,,https://www.reddit.com' || permalink || ',"post ""' || id || '"", ok"' AS line FROM voted""")
def csv_rows(s, d):
    view = bound_view(s, d).withColumns({"years_experience": F.round("years_experience"), "title": F.concat(F.lit('post "'), "id", F.lit('", ok'))})
    return sinks.csv_lines(view).select("id", "line")


_SHOWN = ("id", "outcome", "degree", "field_normalized", "profession_normalized", "law_firm_normalized", "publications", "patents", "citations", "years", "processing_days", "premium_processing", "was_rfed", "run", "title", "permalink", "flair", "created_utc", "selftext", "op_comments", "classified_at", "prompt_version", "schema_version", "rfe_date", "rfe_response_date")


@query("content_fingerprint", f"""{BASE}, p AS (SELECT id AS pid, title, link_flair_text AS flair, selftext FROM posts),
  x AS (SELECT rec.*, title, flair, selftext, NULL AS op_comments, NULL AS rfe_date, NULL AS rfe_response_date, years_experience::DECIMAL(18,1)::VARCHAR AS years FROM rec JOIN p ON pid = id),
  h AS (SELECT sha256(concat_ws('|', {", ".join(f"coalesce({c}::VARCHAR, chr(92) || 'N')" for c in _SHOWN)})) AS h FROM x)
  SELECT left(sha256('|' || sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT) || '|' || sum(('0x' || substr(h, 17, 15))::UBIGINT::HUGEINT) || '|' || count(*)), 16) AS fingerprint FROM h""")
def content_fingerprint(s, d):
    """Years to one digit, so that both engines write them alike."""
    return records.fingerprint(bound_records(s, d).withColumn("years_experience", F.col("years_experience").cast("decimal(18,1)")))


@query("version_runs", f"WITH {CLASSIFIED_SQL} SELECT prompt_version || '/' || schema_version AS version_key, run_key, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) FILTER (WHERE status = 'failed') AS failed, count(DISTINCT post_id) AS posts, max(classified_at) AS last_classified_at FROM cls GROUP BY 1, 2")
def version_runs(s, d):
    rows = pipeline.version_runs(bound_classified(s, d)).select("version_key", F.explode("runs").alias("r"))
    return rows.select("version_key", *[F.col(f"r.{c}") for c in ("run_key", "ok", "excluded", "failed", "posts", "last_classified_at")])


@query("dashboard_view", f"{REFILE_SQL} SELECT v.id, v.run, v.outcome, CASE WHEN m.id IS NOT NULL THEN TRUE END AS refiled, m.url AS refiled_url, CASE WHEN n.next_id IS NOT NULL THEN TRUE END AS refile_approval FROM voted v LEFT JOIN m ON m.id = v.id LEFT JOIN (SELECT DISTINCT next_id FROM m) n ON n.next_id = v.id")
def dashboard_view(s, d):
    return views.mark_refiled(bound_view(s, d)).select("id", "run", "outcome", "refiled", "refiled_url", "refile_approval")


@query("json_extract_object", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract_object(s, d):
    said = table(s, d, "events").withColumn("answer", F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("So "), "props", F.lit(" it is"))))
    return said.select("event_id", F.try_variant_get(jsonx.extract_json_object(F.col("answer")), "$.k", "long").alias("k"))


@query("run_keys", "SELECT n_nationkey, 'b/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '@high' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN '#x' ELSE '' END AS run_key FROM nation")
def run_keys(s, d):
    n = F.col("n_nationkey")
    return table(s, d, "nation").select("n_nationkey", derive.run_key(F.lit("b"), F.col("n_name"), F.when(n % 2 == 0, "high").otherwise(""), F.when(n % 3 == 0, "x")).alias("run_key"))


@query("infer_premium", f"WITH {CLASSIFIED_SQL} SELECT post_id, run_key, profession_raw, CASE WHEN premium_stored IS NULL AND processing_days > 90 AND NOT coalesce(was_rfed, FALSE) THEN FALSE ELSE premium_stored END AS premium FROM cls")
def infer_premium(s, d):
    return bound_classified(s, d).select("post_id", "run_key", "profession_raw", derive.infer_premium(F.col("premium_processing"), F.col("processing_days"), F.col("was_rfed")).alias("premium"))


@query("chart_rows", f"{BASE} SELECT {QUARTER} AS quarter, greatest(0, count(*) - count(*) FILTER (WHERE outcome = 'approved') - count(*) FILTER (WHERE outcome = 'denied')) AS other FROM rec GROUP BY 1")
def chart_rows(s, d):
    q = stats.quarter_series(bound_records(s, d))
    return q.select("quarter", derive.undecided(F.col("count"), F.col("approved"), F.col("denied")).alias("other"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The dashboard's charts over the vote of the last years."""
    return chart(stats.distributions(filters.in_range(bound_view(s, d), start=0)))


