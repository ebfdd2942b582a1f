"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The tables' columns.
RAW_SCHEMA = (
    T.StructType()
    .add("id", "string")
    .add("subreddit", "string")
    .add("title", "string")
    .add("selftext", "string")
    .add("link_flair_text", "string")
    .add("author", "string")
    .add("score", "long")
    .add("num_comments", "long")
    .add("permalink", "string")
    .add("url", "string")
    .add("created_utc", "long")
    .add("fetched_at", "long")
    .add("raw_json", "string")
    .add("source", "string")
    .add("is_candidate", "boolean")
    .add("prefilter_reason", "string")
    .add("op_comments", "string")
)
CLASSIFIED_KEY = ["post_id", "content_hash", "prompt_version", "schema_version", "run_key"]
COUNT_METRICS = ["publications", "patents", "citations", "recommendation_letters"]
CLASSIFIED_SCHEMA = (
    T.StructType()
    .add("post_id", "string")
    .add("content_hash", "string")
    .add("prompt_version", "string")
    .add("schema_version", "string")
    .add("run_key", "string")
    .add("classifier_backend", "string")
    .add("classifier_model", "string")
    .add("run_effort", "string")
    .add("run_label", "string")
    .add("status", "string")
    .add("failure_reason", "string")
    .add("body_available", "boolean")
    .add("outcome", "string")
    .add("degree", "string")
    .add("field_raw", "string")
    .add("field_normalized", "string")
    .add("profession_raw", "string")
    .add("profession_normalized", "string")
    .add("law_firm_raw", "string")
    .add("law_firm_normalized", "string")
    .add("publications", "long")
    .add("publications_known", "boolean")
    .add("patents", "long")
    .add("patents_known", "boolean")
    .add("citations", "long")
    .add("citations_known", "boolean")
    .add("recommendation_letters", "long")
    .add("recommendation_letters_known", "boolean")
    .add("years_experience", "double")
    .add("years_experience_known", "boolean")
    .add("receipt_date", "string")
    .add("decision_date", "string")
    .add("processing_days", "long")
    .add("processing_days_known", "boolean")
    .add("processing_source", "string")
    .add("premium_processing", "boolean")
    .add("was_rfed", "boolean")
    .add("rfe_date", "string")
    .add("rfe_response_date", "string")
    .add("classified_at", "long")
    .add("raw_llm_output", "string")
)
STATE_SCHEMA = (
    T.StructType()
    .add("subreddit", "string")
    .add("last_created_utc", "long")
    .add("last_run_at", "long")
)
META_SCHEMA = (
    T.StructType()
    .add("key", "string")
    .add("value", "string")
)
COMMENT_SCHEMA = (
    T.StructType()
    .add("post_id", "string")
    .add("id", "string")
    .add("author", "string")
    .add("body", "string")
    .add("parent_id", "string")
    .add("created_utc", "long")
)

#: The extraction contract: what a classifier returns for one post.
EXTRACTED = (
    "struct<is_niw_i140_decision:boolean,outcome:string,degree:string,field_raw:string,profession_raw:string,law_firm_raw:string,"
    "publications:struct<value:bigint,known:boolean>,patents:struct<value:bigint,known:boolean>,citations:struct<value:bigint,known:boolean>,"
    "recommendation_letters:struct<value:bigint,known:boolean>,years_experience:struct<value:double,known:boolean>,"
    "timeline:struct<receipt_date:string,decision_date:string,processing_days:bigint,processing_source:string,premium_processing:boolean,"
    "was_rfed:boolean,rfe_date:string,rfe_response_date:string>>"
)

# Labels, bins (lower inclusive, upper exclusive, None without end), windows and versions.
OUTCOMES = ("approved", "denied")
DEGREES = ("PhD", "Masters", "Bachelors", "MD", "Postdoc", "Other")
PROCESSING_SOURCES = ("dates", "stated_duration")
UNKNOWN, OTHER, TOP_CATEGORIES = "Unknown", "Other", 9
BINS: dict[str, list[tuple[str, int, int | None]]] = {
    "publications": [("0", 0, 1), ("1–2", 1, 3), ("3–5", 3, 6), ("6–10", 6, 11), ("11–20", 11, 21), ("21+", 21, None)],
    "patents": [("0", 0, 1), ("1", 1, 2), ("2–3", 2, 4), ("4+", 4, None)],
    "citations": [("0", 0, 1), ("1–10", 1, 11), ("11–20", 11, 21), ("21–30", 21, 31), ("31–50", 31, 51), ("51–100", 51, 101), ("101–200", 101, 201), ("201–500", 201, 501), ("501+", 501, None)],
    "years_experience": [("0–2", 0, 3), ("3–5", 3, 6), ("6–10", 6, 11), ("11–15", 11, 16), ("16+", 16, None)],
    "processing_days": [("0–30", 0, 31), ("31–60", 31, 61), ("61–90", 61, 91), ("91–120", 91, 121), ("121–180", 121, 181), ("181–365", 181, 366), ("365+", 366, None)],
}
RANGE_DAYS = {"3m": 90, "6m": 180, "12m": 365, "24m": 730, "36m": 1095}
DAY = 86_400
INFER_REGULAR_AFTER_DAYS = 90
AUTHOR_SKIP = ("", "[deleted]", "[removed]", "AutoModerator")
WITHDRAWN = ("[removed]", "[deleted]")
PROMPT_VERSION, SCHEMA_VERSION = "p3", "s3"
COMPOSITE = "composite"
PUBLIC_DROP = ("selftext", "op_comments", "author")
COMMENT_SEPARATOR, COMMENT_CHARS = "\n---\n", 4000
COMPLETENESS = ("degree", "field", "profession", "law_firm", "citations", "publications", "patents", "processing_days", "premium", "rfe")
CSV_COLUMNS = (
    "date", "outcome", "degree", "field", "profession", "law_firm", "citations", "publications", "patents", "years_experience",
    "processing_days", "premium_processing", "rfe", "rfe_date", "rfe_response_date", "refiled", "reddit_url", "title",
)
