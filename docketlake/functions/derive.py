"""Derived columns: keys, hashes, labels and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import filled, first_match, strip
from docketlake.schema import BINS, INFER_REGULAR_AFTER_DAYS, UNKNOWN, WITHDRAWN

#: Metric names to record columns, of labels and of numbers.
CATEGORICAL = {
    "outcome": lambda: F.col("outcome"),
    "degree": lambda: F.col("degree"),
    "field": lambda: F.col("field_normalized"),
    "profession": lambda: F.col("profession_normalized"),
    "law_firm": lambda: F.col("law_firm_normalized"),
    "premium": lambda: premium_label(F.col("premium_processing")),
    "rfe": lambda: rfe_label(F.col("was_rfed")),
}
NUMERIC = tuple(BINS)
METRICS = (*CATEGORICAL, *NUMERIC)


def run_key(backend: Column, model: Column, effort: Column, label: Column) -> Column:
    """backend/model, with @effort and #label where there are any."""
    part = lambda sign, c: F.when(filled(c) != "", F.concat(F.lit(sign), c)).otherwise("")
    return F.concat(backend, F.lit("/"), F.coalesce(F.nullif(model, F.lit("")), backend), part("@", effort), part("#", label))


def run_key_text(backend: str, model: str | None = None, effort: str | None = None, label: str | None = None) -> str:
    """The same of a run's settings, before anything has run."""
    return f"{backend}/{model or backend}" + (f"@{effort}" if effort else "") + (f"#{label}" if label else "")


def version_key(prompt: Column, schema: Column) -> Column:
    return F.concat(filled(prompt), F.lit("/"), filled(schema))


def content_hash(title: Column, body: Column, flair: Column, op_comments: Column) -> Column:
    """SHA-256 over the stripped texts, a line each; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *[strip(filled(c)) for c in (title, body, flair, op_comments)]), 256)


def quarter_key(epoch: Column) -> Column:
    """YYYY-Qn in UTC."""
    ts = F.timestamp_seconds(epoch)
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def infer_premium(premium: Column, days: Column, rfed: Column) -> Column:
    """Regular, where premium isn't stated and a case without a request for evidence took longer than premium allows."""
    slow = premium.isNull() & F.coalesce(days > INFER_REGULAR_AFTER_DAYS, F.lit(False)) & ~F.coalesce(rfed, F.lit(False))
    return F.when(slow, False).otherwise(premium)


def processing_days(timeline: Column) -> tuple[Column, Column]:
    """(days, source): as stated, else between the two dates if not negative."""
    iso = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    between = F.datediff(iso(timeline["decision_date"]), iso(timeline["receipt_date"])).cast("long")
    between = F.when(between >= 0, between)
    stated, source = timeline["processing_days"], timeline["processing_source"]
    return F.coalesce(stated, between), F.when(stated.isNotNull(), F.coalesce(F.nullif(source, F.lit("")), F.lit("stated_duration"))).when(between.isNotNull(), "dates").otherwise(source)


def premium_label(premium: Column) -> Column:
    return F.when(premium, "Premium").when(~premium, "Regular")


def rfe_label(rfed: Column) -> Column:
    return F.when(rfed, "RFE'd").when(~rfed, "No RFE")


def bin_label(value: Column, metric: str) -> Column:
    """The bin of a value; null for null. A value below all bins lands in the last."""
    bins = BINS[metric]
    rules = [((value >= low) & (value < high), label) for label, low, high in bins if high is not None]
    return F.when(value.isNotNull(), first_match(rules, bins[-1][0]))


def bin_rank(label: Column, metric: str) -> Column:
    return first_match([(label == name, F.lit(i)) for i, (name, _, _) in enumerate(BINS[metric])], F.lit(len(BINS[metric])))


def metric_label(metric: str) -> Column:
    """The label of a record for any metric, null if unknown. An empty label counts as unknown."""
    if metric in CATEGORICAL:
        return F.nullif(CATEGORICAL[metric](), F.lit(""))
    if metric in BINS:
        return bin_label(F.col(metric), metric)
    raise ValueError(f"unknown metric: {metric!r}")


def facet(metric: str) -> Column:
    return F.coalesce(metric_label(metric), F.lit(UNKNOWN))


def undecided(count: Column, approved: Column, denied: Column) -> Column:
    return F.greatest(F.lit(0), count - approved - denied)


def percent(rate: Column) -> Column:
    return F.round(rate * 100).cast("int")


def body_available(body: Column) -> Column:
    return (filled(body) != "") & ~body.isin(*WITHDRAWN)


def source_text(title: Column, flair: Column, body: Column, op_comments: Column) -> Column:
    """What a record was read from, in one block."""
    shown, comments = strip(filled(body)), strip(filled(op_comments))
    return F.concat(
        F.lit("TITLE: "), filled(title), F.when(filled(flair) != "", F.concat(F.lit("\nFLAIR: "), flair)).otherwise(""),
        F.lit("\n\n"), F.when(shown == "", "[body unavailable]").otherwise(shown),
        F.when(comments != "", F.concat(F.lit("\n\nOP COMMENTS:\n"), comments)).otherwise(""),
    )


def user_prompt(title: Column, body: Column, flair: Column, op_comments: Column) -> Column:
    """The text a model classifies."""
    shown = F.when((filled(body) == "") | body.isin(*WITHDRAWN), "[body unavailable]").otherwise(body)
    comments = strip(filled(op_comments))
    intro = "\n\nOP's own comments on this post, sometimes with parent-comment context (authoritative detail about the same case):\n"
    return F.concat(
        F.lit("Flair: "), F.coalesce(F.nullif(flair, F.lit("")), F.lit("none")), F.lit("\nTitle: "), filled(title), F.lit("\n\nBody:\n"), shown,
        F.when(comments != "", F.concat(F.lit(intro), comments)).otherwise(""), F.lit("\n\nExtract the structured data as a single JSON object."),
    )


def duration_text(seconds: Column) -> Column:
    """1h02m, 3m04s or 5s; a dash for null."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(seconds.isNull(), "—").when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, rest)).otherwise(F.format_string("%ds", rest))


def utc_text(epoch: Column) -> Column:
    """YYYY-MM-DD HH:MM; a year of more than four digits has no sign before it."""
    return F.ltrim(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"), F.lit("+"))


