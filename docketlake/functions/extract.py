"""Heuristic extraction of a case's facts from post text, as Columns.

What isn't mentioned is null; an explicit "no ..." is zero. The patterns are
fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import filled, first_match, group, matches, strip

# What the texts are matched with.
APPROVED = r"\b(approved|approval|granted)\b"
DENIED = r"\b(denied|denial|rejected)\b"
OTHER_FORM = r"\b(i[\s-]?485|adjustment of status|consular|nvc|ds[\s-]?260)\b"
CONTEXT = r"\b(niw|i[\s-]?140|eb[\s-]?2|petition|national interest)\b"
DEGREE_PATTERNS = [
    ("PhD", r"\bph\.?\s?d\b|\bdoctorate\b"),
    ("Postdoc", r"\bpost[\s-]?doc"),
    ("MD", r"\bm\.?d\b"),
    ("Masters", r"master'?s?\b|\bm\.?s\.?\b|\bm\.?eng\b|\bmba\b"),
    ("Bachelors", r"bachelor'?s?\b|\bb\.?s\.?\b|\bb\.?tech\b"),
]
FIELD_TERMS = (
    "machine learning", "artificial intelligence", "computer vision", "data science", "bioinformatics", "biology", "genomics", "neuroscience",
    "chemistry", "materials science", "materials", "physics", "economics", "finance", "mechanical engineering", "electrical engineering",
    "civil engineering", "robotics", "public health",
)
PROFESSION_TERMS = (
    "phd student", "postdoc", "postdoctoral researcher", "software engineer", "data scientist", "research scientist", "researcher", "physician",
    "assistant professor", "professor", "entrepreneur", "founder", "engineer",
)
PROFESSION_STATED = r"\b(?:occupation|profession|role|job title|current status|position)[:\s-]+([^\n.;,]+)"
PUBLICATIONS = r"(?:publications?|papers?|pubs?)"
PATENTS = r"(?:patents?|patent applications?|provisional patents?)"
CITATIONS = r"citations?"
LETTERS = r"(?:(?:recommendation|testimonial|expert|reference|support)\s+letters?|letters?)"
YEARS = r"(\d+(?:\.\d+)?)\s*\+?\s*years?(?:\s+of)?\s+(?:experience|exp|work)"
IN_DAYS, IN_MONTHS, DAYS_PER_MONTH = r"approved in\s+(\d+)\s+days", r"(?:approved|decision)\s+in\s+(\d+)\s+months", 30
RECEIVED, DECIDED = r"(?:RD|receipt date)[:\s]+(\d{4}-\d{2}-\d{2})", r"(?:AD|approval date|decision date)[:\s]+(\d{4}-\d{2}-\d{2})"
PREMIUM, REGULAR = r"\bpremium processing\b|\bexpedited\b|\bpp\b", r"\bregular processing\b|\bstandard processing\b|\bno premium\b"
NO_RFE, RFE = r"without (?:an )?rfe|\bno rfe\b", r"\brfe\b|request for evidence"
DIY, FIRM = r"\b(diy|self[\s-]?petition|pro se|no (?:lawyer|attorney))\b", r"\b(wegreened|chen immigration|chen associates)\b"
USAGE_LIMIT = r"usage limit reached|limit will reset|\blimit reached\b|resets? (?:at|in)|hour limit"
EPOCH = r"\b(1[6-9]\d{8})\b"


def count_before(text: Column, noun: str) -> Column:
    """The number before ``noun``; 0 for "no" or "zero", null if there is none."""
    number = group(text, rf"(\d+)\s*\+?\s*(?:peer[\s-]?reviewed\s*)?{noun}")
    return F.when(matches(text, rf"\b(no|zero)\s+{noun}"), F.lit(0).cast("long")).otherwise(number.try_cast("long"))


def years_of_experience(text: Column) -> Column:
    return group(text, YEARS).try_cast("double")


def profession(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(strip(group(text, PROFESSION_STATED)), first_match([(F.contains(low, F.lit(t)), t) for t in PROFESSION_TERMS]))


def field(text: Column) -> Column:
    low = F.lower(text)
    return first_match([(F.contains(low, F.lit(t)), t) for t in FIELD_TERMS])


def degree(text: Column) -> Column:
    return first_match([(matches(text, p), d) for d, p in DEGREE_PATTERNS])


def law_firm(text: Column) -> Column:
    return F.when(matches(text, DIY), F.lit("DIY")).otherwise(group(text, FIRM))


def premium(text: Column) -> Column:
    return F.when(matches(text, PREMIUM), True).when(matches(text, REGULAR), False)


def had_rfe(text: Column) -> Column:
    return F.when(matches(text, NO_RFE), False).when(matches(text, RFE), True)


def timeline(text: Column) -> Column:
    """Stated days, else stated months, else both dates."""
    days, months = group(text, IN_DAYS).try_cast("long"), group(text, IN_MONTHS).try_cast("long")
    stated = F.coalesce(days, months * DAYS_PER_MONTH)
    received, decided = group(text, RECEIVED), group(text, DECIDED)
    dated = stated.isNull() & received.isNotNull() & decided.isNotNull()
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(dated, received).alias("receipt_date"),
        F.when(dated, decided).alias("decision_date"),
        stated.alias("processing_days"),
        F.when(stated.isNotNull(), "stated_duration").when(dated, "dates").alias("processing_source"),
        premium(text).alias("premium_processing"),
        had_rfe(text).alias("was_rfed"),
        none.alias("rfe_date"),
        none.alias("rfe_response_date"),
    )


def outcome_stated(text: Column) -> Column:
    """A denial anywhere outweighs an approval."""
    return F.when(matches(text, DENIED), "denied").when(matches(text, APPROVED), "approved")


def known(value: Column) -> Column:
    return F.struct(value.alias("value"), value.isNotNull().alias("known"))


def heuristic_extract(title: Column, body: Column, op_comments: Column | None = None) -> Column:
    """The extraction contract (``schema.EXTRACTED``) of a post."""
    text = F.concat(filled(title), F.lit("\n"), filled(body), F.lit("\n"), filled(op_comments) if op_comments is not None else F.lit(""))
    outcome = outcome_stated(text)
    decision = outcome.isNotNull() & matches(text, CONTEXT) & ~matches(text, OTHER_FORM)
    return F.struct(
        decision.alias("is_niw_i140_decision"),
        F.when(decision, outcome).alias("outcome"),
        degree(text).alias("degree"),
        field(text).alias("field_raw"),
        profession(text).alias("profession_raw"),
        law_firm(text).alias("law_firm_raw"),
        known(count_before(text, PUBLICATIONS)).alias("publications"),
        known(count_before(text, PATENTS)).alias("patents"),
        known(count_before(text, CITATIONS)).alias("citations"),
        known(count_before(text, LETTERS)).alias("recommendation_letters"),
        known(years_of_experience(text)).alias("years_experience"),
        timeline(text).alias("timeline"),
    )


def usage_limit(text: Column) -> Column:
    """(hit, reset_epoch): whether a model's output says its usage limit was reached, and until when."""
    hit = F.coalesce(matches(text, USAGE_LIMIT), F.lit(False))
    return F.struct(hit.alias("hit"), F.when(hit, group(text, EPOCH).try_cast("long")).alias("reset_epoch"))
