"""Which posts are worth classifying: ordered rules that give a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import filled, first_match, matches, strip
from docketlake.schema import WITHDRAWN

# Flairs and patterns of the rules.
DECISION_FLAIRS = ("APPROVED", "APPROVAL", "DENIED", "DENIAL")
OUTCOME = r"\b(approved|approval|denied|denial|rejected)\b"
CONTEXT = r"\b(niw|i[\s-]?140|eb[\s-]?2|petition|national interest)\b"
STATUS_ADJUSTMENT = r"\b(i[\s-]?485|adjustment of status|\baos\b|advance parole|green card in hand)\b"
CONSULAR = r"\b(nvc|consular|ds[\s-]?260|visa interview|visa stamp)\b"
BODY_DECISION = (
    r"\b(?:was|got|been|i[\s-]?140|niw|petition|case)\b[^.\n]{0,30}\b(?:approved|denied)\b"
    r"|\b(?:approved|denied)\b[^.\n]{0,25}\b(?:without (?:an )?rfe|in \d+\s*(?:day|week|month))"
)


def visible_body(body: Column) -> Column:
    """Empty for a withdrawn post."""
    return F.when(body.isin(*WITHDRAWN), "").otherwise(filled(body))


def prefilter_reason(title: Column, body: Column, flair: Column) -> Column:
    title, body, flair = filled(title), visible_body(body), F.upper(strip(filled(flair)))
    in_title, in_body = matches(title, OUTCOME), matches(body, BODY_DECISION)
    off_topic = lambda text, pattern: matches(text, pattern) & ~matches(text, CONTEXT)
    return first_match(
        [
            (flair.isin(*DECISION_FLAIRS), F.concat(F.lit("flair:"), flair)),
            (in_title & off_topic(title, STATUS_ADJUSTMENT), "excluded:i485"),
            (in_title & off_topic(title, CONSULAR), "excluded:nvc"),
            (in_title, "kw:title"),
            (in_body & off_topic(body, STATUS_ADJUSTMENT), "excluded:i485"),
            (in_body, "kw:body"),
        ],
        "no_signal",
    )


def is_candidate(reason: Column) -> Column:
    return reason.startswith("flair:") | reason.startswith("kw:")
