"""Text helpers as Columns, with the Unicode behaviour of the data model."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive, with Unicode character classes.
UNICODE = "(?iU)"


def strip(text: Column) -> Column:
    """Without white space, of any Unicode kind, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """The first match's group, null where there is none."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, index), F.lit(""))


def any_contains(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_match(rules: Iterable[tuple[Column, Column | str | None]], otherwise: Column | str | None = None) -> Column:
    """The value of the first rule that holds."""
    out: Column | None = None
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    for condition, value in rules:
        out = F.when(condition, as_column(value)) if out is None else out.when(condition, as_column(value))
    if out is None:
        return as_column(otherwise)
    return out.otherwise(as_column(otherwise)) if otherwise is not None else out
