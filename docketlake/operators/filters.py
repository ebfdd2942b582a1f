"""Predicates of the dashboard: time, quarters, facets and the tail behind "Other"."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.derive import facet, quarter_key
from docketlake.schema import DAY, RANGE_DAYS, UNKNOWN


def window_from_range(key: str, now: int) -> tuple[int, int]:
    """(start, end) of a relative range; ValueError for an unknown one."""
    if key not in RANGE_DAYS:
        raise ValueError(f"unknown range: {key!r}")
    return now - RANGE_DAYS[key] * DAY, now


def resolve_window(range_key: str | None = None, start: str | None = None, end: str | None = None, now: int = 0) -> tuple[int | None, int | None]:
    """A range, else ISO dates, the end's day included; ValueError for what doesn't parse."""
    if range_key and range_key != "all":
        return window_from_range(range_key, now)

    def epoch(day: str) -> int:
        return int(dt.datetime.combine(dt.date.fromisoformat(day), dt.time(), dt.UTC).timestamp())

    return (epoch(start) if start else None), (epoch(end) + DAY - 1 if end else None)


def in_range(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Both ends included, either may be open. Constant per post, so it may go below the vote."""
    df = df.filter(F.col("created_utc") >= start) if start is not None else df
    return df.filter(F.col("created_utc") <= end) if end is not None else df


def in_quarters(df: DataFrame, quarters: list[str]) -> DataFrame:
    """Any of the quarters; all if none is named."""
    return df.filter(quarter_key(F.col("created_utc")).isin(*quarters)) if quarters else df


def in_facets(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Any label within a metric, and all metrics; an empty list doesn't restrict. "Unknown" can be chosen."""
    chosen = [facet(metric).isin(*labels) for metric, labels in filters.items() if labels]
    return df.filter(reduce(lambda a, b: a & b, chosen)) if chosen else df


def other_tail(df: DataFrame, metric: str, named: list[str]) -> DataFrame:
    """Records behind a chart's "Other": known, and none of its named labels."""
    label = facet(metric)
    return df.filter((label != UNKNOWN) & ~label.isin(*named)) if named else df.filter(label != UNKNOWN)


def page(df: DataFrame, number: int, size: int = 25) -> DataFrame:
    """A page of records, newest first; ``number`` counts from 0, and past the end is the last page."""
    if number < 0 or size <= 0:
        raise ValueError("page numbers start at 0 and pages have rows")
    if number:
        number = min(number, max(0, (df.count() - 1) // size))
    return df.orderBy(F.coalesce("created_utc", F.lit(0)).desc(), "id").offset(number * size).limit(size)


def first_records(df: DataFrame, limit: int = 1000) -> DataFrame:
    if limit < 0:
        raise ValueError("limit can't be negative")
    return df.orderBy(F.coalesce("created_utc", F.lit(0)).desc(), "id").limit(limit)
