"""Helpers for tables whose column names aren't known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anonymous(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with its columns under internal names, and those columns by their own names: nothing added then clashes."""
    internal = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*internal), {name: F.col(c) for name, c in zip(df.columns, internal, strict=True)}
