"""Shared plan building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is evaluated exactly once per row.

    A plain projected column is copied into every later filter, explode guard and lambda that uses
    it. Generate is a barrier to that: its output is an attribute, not an expression. (The outer
    form, because the inner one adds a guard on the very expression.)
    """
    return df.select(*df.columns, F.explode_outer(F.array(value)).alias(name))
