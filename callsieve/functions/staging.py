"""Evaluate expensive expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections and filters read, never recompute.

    A plain ``withColumn`` may be inlined into each place that uses it, filters
    pushed below it included; for a parsed document that multiplies the work.
    Expanding a one-element array of structs is a boundary the optimizer moves
    no expression across. It keeps whole-stage code generation and adds no row.
    """
    record = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(record)))
