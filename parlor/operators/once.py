"""Evaluate costly expressions once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read without recomputing them.

    A filter on a plain computed column is pushed below it, which repeats the expression (for
    example a regular expression over the whole text). A one-row generator keeps it in place.
    """
    kept = [c for c in df.columns if c not in columns]
    added = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*kept, added)
