"""Filters on columns that were dear to compute."""

from pyspark.sql import Column, DataFrame, functions as F


def filter_here(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows that meet a condition, tested where it stands in the plan.

    A plain filter is moved below the projections that computed its columns and repeats
    all of their work, once more for each use. Rows leave a generator instead: one that
    fails the condition yields nothing.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*df.columns)))))
