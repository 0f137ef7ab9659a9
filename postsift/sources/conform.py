"""Bringing tables of any origin onto the shared column lists."""

from pyspark.sql import DataFrame, functions as F

from postsift import vocab


def conform_unified(df: DataFrame, columns=None) -> DataFrame:
    """The 25 unified columns in order, as strings; absent or null ones are ''."""
    present = set(df.columns)
    return df.select(*[
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in present else F.lit("")).alias(c)
        for c in (columns or vocab.UNIFIED_COLUMNS)
    ])


def backfill_columns(df: DataFrame, columns=None) -> DataFrame:
    """Add the label view's absent columns as ''."""
    missing = [c for c in (columns or vocab.LABEL_VIEW_COLUMNS) if c not in df.columns]
    return df.withColumns({c: F.lit("") for c in missing}) if missing else df


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column one frame lacks is '' there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.na.fill("")
