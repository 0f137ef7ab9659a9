"""Scraped postings to one shuffled, deduplicated batch for annotators."""

from pyspark.sql import DataFrame, functions as F

from postsift import vocab
from postsift.functions import notes, text
from postsift.operators import annotation, dedupe
from postsift.sources.conform import union_sources


def blank_description_filter(df: DataFrame) -> DataFrame:
    return df.filter(text.strip(text.or_empty("description")) != "")


def with_annotation_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "short_text": notes.short_text_flag("description"),
        "urgency_terms": notes.urgency_hint("description"),
        "notes": F.lit(""),
    })


def build_annotation_batch(*scrapes: DataFrame, seed=vocab.SEED) -> DataFrame:
    """Unified columns, the four annotation columns and ``row``, the shuffled position.

    Inputs carry ``source_rank`` and ``ordinal`` (load order).
    """
    rows = blank_description_filter(union_sources(*scrapes))
    unique = with_annotation_columns(dedupe.annotation_dedupe(rows, hash_name="_hash"))
    keyed = unique.withColumn("_id", F.concat_ws("|", "source", "_hash"))
    present = set(keyed.columns)
    absent = {c: F.lit("") for c in vocab.UNIFIED_COLUMNS if c not in present}
    keyed = keyed.withColumns(absent) if absent else keyed
    placed = annotation.annotation_shuffle(
        keyed.select("_id", *vocab.UNIFIED_COLUMNS, *vocab.ANNOTATION_COLUMNS), "_id", seed)
    return placed.select("row", *vocab.UNIFIED_COLUMNS, *vocab.ANNOTATION_COLUMNS)
