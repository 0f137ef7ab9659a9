"""Labels: where they come from, which rows have one, and writing new ones."""

from pyspark.sql import Column, DataFrame, functions as F

from postsift import vocab
from postsift.functions.text import strip

KNOWN = ["0", "1"]


def known_label(c="fraudulent") -> Column:
    return F.col(c).isin(KNOWN)


def known_label_filter(df: DataFrame, label="fraudulent") -> DataFrame:
    return df.filter(known_label(label))


def label_provenance(labelled: DataFrame, use_suggested=False) -> DataFrame:
    """Strip labels and tell manual ones from suggested ones that filled a gap.

    Unlabelled rows stay, so that :func:`load_stats` can count them.
    """
    df = labelled.withColumn("fraudulent", strip("fraudulent"))
    fill = F.lit(False)
    if use_suggested and "suggested_label" in labelled.columns:
        fill = ~known_label() & F.col("suggested_label").isin(KNOWN)
    df = df.withColumn("label_source", F.when(fill, "ai_suggested").otherwise("manual"))
    if use_suggested and "suggested_label" in labelled.columns:
        filled = F.when(F.col("label_source") == "ai_suggested", F.col("suggested_label")).otherwise(F.col("fraudulent"))
        df = df.withColumn("fraudulent", filled)
    return df


def load_labelled(labelled: DataFrame, use_suggested=False) -> DataFrame:
    """Labelled rows with ``label_source``."""
    return known_label_filter(label_provenance(labelled, use_suggested))


def load_base(base: DataFrame, label_source=vocab.CORPUS_SOURCE) -> DataFrame:
    return base.withColumn("label_source", F.lit(label_source))


def count_if(condition) -> Column:
    return F.count_if(condition).cast("bigint")


def load_stats(labelled: DataFrame, use_suggested=False) -> DataFrame:
    """Rows read, labelled by hand, filled from suggestions, and left out."""
    df = label_provenance(labelled, use_suggested)
    suggested = F.col("label_source") == "ai_suggested"
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(known_label() & ~suggested).alias("manual"),
        count_if(suggested).alias("ai_suggested"),
        count_if(~known_label()).alias("unlabelled_dropped"),
    )


def split_label_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label events that may be applied, and those that may not, with a reason."""
    allowed = F.coalesce(F.col("fraudulent").isin("0", "1", ""), F.lit(False))
    rejected = events.filter(~allowed).withColumn("reason", F.lit("fraudulent must be 0, 1 or empty"))
    return events.filter(allowed), rejected


def label_upsert(rows: DataFrame, events: DataFrame, row="row", order_by=("ts",)) -> DataFrame:
    """Set label and notes from the last valid event of each row."""
    valid, _ = split_label_events(events)
    said = F.struct(F.col("fraudulent"), F.coalesce("notes", F.lit("")).alias("notes"))
    latest = valid.groupBy(row).agg(F.max_by(said, F.struct(*order_by)).alias("_said"))
    hit = F.col("_said").isNotNull()
    return rows.join(latest, row, "left").select(*[
        F.when(hit, F.col("_said")[c]).otherwise(F.col(c)).alias(c) if c in ("fraudulent", "notes") else F.col(c)
        for c in rows.columns
    ])
