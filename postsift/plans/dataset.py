"""Posting tables to a labelled training set with a leak-free split."""

from pyspark.sql import DataFrame, functions as F

from postsift import vocab
from postsift.functions import keys
from postsift.operators import dedupe, labels, split, stats
from postsift.operators.lineage import cut_lineage
from postsift.sources.conform import union_sources

_CARRIED = ["source", "source_id", "label_source", "fraudulent", "title", "company_profile", "location", "salary_range",
            "employment_type", "contact_email_domain", "is_free_email_provider", "url", "source_rank", "ordinal"]


def labelled_texts(base: DataFrame, local: DataFrame, min_chars=vocab.MIN_TEXT_CHARS, use_suggested=False,
                   base_label_source=vocab.CORPUS_SOURCE) -> DataFrame:
    """All labelled postings long enough to judge, with ``text`` and ``text_norm``."""
    both = union_sources(labels.load_base(base, base_label_source), labels.load_labelled(local, use_suggested))
    known = labels.known_label_filter(both)
    present = [c for c in _CARRIED if c in known.columns]
    absent = [F.lit("").alias(c) for c in _CARRIED if c not in known.columns]
    texts = known.select(*present, *absent, keys.build_text().alias("text"))
    sized = texts.withColumn("text_chars", F.length("text")).filter(F.col("text_chars") >= min_chars)
    return sized.withColumn("text_norm", keys.normalize_key("text"))


def unique_texts(texts: DataFrame) -> DataFrame:
    """One row per text, conflicting texts gone, with ``group`` and ``id``: one shuffle.

    Group and id are made before it, so the normalized text stays behind.
    """
    keyed = texts.withColumns({
        "group": keys.group_key("source", "company_profile", "contact_email_domain", "is_free_email_provider", "text_norm"),
        "id": keys.posting_key("source", "source_id", "text_norm"),
    })
    merged = dedupe.collapse_copies(keyed, "text_norm", label="fraudulent")
    return merged.filter(~F.col("label_conflict")).drop("label_conflict", "n_copies")


def build_dataset(base: DataFrame, local: DataFrame, min_chars=vocab.MIN_TEXT_CHARS, test_size=0.2, use_suggested=False,
                  seed=vocab.SEED, base_label_source=vocab.CORPUS_SOURCE) -> DataFrame:
    """The training dataset. Inputs carry ``source_rank`` and ``ordinal`` (load order).

    Deduplicated rows are materialized once, since groups are dealt from them and then
    joined back. Stops if a group is in both splits.
    """
    texts = labelled_texts(base, local, min_chars, use_suggested, base_label_source)
    rows = cut_lineage(unique_texts(texts).drop("source_rank", "ordinal"))
    data = split.group_stratified_split(rows, test_size, seed).select(*vocab.DATASET_COLUMNS)
    return split.assert_no_leak(data)


def removal_stats(base: DataFrame, local: DataFrame, min_chars=vocab.MIN_TEXT_CHARS, use_suggested=False) -> DataFrame:
    """How many rows were short, conflicting or copies: one scan, counts per text, then their sums."""
    texts = labelled_texts(base, local, 0, use_suggested)
    short = F.col("text_chars") < min_chars
    known = F.when(~short, F.col("fraudulent").cast("int"))
    groups = texts.groupBy(keys.text_key("text_norm").alias("_key")).agg(
        labels.count_if(short).alias("short"), labels.count_if(~short).alias("n"), (F.min(known) != F.max(known)).alias("clash"))
    total = lambda when, n: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("short"), F.lit(0)).alias("short"),
        total(F.col("clash"), F.col("n")).alias("conflicting"),
        total(~F.col("clash"), F.col("n") - 1).alias("duplicates"))


def summarize(dataset: DataFrame) -> dict[str, DataFrame]:
    return {
        "crosstab": stats.crosstab_margins(dataset),
        "splits": stats.split_summary(dataset),
        "label_sources": stats.counts_by(dataset, "label_source"),
    }
