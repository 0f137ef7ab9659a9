"""Duplicate texts and conflicting labels."""

from pyspark.sql import DataFrame, functions as F

from postsift.functions import keys
from postsift.operators.hotkeys import left_join_hot


def label_nunique_by_text(df: DataFrame, text_norm="text_norm", label="fraudulent") -> DataFrame:
    """Distinct labels per text."""
    return df.groupBy(keys.text_key(text_norm).alias("text_key")).agg(F.countDistinct(label).alias("n_labels"))


def _labels_differ(label):
    """Whether a text's labels differ, nulls apart: bounds of 64-bit hashes, which hash aggregation can hold."""
    code = F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string")))
    return F.min(code) != F.max(code)


def collapse_copies(df: DataFrame, key_text: str, order_by=("source_rank", "ordinal"), label=None) -> DataFrame:
    """One row per text, the first in load order, with ``n_copies`` and, given a label
    column, whether copies disagree (``label_conflict``).

    A single aggregation answers all three questions: rows shuffle once, on a hash of
    the text, after copies were merged where they were read, so a text that makes up a
    third of the table costs one row per task. The key text itself is not carried along.
    """
    carried = [c for c in df.columns if c != key_text]
    first = F.min_by(F.struct(*carried), F.struct(*order_by)).alias("_first")
    facts = [first, F.count(F.lit(1)).alias("n_copies")]
    if label is not None:
        facts.append(_labels_differ(label).alias("label_conflict"))
    merged = df.groupBy(keys.text_key(key_text).alias("_key")).agg(*facts)
    return merged.drop("_key").select("_first.*", *[c for c in merged.columns if c not in ("_key", "_first")])


def dedupe_keep_first(df: DataFrame, key_text="text_norm", order_by=("source_rank", "ordinal")) -> DataFrame:
    """The first row of each text in load order, without the key text."""
    return collapse_copies(df, key_text, order_by).drop("n_copies")


def conflict_anti_join(df: DataFrame, text_norm="text_norm", label="fraudulent") -> DataFrame:
    """All rows, copies included, whose text carries a single label.

    Labels are counted per text first. Rows of a text that makes up a large share of the
    table are then spread over all tasks (``left_join_hot``).
    """
    keyed = df.withColumn("_text", F.hex(keys.text_key(text_norm)))
    facts = keyed.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"), _labels_differ(label).alias("_clash"))
    total = facts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    joined = left_join_hot(keyed, facts, "_text", "_n", total)
    return joined.filter(~F.coalesce("_clash", F.lit(False))).select(*df.columns)


def annotation_dedupe(df: DataFrame, order_by=("source_rank", "ordinal"), hash_name: str | None = None) -> DataFrame:
    """One row per description, the first in load order, with ``duplicate_count``.

    ``hash_name`` names a column for the description's short hash, made while its normalized text is there.
    """
    keyed = df.withColumn("_norm", keys.normalize_key("description"))
    if hash_name:
        keyed = keyed.withColumn(hash_name, keys.short_hash("_norm"))
    return collapse_copies(keyed, "_norm", order_by).withColumnRenamed("n_copies", "duplicate_count")


def duplicate_count_lookup(df: DataFrame, key: str) -> DataFrame:
    """Every key with its count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("duplicate_count"))


def with_duplicate_count(df: DataFrame, key: str, name="duplicate_count") -> DataFrame:
    """Every row with all its columns and the number of rows that share its key.

    Null keys are copies of each other, and not of empty ones. Counts are made before the shuffle;
    rows of a key that makes up a large share of the table are then spread over all tasks.
    """
    keyed = df.withColumn("_text", F.coalesce(F.hex(keys.text_key(F.col(key).cast("string"))), F.lit("null")))
    counts = keyed.groupBy("_text").agg(F.count(F.lit(1)).alias("_n")).withColumn(name, F.col("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return left_join_hot(keyed, counts, "_text", "_n", total).drop("_text")
