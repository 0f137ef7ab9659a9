"""Counts and shares, each from one conditional aggregation."""

from pyspark.sql import DataFrame, functions as F

from postsift import vocab
from postsift.operators.labels import count_if


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def crosstab_margins(df: DataFrame, rows=("source", "split"), label="fraudulent") -> DataFrame:
    """Legitimate and fraudulent rows per source and split, with the All row and column.

    The margins come from the counts, not from a second look at the rows.
    """
    counted = df.groupBy(*rows).agg(
        count_if(F.col(label).cast("string") == "0").alias("legitimate"),
        count_if(F.col(label).cast("string") == "1").alias("fraudulent"),
    )
    sums = [F.sum("legitimate").alias("legitimate"), F.sum("fraudulent").alias("fraudulent")]
    table = counted.groupingSets([list(rows), []], *rows).agg(F.grouping(rows[0]).alias("_all"), *sums)
    return table.select(
        F.when(F.col("_all") == 1, "All").otherwise(F.col(rows[0])).alias(rows[0]),
        *[F.when(F.col("_all") == 1, "").otherwise(F.col(c)).alias(c) for c in rows[1:]],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("legitimate", "fraudulent")],
        (F.coalesce("legitimate", F.lit(0)) + F.coalesce("fraudulent", F.lit(0))).alias("all_rows"),
    )


def split_summary(df: DataFrame, split="split", label="fraudulent", group="group") -> DataFrame:
    """Rows, fraud share and number of groups of each split.

    Rows are counted per group first, so one huge group is merged where it is read.
    """
    grouped = df.groupBy(split, group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    return grouped.groupBy(split).agg(
        F.sum("n").alias("n_rows"),
        (F.sum("pos").cast("double") / F.sum("n")).alias("fraud_share"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def fraud_share(df: DataFrame, split="split", label="fraudulent") -> DataFrame:
    return df.groupBy(split).agg(F.avg(F.col(label).cast("int")).alias("fraud_share"))


def annotation_stats(inputs: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows in and out of an annotation batch; removed ones include blank descriptions."""
    before = inputs.select(F.lit(1).alias("i"), F.lit(0).alias("o"), *[F.lit(0).alias(c) for c in "sfu"])
    after = batch.select(
        F.lit(0).alias("i"), F.lit(1).alias("o"),
        F.col("short_text").alias("s"),
        (F.col("is_free_email_provider") == "1").cast("int").alias("f"),
        (F.col("urgency_terms") > 0).cast("int").alias("u"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return before.unionByName(after).agg(
        total("i").alias("input_rows"),
        total("o").alias("output_rows"),
        (total("i") - total("o")).alias("duplicates_removed"),
        total("s").alias("short_text"),
        total("f").alias("free_email"),
        total("u").alias("with_urgency_terms"),
    )


def class_feature_means(features: DataFrame, label="fraudulent", decimals=3) -> DataFrame:
    """Mean of each feature per class, one row per feature."""
    means = features.groupBy(F.col(label).cast("int").alias("_y")).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in vocab.FEATURE_ORDER])
    tall = means.unpivot("_y", vocab.FEATURE_ORDER, "feature", "mean")
    value = lambda y: F.round(F.max(F.when(F.col("_y") == y, F.col("mean"))), decimals)
    return tall.groupBy("feature").agg(value(0).alias("legitimate"), value(1).alias("fraudulent"))


def base_load_stats(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col("fraudulent") == "0").alias("legitimate"),
        count_if(F.col("fraudulent") == "1").alias("fraudulent"),
        count_if(F.col("contact_email_domain") != "").alias("with_domain"),
        count_if(F.col("is_free_email_provider") == "1").alias("free_email"),
    )


def annotation_progress(rows: DataFrame) -> DataFrame:
    """How far labelling is, and how often labels agree with suggestions (whole percent)."""
    labelled = F.col("fraudulent") != ""
    excluded = ~labelled & F.col("notes").contains("excluded")
    df = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(labelled).alias("labelled"),
        count_if(excluded).alias("excluded"),
        count_if(F.col("fraudulent") == "1").alias("fraudulent"),
        count_if(labelled & (F.col("fraudulent") == F.col("suggested_label"))).alias("_agree"),
    )
    done = F.col("labelled") + F.col("excluded")
    return df.select(
        "n_rows", done.alias("done"), "excluded", "fraudulent",
        F.when(F.col("n_rows") > 0, 100.0 * done / F.col("n_rows")).alias("done_pct"),
        F.when(F.col("labelled") > 0, F.floor(100.0 * F.col("_agree") / F.col("labelled") + 0.5)).alias("agree_pct"),
    )
