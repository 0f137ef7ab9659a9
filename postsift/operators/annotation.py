"""What annotators see and what their notes add up to."""

from pyspark.sql import DataFrame, functions as F

from postsift import vocab
from postsift.functions import notes
from postsift.operators.ranking import global_rank, seeded_order, seeded_ranges

VIEWS = ("todo", "all", "low", "fraud", "medium", "labelled", "disagree")


def annotation_shuffle(df: DataFrame, id_col: str, seed=vocab.SEED, name="row") -> DataFrame:
    """Append a repeatable random position, so no source is labelled in one block."""
    keyed = df.withColumn("_h", seeded_order(id_col, seed))
    return global_rank(keyed, [F.asc("_h"), F.asc(id_col)], name, seeded_ranges("_h")).drop("_h")


def in_view(view: str):
    labelled = F.col("fraudulent") != ""
    return {
        "todo": ~labelled & ~F.col("notes").contains("excluded"),
        "all": F.lit(True),
        "low": F.col("confidence") == "low",
        "fraud": F.col("suggested_label") == "1",
        "medium": F.col("confidence") == "medium",
        "labelled": labelled,
        "disagree": labelled & (F.col("suggested_label") != "") & (F.col("fraudulent") != F.col("suggested_label")),
    }[view]


def queue_rank():
    """Least certain first: low confidence, suggested fraud, medium, the rest."""
    return (
        F.when(F.col("confidence") == "low", 0)
        .when(F.col("suggested_label") == "1", 1)
        .when(F.col("confidence") == "medium", 2)
        .otherwise(3)
    )


def annotation_queue(rows: DataFrame, view="todo", row="row") -> DataFrame:
    return rows.filter(in_view(view)).withColumn("queue_rank", queue_rank()).orderBy("queue_rank", row)


def indicator_counts(rows: DataFrame) -> DataFrame:
    """How often each indicator was noted, per label, over labelled rows."""
    ticked = rows.filter(F.col("fraudulent").isin("0", "1")).select(
        "fraudulent", F.explode(notes.indicators("notes")).alias("indicator"))
    return ticked.groupBy("indicator", "fraudulent").agg(F.count(F.lit(1)).alias("n"))
