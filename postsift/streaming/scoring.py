"""The scoring plan over a stream of submissions."""

from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postsift.operators import shap, submissions
from postsift.operators.lineage import cut_lineage
from postsift.plans.scoring import score_accepted
from postsift.sources import sinks

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("submission_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source_platform", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()),
])


def read_submissions(spark: SparkSession, path: str, fmt="json", files_per_batch=1000) -> DataFrame:
    return (spark.readStream.schema(SUBMISSION_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .format(fmt).load(path))


def score_stream(stream: DataFrame, path: str, checkpoint: str, model=None, paths=None, trigger=None):
    """Start scoring a stream of submissions into the four tables and a table of rejects.

    Each submission id is stored once, whatever the sizes of the batches: the keys of a batch are
    stored with it, and later batches leave out keys that an earlier one has. Of several rows
    with one id in a batch the least by all columns stays; rows without an id are told apart by all their columns,
    and so are rejects. Folders of a batch are named by the query and the batch, so nothing of another
    query is replaced, and a marker is written last: what a stop left behind is not seen by
    ``stored_tables`` and is written anew. One query writes to a path at a time.
    The path table is sent once, not per batch.
    """
    paths = None if paths is None else shap.Explainer(paths)
    query_id = Future()

    def process(rows: DataFrame, batch_id: int) -> None:
        store_batch(rows, path, f"{query_id.result()}_{batch_id}", model, paths)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    query_id.set_result(query.id)  # stays the same when the query restarts from its checkpoint
    return query


def store_batch(rows: DataFrame, path: str, batch: str, model=None, paths=None) -> None:
    """Score and store the rows of one batch whose keys are not stored yet; a committed batch is left as it is."""
    if sinks.is_committed(rows.sparkSession, path, batch):
        return
    own = rows.columns
    validated = submissions.validate_submissions(rows)
    row_key = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    kind = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    by_id = F.when(F.col("reason").isNull(), F.col("submission_id").cast("string"))
    named = F.when(by_id.isNull(), F.lit("row")).otherwise(F.lit("id"))
    keyed = validated.withColumn("key", F.sha2(F.concat_ws(":", kind, named, F.coalesce(by_id, row_key)), 256))
    # Stored once: the four tables, the rejects and the keys are written from the same rows.
    new = cut_lineage(sinks.unstored(sinks.first_of_key(keyed, "key"), path, "key", batch))
    sinks.score_sink(score_accepted(submissions.accepted(new).drop("key"), model, paths), path, batch)
    submissions.rejected(new).drop("key").write.mode("overwrite").parquet(f"{path}/{sinks.REJECTS}/batch_id={batch}")
    sinks.commit_batch(new, path, batch)


def stored_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What committed batches stored: the four tables and the rejects. Empty before the first commit."""
    found = {name: sinks.committed(spark, path, name) for name in (*sinks.TABLES, sinks.REJECTS)}
    return {name: table.drop("batch_id") for name, table in found.items() if table is not None}
