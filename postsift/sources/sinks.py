"""Scored tables, metrics documents, models and the feature cache."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postsift import vocab
from postsift.functions import stylometry, verdict
from postsift.operators import forest, shap
from postsift.operators.submissions import stable_id

TABLES = ("job_postings", "feature_vectors", "classification_results", "explainability_reports")
REJECTS = "rejects"
KEY_BUCKETS = 16  # folders of a batch's keys; a lookup that touches few keys reads few of them


def score_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """The four linked tables of scored postings; reports exist for fraud only."""
    ids = scored.withColumn("vector_id", stable_id("vector", "posting_id")).withColumn(
        "result_id", stable_id("result", "posting_id")).withColumn("report_id", stable_id("report", "posting_id"))
    frauds = ids.filter(F.col("label") == verdict.FRAUD)
    return {
        "job_postings": ids.select(
            "posting_id", F.col("text").alias("raw_text"), "source_platform", "submitted_at", "user_id"),
        "feature_vectors": ids.select("vector_id", *vocab.FEATURE_ORDER, "posting_id"),
        "classification_results": ids.select(
            "result_id", "label", "confidence_score", "is_stub", "classified_at", "vector_id", "posting_id"),
        "explainability_reports": frauds.select(
            "report_id",
            F.to_json("top_features", {"ignoreNullFields": "false"}).alias("top_features"),
            F.to_json(F.transform("top_features", lambda r: r["shap_value"])).alias("shap_values"),
            F.col("summary").alias("plain_language_summary"),
            "result_id", "posting_id"),
    }


def score_sink(scored: DataFrame, path: str, batch_id=None) -> None:
    """Write the four tables. A batch goes to its own folder, so writing it again replaces it.

    Scores are kept while the tables are written. They follow from the rows alone, so a
    lost part is computed again with the same result.
    """
    scored = scored.persist()
    try:
        for name, table in score_tables(scored).items():
            if batch_id is None:
                table.write.mode("append").parquet(f"{path}/{name}")
            else:
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    finally:
        scored.unpersist()


# --- batches of a stream, each key stored once -----------------------------------


def first_of_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the least by all its columns, so that a task that runs again picks the same."""
    return df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("_row")).select(key, "_row.*")


def unstored(rows: DataFrame, path: str, key: str, batch: str) -> DataFrame:
    """Rows whose key no other committed batch has stored.

    The stored keys are reduced to those of ``rows`` first, bucket by bucket; where the rows are few
    their keys are broadcast, so the stored keys are read and not shuffled.
    """
    stored = stored_keys(rows.sparkSession, path)
    if stored is None:
        return rows
    bucket = _bucket(key)
    asked = rows.select(F.col(key).alias("key"), bucket.alias("bucket"))
    seen = stored.filter(F.col("batch_id") != batch).join(asked, ["bucket", "key"], "left_semi")
    return rows.join(seen.select(F.col("key").alias(key)), key, "left_anti")


def _bucket(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return _exists(spark, f"{path}/markers/batch_id={batch}/_SUCCESS")


def commit_batch(keys: DataFrame, path: str, batch: str) -> None:
    """Store a batch's keys, then its marker. Readers see a batch only once the marker stands.

    The marker is one file of one row, so it is there or not; all else of a batch was written before.
    """
    keys.select("key", _bucket("key").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch_id={batch}")
    keys.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/markers/batch_id={batch}")


def stored_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys of committed batches (key, bucket, batch_id); None before the first."""
    return committed(spark, path, "keys", "key string, bucket int, batch_id string")


def committed(spark: SparkSession, path: str, table: str, schema=None) -> DataFrame | None:
    """Rows of a table that belong to committed batches, with ``batch_id``; None before the first.

    Only committed folders are opened: what a stopped batch left behind is not read. Spark names
    the folders' files where it lists them, the driver holds one name per batch.
    """
    if not _exists(spark, f"{path}/markers"):
        return None
    names = sorted(m[1] for m in (re.fullmatch(r"batch_id=(.+)", n) for n in _children(spark, f"{path}/markers")) if m and is_committed(spark, path, m[1]))
    folders = [f"{path}/{table}/batch_id={n}" for n in names]
    if not folders:
        return None
    reader = spark.read.option("basePath", f"{path}/{table}")
    return (reader.schema(schema) if schema else reader).parquet(*folders)


def metrics_document(search: dict, scores: DataFrame, dataset: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Best parameters, scores, label sources and versions as one nested row."""
    spark = scores.sparkSession
    sources = dataset.groupBy("label_source").agg(F.count(F.lit(1)).alias("n"))
    # One row per label source: manual, suggested and the corpus.
    counted = sources.agg(F.map_from_entries(F.collect_list(F.struct("label_source", "n"))).alias("label_sources"))
    test = scores.select(F.struct("precision", "recall", "f1", "pr_auc", "roc_auc").alias("test"))
    best = {k: "None" if v is None else str(v) for k, v in search["best_params"].items()}
    fixed = spark.createDataFrame(
        [(1, best, float(search["best_score"]), versions)],
        "_one int, best_params map<string,string>, cv_pr_auc double, versions map<string,string>")
    one = F.lit(1).alias("_one")
    return fixed.join(test.select(one, "*"), "_one").join(counted.select(one, "*"), "_one").select(
        "best_params", "cv_pr_auc", "test", "label_sources", "versions")


def metrics_sink(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").json(path)


# --- models --------------------------------------------------------------------


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write the forest, and the path table its explanations read."""
    if isinstance(model, forest.StoredForest):
        model.save(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    shap.tree_paths(spark.read.parquet(f"{path}/model/data")).write.mode("overwrite").parquet(f"{path}/paths")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _children(spark: SparkSession, path: str) -> list[str]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm_path)]


def load_model(spark: SparkSession, path: str):
    """(model, paths), each None while it has not been written: scoring then runs as a stub."""
    model = forest.load_forest(spark, f"{path}/model") if _exists(spark, f"{path}/model/metadata") else None
    paths = spark.read.parquet(f"{path}/paths") if _exists(spark, f"{path}/paths/_SUCCESS") else None
    return model, paths


# --- features ------------------------------------------------------------------


def cached_features(dataset: DataFrame, path: str, text_col="text") -> DataFrame:
    """Features of a dataset by text hash; only texts not yet stored are computed.

    New rows are appended to the cache. A cache with other feature columns is rebuilt.
    """
    spark = dataset.sparkSession
    keyed = dataset.withColumn("text_hash", F.sha2(text_col, 256))
    names = ["text_hash", *vocab.FEATURE_ORDER]
    usable = _exists(spark, path) and spark.read.parquet(path).columns == names
    texts = keyed.select("text_hash", text_col)
    if usable:
        texts = texts.join(spark.read.parquet(path).select("text_hash"), "text_hash", "left_anti")
    texts = texts.groupBy("text_hash").agg(F.first(text_col).alias(text_col))
    new = stylometry.extract_features(texts, text_col).select("text_hash", *stylometry.feature_columns())
    new.write.mode("append" if usable else "overwrite").parquet(path)
    stored = spark.read.parquet(path)
    return keyed.join(stored, "text_hash").drop("text_hash")
