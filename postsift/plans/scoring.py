"""Submissions to scored, explained postings."""

from pyspark.sql import DataFrame, functions as F

from postsift import vocab
from postsift.functions import stylometry, verdict
from postsift.operators import forest, shap, submissions
from postsift.operators.lineage import cut_lineage
from postsift.sources.sinks import score_sink

SCORE_COLUMNS = ["label", "confidence_score", "is_stub"]


def classify_features(features: DataFrame, model=None) -> DataFrame:
    """Append label, confidence and whether the stub rule decided."""
    if model is None:
        return verdict.stub_classify(features)
    kept = features.columns
    vectors = forest.VectorAssembler(inputCols=[f"_f_{c}" for c in vocab.FEATURE_ORDER], outputCol="features").transform(
        features.withColumns({f"_f_{c}": F.col(c).cast("double") for c in vocab.FEATURE_ORDER}))
    return forest.classify(model, vectors, kept)


def score_accepted(accepted: DataFrame, model=None, paths=None) -> DataFrame:
    """Features, verdict and, for frauds, reasons. Narrow from end to end, without a shuffle, unless a stored
    forest or a path table deals its trees to tasks; rows and features are then stored first, being read twice.
    """
    ids = accepted.withColumn("posting_id", submissions.stable_id("posting", "submission_id"))
    features = stylometry.extract_features(ids, "text")
    if isinstance(model, forest.StoredForest) or isinstance(paths, DataFrame):
        features = cut_lineage(features)
    scored = classify_features(features, model)
    explained = shap.explain(scored, paths)
    return explained.withColumn("classified_at", F.current_timestamp())


def score_postings(raw: DataFrame, model=None, paths=None) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) submissions; both lazy.

    ``raw`` has submission_id, text, source_platform, user_id and submitted_at. Without
    a model the stub rule decides; without a path table the stub reasons explain.
    """
    validated = submissions.validate_submissions(raw)
    return score_accepted(submissions.accepted(validated), model, paths), submissions.rejected(validated)


def responses(scored: DataFrame) -> DataFrame:
    """What a submitter gets back."""
    report = F.struct("top_features", "summary")
    return scored.select(
        "posting_id", "label", "confidence_score",
        F.when(F.col("label") == verdict.FRAUD, report).alias("explainability_report"),
        F.col("is_stub").alias("is_stub_model"),
    )


def score_and_store(raw: DataFrame, path: str, model=None, paths=None, batch_id=None) -> DataFrame:
    """Score submissions into the four tables; returns the rejected ones."""
    scored, rejected = score_postings(raw, model, paths)
    score_sink(scored, path, batch_id)
    return rejected
