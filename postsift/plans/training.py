"""Dataset to a tuned, evaluated and stored forest."""

import pyspark
from pyspark.sql import DataFrame, functions as F

from postsift import vocab
from postsift.operators import evaluate, forest, ranking, shap, split
from postsift.operators.lineage import cut_lineage
from postsift.sources import sinks


def train_and_evaluate(dataset: DataFrame, path: str, grid=None, folds=5, seed=vocab.SEED, sample=1000) -> dict:
    """Tune on the train split by grouped folds, evaluate once on the test split, store all.

    Writes features, model, path table and metrics under ``path``.
    """
    spark = dataset.sparkSession
    table = cut_lineage(forest.labelled_features(sinks.cached_features(dataset, f"{path}/features")))
    train = split.with_folds(table.filter("split = 'train'"), folds, seed, label="y")
    search = forest.grid_search(forest.assemble(train, ["fold", "y"]), grid, seed)
    model = search["model"]
    sinks.save_model(spark, model, path)
    test = table.filter("split = 'test'")
    predictions = cut_lineage(forest.fraud_probability(model, forest.assemble(test, ["id", "source", "y"]), ["id", "source", "y"]))
    report = evaluate.evaluate(predictions)
    document = sinks.metrics_document(search, report["scores"], dataset, {"pyspark": pyspark.__version__})
    sinks.metrics_sink(document, f"{path}/metrics")
    paths = spark.read.parquet(f"{path}/paths")
    sampled = cut_lineage(ranking.seeded_sample(test, "id", sample, seed))
    return {
        **report,
        "search": search,
        "model": model,
        "paths": paths,
        "predictions": predictions,
        "importance": forest.feature_importance(spark, model),
        "shap_summary": shap.shap_summary(shap.tree_shap(sampled, paths)),
        "metrics": document,
    }
