"""Metrics over prediction tables: label ``y`` (0/1), fraud probability ``p``, ``pred``."""

from pyspark.sql import DataFrame, Window, functions as F

from postsift.operators.labels import count_if
from postsift.operators.ranking import running_totals


def with_prediction(df: DataFrame, p="p") -> DataFrame:
    """The more likely class; a tie is legitimate."""
    return df.withColumn("pred", (F.col(p) > 0.5).cast("int"))


def confusion_matrix(df: DataFrame, keys=()) -> DataFrame:
    y, pred = F.col("y") == 1, F.col("pred") == 1
    return df.groupBy(*keys).agg(
        count_if(~y & ~pred).alias("tn"),
        count_if(~y & pred).alias("fp"),
        count_if(y & ~pred).alias("fn"),
        count_if(y & pred).alias("tp"),
    )


def _share(top, bottom):
    """A quotient that is 0 where there is nothing to divide by."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _share(tp, tp + fp),
        "recall": _share(tp, tp + fn),
        "f1": _share(2 * tp, 2 * tp + fp + fn),
    })


def classification_report(df: DataFrame) -> DataFrame:
    """Per-class scores, accuracy, macro and weighted averages, one row each."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp

    def scores(name, hit, said, there):
        return {"class": F.lit(name), "precision": _share(hit, said), "recall": _share(hit, there),
                "f1": _share(2 * hit, said + there), "support": there}

    legit = scores("legitimate", tn, tn + fn, n0)
    fraud = scores("fraudulent", tp, tp + fp, n1)
    accuracy = {"class": F.lit("accuracy"), "precision": F.lit(None).cast("double"),
                "recall": F.lit(None).cast("double"), "f1": _share(tn + tp, n0 + n1), "support": n0 + n1}

    def average(name, w0, w1):
        mean = lambda k: _share(w0 * legit[k] + w1 * fraud[k], w0 + w1)
        return {"class": F.lit(name), **{k: mean(k) for k in ("precision", "recall", "f1")}, "support": n0 + n1}

    lines = [legit, fraud, accuracy, average("macro avg", F.lit(1), F.lit(1)), average("weighted avg", n0, n1)]
    rows = F.array(*[F.struct(*[v.alias(k) for k, v in line.items()]) for line in lines])
    return confusion_matrix(df).select(F.inline(rows))


def per_source_rates(df: DataFrame, source="source") -> DataFrame:
    """Frauds caught and legitimate rows flagged per source; null where a class is absent."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col("y") == 1).alias("frauds"),
        F.avg(F.when(F.col("y") == 1, F.col("pred"))).alias("recall"),
        F.avg(F.when(F.col("y") == 0, F.col("pred"))).alias("false_positive_rate"),
    )


def ranking_metrics(df: DataFrame, keys=()) -> DataFrame:
    """Average precision and ROC area, per key if given.

    Equal scores are merged before anything is shuffled by score. Running counts over
    descending scores then give both areas from one sum over distinct scores.
    """
    keys = list(keys)
    y = F.col("y").cast("bigint")
    steps = df.groupBy(*keys, "p").agg(F.sum(y).alias("_tp"), F.sum(1 - y).alias("_fp"))
    run = running_totals(steps, [*[F.asc(k) for k in keys], F.desc("p")], {"_run_tp": "_tp", "_run_fp": "_fp"})
    if keys:
        per_key = run.groupBy(*keys).agg(F.sum("_tp").alias("_P"), F.sum("_fp").alias("_N"))
        earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per key: folds x settings
        base = per_key.select(*keys, *[
            F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in (("_P", "_base_tp"), ("_N", "_base_fp"))])
        run = run.join(F.broadcast(base), keys).withColumns({"_run_tp": F.col("_run_tp") - F.col("_base_tp"), "_run_fp": F.col("_run_fp") - F.col("_base_fp")})
    d = lambda c: F.col(c).cast("double")
    pos, neg = F.sum("_tp").cast("double"), F.sum("_fp").cast("double")
    above = F.sum(d("_tp") * (d("_run_fp") - d("_fp") / 2))
    return run.groupBy(*keys).agg(
        F.sum("_tp").alias("positives"),
        F.sum("_fp").alias("negatives"),
        F.when(pos > 0, F.sum(d("_tp") * d("_run_tp") / (d("_run_tp") + d("_run_fp"))) / pos).alias("average_precision"),
        F.when((pos > 0) & (neg > 0), (pos * neg - above) / (pos * neg)).alias("roc_auc"),
    )


def average_precision(df: DataFrame, keys=()) -> DataFrame:
    return ranking_metrics(df, keys).select(*keys, "average_precision")


def roc_auc(df: DataFrame, keys=()) -> DataFrame:
    return ranking_metrics(df, keys).select(*keys, "roc_auc")


def cv_results(predictions: DataFrame) -> DataFrame:
    """Mean and spread of fold scores per parameter set, from (param_id, fold, y, p)."""
    keys = ["param_id", "fold"]
    hits = precision_recall_f1(confusion_matrix(with_prediction(predictions), keys))
    folds = ranking_metrics(predictions, keys).join(hits, keys)
    return folds.groupBy("param_id").agg(
        F.avg("average_precision").alias("mean_pr_auc"),
        F.stddev_pop("average_precision").alias("std_pr_auc"),
        F.avg("f1").alias("mean_f1"),
        F.avg("recall").alias("mean_recall"),
        F.avg("precision").alias("mean_precision"),
    )


def top_params(results: DataFrame, n=5) -> DataFrame:
    return results.orderBy(F.desc("mean_pr_auc"), F.asc("param_id")).limit(n)


def held_out_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and both areas of one prediction table, as one row."""
    scored = with_prediction(predictions)
    hits = precision_recall_f1(confusion_matrix(scored)).withColumn("_one", F.lit(1))
    areas = ranking_metrics(scored).withColumn("_one", F.lit(1))
    return hits.join(areas, "_one").select(
        "precision", "recall", "f1", F.col("average_precision").alias("pr_auc"), "roc_auc", "tn", "fp", "fn", "tp")


def evaluate(predictions: DataFrame, source="source") -> dict[str, DataFrame]:
    """The held-out evaluation: scores, report, confusion matrix and per-source rates."""
    scored = with_prediction(predictions)
    return {
        "scores": held_out_scores(predictions),
        "report": classification_report(scored),
        "confusion": confusion_matrix(scored),
        "per_source": per_source_rates(scored, source),
    }
