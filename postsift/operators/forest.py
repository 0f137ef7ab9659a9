"""Random forests over feature tables."""

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from postsift import vocab
from postsift.functions import verdict
from postsift.functions.stylometry import feature_columns
from postsift.operators import evaluate
from postsift.operators.lineage import cut_lineage, shared_folder
from postsift.operators.tree_groups import summed_over_trees

MAX_DEPTH = 30  # the deepest trees MLlib grows; stands for "no limit"
TREES_PER_FIT = 40  # a large forest grows in parts of so many trees
FITS_AT_ONCE = 8
ROWS_PER_TASK = 16_384  # a fit beside others gets a task for so many rows
STORED_FROM = 1 << 20  # rows x trees from which a forest is stored part by part, not held by the driver
ROWS_PER_PART = 450_000  # rows x trees of such a part: the driver holds the nodes of a few parts while they grow
TREES_PER_PART = 20
PART_ROWS_PER_TASK = 1 << 18
NODES_PER_GROUP = 1 << 18  # nodes that a task holds to walk rows through
_SEED_STEP = 1_000_003  # keeps the seeds of parts apart: MLlib adds partition numbers to them

# The parameter grid searched by default.
GRID = {"numTrees": [300], "maxDepth": [None, 12, 24], "minInstancesPerNode": [1, 3, 10],
        "featureSubsetStrategy": ["sqrt", "0.5"]}


def assemble(df: DataFrame, keep) -> DataFrame:
    """The fifteen features as one vector, in model order."""
    inputs = df.select(*keep, *feature_columns())
    return VectorAssembler(inputCols=vocab.FEATURE_ORDER, outputCol="features").transform(inputs).select(*keep, "features")


def feature_label_join(features: DataFrame, dataset: DataFrame, text="text") -> DataFrame:
    """Features with label, split and group: one row per row of ``dataset`` whose text has features.

    Matched by text, of which features follow. An id may be repeated (an edited posting keeps
    its own), so it would multiply rows.
    """
    by_text = features.groupBy(F.sha2(text, 256).alias("_key")).agg(*[F.any_value(c).alias(c) for c in vocab.FEATURE_ORDER])
    labels = dataset.select(F.sha2(text, 256).alias("_key"), "id", "source", "split", "group", F.col("fraudulent").cast("int").alias("y"))
    return labels.join(by_text, "_key").drop("_key")


def labelled_features(featured: DataFrame) -> DataFrame:
    """The same of a dataset that carries its features already: no join."""
    return featured.select("id", "source", "split", "group", F.col("fraudulent").cast("int").alias("y"), *vocab.FEATURE_ORDER)


def balanced_weights(df: DataFrame, label="y", keys=()) -> DataFrame:
    """Append ``weight``: rows / (classes x rows of the class), over the rows given.

    With ``keys`` (a fold, say) the weights are those of each key's own rows.
    """
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
        weights = counts.join(totals, list(keys))
        weights = weights.select(*keys, label, (F.col("_total") / (F.col("_classes") * F.col("_n"))).alias("weight"))
        return df.join(F.broadcast(weights), [*keys, label])  # a row per fold and class
    return df.withColumn("weight", _class_weight({r[label]: r["_n"] for r in counts.collect()}, label))  # one row per class


def _class_weight(counts: dict, label="y"):
    """The balanced weight of a row, given the rows of each class."""
    total, chain = sum(counts.values()), F
    for value, n in counts.items():
        chain = chain.when(F.col(label) == value, F.lit(total / (len(counts) * n)))
    return chain.otherwise(F.lit(1.0)) if counts else F.lit(1.0)


class StoredForest:
    """A forest whose trees lie in a shared folder as MLlib writes them, in one part or in many of ``size`` trees.

    The driver never holds them, and a task holds a group of trees at a time.
    """

    def __init__(self, spark: SparkSession, parts: list[str], size: int):
        self.spark, self.parts, self.size = spark, parts, size
        self.trees = self.table("treesMetadata").count()
        self.groups = -(-self.table("data").count() // NODES_PER_GROUP) or 1

    def table(self, name: str) -> DataFrame:
        """A table of all parts, their trees numbered through."""
        rows = self.spark.read.parquet(*[f"{part}/{name}" for part in self.parts])
        if len(self.parts) == 1:
            return rows
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d+)/[^/]+/[^/]+$", 1).cast("int")
        number = rows.columns[0]  # MLlib names it in one table only
        return rows.withColumn(number, F.col(number) + part * self.size)

    def save(self, path: str) -> None:
        """Write as one MLlib model, marked as stored; the metadata last, by which a model is found."""
        for name in ("treesMetadata", "data"):
            self.table(name).write.mode("overwrite").parquet(f"{path}/{name}")
        about = json.loads(self.spark.read.text(f"{self.parts[0]}/metadata").first()[0]) | {"numTrees": self.trees, "stored": True}
        about["paramMap"]["numTrees"] = self.trees
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    def with_probability(self, df: DataFrame) -> DataFrame:
        """Append ``p``: the mean over trees of the fraud share in the leaf that a row falls into."""
        node = F.col("nodeData")
        cover = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, x: a + x)
        nodes = self.table("data").select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
            F.when(cover > 0, F.get(node["impurityStats"], 1) / cover).otherwise(F.lit(0.0)).alias("share"))
        summed = summed_over_trees(df, vector_to_array("features"), nodes, self.groups, _leaf_shares, 1, "_p")
        return summed.withColumn("p", F.col("_p")[0] / self.trees).drop("_p")

    def importances(self) -> list[float]:
        """As MLlib has them: gain by rows, which add up to one in each tree, and then in all."""
        node = F.col("nodeData")
        weight = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, x: a + x)
        by_tree = self.table("data").filter(node["leftChild"] >= 0).groupBy("treeID", node["split"]["featureIndex"].alias("i")).agg(F.sum(node["gain"] * weight).alias("v"))
        whole = by_tree.groupBy("treeID").agg(F.sum("v").alias("whole")).filter("whole != 0")
        found = by_tree.join(whole, "treeID").groupBy("i").agg(F.sum(F.col("v") / F.col("whole")).alias("v")).collect()  # one row per feature
        total = sum(r["v"] for r in found)
        by_place = {r["i"]: r["v"] / total for r in found}
        return [by_place.get(i, 0.0) for i in range(len(vocab.FEATURE_ORDER))]


def _leaf_shares(x, nodes) -> np.ndarray:
    """For rows x (rows, features) the sum over the trees in ``nodes`` of the share in the row's leaf, (rows, 1)."""
    columns = [nodes[c].to_numpy() for c in ("tree", "id", "left", "right", "feature", "threshold", "share")]
    order = np.lexsort((columns[1], columns[0]))
    tree, ids, *columns = (c[order] for c in columns)
    total, rows = np.zeros(len(x)), np.arange(len(x))
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    for start, end in zip(starts, [*starts[1:], len(tree)]):
        left, right, feature, threshold, share = (c[start:end] for c in columns)
        place = lambda child: np.searchsorted(ids[start:end], child)
        left, right, leaf = place(left), place(right), left < 0
        at = np.zeros(len(x), int)
        inner = rows[~leaf[at]]
        while len(inner):
            here = at[inner]
            at[inner] = np.where(x[inner, feature[here]] <= threshold[here], left[here], right[here])
            inner = inner[~leaf[at[inner]]]
        total += share[at]
    return total[:, None]


def load_forest(spark: SparkSession, path: str) -> "RandomForestClassificationModel | StoredForest":
    """A saved forest: left in its folder if it was stored part by part."""
    if json.loads(spark.read.text(f"{path}/metadata").first()[0]).get("stored"):
        return StoredForest(spark, [path], 0)
    return RandomForestClassificationModel.load(path)


def train_forest(train: DataFrame, params=None, seed=vocab.SEED) -> "RandomForestClassificationModel | StoredForest":
    """Fit on (features, y) with balanced class weights.

    Trees do not depend on each other. Between the rounds of a fit one driver thread deals with all nodes
    of the round, so a large forest grows in parts at the same time, over rows that are stored once. Parts of a
    forest that may be too large for the driver are stored as soon as they are grown.
    """
    trees = (params or {}).get("numTrees", 300)
    if trees <= TREES_PER_FIT:
        return _fit(balanced_weights(train), params, seed)
    weighted = cut_lineage(balanced_weights(train))
    rows = weighted.count()
    if rows * trees > STORED_FROM:
        return _grow_stored(weighted, rows, {**(params or {}), "numTrees": trees}, seed)
    sizes = [min(TREES_PER_FIT, trees - start) for start in range(0, trees, TREES_PER_FIT)]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = [pool.submit(inheritable_thread_target(train.sparkSession)(_fit), weighted, {**(params or {}), "numTrees": n}, seed + k * _SEED_STEP)
                 for k, n in enumerate(sizes)]
        return _one_forest([part.result() for part in parts])


def _grow_stored(weighted: DataFrame, rows: int, params: dict, seed) -> StoredForest:
    """Parts of a few trees; a task gets many rows of a part, since it sends statistics of all nodes being split."""
    spark, trees = weighted.sparkSession, params["numTrees"]
    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    size = max(1, min(TREES_PER_PART, ROWS_PER_PART // rows))
    narrow = _task_per_rows(weighted, rows, PART_ROWS_PER_TASK)

    def grow(number: int) -> str:
        part = {**params, "numTrees": min(size, trees - number * size)}
        path = f"{folder}/part-{number}"
        _fit(narrow, part, seed + number * _SEED_STEP).write().overwrite().save(path)
        return path

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = [pool.submit(inheritable_thread_target(spark)(grow), number) for number in range(-(-trees // size))]
        return StoredForest(spark, [part.result() for part in parts], size)


def _one_forest(parts) -> RandomForestClassificationModel:
    """The trees of all parts as one model, with the parameters of the first; the trees stay in the JVM."""
    context, first = SparkContext._active_spark_context, parts[0]
    package = context._jvm.org.apache.spark.ml.classification
    grown = [tree for part in parts for tree in part._call_java("trees")]
    trees = context._gateway.new_array(package.DecisionTreeClassificationModel, len(grown))
    for place, tree in enumerate(grown):
        trees[place] = tree
    forest = package.RandomForestClassificationModel(first.uid, trees, first.numFeatures, first.numClasses)
    model = RandomForestClassificationModel(first._java_obj.copyValues(forest, context._jvm.org.apache.spark.ml.param.ParamMap()))
    model._java_obj.set(model._java_obj.numTrees(), len(grown))
    model._transfer_params_from_java()
    return model


def _fit(weighted: DataFrame, params, seed) -> RandomForestClassificationModel:
    settings = {"numTrees": 300, **(params or {})}
    if settings.get("maxDepth") is None:
        settings["maxDepth"] = MAX_DEPTH
    # Without cached node ids each round sends all trees grown so far to every task, and every row walks them from the root.
    forest = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", seed=seed, cacheNodeIds=True, **settings)
    return forest.fit(_at_most_a_task_per_core(weighted))


def _at_most_a_task_per_core(df: DataFrame) -> DataFrame:
    """Each task of a round sends statistics of all nodes being split, so further tasks only add to what is sent."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores) if df.rdd.getNumPartitions() > cores else df


def _task_per_rows(df: DataFrame, rows: int, rows_per_task=None) -> DataFrame:
    """For fits that run beside each other and so fill the cores: each task of a round makes and sends
    statistics of all nodes being split, however few rows it has.
    """
    tasks = -(-rows // (rows_per_task or ROWS_PER_TASK)) or 1
    return df.coalesce(tasks) if df.rdd.getNumPartitions() > tasks else df


def param_sets(grid=None) -> list[dict]:
    grid = grid or GRID
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def fraud_probability(model, df: DataFrame, keep) -> DataFrame:
    if isinstance(model, StoredForest):
        return model.with_probability(df).select(*keep, "p")
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("p"))


def grid_search(train: DataFrame, grid=None, seed=vocab.SEED, parallelism=8) -> dict:
    """Try each parameter set on each fold, then refit the best on all of ``train``.

    ``train`` has (features, y, fold); it is stored once and shared by all fits, and class weights of
    all folds come from one count. Each forest trains on the cluster, ``parallelism`` of them at a
    time; the driver loops over settings and folds only. Out-of-fold predictions are stored once
    per setting, with the forests that made them gone.
    """
    train = cut_lineage(train)
    counts = train.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes
    folds, sets = sorted({r["fold"] for r in counts}), param_sets(grid)
    train = _task_per_rows(train, sum(r["n"] for r in counts))

    def held_out(number, fold):
        outside = {}
        for r in counts:
            if r["fold"] != fold:
                outside[r["y"]] = outside.get(r["y"], 0) + r["n"]
        inside = F.col("fold") == fold
        model = _fit(train.filter(~inside).withColumn("weight", _class_weight(outside)), sets[number], seed)
        return fraud_probability(model, train.filter(inside), ["fold", "y"]).withColumn("param_id", F.lit(number))

    def store(number):
        return cut_lineage(reduce(DataFrame.unionByName, [f.result() for f in fits[number]]))

    guarded = lambda f: inheritable_thread_target(train.sparkSession)(f)
    with ThreadPoolExecutor(parallelism) as pool:
        fits = [[pool.submit(guarded(held_out), n, fold) for fold in folds] for n in range(len(sets))]
        stored = []
        for number in range(len(sets)):  # in the order in which fits end
            stored.append(store(number))
            fits[number] = None
    predictions = reduce(DataFrame.unionByName, stored)
    results = cut_lineage(evaluate.cv_results(predictions))
    best = evaluate.top_params(results, 1).first()
    return {
        "params": sets,
        "predictions": predictions,
        "cv_results": results,
        "best_params": sets[best["param_id"]],
        "best_score": best["mean_pr_auc"],
        "model": train_forest(train, sets[best["param_id"]], seed),
    }


def classify(model, assembled: DataFrame, keep) -> DataFrame:
    """Label, and confidence as the probability of the label given."""
    scored = fraud_probability(model, assembled, keep)
    return scored.select(
        *keep,
        F.when(F.col("p") > 0.5, verdict.FRAUD).otherwise(verdict.LEGITIMATE).alias("label"),
        F.greatest("p", 1 - F.col("p")).alias("confidence_score"),
        F.lit(False).alias("is_stub"),
    )


def feature_importance(spark, model) -> DataFrame:
    """Impurity importance, the strongest feature first."""
    values = model.importances() if isinstance(model, StoredForest) else model.featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(vocab.FEATURE_ORDER, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
