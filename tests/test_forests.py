"""Forests too large for the driver, and contributions of many rows."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from postsift import vocab
from postsift.operators import forest, shap, tree_groups
from postsift.operators.lineage import cut_lineage
from postsift.plans import scoring
from postsift.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    """300 rows, of which the last twenty repeat others' ids and features."""
    r = random.Random(7)
    rows = []
    for i in range(280):
        x = [round(r.random() * 10, 1) for _ in vocab.FEATURE_ORDER]
        rows.append((f"p{i}", int(x[0] + x[1] * (x[2] > 5) > 9 or r.random() < 0.1), *x))
    return cut_lineage(spark.createDataFrame(rows + rows[:20], "id string, y int, " + ", ".join(f"{c} double" for c in vocab.FEATURE_ORDER)))


@pytest.fixture
def small_steps(monkeypatch):
    """Everything that is bounded in size meets its bound."""
    for module, name, value in ((forest, "STORED_FROM", 0), (forest, "TREES_PER_FIT", 2), (forest, "TREES_PER_PART", 2), (forest, "PART_ROWS_PER_TASK", 200),
                                (forest, "NODES_PER_GROUP", 40), (tree_groups, "ROWS_PER_BLOCK", 100)):
        monkeypatch.setattr(module, name, value)


def test_a_forest_too_large_for_the_driver_stays_stored(spark, table, small_steps, folder):
    rows = cut_lineage(forest.assemble(table, ["id", "y"]))
    params = {"numTrees": 5, "maxDepth": 5, "minInstancesPerNode": 2}
    model = forest.train_forest(rows, params)
    assert isinstance(model, forest.StoredForest) and (model.trees, len(model.parts)) == (5, 3) and model.groups > 1
    weighted = forest._task_per_rows(cut_lineage(forest.balanced_weights(rows)), 300, 200)
    held = forest._one_forest([forest._fit(weighted, {**params, "numTrees": n}, vocab.SEED + k * forest._SEED_STEP) for k, n in enumerate((2, 2, 1))])
    scores = lambda m: sorted((r["id"], r["p"]) for r in forest.fraud_probability(m, rows, ["id"]).collect())
    found, wanted = scores(model), scores(held)
    assert len(found) == 300 and [i for i, _ in found] == [i for i, _ in wanted]
    assert [p for _, p in found] == pytest.approx([p for _, p in wanted], abs=1e-12)
    ranks = lambda m: {r["feature"]: r["importance"] for r in forest.feature_importance(spark, m).collect()}
    assert ranks(model) == pytest.approx(ranks(held), abs=1e-12)

    sinks.save_model(spark, model, folder)
    loaded, paths = sinks.load_model(spark, folder)
    assert isinstance(loaded, forest.StoredForest) and scores(loaded) == found  # to the last digit
    plain = RandomForestClassificationModel.load(f"{folder}/model")
    assert plain.getNumTrees == 5 and scores(plain) == wanted and plain.getMinInstancesPerNode() == 2
    sinks.save_model(spark, held, f"{folder}/held")
    key = lambda r: (r["tree"], r["leaf"])
    assert sorted(paths.collect(), key=key) == sorted(sinks.load_model(spark, f"{folder}/held")[1].collect(), key=key)
    assert sorted(scoring.classify_features(table, model).columns) == sorted([*table.columns, "label", "confidence_score", "is_stub"])


def test_paths_take_one_shuffle_of_the_nodes(spark):
    """A chain of 32 levels under a first node; the paths of its leaves against those written out."""
    node = "struct<id: int, impurityStats: array<double>, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>>"
    rows, cover = [], 2.0 ** 33
    for level in range(32):  # the left child is a leaf with half of the rows, the chain goes on to the right
        rows.append((0, (2 * level, [cover, 0.0], 2 * level + 1, 2 * level + 2, (level % 3, [float(level)]))))
        cover /= 2
        rows.append((0, (2 * level + 1, [cover, 0.0], -1, -1, (-1, []))))
    rows.append((0, (64, [0.0, cover], -1, -1, (-1, []))))
    found = shap.tree_paths(spark.createDataFrame(rows[::-1], f"treeID int, nodeData {node}"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[treeID", "")
    paths = {r["leaf"]: r for r in found.collect()}
    assert set(paths) == {2 * level + 1 for level in range(32)} | {64}
    last = paths[64]
    assert (last["value"], last["lo"][:3], last["hi"][:3], math.prod(last["z"])) == (1.0, [30.0, 31.0, 29.0], [math.inf] * 3, 0.5 ** 32)
    assert (paths[9]["hi"][:3], paths[9]["lo"][:3], paths[9]["z"][:3]) == ([math.inf, 4.0, math.inf], [3.0, 1.0, 2.0], [0.25, 0.25, 0.5])


def _paths(rng, paths, length):
    features = np.array([np.sort(rng.permutation(shap.N)[:length]) for _ in range(paths)])
    lo = rng.normal(-1, 0.5, (paths, length)).round(1)
    hi = np.where(rng.random(lo.shape) < 0.3, np.inf, lo + rng.random(lo.shape).round(1) * 4)
    lo[rng.random(lo.shape) < 0.3] = -np.inf
    lo[np.isinf(lo) & np.isinf(hi)] = 0.0
    return features, rng.random(paths), lo, hi, rng.uniform(0.01, 1, (paths, length))


def test_many_rows_look_their_contributions_up():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20000, shap.N)).round(1)  # many values lie on thresholds
    x[5, 3] = np.nan
    groups = [_paths(rng, 9, length) for length in range(1, shap.N + 1)]
    groups[4][2][0, 0], groups[4][3][0, 0] = 2.0, 1.0  # an interval that no value lies in
    want = sum(shap.path_contributions(x, *g) for g in groups)
    assert np.allclose(shap.reduced_contributions(x, groups), want, rtol=0, atol=1e-12)
    few = x[:40]  # fewer rows than patterns of most paths
    assert np.allclose(shap.reduced_contributions(few, groups), want[:40], rtol=0, atol=1e-12)

    def timed(f, *args):
        start = time.process_time()
        f(*args)
        return time.process_time() - start

    group = _paths(rng, 300, 8)
    slow = min(timed(lambda: [shap.path_contributions(x, *[a[c:c + 64] for a in group]) for c in range(0, 300, 64)]) for _ in range(2))
    assert min(timed(shap.reduced_contributions, x, [group]) for _ in range(2)) < slow / 1.5


def test_a_path_table_and_an_explainer_give_the_same(spark, table, folder, monkeypatch):
    monkeypatch.setattr(tree_groups, "ROWS_PER_BLOCK", 100)
    model = forest.train_forest(forest.assemble(table, ["y"]), {"numTrees": 5, "maxDepth": 6})
    sinks.save_model(spark, model, folder)
    paths = sinks.load_model(spark, folder)[1]
    asked = table.withColumn("asked", F.when(F.substring("id", -1, 1) != "3", F.col("y") == 1))  # true, false and null
    got = shap.tree_shap(asked, paths, "asked", slice_bytes=4000)
    assert got.columns == [*asked.columns, "shap"]
    key = lambda r: (r["id"], r["shap"] is None)
    got, want = sorted(got.collect(), key=key), sorted(shap.tree_shap(asked, shap.Explainer(paths), "asked").collect(), key=key)
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and any(r["shap"] for r in got)
    for a, b in zip(got, want):
        assert (a["shap"] is None) == (b["shap"] is None) == (not a["asked"])
        assert a["shap"] is None or a["shap"] == pytest.approx(b["shap"], abs=1e-12)
    assert shap.tree_shap(asked.limit(0), paths).count() == 0
