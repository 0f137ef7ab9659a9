import gzip
import hashlib
import itertools
import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift import vocab
from postsift.operators import annotation, dedupe, evaluate, forest, hotkeys, labels, ranking, shap, split, stats
from postsift.operators.lineage import cut_lineage
from postsift.plans import scoring
from postsift.sources import conform, corpus, files, sinks, sitemaps
from postsift.streaming import scoring as streaming


def test_csv_with_mark_breaks_and_quotes(spark, folder):
    Path(folder, "in.csv").write_text('﻿source,source_id,title\na,1,"two\nlines ""quoted"""\nb,,\n', encoding="utf-8")
    rows = files.read_postings(spark, f"{folder}/in.csv", fmt="csv").orderBy("source").collect()
    assert [tuple(r) for r in rows] == [("a", "1", 'two\nlines "quoted"'), ("b", "", "")]


def test_load_order_follows_files_not_tasks(spark, folder):
    """A small first file and a large second one, which Spark reads first, through cleaning and the base corpus."""
    for name, n in (("1", 2), ("2", 400)):
        lines = "".join(f"{name}-{i},Clerk {i}\n" for i in range(n))
        Path(folder, f"{name}.csv").write_text("source_id,title\n" + lines)
        rows = "".join(f"{int(name) * 1000 + i},Ünit {i}\n" for i in range(n))
        Path(folder, f"base-{name}.csv").write_text("job_id,description\n" + rows, encoding="utf-8")
    df = files.with_load_order(files.read_postings(spark, [f"{folder}/2.csv", f"{folder}/1.csv"], fmt="csv"), 1)
    assert [r["source_id"] for r in df.orderBy("source_rank", "ordinal").collect()] == [f"1-{i}" for i in range(2)] + [f"2-{i}" for i in range(400)]
    raw = spark.read.csv([f"{folder}/base-2.csv", f"{folder}/base-1.csv"], header=True, multiLine=True, schema="job_id long, description string")
    raw = raw.select("*", *[F.lit("").alias(c) for c in corpus.CORPUS_SCHEMA.names if c not in raw.columns])
    base = files.with_load_order(corpus.standardize_base(raw), 0).orderBy("ordinal")
    assert [r["source_id"] for r in base.collect()] == [str(1000 + i) for i in range(2)] + [str(2000 + i) for i in range(400)]


def test_annotations_are_not_replaced(spark, folder):
    df = spark.range(3)
    files.write_annotations(df, f"{folder}/x")
    with pytest.raises(Exception):
        files.write_annotations(df, f"{folder}/x")
    files.write_annotations(df, f"{folder}/x", force=True)


def test_gzipped_sitemap_to_frontier(spark, folder):
    pre = vocab.BOARD_B["job_url_prefix"]
    xml = (f"<urlset><url>\n<loc> {pre}a </loc><lastmod>2025-01-01</lastmod></url><url><loc>{pre}a</loc><lastmod>2025-03-01</lastmod></url>"
           f"<url><loc>{pre}b</loc></url><url><loc>https://other.org/c</loc></url></urlset>")
    with gzip.open(f"{folder}/s.xml.gz", "wt") as f:
        f.write(xml)
    urls = sitemaps.sitemap_urls(sitemaps.read_sitemaps(spark, f"{folder}/s.xml.gz"))
    assert urls.count() == 3
    assert [tuple(r) for r in sitemaps.crawl_frontier(urls, 5).collect()] == [(pre + "a", "2025-03-01"), (pre + "b", "")]


def test_global_rank_and_running_totals(spark):
    values = [(i, random.Random(i).randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(values, "i int, v int").repartition(7)
    order = sorted(values, key=lambda r: (-r[1], r[0]))
    got = {r["i"]: r["rank"] for r in ranking.global_rank(df, [F.desc("v"), F.asc("i")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(order)}
    sums = {r["i"]: r["run"] for r in ranking.running_totals(df, [F.desc("v"), F.asc("i")], {"run": "v"}).collect()}
    assert sums == dict(zip((i for i, _ in order), itertools.accumulate(v for _, v in order)))


def test_the_annotation_shuffle_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(i):
        seen.add(1)
        return i

    ids = [str(i) for i in range(300)] + ["7", None, None]
    df = spark.createDataFrame([(i,) for i in ids], "i string").repartition(3).withColumn("t", costly("i"))
    got = annotation.annotation_shuffle(df, "i").collect()
    digest = lambda i: hashlib.md5(f"{vocab.SEED}|{i}".encode()).hexdigest()
    expected = sorted(ids, key=lambda i: (i is not None, i and digest(i)))
    assert [(r["i"], r["t"]) for r in sorted(got, key=lambda r: r["row"])] == [(i, i) for i in expected]
    assert sorted(r["row"] for r in got) == list(range(len(ids)))
    assert seen.value == len(ids)


def test_hot_keys_keep_all_rows(spark):
    keys = ["hot"] * 2000 + ["warm"] * 300 + [f"k{i}" for i in range(2700)]
    left = spark.createDataFrame(list(enumerate(keys)), "i int, g string")
    right = left.groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.min("i").alias("fold")).filter("g <> 'k5'")
    joined = hotkeys.left_join_hot(left, right, "g", "n_rows", len(keys)).collect()
    first = {}
    for i, g in enumerate(keys):
        first.setdefault(g, i)
    assert sorted((r["i"], r["g"], r["fold"]) for r in joined) == [(i, g, None if g == "k5" else first[g]) for i, g in enumerate(keys)]


def test_repeated_ids_keep_their_rows(spark):
    names = vocab.FEATURE_ORDER
    data = spark.createDataFrame([("s:1", "old text", "0"), ("s:1", "new text", "1"), ("s:2", "new text", "0"), ("s:3", "unseen", "0")], "id string, text string, fraudulent string")
    data = data.withColumns({"source": F.lit("s"), "split": F.lit("train"), "group": F.lit("g")})
    features = spark.createDataFrame([(t, *[v] * len(names)) for t, v in (("old text", 1.0), ("new text", 2.0), ("new text", 2.0))],
                                     "text string, " + ", ".join(f"{c} double" for c in names))
    got = sorted((r["id"], r["y"], r["ttr"]) for r in forest.feature_label_join(features, data).collect())
    assert got == [("s:1", 0, 1.0), ("s:1", 1, 2.0), ("s:2", 0, 2.0)]


def test_pages_of_history_by_number_and_by_last_row(spark):
    from postsift.operators import history
    posts = spark.range(25).select(F.format_string("p%02d", "id").alias("posting_id"), F.lit("some text").alias("raw_text"), F.lit("web").alias("source_platform"),
                                   F.timestamp_seconds(F.col("id") % 7).alias("submitted_at"), F.lit("u").alias("user_id"))
    results = posts.filter("posting_id < 'p20'").select("posting_id", F.lit("fraudulent").alias("label"))
    pages = [history.history(posts, posts.select("posting_id"), results, page=n, per_page=10).collect() for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [10, 10, 5] and len({r["posting_id"] for p in pages for r in p}) == 25
    assert all((r["label"] is None) == (r["posting_id"] >= "p20") for p in pages for r in p)
    last = pages[0][-1]
    assert history.history(posts, posts.select("posting_id"), results, after=(last["submitted_at"], last["posting_id"])).collect() == pages[1]


def test_split_of_skewed_groups(spark):
    r = random.Random(3)
    rows = [("big", str(int(r.random() < 0.05))) for _ in range(3000)] + [(f"g{i}", str(int(r.random() < 0.05))) for i in range(3000)]
    df = spark.createDataFrame([(n, *x) for n, x in enumerate(rows)], "id int, `group` string, fraudulent string")
    out = split.assert_no_leak(split.group_stratified_split(df)).cache()
    assert out.count() == 6000 and out.filter("split is null").count() == 0
    folds = {row["fold"]: row["n"] for row in split.with_folds(df.filter("`group` <> 'big'"), 5).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert set(folds) == {0, 1, 2, 3, 4} and all(580 <= n <= 620 for n in folds.values())
    with pytest.raises(AssertionError):
        split.assert_no_leak(df.select("group", F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split")))
    assert split.fold_count(0.4) == 2 and split.fold_count(0.2) == 5


def test_folds_beside_a_heavy_group(spark):
    """A group of 40 % has a fold of its own; heavy and light groups leave the others even, frauds too."""
    n = 20_000
    group = F.when(F.col("id") < 0.4 * n, "big").when(F.col("id") < 0.5 * n, F.concat(F.lit("m"), F.floor(F.col("id") / 100))).otherwise(
        F.concat(F.lit("s"), F.col("id")))
    df = spark.range(n).select("id", group.alias("group"), (F.col("id") % 8 == 0).cast("int").cast("string").alias("fraudulent"))
    folds = split.group_folds(df, 5).cache()
    assert folds.count() == folds.select("group").distinct().count() == df.select("group").distinct().count()
    loads = {r["fold"]: r for r in folds.groupBy("fold").agg(F.sum("n_rows").alias("rows"), F.sum("n_pos").alias("frauds")).collect()}
    assert set(loads) == {0, 1, 2, 3, 4} and sum(r["rows"] for r in loads.values()) == n and sum(r["frauds"] for r in loads.values()) == n / 8
    assert [loads[4]["rows"], loads[4]["frauds"]] == [0.4 * n, 0.05 * n]
    assert all(abs(loads[f]["rows"] - 0.15 * n) <= n / 1000 and abs(loads[f]["frauds"] - 0.01875 * n) <= n / 1000 for f in range(4))
    assert {r["split"]: r["n"] for r in split.group_stratified_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}["test"] == loads[0]["rows"]


def test_folds_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, `group` string, fraudulent string")
    assert split.with_folds(empty, 5).count() == 0
    odd = spark.createDataFrame([(1, None, "1"), (2, None, "0"), (3, "a", None), (4, "a", None), (5, "b", "0")], empty.schema)
    rows = {r["id"]: r["fold"] for r in split.with_folds(odd, 2).collect()}
    assert rows[1] is None and rows[2] is None and rows[3] == rows[4] and rows[5] is not None


def test_room_is_filled_to_one_level():
    rng = random.Random(3)
    for _ in range(300):
        loads, total = [rng.randint(0, 40) for _ in range(rng.randint(1, 6))], rng.randint(1, 60)
        m, bounds = split.room_bounds(loads, total)
        rooms = [(b - a) / m for a, b in zip([0, *bounds], bounds)]
        filled = [x + r for x, r in zip(loads, rooms) if r > 0]
        assert math.isclose(sum(rooms), total) and max(filled) - min(filled) < 1e-9
        assert all(x >= max(filled) - 1e-9 for x, r in zip(loads, rooms) if r == 0)


def test_copies_and_conflicts(spark):
    rows = [("x", "0", 1, 5), ("x", "0", 0, 9), ("y", "0", 0, 1), ("y", "1", 1, 2), ("z", "1", 1, 1)] + [("hot", "0", 1, n) for n in range(100, 400)]
    df = spark.createDataFrame(rows, "text_norm string, fraudulent string, source_rank int, ordinal int")
    merged = dedupe.collapse_copies(df.withColumn("t", F.col("text_norm")), "text_norm", label="fraudulent")
    got = {r["t"]: (r["source_rank"], r["ordinal"], r["n_copies"], r["label_conflict"]) for r in merged.collect()}
    assert got == {"x": (0, 9, 2, False), "y": (0, 1, 2, True), "z": (1, 1, 1, False), "hot": (1, 100, 300, False)}
    assert dedupe.conflict_anti_join(df).count() == len(rows) - 2


def test_label_events(spark):
    rows = spark.createDataFrame([(1, "", "old"), (2, "1", "keep")], "row int, fraudulent string, notes string")
    events = spark.createDataFrame([(1, "1", "a", 1), (1, "0", None, 2), (1, "7", "bad", 3)], "row int, fraudulent string, notes string, ts int")
    assert sorted(tuple(r) for r in labels.label_upsert(rows, events).collect()) == [(1, "0", ""), (2, "1", "keep")]
    assert labels.split_label_events(events)[1].count() == 1


def pairwise(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def stepwise(y, p):
    total, area = sum(y), 0.0
    for s in sorted(set(p)):
        tp = sum(a for a, b in zip(y, p) if b >= s)
        area += sum(a for a, b in zip(y, p) if b == s) / total * tp / sum(b >= s for b in p)
    return area


def test_areas_equal_their_definitions(spark):
    r = random.Random(1)
    cases = {0: ([1, 0, 1, 0], [0.9, 0.1, 0.8, 0.2]), 1: ([1, 0], [0.1, 0.9]), 2: ([1, 0, 0, 1], [0.5] * 4)}
    y = [int(r.random() < 0.3) for _ in range(400)]
    cases[3] = (y, [round(0.3 * v + 0.7 * r.random(), 2) for v in y])
    rows = [(k, int(a), float(b)) for k, (ys, ps) in cases.items() for a, b in zip(ys, ps)]
    got = {r["k"]: r for r in evaluate.ranking_metrics(spark.createDataFrame(rows, "k int, y int, p double"), ["k"]).collect()}
    for k, (ys, ps) in cases.items():
        assert got[k]["roc_auc"] == pytest.approx(pairwise(ys, ps), abs=1e-12)
        assert got[k]["average_precision"] == pytest.approx(stepwise(ys, ps), abs=1e-12)
    one_class = evaluate.ranking_metrics(spark.createDataFrame([(0, 0.5), (0, 0.7)], "y int, p double")).first()
    assert one_class["average_precision"] is None and one_class["roc_auc"] is None


def test_empty_class_rates_are_null(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 0, 0)], "source string, y int, pred int")
    got = {r["source"]: (r["recall"], r["false_positive_rate"]) for r in evaluate.per_source_rates(df).collect()}
    assert got == {"a": (0.5, None), "b": (None, 0.0)}


@pytest.fixture(scope="module")
def forest_table(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        x = [round(r.random() * 10, 1) for _ in vocab.FEATURE_ORDER]
        rows.append((f"p{i}", "s", "train", f"g{i}", int(x[0] + x[1] * (x[2] > 5) > 9 or r.random() < 0.1), *x))
    schema = "id string, source string, split string, `group` string, y int, " + ", ".join(f"{c} double" for c in vocab.FEATURE_ORDER)
    return spark.createDataFrame(rows, schema)


def test_training_sends_neither_grown_trees_nor_a_copy_per_small_task(spark, forest_table):
    scattered = cut_lineage(forest.assemble(forest_table.repartition(40), ["y"]))  # rows keep their order
    cores = spark.sparkContext.defaultParallelism
    narrow = forest._at_most_a_task_per_core(forest.balanced_weights(scattered))
    assert narrow.rdd.getNumPartitions() == cores and narrow.count() == forest_table.count()
    params = {"numTrees": 5, "maxDepth": 6}
    model = forest.train_forest(scattered, params)
    assert model.getCacheNodeIds()
    plain = forest.RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", seed=vocab.SEED, **params).fit(narrow)
    assert model.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]  # the same trees


def test_a_large_forest_grows_in_parts(spark, forest_table, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(forest, "TREES_PER_FIT", 2)
    rows = cut_lineage(forest.assemble(forest_table, ["id", "y"]))
    model = forest.train_forest(rows, {"numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 2})
    assert (model.getNumTrees, model.getMaxDepth(), model.getMinInstancesPerNode(), model.numFeatures, model.getSeed()) == (5, 3, 2, 15, vocab.SEED)
    texts = [t.toDebugString.split("\n", 1)[1] for t in model.trees]
    assert len(set(texts)) == 5  # parts do not repeat each other's draws
    weighted = cut_lineage(forest.balanced_weights(rows))
    parts = [forest._fit(weighted, {"numTrees": n, "maxDepth": 3, "minInstancesPerNode": 2}, vocab.SEED + k * forest._SEED_STEP) for k, n in enumerate((2, 2, 1))]
    assert texts == [t.toDebugString.split("\n", 1)[1] for part in parts for t in part.trees]
    path = "file://" + str(tmp_path_factory.mktemp("model"))
    sinks.save_model(spark, model, path)
    loaded, paths = sinks.load_model(spark, path)
    scores = lambda m: {r["id"]: r["p"] for r in forest.fraud_probability(m, rows, ["id"]).collect()}
    whole, each = scores(model), [scores(part) for part in parts]
    assert whole == scores(loaded) and paths.select("tree").distinct().count() == 5
    assert all(whole[i] == pytest.approx(sum(n * p[i] for n, p in zip((2, 2, 1), each)) / 5) for i in whole)


def test_contributions_equal_brute_force(spark, forest_table, tmp_path_factory):
    model = forest.train_forest(forest.assemble(forest_table, ["y"]), {"numTrees": 3, "maxDepth": 4, "featureSubsetStrategy": "0.5"})
    path = "file://" + str(tmp_path_factory.mktemp("model"))
    assert sinks.load_model(spark, path) == (None, None)
    sinks.save_model(spark, model, path)
    loaded, paths = sinks.load_model(spark, path)
    rows = forest_table.limit(12)
    got = {r["id"]: r["shap"] for r in shap.tree_shap(rows, paths).collect()}
    sliced = {r["id"]: r["shap"] for r in shap.tree_shap(rows, paths, slice_bytes=4000).collect()}
    leaves, n_trees = paths.collect(), paths.select("tree").distinct().count()
    used = [f for f in range(15) if any(math.isfinite(p["lo"][f]) or math.isfinite(p["hi"][f]) for p in leaves)]

    def value(x, known):
        total = 0.0
        for p in leaves:
            w = p["value"]
            for f in used:
                w *= float(p["lo"][f] < x[f] <= p["hi"][f]) if f in known else p["z"][f]
            total += w
        return total / n_trees

    prob = {r["id"]: r["p"] for r in forest.fraud_probability(loaded, forest.assemble(forest_table, ["id"]), ["id"]).collect()}
    for row in rows.collect():
        x = [row[c] for c in vocab.FEATURE_ORDER]
        assert value(x, set(used)) == pytest.approx(prob[row["id"]], abs=1e-12)
        assert sum(got[row["id"]]) + value(x, set()) == pytest.approx(prob[row["id"]], abs=1e-12)
        assert sliced[row["id"]] == pytest.approx(got[row["id"]], abs=1e-12)
    row = rows.first()
    x, memo = [row[c] for c in vocab.FEATURE_ORDER], {}
    n = min(len(used), 9)
    if len(used) <= 9:
        v = lambda s: memo.setdefault(s, value(x, s))
        for f in used:
            others = [g for g in used if g != f]
            phi = sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (v(frozenset(s) | {f}) - v(frozenset(s)))
                      for k in range(n) for s in itertools.combinations(others, k))
            assert got[row["id"]][f] == pytest.approx(phi, abs=1e-12)


def test_paths_of_a_hand_made_forest(spark):
    """A chain that tests feature 2 at each of seven levels, and a tree that is one leaf."""
    node = "struct<id: int, impurityStats: array<double>, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>>"
    rows = [(1, (0, [3.0, 1.0], -1, -1, (-1, [])))]
    for level in range(7):  # inner nodes 0, 2, 4 ...; the left child is a leaf with half of the rows
        rows.append((0, (2 * level, [2.0 ** (9 - level), 0.0], 2 * level + 1, 2 * level + 2, (2, [float(level)]))))
        rows.append((0, (2 * level + 1, [2.0 ** (7 - level), 2.0 ** (7 - level)], -1, -1, (-1, []))))
    rows.append((0, (14, [0.0, 4.0], -1, -1, (-1, []))))
    paths = {(r["tree"], r["leaf"]): r for r in shap.tree_paths(spark.createDataFrame(rows, f"treeID int, nodeData {node}")).collect()}
    assert set(paths) == {(1, 0), (0, 14)} | {(0, 2 * level + 1) for level in range(7)}
    assert paths[1, 0]["value"] == 0.25 and paths[1, 0]["z"] == [1.0] * 15 and paths[1, 0]["lo"] == [-math.inf] * 15
    for level in range(7):
        leaf = paths[0, 2 * level + 1]
        assert (leaf["value"], leaf["lo"][2], leaf["hi"][2], leaf["z"][2]) == (0.5, level - 1.0 if level else -math.inf, float(level), 0.5 ** (level + 1))
        assert leaf["z"][:2] + leaf["z"][3:] == [1.0] * 14 and leaf["hi"][:2] + leaf["hi"][3:] == [math.inf] * 14
    assert (paths[0, 14]["value"], paths[0, 14]["lo"][2], paths[0, 14]["hi"][2], paths[0, 14]["z"][2]) == (1.0, 6.0, math.inf, 0.5 ** 7)


def test_every_row_gets_the_count_of_its_key(spark):
    keys = ["a"] * 300 + ["b", "b", "", None, None, "c"]
    df = spark.createDataFrame([(n, k, "x") for n, k in enumerate(keys)], "i int, k string, _other string")
    rows = dedupe.with_duplicate_count(df, "k").collect()
    assert sorted(((r["i"], r["k"], r["_other"], r["duplicate_count"]) for r in rows), key=lambda r: r[0]) == [(n, k, "x", keys.count(k)) for n, k in enumerate(keys)]
    assert dedupe.with_duplicate_count(df.limit(0), "k").count() == 0


def test_states_of_contributions_add_up(spark):
    """Quantiles of merged parts lie within the error bound; one part is large, one empty, one constant."""
    values = [float((n * 7919) % 30011) - 15000 for n in range(30011)]  # each whole number from -15000 to 15010 once
    parts = [values[:25000], [], values[25000:]]
    states = [shap.shap_state(spark.createDataFrame([([v] * 14 + [0.25],) for v in part] + [(None,)], "shap array<double>")) for part in parts]
    merged = shap.state_summary(shap.merge_states(states[0].union(states[1]).union(states[2])), (0.0, 0.01, 0.5, 0.99, 1.0))
    rows = {r["feature"]: r for r in merged.collect()}
    assert set(rows) == set(vocab.FEATURE_ORDER)
    first, last = rows[vocab.FEATURE_ORDER[0]], rows[vocab.FEATURE_ORDER[14]]
    assert first["n"] == 30011 and first["mean"] == pytest.approx(5.0) and first["mean_abs"] == pytest.approx(sum(map(abs, values)) / 30011)
    assert (first["quantiles"][0], first["quantiles"][4]) == (-15000, 15010)
    assert all(abs((q + 15000) / 30011 - s) < 0.01 for q, s in zip(first["quantiles"], (0.0, 0.01, 0.5, 0.99, 1.0)))
    assert last["quantiles"] == [0.25] * 5 and last["mean"] == 0.25
    assert shap.shap_summary(spark.createDataFrame([(None,)], "shap array<double>")).count() == 0


def test_contributions_take_a_fraction_of_the_plain_formula():
    rng = np.random.default_rng(5)

    def plain(x, features, value, lo, hi, z):
        """The integral node by node, each feature's factor divided out."""
        part = x[:, features]
        known = ((part > lo) & (part <= hi)).astype(float)
        nodes, weights = np.polynomial.legendre.leggauss(-(-features.shape[1] // 2))
        weight = np.zeros_like(known)
        for t, w in zip((nodes + 1) / 2, weights / 2):
            factor = t * known + (1 - t) * z
            weight += w * factor.prod(axis=2, keepdims=True) / factor
        return ((known - z) * value[:, None] * weight).reshape(len(x), -1) @ np.eye(shap.N)[features.ravel()]

    def timed(f, *args):
        start = time.process_time()
        return f(*args), time.process_time() - start

    for length in range(1, shap.N + 1):
        paths = 600 if length == 10 else 7
        features = np.array([np.sort(rng.permutation(shap.N)[:length]) for _ in range(paths)])
        lo = rng.normal(-1, 0.5, (paths, length))
        group = (features, rng.random(paths), lo, lo + rng.random((paths, length)) * 4, rng.uniform(0.01, 1, (paths, length)))
        x = rng.normal(size=(500, shap.N))
        (want, slow), (got, quick) = timed(plain, x, *group), min((timed(shap.reduced_contributions, x, [group]) for _ in range(3)), key=lambda r: r[1])
        assert np.allclose(got, want, rtol=0, atol=1e-12)
        assert length != 10 or quick < slow / 1.5


def test_leaf_contributions_on_a_hand_made_tree():
    """One path with two features: Shapley values written out by hand."""
    inf = np.inf
    lo, hi, z = np.full((1, 15), -inf), np.full((1, 15), inf), np.ones((1, 15))
    hi[0, 0], z[0, 0], lo[0, 1], z[0, 1] = 1.0, 0.25, 2.0, 0.5
    x = np.zeros((1, 15))
    x[0, 0], x[0, 1] = 1.0, 1.0  # passes the first test, fails the second
    phi = shap.leaf_contributions(x, np.array([0.8]), lo, hi, z)[0]
    v = {(0, 0): 0.125, (1, 0): 0.5, (0, 1): 0.0, (1, 1): 0.0}
    assert phi[0] == pytest.approx(0.8 * 0.5 * ((v[1, 0] - v[0, 0]) + (v[1, 1] - v[0, 1])))
    assert phi[1] == pytest.approx(0.8 * 0.5 * ((v[0, 1] - v[0, 0]) + (v[1, 1] - v[1, 0])))
    assert not phi[2:].any()


def test_explanations_name_three_features_for_fraud_only(spark, forest_table, folder):
    model = forest.train_forest(forest.assemble(forest_table, ["y"]), {"numTrees": 5, "maxDepth": 4})
    sinks.save_model(spark, model, folder)
    scored = scoring.classify_features(forest_table, model)
    for row in shap.explain(scored, sinks.load_model(spark, folder)[1]).collect():
        assert 0.5 <= row["confidence_score"] <= 1
        if row["label"] == "legitimate":
            assert row["top_features"] is None and row["summary"] is None
        else:
            sizes = [abs(f["shap_value"]) for f in row["top_features"]]
            assert len(sizes) == 3 and sizes == sorted(sizes, reverse=True)
            assert all(f["impact"] == ("high" if abs(f["shap_value"]) > 0.1 else "moderate") for f in row["top_features"])
    total = forest.feature_importance(spark, model).agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)


def test_tuning_picks_the_best_of_the_grid(spark, forest_table):
    train = split.with_folds(forest_table, 2, label="y")
    found = forest.grid_search(forest.assemble(train, ["fold", "y"]), {"numTrees": [4], "maxDepth": [1, 5]})
    scores = {r["param_id"]: r["mean_pr_auc"] for r in found["cv_results"].collect()}
    assert found["best_score"] == max(scores.values()) and found["best_params"] == found["params"][max(scores, key=scores.get)]
    assert found["predictions"].count() == 2 * forest_table.count()
    assert len(forest.param_sets()) == 18


def test_fits_of_a_search_take_a_task_per_so_many_rows(spark, forest_table, monkeypatch):
    """Rows lie in 8 parts; each task of a fit costs statistics of all nodes, so few rows go to one task."""
    train = forest.assemble(forest_table.withColumn("fold", F.substring("id", -1, 1).cast("int") % 2), ["fold", "y"]).repartition(8)
    plain, seen = forest._fit, []
    monkeypatch.setattr(forest, "_fit", lambda rows, *a: seen.append((rows.rdd.getNumPartitions(), rows.count())) or plain(rows, *a))
    for rows, tasks in ((forest.ROWS_PER_TASK, 1), (100, 3)):
        monkeypatch.setattr(forest, "ROWS_PER_TASK", rows)
        seen.clear()
        found = forest.grid_search(train, {"numTrees": [2], "maxDepth": [2, 3]})
        assert sorted(seen) == [(tasks, 150)] * 4 + [(tasks, 300)]  # 2 settings on 2 folds, and the best on all rows
        assert found["predictions"].count() == 600


def _submitted(spark, folder):
    """Eleven rows in eleven files: one without user, one without text."""
    rows = [(str(n), "URGENT act now, mail x@gmail.com" if n % 2 else "Plain posting.", "web", None if n == 4 else "u1") for n in range(10)] + [("10", "  ", "web", "u1")]
    df = spark.createDataFrame(rows, "submission_id string, text string, source_platform string, user_id string").withColumn("submitted_at", F.lit("2025-01-01").cast("timestamp"))
    df.repartitionByRange(11, "submission_id").write.json(f"{folder}/in")


def _score(spark, folder, attempt, files_per_batch):
    stream = streaming.read_submissions(spark, f"{folder}/in", files_per_batch=files_per_batch)
    streaming.score_stream(stream, f"{folder}/out", f"{folder}/check-{attempt}").awaitTermination()


ONCE = {"job_postings": 9, "feature_vectors": 9, "classification_results": 9, "explainability_reports": 5, "rejects": 2}


def _sizes(spark, folder):
    return {name: table.count() for name, table in streaming.stored_tables(spark, f"{folder}/out").items()}


def test_replays_with_other_batch_sizes_store_each_id_once(spark, folder):
    _submitted(spark, folder)
    assert streaming.stored_tables(spark, f"{folder}/out") == {}
    for attempt, files_per_batch in (("a", 1000), ("b", 4), ("a", 2)):  # the last finds nothing new in its checkpoint
        _score(spark, folder, attempt, files_per_batch)
        assert _sizes(spark, folder) == ONCE
    spark.createDataFrame([("3", "sent again", "web", "u1"), ("11", "a new one", "web", "u2")], "submission_id string, text string, source_platform string, user_id string").coalesce(1).write.mode("append").json(f"{folder}/in")
    _score(spark, folder, "b", 1000)
    tables = streaming.stored_tables(spark, f"{folder}/out")
    texts = [r["raw_text"] for r in tables["job_postings"].collect()]
    assert len(texts) == 10 and "a new one" in texts and "sent again" not in texts
    linked = tables["job_postings"].join(tables["classification_results"], "posting_id").join(tables["feature_vectors"], ["posting_id", "vector_id"])
    assert linked.count() == 10


@pytest.mark.parametrize("stop", ["classification_results", "rejects", "marker"])
def test_stop_within_a_batch_neither_loses_nor_doubles(spark, folder, stop, monkeypatch):
    _submitted(spark, folder)
    tables, commit, calls = sinks.score_tables, sinks.commit_batch, []

    def part(scored):  # the second batch stops before the named table is written
        calls.append(1)
        made = tables(scored)
        if len(calls) == 2 and stop in made:
            made[stop] = made[stop].withColumn("_stop", F.raise_error(F.lit("stopped")))
        return made

    def mark(keys, path, batch):
        if len(calls) == 2 and stop == "marker":
            raise RuntimeError("stopped")
        commit(keys, path, batch)

    def rejected(validated):
        if len(calls) == 2 and stop == "rejects":
            raise RuntimeError("stopped")
        return validated.filter("reason is not null")

    monkeypatch.setattr(sinks, "score_tables", part)
    monkeypatch.setattr(sinks, "commit_batch", mark)
    monkeypatch.setattr(streaming.submissions, "rejected", rejected)
    with pytest.raises(Exception, match="stopped"):
        _score(spark, folder, "a", 3)
    monkeypatch.undo()
    assert 0 < _sizes(spark, folder)["job_postings"] < 9
    _score(spark, folder, "b", 5)  # another checkpoint reads all again
    assert _sizes(spark, folder) == ONCE
    _score(spark, folder, "a", 4)  # the stopped query goes on: its batch finds its keys stored
    assert _sizes(spark, folder) == ONCE


def test_rows_of_one_batch_that_share_an_id(spark, folder):
    schema = "submission_id string, text string, source_platform string, user_id string, submitted_at timestamp"
    rows = [("1", "b", "web", "u", None), ("1", "a", "web", "u", None), (None, "x", "web", "u", None), (None, "x", "web", "u", None), (None, "y", None, "u", None),
            ("2", "", "web", "u", None), ("2", "", "web", "u", None), ("2", "now with text", "web", "u", None)]
    df = spark.createDataFrame(rows, schema)
    for batch in ("q_0", "q_0", "r_0"):
        streaming.store_batch(df, folder, batch)
        tables = streaming.stored_tables(spark, folder)
        assert sorted(r["raw_text"] for r in tables["job_postings"].collect()) == ["a", "now with text", "x", "y"]
        assert tables["rejects"].count() == 1
    streaming.store_batch(df.limit(0), folder, "r_1")
    assert streaming.stored_tables(spark, folder)["job_postings"].count() == 4


def test_feature_cache_computes_new_texts_only(spark, folder):
    first = spark.createDataFrame([("a", "one text"), ("b", "one text"), ("c", "two texts!")], "id string, text string")
    assert sinks.cached_features(first, f"{folder}/f").count() == 3
    assert spark.read.parquet(f"{folder}/f").count() == 2
    more = first.union(spark.createDataFrame([("d", "three")], "id string, text string"))
    assert sinks.cached_features(more, f"{folder}/f").count() == 4
    assert spark.read.parquet(f"{folder}/f").count() == 3


def test_conform_and_backfill(spark):
    df = spark.createDataFrame([("a", None, 3)], "source string, title string, fraudulent int")
    row = conform.conform_unified(df).first()
    assert list(row.asDict()) == vocab.UNIFIED_COLUMNS and row["title"] == "" and row["fraudulent"] == "3" and row["url"] == ""
    assert set(vocab.LABEL_VIEW_COLUMNS) <= set(conform.backfill_columns(df).columns)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_training_from_dataset_to_stored_model(spark, folder):
    from checks import catalog
    from postsift.plans import training
    data = catalog.Inputs(spark, "/root/testdata/sf0.001").dataset
    run = training.train_and_evaluate(data, folder, {"numTrees": [4], "maxDepth": [3]}, folds=2, sample=5)
    assert run["predictions"].count() == data.filter("split = 'test'").count()
    assert run["scores"].count() == 1 and run["report"].count() == 5 and run["importance"].count() == 15
    assert run["shap_summary"].count() == 15 and run["metrics"].first()["best_params"] == {"numTrees": "4", "maxDepth": "3"}
    loaded, _ = sinks.load_model(spark, folder)
    table = forest.assemble(sinks.cached_features(data, f"{folder}/features"), ["id"])
    both = forest.fraud_probability(run["model"], table, ["id"]).join(
        forest.fraud_probability(loaded, table, ["id"]).withColumnRenamed("p", "q"), "id")
    assert both.filter("p <> q").count() == 0 and both.count() == data.count()
