"""Exact per-feature contributions to a forest's fraud probability.

A forest is a sum over leaves: each leaf gives its fraud share v if every feature
that its path tests falls into the path's interval. For one leaf, a feature that is
known passes or fails (o = 1 or 0); an unknown one passes with the share z of
training rows that went the path's way. The contribution of feature i is then

    v (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (t o_j + (1 - t) z_j) dt

which is Shapley's weighting of all coalitions written as an integral. The integrand
is a polynomial of a degree under the number of features tested, so half as many
Gauss-Legendre nodes integrate it exactly. Untested features contribute nothing.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postsift import vocab
from postsift.functions import verdict
from postsift.operators.tree_groups import summed_over_trees, wide

N = len(vocab.FEATURE_ORDER)
SLICE_BYTES = 128 << 20
_PATH_BYTES = 8 * (3 * N + 1)
_CELLS = 1 << 17  # rows x paths x tested features at once
_TABLE_CELLS = 1 << 18  # paths x tested features x patterns at once
_ROWS_AT_ONCE = 1 << 14
_GROUP_BYTES = 6 << 20  # paths of a task that explains a table


# --- the forest as a table of paths ------------------------------------------


_PATHS = "tree int, leaf int, value double, lo array<double>, hi array<double>, z array<double>"


def tree_paths(saved_nodes: DataFrame) -> DataFrame:
    """Leaf paths of a saved forest, from its node table: tree, leaf, value, lo, hi, z.

    The nodes of a tree are read in the order of their ids: a node comes before those below it, and MLlib numbers
    a subtree through before the next. So a task keeps one node a level, whose path its children carry on,
    and never a tree. Repeated tests of a feature merge: intervals meet, shares multiply. A tree that is a single
    leaf has one path without tests.
    """
    node = F.col("nodeData")
    flat = saved_nodes.select(
        F.col("treeID").cast("int").alias("tree"),
        node["id"].alias("id"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, x: a + x).alias("cover"),
        F.get(node["impurityStats"], 1).alias("frauds"),
    )
    tasks = 2 * saved_nodes.sparkSession.sparkContext.defaultParallelism
    return flat.repartition(tasks, "tree").sortWithinPartitions("tree", "id").mapInArrow(_walk, _PATHS)


def _walk(batches):
    """Paths of the leaves among nodes ordered by tree and id."""
    root = [-np.inf] * N, [np.inf] * N, [1.0] * N, None, None
    current, above = None, {}  # node: the path to it but for its share, the feature tested last, the cover there
    for batch in batches:
        found = []
        for tree, node, left, right, feature, threshold, cover, frauds in zip(*[c.to_pylist() for c in batch.columns]):
            if tree != current:
                current, above = tree, {}
            lo, hi, z, tested, whole = above.pop(node, root)
            if tested is not None:
                z = z.copy()
                z[tested] *= cover / whole
            if left < 0:
                if cover:
                    found.append((tree, node, frauds / cover, lo, hi, z))
                continue
            below, beyond = hi.copy(), lo.copy()
            below[feature], beyond[feature] = min(hi[feature], threshold), max(lo[feature], threshold)
            above[left], above[right] = (lo, below, z, feature, cover), (beyond, hi, z, feature, cover)
        kinds = [pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * 3]
        columns = zip(*found) if found else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "leaf", "value", "lo", "hi", "z"])


def base_value(paths: DataFrame) -> Column:
    """Expected fraud probability before any feature is known, as an aggregate."""
    reach = F.aggregate("z", F.lit(1.0), lambda a, x: a * x)
    return F.sum(F.col("value") * reach) / F.countDistinct("tree")


# --- contributions -----------------------------------------------------------


def reduced(value, lo, hi, z) -> list[tuple]:
    """Paths by the number of features they test, without the other features.

    Each group is (features, value, lo, hi, z); all but ``value`` have one column per tested feature.
    A path without a test contributes nothing and is left out.
    """
    tested = np.isfinite(lo) | np.isfinite(hi)
    lengths = tested.sum(axis=1)
    out = []
    for length in np.unique(lengths[lengths > 0]):
        paths = np.flatnonzero(lengths == length)
        features = np.nonzero(tested[paths])[1].reshape(-1, length)
        out.append((features, value[paths], *[np.take_along_axis(a[paths], features, 1) for a in (lo, hi, z)]))
    return out


def _nodes(length: int):
    """Gauss-Legendre nodes and weights on [0, 1], exact as the integrand's degree is under ``length``."""
    nodes, weights = np.polynomial.legendre.leggauss(-(-length // 2))
    return (nodes + 1) / 2, weights / 2


def path_contributions(x, features, value, lo, hi, z) -> np.ndarray:
    """Contributions for rows x (rows, features), summed over paths that test equally many features.

    At node t a known feature is a factor t + (1 - t) z of the integrand and another is (1 - t) z, so the
    integrand is exp of a sum over the known ones. Left without its own factor it serves all features that fail alike.
    """
    paths, length = features.shape
    t, w = _nodes(length)
    failed = (1 - t) * z[:, :, None]  # (paths, tested features, nodes)
    passed = t + failed
    base = np.log(failed).sum(axis=1)[:, :, None]
    gain = np.log(passed / failed).transpose(0, 2, 1)
    each = value[:, None] * (w / (1 - t))  # a feature that fails gives minus this share of the integrand
    own = value[:, None, None] * w * (1 - z[:, :, None]) / passed + each[:, None, :]
    place = np.eye(N)[features.ravel()].T
    out = np.zeros_like(x)
    rows_at_once = max(1, _CELLS // (paths * length))
    for r in range(0, len(x), rows_at_once):
        columns = np.ascontiguousarray(x[r:r + rows_at_once].T)
        part = columns[features]  # (paths, tested features, rows)
        known = ((part > lo[:, :, None]) & (part <= hi[:, :, None])).astype(float)
        integrand = np.matmul(gain, known)  # (paths, nodes, rows)
        integrand += base
        np.exp(integrand, out=integrand)
        known *= np.matmul(own, integrand)
        known -= np.matmul(each[:, None, :], integrand)
        out[r:r + rows_at_once] = (place @ known.reshape(paths * length, -1)).T
    return out


def reduced_contributions(x, groups, paths_at_once=64) -> np.ndarray:
    """Contributions for rows x (rows, features), summed over groups of paths.

    What a path contributes follows from which of its tests a row passes. Where rows are many against
    these patterns, each pattern is worked out once and looked up by the rows.
    """
    out = np.zeros((N, len(x)))
    many = [g for g in groups if 2 * len(x) >= 1 << g[0].shape[1]]
    if many:
        codes, tests = _coded(x, many)
        for (features, value, _, _, z), (first, span) in zip(many, tests):
            length = features.shape[1]
            step = max(1, _TABLE_CELLS // (length << length))
            for c in range(0, len(features), step):
                part = slice(c, c + step)
                _look_up(codes, features[part], first[part], span[part], _tables(value[part], z[part]), out)
    out = out.T.copy()
    for group in groups:
        if 2 * len(x) < 1 << group[0].shape[1]:
            for c in range(0, len(group[0]), paths_at_once):
                out += path_contributions(x, *[a[c:c + paths_at_once] for a in group])
    return out


def _coded(x, groups):
    """Rows as numbers of thresholds below their values, and intervals as first number and span."""
    ends = [np.unique(np.concatenate([a[features == f] for features, _, lo, hi, _ in groups for a in (lo, hi)])) for f in range(N)]
    ends = [e[np.isfinite(e)] for e in ends]
    kind = np.uint16 if max(map(len, ends)) < (1 << 16) - 2 else np.uint32
    never = np.iinfo(kind).max  # no row has this number; one less is that of a missing value, which passes no test
    codes = np.array([np.where(np.isnan(x[:, f]), never - 1, np.searchsorted(ends[f], x[:, f])) for f in range(N)], kind)
    tests = []
    for features, _, lo, hi, _ in groups:
        first, last = np.zeros(features.shape, np.int64), np.zeros(features.shape, np.int64)
        for f in range(N):
            here = features == f
            first[here], last[here] = np.searchsorted(ends[f], lo[here], "right"), np.searchsorted(ends[f], hi[here])
        empty = last < first
        tests.append((np.where(empty, never, first).astype(kind), np.where(empty, 0, last - first).astype(kind)))
    return codes, tests


def _tables(value, z) -> np.ndarray:
    """Contributions of each path's tested features for every pattern of passed tests: (paths, tested, patterns)."""
    paths, length = z.shape
    t, w = _nodes(length)
    failed = (1 - t) * z[:, :, None]  # (paths, tested features, nodes)
    passed = t + failed
    integrand = np.ones((paths, len(t), 1))
    for j in range(length):  # bit j of a pattern: test j is passed
        integrand = np.concatenate([integrand * failed[:, j, :, None], integrand * passed[:, j, :, None]], axis=2)
    each = value[:, None] * (w / (1 - t))
    own = value[:, None, None] * w * (1 - z[:, :, None]) / passed + each[:, None, :]
    out = np.matmul(own, integrand)
    out *= (np.arange(1 << length) >> np.arange(length)[:, None]) & 1
    out -= np.matmul(each[:, None, :], integrand)
    return out


def _look_up(codes, features, first, span, tables, out) -> None:
    """Add to ``out`` (features, rows) what the tables hold for the patterns of the rows."""
    length = features.shape[1]
    for r in range(0, codes.shape[1], _ROWS_AT_ONCE):
        part, total = codes[:, r:r + _ROWS_AT_ONCE], out[:, r:r + _ROWS_AT_ONCE]
        found = np.empty(part.shape[1])
        for p in range(len(features)):
            bits = np.zeros((2, part.shape[1]), np.uint8)
            for j in range(length):
                passed = (part[features[p, j]] - first[p, j]) <= span[p, j]  # unsigned: numbers below the first wrap
                bits[j >> 3] |= passed.view(np.uint8) << np.uint8(j & 7)
            pattern = bits[0].astype(np.intp)
            if length > 8:
                pattern |= bits[1].astype(np.intp) << 8
            for j in range(length):
                np.take(tables[p, j], pattern, out=found, mode="clip")
                total[features[p, j]] += found


def leaf_contributions(x, value, lo, hi, z) -> np.ndarray:
    """Contributions for rows x (rows, features), summed over the given leaves."""
    return reduced_contributions(x, reduced(value, lo, hi, z))


class Explainer:
    """A forest's paths, read once and sent to the executors in slices of bounded size."""

    def __init__(self, paths: DataFrame, slice_bytes=SLICE_BYTES):
        context = paths.sparkSession.sparkContext
        size = paths.agg(F.count(F.lit(1)), F.countDistinct("tree")).first()
        self.trees = size[1]
        slices = max(1, -(-size[0] * _PATH_BYTES // slice_bytes))
        numbered = paths.withColumn("_slice", F.pmod(F.xxhash64("tree", "leaf"), F.lit(slices)))
        # A slice at a time on the driver; what is sent holds the tested features only.
        self.slices = [context.broadcast(_arrays(numbered.filter(F.col("_slice") == k).toArrow())) for k in range(slices)]

    def column(self, number: int, features: Column, wanted: Column) -> Column:
        """Contributions of one slice's leaves; null where not wanted. Only the features go to Python."""
        leaves, trees = self.slices[number], self.trees

        @F.pandas_udf("array<double>")
        def contribute(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), index=x.index, dtype=object)
            there = x.notna()
            if there.any():
                rows = np.vstack(x[there].to_numpy()).astype(float)
                total = reduced_contributions(rows, leaves.value)
                out[there] = pd.Series(list(total / trees), index=x.index[there], dtype=object)
            return out

        return contribute(F.when(wanted, features))


def _arrays(table):
    return reduced(table["value"].to_numpy(), wide(table["lo"]), wide(table["hi"]), wide(table["z"]))


def _leaf_sums(x, table) -> np.ndarray:
    return reduced_contributions(x, _arrays(table))


def tree_shap(df: DataFrame, paths, when: str | None = None, slice_bytes=SLICE_BYTES) -> DataFrame:
    """Append ``shap``: one contribution per feature in model order, null where ``when`` is false.

    ``paths`` is a path table or an ``Explainer`` made of one. It grows with the model, not with the data.
    Contributions add up over leaves. Blocks of rows and groups of trees of a path table meet in tasks, whose sums are
    added up. An ``Explainer`` has sent its leaves in slices: one plan for forests of all sizes, and no shuffle.
    """
    features = F.array(*[F.col(c).cast("double") for c in vocab.FEATURE_ORDER])
    wanted = F.lit(True) if when is None else F.coalesce(F.col(when), F.lit(False))
    if not isinstance(paths, Explainer):
        leaves, trees = paths.agg(F.count(F.lit(1)), F.countDistinct("tree")).first()
        groups = max(1, min(trees, -(-leaves * _PATH_BYTES // min(slice_bytes, _GROUP_BYTES))))
        out = summed_over_trees(df, F.when(wanted, features), paths, groups, _leaf_sums, N, "shap")
        return out.withColumn("shap", F.transform("shap", lambda v: v / F.lit(trees)))
    out = df.withColumn("shap", paths.column(0, features, wanted))
    for number in range(1, len(paths.slices)):
        out = out.withColumn("shap", F.zip_with("shap", paths.column(number, features, wanted), lambda a, b: a + b))
    return out


# --- explanations --------------------------------------------------------------


def top3_contributions(shap) -> Column:
    """The three strongest features as (feature, description, shap_value, impact)."""
    shap = F.col(shap) if isinstance(shap, str) else shap
    names = F.array(*[F.lit(n) for n in vocab.FEATURE_ORDER])
    ranked = F.array_sort(F.transform(shap, lambda v, i: F.struct(
        (-F.abs(v)).alias("rank"), i.alias("place"), v.alias("v"), F.get(names, i).alias("feature"))))
    return F.transform(F.slice(ranked, 1, 3), lambda s: F.struct(
        s["feature"].alias("feature"),
        verdict.describe(s["feature"]).alias("description"),
        s["v"].alias("shap_value"),
        F.when(F.abs(s["v"]) > 0.1, F.lit("high")).otherwise(F.lit("moderate")).alias("impact"),
    )).cast(verdict.REASON_TYPE)


def explain(df: DataFrame, paths=None) -> DataFrame:
    """Append ``top_features`` and ``summary`` for fraudulent rows; null for the others.

    ``paths``: a path table, an ``Explainer``, or None for the stub reasons.
    """
    flagged = df.withColumn("_flagged", F.col("label") == verdict.FRAUD)
    if paths is None:
        reasons = verdict.stub_reasons("free_email_flag", "urgency_term_count", "ttr")
        out = flagged.withColumn("top_features", F.when(F.col("_flagged"), reasons))
    else:
        out = tree_shap(flagged, paths, "_flagged").withColumn("top_features", top3_contributions("shap"))
    return out.withColumn("summary", verdict.summary_text("top_features", "label")).withColumn(
        "summary", F.when(F.col("_flagged"), F.col("summary"))).drop("_flagged", "shap")


SKETCH_K = 800  # size of a quantile sketch: ranks are off by less than half a percent or so, at any number of rows


def shap_state(df: DataFrame) -> DataFrame:
    """What a summary needs of rows with ``shap``: per feature count, sums and a quantile sketch.

    States add up (``merge_states``), so those of batches or of a stream's batches can be stored and
    summed later. A task sends one row per feature.
    """
    names = F.array(*[F.lit(n) for n in vocab.FEATURE_ORDER])
    tall = df.filter(F.col("shap").isNotNull()).select(F.posexplode("shap").alias("_i", "v"))
    return tall.groupBy(F.get(names, F.col("_i")).alias("feature")).agg(
        F.count("v").alias("n"), F.sum("v").alias("total"), F.sum(F.abs("v")).alias("total_abs"),
        F.kll_sketch_agg_double("v", SKETCH_K).alias("sketch"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same features as one."""
    return states.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("total_abs").alias("total_abs"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def state_summary(state: DataFrame, shares=(0.05, 0.5, 0.95)) -> DataFrame:
    """Mean size, mean and quantiles per feature; the strongest feature first."""
    return state.select(
        "feature", "n",
        (F.col("total_abs") / F.col("n")).alias("mean_abs"),
        (F.col("total") / F.col("n")).alias("mean"),
        F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(s)) for s in shares])).alias("quantiles"),
    ).orderBy(F.desc("mean_abs"), "feature")


def shap_summary(df: DataFrame) -> DataFrame:
    """Spread of contributions per feature over rows with ``shap``; no row where none has it."""
    return state_summary(shap_state(df))
