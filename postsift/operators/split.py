"""Splits and folds that keep each employer's postings together."""

from pyspark.sql import Column, DataFrame, functions as F

from postsift import vocab
from postsift.operators.hotkeys import left_join_hot
from postsift.operators.lineage import cut_lineage
from postsift.operators.ranking import running_totals, seeded_order

HEAVY_SHARE = 1000


def fold_count(test_size: float) -> int:
    """How many folds give a test share near ``test_size``; halves round to even."""
    return round(1 / test_size)


def place_heavy(groups, k: int, n_all: int, pos_all: int):
    """Folds of (n_rows, n_pos) groups, placed one by one, and the folds' loads [rows, frauds].

    A group goes where the sum of the folds' squared shares of rows and of frauds grows least. Of
    equal folds the last is taken: the heaviest groups stay out of the first one, the test split.
    """
    loads = [[0, 0] for _ in range(k)]
    rows_weight, pos_weight = max(pos_all, 1) ** 2, n_all ** 2  # whole numbers, so every engine agrees
    folds = []
    for n, pos in groups:
        fold = min(range(k), key=lambda f: (loads[f][0] * n * rows_weight + loads[f][1] * pos * pos_weight, -f))
        loads[fold][0] += n
        loads[fold][1] += pos
        folds.append(fold)
    return folds, loads


def room_bounds(loads, total: int):
    """(m, upper bounds): ``total`` poured into folds of these loads until the filled ones are level.

    Bounds are running totals times ``m``, the number of folds that get some, so they are whole.
    """
    levels = [(sum(x <= top for x in loads), sum(x for x in loads if x <= top)) for top in loads]
    m, below = max(level for level, top in zip(levels, loads) if total + level[1] >= level[0] * top)
    rooms = [max(0, total + below - m * x) for x in loads]
    return m, [sum(rooms[:f + 1]) for f in range(len(rooms))]


def _poured(before: str, loads, total: int) -> Column:
    """The fold into whose room a running total falls."""
    m, bounds = room_bounds(loads, total)
    fold = F.lit(len(bounds) - 1)
    for f in reversed(range(len(bounds) - 1)):
        fold = F.when(F.col(before) * m < bounds[f], f).otherwise(fold)
    return fold


def group_folds(df: DataFrame, k: int, seed=vocab.SEED, group="group", label="fraudulent") -> DataFrame:
    """One row per group with its size, frauds and fold; folds get even numbers of rows and of frauds.

    Groups with at least 1/HEAVY_SHARE of all rows or frauds number at most 2 * HEAVY_SHARE. They
    are placed one by one, the largest first (``place_heavy``). All others fill the remaining room
    in random order by seed: first groups with frauds, by frauds, then the rest, by rows. Each is
    lighter than 1/HEAVY_SHARE, so folds come out that even unless one heavy group is larger than a
    fold. A null label is no fraud. Rows without a group (null) are one group.
    """
    fraud = (F.col(label).cast("string") == "1").cast("bigint")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(fraud), F.lit(0)).alias("n_pos"))
    groups = cut_lineage(sizes.withColumn("_h", seeded_order(F.coalesce(F.col(group).cast("string"), F.lit("\x00")), seed)))
    n_all, pos_all = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("n_pos"), F.lit(0))).first()
    is_heavy = (F.col("n_rows") * HEAVY_SHARE >= n_all) | ((F.col("n_pos") > 0) & (F.col("n_pos") * HEAVY_SHARE >= pos_all))
    heavy = sorted(groups.filter(is_heavy).select("n_rows", "n_pos", "_h").collect(), key=lambda r: (-r[0], -r[1], r[2]))
    folds, loads = place_heavy([r[:2] for r in heavy], k, n_all, pos_all)
    places = df.sparkSession.createDataFrame([(r[2], fold) for r, fold in zip(heavy, folds)], "_h string, fold int")
    placed = groups.filter(is_heavy).join(F.broadcast(places), "_h").select(group, "n_rows", "n_pos", "fold")
    rest_pos = pos_all - sum(load[1] for load in loads)
    rest_all = n_all - sum(load[0] for load in loads)
    if not rest_all:
        return placed
    light = groups.filter(~is_heavy).withColumn("_clean", (F.col("n_pos") == 0).cast("int"))
    # frauds before, and rows before among the groups of the same kind
    run = running_totals(light.withColumn("_clean_rows", F.col("_clean") * F.col("n_rows")), ["_clean", "_h"],
                         {"_pos": "n_pos", "_rows": "_clean_rows"})
    run = run.withColumns({"_pos": F.col("_pos") - F.col("n_pos"), "_rows": F.col("_rows") - F.col("_clean_rows")})
    by_pos = _poured("_pos", [load[1] for load in loads], rest_pos).cast("int")
    with_pos = run.filter("_clean = 0").withColumn("fold", by_pos)
    rows = [load[0] for load in loads]
    for r in with_pos.groupBy("fold").agg(F.sum("n_rows").alias("n")).collect():  # a row per fold
        rows[r["fold"]] += r["n"]
    clean = run.filter("_clean = 1").withColumn("fold", _poured("_rows", rows, n_all - sum(rows)).cast("int"))
    return placed.unionByName(with_pos.unionByName(clean).select(group, "n_rows", "n_pos", "fold"))


def with_folds(df: DataFrame, k: int, seed=vocab.SEED, group="group", label="fraudulent") -> DataFrame:
    """Append a ``fold`` column; no group is in two folds, rows without a group have none."""
    folds = group_folds(df, k, seed, group, label).drop("n_pos")
    total = folds.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return left_join_hot(df, folds, group, "n_rows", total)


def group_stratified_split(df: DataFrame, test_size=0.2, seed=vocab.SEED, group="group", label="fraudulent") -> DataFrame:
    """Append ``split``: the first of k folds is test, the rest train."""
    folded = with_folds(df, fold_count(test_size), seed, group, label)
    return folded.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")


def split_leaks(df: DataFrame, group="group", split="split") -> DataFrame:
    """Groups that are in both splits; there must be none."""
    test = (F.col(split) == "test").cast("int")
    sides = df.groupBy(group).agg(F.min(test).alias("_a"), F.max(test).alias("_b"))
    return sides.filter("_a <> _b").select(group)


def assert_no_leak(df: DataFrame, group="group", split="split") -> DataFrame:
    leaks = split_leaks(df, group, split).count()
    if leaks:
        raise AssertionError(f"{leaks} groups are in both splits")
    return df
