"""Sums over all trees of a forest, row by row, without a task that holds the forest or the rows.

Rows are dealt to blocks and trees to groups; each pair of both is a task's work. What it finds for its rows
is summed over the groups. Rows with equal features are worked out once.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postsift.operators.lineage import cut_lineage

ROWS_PER_BLOCK = 1 << 15
_TASKS_PER_PAIR = 3  # keys are hashed to tasks: with more tasks than keys, fewer share one
_MOST_TASKS = 3000


def summed_over_trees(df: DataFrame, vector: Column, trees: DataFrame, groups: int, compute: Callable, width: int, name: str) -> DataFrame:
    """Append ``name``: ``width`` sums over ``trees`` for the features in ``vector``, null where that is null.

    ``trees`` has a column tree and whatever ``compute(x, table)`` reads of the trees of a group; that returns an
    array of (rows, width) for an array of rows. The sums are added in the order of the groups.
    """
    asked = df.withColumn("_x", vector)
    distinct = asked.select("_x").filter(F.col("_x").isNotNull()).distinct()
    vectors = cut_lineage(distinct.withColumn("_n", F.monotonically_increasing_id()))
    blocks = -(-vectors.count() // ROWS_PER_BLOCK) or 1
    keys, tasks = ["_block", "_group"], min(_MOST_TASKS, _TASKS_PER_PAIR * blocks * groups)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)).cast("int")).withColumn("_group", each(groups))
    parts = trees.withColumn("_group", F.pmod("tree", F.lit(groups)).cast("int")).withColumn("_block", each(blocks))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"_n": pa.array([], pa.int64()), "_group": pa.array([], pa.int32()), "v": pa.array([], pa.list_(pa.float64()))})
        found = compute(wide(left["_x"]), right)
        ends = pa.array(np.arange(0, found.size + 1, width, dtype=np.int32))
        return pa.table({"_n": left["_n"], "_group": left["_group"], "v": pa.ListArray.from_arrays(ends, pa.array(found.ravel()))})

    pairs = rows.repartition(tasks, *keys).groupBy(*keys).cogroup(parts.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
        work, "_n long, _group int, v array<double>")
    in_order = F.array_sort(F.collect_list(F.struct("_group", "v")))
    zeros = F.array(*[F.lit(0.0)] * width)
    sums = pairs.groupBy("_n").agg(in_order.alias("_all")).select(
        "_n", F.aggregate("_all", zeros, lambda a, s: F.zip_with(a, s["v"], lambda p, q: p + q)).alias(name))
    found = cut_lineage(vectors.join(sums, "_n").select("_x", name))
    return asked.join(found, "_x", "left").drop("_x")


def wide(column) -> np.ndarray:
    """A column of arrays of equal length as (rows, length)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
