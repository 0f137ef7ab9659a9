"""Ranks and running totals over a whole table without one task holding it."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from postsift.operators.lineage import cut_lineage


def _orders(order_by):
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def running_totals(df: DataFrame, order_by, totals: dict[str, str], ranges: Column | None = None) -> DataFrame:
    """Append inclusive running totals over a total order: ``{new column: summed column}``.

    Rows are range-partitioned by the order and fixed there; totals run inside each
    range, and the totals of the ranges before it, one row per range, are added.
    The order must have no ties. ``ranges`` numbers each row's range where that follows from the
    row, rising with the order: then ``df`` is computed once, not first to sample boundaries and again.
    """
    if ranges is None:
        ranged = df.repartitionByRange(*_orders(order_by)).withColumn("_range", F.spark_partition_id())
    else:
        ranged = df.withColumn("_range", ranges)
    ranged = cut_lineage(ranged)
    inside = Window.partitionBy("_range").orderBy(*_orders(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(*[F.sum(c).alias(f"_sum_{new}") for new, c in totals.items()])
        .select("_range", *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_before_{new}") for new in totals])
    )
    local = ranged.withColumns({new: F.sum(c).over(inside) for new, c in totals.items()})
    # One row per range: no more rows than shuffle partitions, or than ranges given.
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *[(F.col(new) + F.col(f"_before_{new}")).alias(new) for new in totals])


def global_rank(df: DataFrame, order_by, name: str = "rank", ranges: Column | None = None) -> DataFrame:
    """Append the 0-based position of each row in a total order."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(ones, order_by, {name: "_one"}, ranges)
    return ranked.withColumn(name, F.col(name) - 1).drop("_one")


def seeded_order(id_col, seed) -> Column:
    """Repeatable random order of ids; the id itself settles the rare tie."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string") if isinstance(id_col, str) else id_col))


def seeded_ranges(order) -> Column:
    """4,096 ranges of a seeded order, even since its hashes are; rows without an id come first."""
    return F.coalesce(F.conv(F.substring(order, 1, 3), 16, 10).cast("int"), F.lit(-1))


def seeded_sample(df: DataFrame, id_col: str, n: int = 1000, seed=42) -> DataFrame:
    """Up to ``n`` rows without replacement, the same ones every time."""
    return df.orderBy(seeded_order(id_col, seed), F.col(id_col)).limit(n)
