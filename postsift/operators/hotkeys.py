"""Joins on keys of which a few may hold a large share of all rows."""

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 100_000


def left_join_hot(left: DataFrame, right: DataFrame, key: str, row_count: str, total: int) -> DataFrame:
    """Left join to a table with one row per key (a string) that knows the key's row count.

    Keys with at least 1/HOT_SHARE of all rows number at most HOT_SHARE, so they are broadcast;
    their rows take random places in the shuffle of the rest instead of one task.
    """
    carried = [c for c in right.columns if c not in (key, row_count)]
    limit = max(1, -(-total // HOT_SHARE))
    hot = right.filter(F.col(row_count) >= limit).select(F.col(key), F.struct(*carried).alias("_hot"))
    cold = right.filter(F.col(row_count) < limit).select(F.col(key).alias("_key"), F.struct(*carried).alias("_cold"))
    tagged = left.join(F.broadcast(hot), key, "left")
    spread_key = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(
        F.concat(F.lit("\x00"), F.xxhash64(*left.columns).cast("string")))
    joined = tagged.withColumn("_key", spread_key).join(cold, "_key", "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *[found[c].alias(c) for c in carried])
