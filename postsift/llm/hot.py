"""Joins on keys of which a few may stand on a large share of all rows, and on keys that must be unique."""

from pyspark.sql import DataFrame, functions as F

SHARE = 100_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Join to a table with one row per key that knows in ``rows`` how many left rows the key has.

    Keys on at least 1/SHARE of the ``total`` left rows number at most SHARE: they are broadcast,
    and their rows are joined where they are. The rows of all other keys are shuffled. ``left`` is
    read twice, so it should be stored or cheap.
    """
    is_hot = F.col(rows) * SHARE >= F.lit(total)
    hot = F.broadcast(right.filter(is_hot))
    cold = right.filter(~is_hot)
    rest = left.join(F.broadcast(right.filter(is_hot).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key))


def require_keys(table: DataFrame, key: str) -> None:
    """Raises if a key is null or repeated, where a join on it would lose or multiply rows."""
    odd = table.groupBy(F.col(key).alias("key")).count().filter("key is null or count > 1").first()
    if odd:
        raise ValueError(f"{key} {odd['key']} stands for {odd['count']} rows; keys must be unique and not null")
