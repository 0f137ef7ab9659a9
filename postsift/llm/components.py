"""Connected components over a table of links, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from postsift.llm.hot import join_hot
from postsift.operators.lineage import cut_lineage


def _both_ways(links):
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links, total, fit):
    """Each node's larger neighbours point to the smallest of the node and its neighbours."""
    near = _both_ways(links)
    least = fit(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n")), total)
    met = join_hot(near.filter("b > a"), least, "a", "n", 2 * total)
    return fit(met.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), total)


def _small_star(links, total, fit):
    """Each node and its smaller neighbours point to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = fit(down.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")), total)
    moved = join_hot(down, least, "a", "n", total).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return fit(moved.unionByName(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct(), total)


def fitted(rows_per_task):
    """A function of a table and its number of rows: the table in no more tasks than its rows need."""
    return lambda table, rows: table if rows_per_task is None else table.coalesce(max(1, -(-rows // rows_per_task)))


def components(links: DataFrame, rows_per_task=None) -> DataFrame:
    """Columns node and root (smallest node of the component) for all nodes of links (a, b).

    Rounds grow with the logarithm of the component size; each is stored in the shared folder,
    so a lost executor costs one round. A hub of a large component is met where its links are, by
    broadcast, and not in one task. Stops when a round leaves the set of links as it was.
    With ``rows_per_task`` a round runs in as many tasks as its links need, so that a few links do
    not leave thousands of small files; ``links`` is then read twice.
    """
    # Order-free signature of a set of links; a round that changes nothing is the last.
    def signature(table):
        return table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()

    fit = fitted(rows_per_task)
    links = links.select("a", "b").filter("a <> b")
    total = links.count() if rows_per_task else 0
    stars = cut_lineage(fit(fit(links, total).distinct(), total))
    before = signature(stars)
    while before[0]:
        large = cut_lineage(_large_star(stars, before[0], fit))
        stars = cut_lineage(_small_star(large, large.count(), fit))
        now = signature(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
