"""Exact top-k by integer inner product, scored a block at a time under bounds.

Dimensions are the terms, components the weights. Rows are sorted by the nearest of a bounded
sample's centres and cut into blocks of document ranges; a block knows the least and most weight
of each term. Per query, blocks are taken in the order of their summed term maxima, and scored
through their forward index (the matrix of their rows) until the next bound falls below the
query's k-th score. A first pass over the query's own centre sets that score, so most groups of
blocks are passed over without a row scored. The bound is exact, so the result is, too.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from postsift.operators.lineage import cut_lineage

SCALE, TOP, QUERY_STEP = 1024, 10, 100
BLOCK_ROWS = 256
GROUP_ROWS = 16384  # rows of a group of blocks: one task's share of the index
QUERY_ROWS = 512  # queries that meet a group in one task
SAMPLE_ROWS, CENTRES = 20000, 64  # bounded sample that the centres are fitted on
EXACT = 2.0 ** 52


def whole_vectors(table: DataFrame, key="vec_id", vector="embedding", scale=SCALE) -> DataFrame:
    """vec_id, v (array<double> of whole numbers). Null keys, null vectors and vectors with null or
    non-finite components are left out, and so are empty ones, which have no product."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(sound).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _centres(rows: DataFrame, total: int):
    """Centres by length of vector: sampled rows, moved to the mean of their nearest twice."""
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    near = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS)
    out = {}
    for size, part in _by_size(near.toPandas()):
        x = np.vstack(part)
        c = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)]
        for _ in range(3):
            at = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            c = np.vstack([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
        out[size] = c
    return out


def _by_size(df):
    sizes = df.v.map(len)
    return [(int(s), df.v[sizes == s].tolist()) for s in sizes.unique()]


def _dot(a, b):
    """Exact inner products of whole-number rows."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object))


def _best(scores, ids, own, top):
    """Positions of the best of one query's scores: highest first, smaller ids first."""
    keep = np.flatnonzero(ids != own)
    order = keep[np.lexsort((ids[keep], -scores[keep].astype(float) if scores.dtype != object else [-s for s in scores[keep]]))]
    return order[:top]


def search_group(index: pd.DataFrame, queries: pd.DataFrame, top: int, block_rows: int):
    """The best rows of one group of blocks for each query, as (query_id, vec_id, score)."""
    m, ids = np.vstack(index.v.to_numpy()), index.vec_id.to_numpy()
    q, floors = np.vstack(queries.v.to_numpy()), queries.floor.astype(float).fillna(-np.inf).to_numpy()
    cuts = np.arange(0, len(m), block_rows)
    high, low = np.maximum.reduceat(m, cuts), np.minimum.reduceat(m, cuts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # summed term maxima
    out = []
    for k, own in enumerate(queries.query_id.to_numpy()):
        floor, best_score, best_id = floors[k], np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[k], kind="stable"):
            if bounds[k][b] < floor:
                break
            part = slice(cuts[b], cuts[b] + block_rows)
            s = _dot(m[part], q[k:k + 1])[:, 0]
            s, i = np.concatenate((best_score, s)), np.concatenate((best_id, ids[part]))
            pick = _best(s, i, own, top)
            best_score, best_id = s[pick], i[pick]
            if len(pick) == top:
                floor = max(floor, float(best_score[-1]))
        take = [j for j in range(len(best_id)) if best_score[j] >= floors[k]]
        out += [(int(own), int(best_id[j]), int(best_score[j])) for j in take]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def search(table: DataFrame, key="vec_id", vector="embedding", top=TOP, query_step=QUERY_STEP, block_rows=BLOCK_ROWS, group_rows=GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``top`` candidates of each query, all if fewer.

    Queries are the rows whose id is a multiple of ``query_step``; candidates have another id.
    Ties go to the smaller id. Vectors of different length have no product and don't meet. An id
    that occurs several times is a candidate each time; as a query its smallest vector counts.
    """
    rows = cut_lineage(whole_vectors(table, key, vector))
    total = rows.count()
    centres = _centres(rows, total)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = pd.Series(0, index=v.index, dtype="int32")
        sizes = v.map(len)
        for s in sizes.unique():
            if int(s) in centres:
                x, c = np.vstack(v[sizes == s].to_numpy()), centres[int(s)]
                out[sizes == s] = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1).astype("int32")
        return out

    placed = cut_lineage(rows.withColumn("centre", nearest("v")).withColumn("size", F.size("v")))
    # Groups of blocks: a centre's rows, split by id where there are more than a group holds.
    counts = placed.groupBy("size", "centre").agg(F.count(F.lit(1)).alias("n"))
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(group_rows))).cast("int")
    index = placed.join(F.broadcast(counts), ["size", "centre"]).select(
        "size", "centre", F.pmod(F.xxhash64("vec_id"), split).cast("int").alias("part"), "vec_id", "v")
    asked = placed.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id", "size").agg(F.min(F.struct("v", "centre")).alias("q"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("q.v", "size", "q.centre")).alias("q"))
    chunks = max(1, -(-total // query_step // QUERY_ROWS))
    asked = asked.select(F.col("vec_id").alias("query_id"), "q.v", "q.size", F.col("q.centre").alias("centre"),
                         F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"))
    place = ["size", "centre", "part", "chunk"]
    spots = F.broadcast(counts.select("size", "centre", split.alias("parts")))  # a row per centre

    def met(queries, parts):
        """Queries at groups, compared group by group, queries in bounded chunks."""
        held = index.filter(F.col("part") == 0) if parts is None else index
        held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def run(left, right):
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            return search_group(left.sort_values("vec_id"), right, top, block_rows)

        sent = queries.withColumn("part", F.lit(0)) if parts is None else queries.drop("centre").join(spots, "size").withColumn("part", F.explode(parts)).drop("parts")
        sent = sent.select("query_id", "v", "floor", *[F.col(c).alias(f"q_{c}") for c in place])
        return held.groupBy(*place).cogroup(sent.groupBy(*[f"q_{c}" for c in place])).applyInPandas(run, "query_id long, vec_id long, score long")

    first = met(asked.withColumn("floor", F.lit(None).cast("double")), None)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") == top)
    seeded = cut_lineage(asked.join(floors.select("query_id", F.col("s").cast("double").alias("floor")), "query_id", "left"))
    found = met(seeded, F.sequence(F.lit(0), F.col("parts") - 1)).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return found.select("query_id", "rank", "vec_id", "score")
