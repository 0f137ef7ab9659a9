"""Near copies by SimHash fingerprints, compared at the anchors of a covering code.

The 64 bits are two halves. Fingerprints with at most 3 different bits differ in at most one bit
of one half. The code of a half is the perfect Hamming code of 31 bits beside one free bit: every
half lies within 1 bit of an anchor. Each fingerprint stands at its nearest anchor and visits all
anchors within 1 + 1 bits (17 at most), so two halves within 1 bit meet. A pair that meets is
compared over all 64 bits. Nothing is missed, and no pair within 3 bits is guessed.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from postsift.llm.components import components
from postsift.llm.hot import join_hot
from postsift.operators.lineage import cut_lineage

SEED, MOST_BITS, SHINGLE = 42, 3, 3
HALF_BITS, CODE_BITS = 32, 31
BLOCK = 1024  # fingerprints of one side of a block of a crowded anchor


def fingerprint(text: str | None, width=SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    take = min(width, len(words))
    spans = zip(starts[:len(words) - take + 1].tolist(), ends[take - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - take + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k:k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Columns doc_id and fp (the 64 bits as long) of every row; null and empty texts have 0."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            bits = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _syndrome(half):
    """Xor of the numbers 1 to 31 of the set bits: 0 for words of the code."""
    s = np.zeros(len(half), np.uint32)
    for k in range(1, CODE_BITS + 1):
        s ^= np.where(half >> np.uint32(k - 1) & np.uint32(1), np.uint32(k), np.uint32(0))
    return s


def anchors(half: np.ndarray):
    """Arrays (row, anchor, home) of the anchors within 2 bits of 32-bit words; home: the nearest.

    Bit 31 is free. Of the lower bits, a word of the code has no other within 2; any other word
    has its own (flip the bit that the syndrome names) and those that flipping two bits reaches.
    """
    half = half.astype(np.uint32)
    one, syndrome, rows = np.uint32(1), _syndrome(half), np.arange(len(half))
    bit = np.where(syndrome > 0, one << (syndrome - one), np.uint32(0)).astype(np.uint32)
    near = half ^ bit
    out = [(rows, near, np.ones(len(half), bool)), (rows, near ^ (one << np.uint32(CODE_BITS)), np.zeros(len(half), bool))]
    off = syndrome > 0
    for i in range(1, CODE_BITS + 1):
        j = syndrome ^ np.uint32(i)
        pick = off & (j > i)  # flips of bits i and j, whose numbers xor to the syndrome
        flipped = half[pick] ^ (one << np.uint32(i - 1)) ^ (one << (j[pick] - one))
        out.append((rows[pick], flipped, np.zeros(pick.sum(), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _visits(prints: DataFrame) -> DataFrame:
    """Every fingerprint at its anchors: cell (half and anchor), fp, home."""
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fp.view(np.uint64)
            for side in (0, 1):
                row, anchor, home = anchors((bits >> np.uint64(HALF_BITS * side)).astype(np.uint32))
                cell = anchor.astype(np.int64) | np.int64(side) << np.int64(HALF_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[row]), pa.array(home)], names=["cell", "fp", "home"])

    return prints.select("fp").mapInArrow(run, "cell long, fp long, home boolean")


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Links within a block that hold together what its pairs within MOST_BITS hold together."""
    left = np.unique(group.loc[group.side == 0, "fp"].to_numpy()).view(np.uint64)
    right = np.unique(group.loc[group.side == 1, "fp"].to_numpy()).view(np.uint64)
    nodes = np.unique(np.concatenate((left, right)))
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, at = [], np.searchsorted(nodes, right)
    for x in left:
        mine = find(int(np.searchsorted(nodes, x)))
        for y in at[np.bitwise_count(right ^ x) <= MOST_BITS]:
            other = find(int(y))
            if other != mine:
                links.append((int(nodes[mine].view(np.int64)), int(nodes[other].view(np.int64))))
                parent[other] = mine
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints within MOST_BITS.

    Anchors met by few give each pair once. Crowded anchors are cut into blocks of at most about
    BLOCK fingerprints; every two blocks are compared in a task of their own and give a spanning
    forest of their pairs, so that a crowd never makes all its pairs, and loses no connection.
    """
    at = _visits(prints).repartition("cell")
    size = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("met")).filter("met and n > 1").drop("met")
    kept = cut_lineage(at.join(size, "cell"))
    few = kept.filter(F.col("n") <= BLOCK)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MOST_BITS
    pairs = few.filter("home").alias("x").join(few.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & near)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = kept.filter(F.col("n") > BLOCK)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    part = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    here = crowd.filter("home").select("cell", part.alias("i"), F.explode(every).alias("j"), "fp", F.lit(0).alias("side"))
    there = crowd.select("cell", F.explode(every).alias("i"), part.alias("j"), "fp", F.lit(1).alias("side"))
    trees = here.unionByName(there).groupBy("cell", "i", "j").applyInPandas(_forest, "a long, b long")
    return pairs.unionByName(trees)


def near_groups(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row per input row: doc_id, fp (long) and component_id.

    ``component_id`` is the smallest key that links reach from the row, its own included; null
    keys are never the smallest, and a component of null keys alone has null. Equal texts share a
    fingerprint and are merged before any comparison, so a large group of copies costs one row.
    """
    prints = cut_lineage(fingerprints(docs, key, text))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")))
    rooted = cut_lineage(components(links(distinct)).withColumnRenamed("node", "fp"))
    tops = distinct.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = join_hot(rooted, tops, "root", "n", rooted.count()).select("fp", "component_id")
    final = distinct.join(linked, "fp", "left").select("fp", "times", F.coalesce("component_id", "least").alias("component_id"))
    return join_hot(prints, cut_lineage(final), "fp", "times", prints.count()).select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """Sixteen lower-case hex digits of a long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row of each group stays: that of the smallest key, null keys last.

    Rows are told apart by their key and a 128-bit hash of all columns, so different texts that
    share a key, or have none, are rows of their own; of rows equal in all columns one stays.
    """
    every = docs.select("*", F.xxhash64(*docs.columns).alias("_h"), F.xxhash64(F.lit(1), *docs.columns).alias("_g"))
    row = F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("key"), F.col("_h"), F.col("_g"))
    numbered = cut_lineage(near_groups(every.select(row.alias("_row"), F.col(text).alias("_body")), "_row", "_body"))
    kept = numbered.filter("doc_id = component_id").groupBy("doc_id._h", "doc_id._g").agg(F.count(F.lit(1)).alias("_times"))
    rows = every.join(kept, ["_h", "_g"])
    single = rows.filter("_times = 1").select(*docs.columns)
    return single.unionByName(rows.filter("_times > 1").dropDuplicates(["_h", "_g"]).select(*docs.columns))
