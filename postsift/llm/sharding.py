"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

The weights are bytes. Every node is cut along its widest dimension (spread of values within the
node, against the whole table's spread) at the key where half of its bytes lie below; keys are
found by histograms of 2^12 bins that are refined digit by digit, for all nodes of a level at once.
Equal texts are one point of the tree: their metadata is that of one of them, and they stay
together unless the group is so heavy that keeping it whole would unbalance a cut; then the cut
goes through the group, by document. Only histograms and cuts reach the driver.
"""

from pyspark.sql import DataFrame, Window, functions as F

from postsift.llm.hot import require_keys
from postsift.operators.lineage import cut_lineage

SHARDS = 8
DIGIT = 12  # bits of a histogram
UNEVEN = 0.002  # of a node's bytes: a cut that a group of equal texts moves further goes through it
SLOT_ROWS = 20_000


def _points(docs, key, text):
    """Compact rows: doc_id, size, text_crc32, and the point: three dimensions (length, share of blanks, checksum) and two tie keys."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       F.xxhash64(body).alias("_h"), (F.length(body) - F.length(F.translate(body, " ", ""))).cast("double").alias("_blanks"))
    return rows.select(
        "doc_id", "size", "text_crc32",
        F.log2(F.col("size").cast("double")).alias("d0"),
        (F.col("_blanks") / F.col("size")).alias("d1"),
        (F.col("text_crc32") / F.lit(float(1 << 32))).alias("d2"),
        F.col("_h").alias("group_key"), F.xxhash64("_h", "doc_id").alias("row_key"))


DIMENSIONS = ["d0", "d1", "d2"]
KEY_BITS = 60  # of a point along a dimension: 30 of the value, 30 of the group


def _split_key(value, low, high):
    """A long along one dimension: place of the value between low and high, then of the group."""
    width = F.when(high > low, high - low).otherwise(1.0)
    place = F.least(F.lit((1 << 30) - 1), F.floor((value - low) / width * ((1 << 30) - 1)).cast("long"))
    return F.shiftleft(place, 30).bitwiseOR(F.shiftrightunsigned(F.col("group_key"), 34))


def _half(rows, key, bits):
    """Per node: the key up to which at most half of the bytes lie, the bytes below it and at it.

    One pass per digit of the key; a histogram has 2^DIGIT bins per node.
    """
    found = {}
    for shift in range(bits - DIGIT, -1, -DIGIT):
        known = _lookup({n: f["key"] for n, f in found.items()}, -1) if found else F.lit(0)
        inside = rows if not found else rows.filter(F.shiftright(key, shift + DIGIT) == known)
        bins = inside.groupBy("node", F.shiftright(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        by = {}
        for r in bins.collect():  # nodes x 2^DIGIT at most
            by.setdefault(r.node, []).append((r.bin, r.bytes, r.rows))
        for node, cells in by.items():
            f = found.setdefault(node, {"key": 0, "below": 0, "all": sum(c[1] for c in cells)})
            for b, size, count in sorted(cells):
                if f["below"] + size > f["all"] / 2 or b == max(cells)[0]:
                    f |= {"key": f["key"] << DIGIT | b, "at": size, "rows": count}
                    break
                f["below"] += size
    return found


def _lookup(values, other):
    out = F.lit(other)
    for node, v in values.items():
        out = F.when(F.col("node") == node, F.lit(v)).otherwise(out)
    return out


def _cut(rows):
    """The node column after one more level: children 2n and 2n + 1."""
    wide = rows.groupBy("node").agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).collect()
    whole = {d: max(max(r[f"high_{d}"] for r in wide) - min(r[f"low_{d}"] for r in wide), 1e-12) for d in DIMENSIONS}
    widest = {r.node: max(DIMENSIONS, key=lambda d, r=r: (r[f"high_{d}"] - r[f"low_{d}"]) / whole[d]) for r in wide}
    ranges = {r.node: (r[f"low_{widest[r.node]}"], r[f"high_{widest[r.node]}"]) for r in wide}
    value = F.lit(0.0)
    for node, d in widest.items():
        value = F.when(F.col("node") == node, F.col(d)).otherwise(value)
    key = _split_key(value, _lookup({n: float(a) for n, (a, _) in ranges.items()}, 0.0), _lookup({n: float(b) for n, (_, b) in ranges.items()}, 1.0))
    keyed = rows.withColumn("_key", key)
    found = _half(keyed, F.col("_key"), KEY_BITS)
    heavy = {}
    for node, f in found.items():
        left_out, taken = f["all"] / 2 - f["below"], f["below"] + f["at"] - f["all"] / 2
        f["whole"] = taken < left_out  # the group at the cut goes to the nearer side
        if min(left_out, taken) > UNEVEN * f["all"] and f["rows"] > 1:
            heavy[node] = f
    low = {n: f["key"] + (1 if f["whole"] else 0) for n, f in found.items()}
    right = F.col("_key") >= _lookup(low, 0)
    if heavy:
        at = F.col("_key") == _lookup({n: f["key"] for n, f in heavy.items()}, -1)
        row_key = F.shiftrightunsigned("row_key", 64 - KEY_BITS)
        own = _half_within(keyed.filter(at), row_key, heavy)
        right = F.when(at, row_key >= _lookup(own, 0)).otherwise(right)
    return keyed.withColumn("node", F.col("node") * 2 + right.cast("int")).drop("_key")


def _half_within(rows, key, heavy):
    """Row keys below which the missing bytes of each heavy group lie."""
    found = {n: {"key": 0, "want": f["all"] / 2 - f["below"]} for n, f in heavy.items()}
    for shift in range(KEY_BITS - DIGIT, -1, -DIGIT):
        inside = rows.filter(F.shiftrightunsigned(key, shift + DIGIT) == _lookup({n: f["key"] for n, f in found.items()}, -1))
        bins = inside.groupBy("node", F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("bin")).agg(F.sum("size").alias("bytes"))
        by = {}
        for r in bins.collect():
            by.setdefault(r.node, []).append((r.bin, r.bytes))
        for node, f in found.items():
            cells = sorted(by.get(node, [(0, 0)]))
            for b, size in cells:
                if size > f["want"] or b == cells[-1][0]:
                    f["key"] = f["key"] << DIGIT | b
                    break
                f["want"] -= size
    return {n: f["key"] for n, f in found.items()}


def shard(docs: DataFrame, key="doc_id", text="text", levels=3) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    ``size`` is the UTF-8 bytes of the text plus 1 (null texts: 1). Shards are the 2^levels leaves;
    their bytes differ by about the largest document or UNEVEN per level, whichever is more. Slots
    of a shard run from 0 without gaps. Null and repeated keys are rows like any other; repeated
    rows of one text stay together, and an empty table gives an empty result.
    """
    rows = cut_lineage(_points(docs, key, text).withColumn("node", F.lit(0)))
    total = rows.count()
    if total:
        for _ in range(levels):
            rows = cut_lineage(_cut(rows))
    # Slots: rows are numbered within parts of a shard, parts by the rows before them.
    parts = max(1, -(-total // SLOT_ROWS))
    placed = cut_lineage(rows.withColumn("_part", F.pmod("row_key", F.lit(parts)).cast("int")))
    sizes = placed.groupBy("node", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("node").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    slot = F.row_number().over(Window.partitionBy("node", "_part").orderBy("row_key", "doc_id")) - 1
    numbered = placed.withColumn("_slot", slot).join(before.drop("n"), ["node", "_part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"),
        (F.col("_slot") + F.coalesce("_before", F.lit(0))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, key="doc_id", text="text") -> None:
    """The rows of ``docs`` in one folder per shard; keys must be unique and not null, or it raises."""
    require_keys(docs, key)
    placed = shard(docs, key, text).select(F.col("doc_id").alias(key), "shard", "slot")
    docs.join(placed, key).write.partitionBy("shard").parquet(folder)
