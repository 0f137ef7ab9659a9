"""How five filters of a corpus interact: what each removes, repeats and alone fails, in every order.

A: few words. B: few distinct words. C: many capitals. D: symbols. E: an earlier row has the text.
E is a left-semi join of the table with itself on hash, exact text and smaller key; as only the
existence counts, the other side is the smallest key of each text. The ids that E marks are united
with the ids that fail A to D, and the combinations of failures are counted. At most 32 combinations
per part remain, and all 120 orders are read off them.

Hashes that hold over 1/1000 of the rows number at most 1000; their rows are dealt over as many
places as they hold thousandths, and their side of the join is repeated there.
"""

from itertools import permutations

from pyspark.sql import DataFrame, functions as F

from postsift.operators.lineage import cut_lineage

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
SHARE = 1000
FEW = 1_000_000  # hashes that may be broadcast, 8 bytes each
EARLIER = 1 << LETTERS.index("E")


def _failing():
    """Bits 0 to 3: the row fails A to D; reads _text and _words."""
    n, size = F.size("_words").cast("long"), F.char_length("_text").cast("long")
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct("_words")).cast("long") < LEAST_DISTINCT_PERCENT * n,
             100 * F.regexp_count("_text", F.lit("[A-Z]")).cast("long") > MOST_CAPITALS_PERCENT * size, F.col("_text").rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for k, f in enumerate(fails):
        bits = bits + F.when(f, 1 << k).otherwise(0)
    return bits


def _copied(light, bodies):
    """The rows whose text an earlier key has; equal rows are alike, so a row may come once or often."""
    hashes = light.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    hashes = cut_lineage(hashes)
    several = hashes.filter("low < high").select("_h", "n")  # others can't have an earlier key
    total = hashes.agg(F.sum("n")).first()[0] or 0
    few = several.select("_h").distinct()
    rows = bodies.join(F.broadcast(few), "_h", "left_semi") if few.count() <= FEW else bodies
    hot = hashes.groupBy("_h").agg(F.sum("n").alias("n")).filter(F.col("n") * SHARE > total)
    hot = F.broadcast(hot.select("_h", F.ceil(F.col("n") * SHARE / F.lit(max(total, 1))).cast("int").alias("_places")))
    places = F.coalesce("_places", F.lit(1))
    earliest = rows.filter("doc_id is not null").groupBy("_h", "_text").agg(F.min("doc_id").alias("first"))
    earliest = earliest.join(hot, "_h", "left").select(
        F.col("_h").alias("h"), F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), F.col("_text").alias("body"), "first")
    dealt = rows.join(hot, "_h", "left").withColumn("_place", F.pmod(F.xxhash64("doc_id", "_g"), places).cast("int"))
    found = dealt.join(earliest, (F.col("_h") == F.col("h")) & (F.col("_place") == F.col("place"))
                       & (F.col("_text") == F.col("body")) & (F.col("first") < F.col("doc_id")), "left_semi")
    return found.select("doc_id", "part", "_h", "_g")


def failures(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", part="lang") -> DataFrame:
    """Documents by part and combination: part, mask (bit k: fails the k-th letter), n, good, toxic.

    Null texts are empty, null parts the empty string. Rows with a null key have no earlier key
    and are nobody's earlier row; rows that repeat a key are rows of their own, and equal texts
    with equal keys are not earlier than each other. A key with several labels is good (toxic) if
    one says so; labels without a row don't count. Other columns don't matter.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keyed = own.withColumn("_h", F.xxhash64("_text")).withColumn("_g", F.xxhash64(F.lit(1), "_text"))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    light = cut_lineage(keyed.withColumn("_words", words).select("doc_id", "part", "_h", "_g", _failing().alias("bits")))
    copied = _copied(light, keyed)
    every = light.select("doc_id", "part", "_h", "_g", "bits", F.lit(1).alias("here"))
    marked = copied.select("doc_id", "part", "_h", "_g", F.lit(EARLIER).alias("bits"), F.lit(0).alias("here"))
    rows = every.unionByName(marked).groupBy("doc_id", "part", "_h", "_g").agg(F.bit_or("bits").alias("mask"), F.sum("here").alias("n"))
    counted = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flags = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1)).alias("_good"),
                                                             F.max(F.when(F.col("toxic") == 1, 1)).alias("_toxic"))
    joined = counted.join(flags, F.col("doc_id") == F.col("_id"), "left")
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("if(_good = 1, n, 0)")).alias("good"),
                                              F.sum(F.expr("if(_toxic = 1, n, 0)")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", part="lang") -> DataFrame:
    """One row per part, order of the five filters and step, counts of documents within the part.

    kept: pass this filter and those before; removed: fail this one first; redundant: fail this
    one and one before; unique_fails: fail this one only; good_lost, toxic_lost: removed rows with
    that label; shapley: removed by this filter, summed over all orders. Without rows: no parts.
    """
    combos = failures(docs, labels, key, text, part)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = combos.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bit = f"shiftleft(1, instr('{LETTERS}', substring(filter_order, %s, 1)) - 1)"
    prior = f"aggregate(transform(sequence(1, {len(LETTERS)}), k -> if(k < step, {bit % 'k'}, 0)), 0, (s, x) -> s + x)"
    placed = steps.withColumn("_bit", F.expr(bit % "step")).withColumn("_prior", F.expr(prior))
    fails = F.col("mask").bitwiseAND(F.col("_bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("_prior")) != 0
    removed = fails & ~before
    n_orders = 120  # of five filters; each of k that a row fails comes first in 120 / k of them
    count = lambda condition, value: F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")
    return placed.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        count(~fails & ~before, "n").alias("kept"), count(removed, "n").alias("removed"), count(fails & before, "n").alias("redundant"),
        count(F.col("mask") == F.col("_bit"), "n").alias("unique_fails"), count(removed, "good").alias("good_lost"),
        count(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{n_orders} div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"))
