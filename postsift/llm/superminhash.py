"""Near copies by word shingles: SuperMinHash signatures, bands, verified links, grouped by union-find.

Each shingle of a text ranks the SLOTS places of a signature by a random permutation of its own:
the place it ranks j-th gets j plus a random fraction, and a place keeps its least value. Ranks of
one shingle exclude each other, so equal places vary less than with independent hashes. The ranks
are given out in rounds; once every place holds less than the next rank, no later rank can win and
the text is done, after two or three rounds for most texts.

Texts whose bands of ROWS places agree somewhere meet. Two sets at the least similarity of 0.85
miss each other with a chance of (1 - 0.85^6)^32, 3 in 10 million. A crowd in a band is not paired:
1. Each text is checked on full shingle sets against one hub. The hub of a crowd is its text with
   the largest crowds in all bands, which is the one nearest to the middle of the group.
2. Then against the hub of each crowd that is still in another group.
3. Where a crowd still falls into several groups, texts outside the crowd's largest group are
   compared by signatures with all of it, block by block, each pair in the first band it shares.
   Pairs of different groups whose signatures agree in FLOOR of the places (0.85 less five
   deviations) are checked on full sets, block by block again: a block's task gets each text once,
   so what is shuffled follows the texts of the blocks and not the pairs.
Pairs within one group need no check: it is connected already.

Equal word sequences are one text throughout, so a large group of copies costs one row.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from postsift.llm.components import components, fitted
from postsift.llm.hot import join_hot
from postsift.operators.hotkeys import left_join_hot
from postsift.operators.lineage import cut_lineage

SHINGLE, LEAST_PERCENT = 3, 85
SLOTS, ROWS = 192, 6
FLOOR = 0.72
SEED = 42
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # texts of one side of a block of a crowd, and their shingles
CHUNK = 128  # texts that are checked against one copy of the other text
ROWS_PER_TASK = 50_000  # links or entries of crowds, under 100 bytes each
FEW = 200_000  # names of texts that may be broadcast, about 100 bytes each
SLICE_CHARS, PART = 1 << 21, 1 << 15  # characters read together; shingles ranked together
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x):
    """The finalizer of a public 64-bit generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(shingles: np.ndarray, slots=SLOTS) -> np.ndarray:
    """SuperMinHash of distinct 64-bit shingle hashes: rank in the upper 8 bits, fraction below."""
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), PART):
        state = shingles[start:start + PART].copy()
        rows = np.arange(len(state))
        place = np.tile(np.arange(slots, dtype=np.uint8), (len(state), 1))
        for rank in range(slots):
            if int(least.max() >> np.uint64(56)) < rank:
                break  # every place has a lower rank
            state += GOLDEN
            fraction = _mixed(state)
            other = rank + (_mixed(state ^ GOLDEN) >> np.uint64(32)).astype(np.int64) % (slots - rank)
            won = place[rows, other]
            place[rows, other] = place[:, rank]
            np.minimum.at(least, won, np.uint64(rank << 56) | fraction >> np.uint64(8))
    return least


def shingle_keys(numbers: np.ndarray, width=SHINGLE) -> np.ndarray:
    """One row of word numbers per distinct shingle; fewer words than ``width`` are one shingle."""
    if not len(numbers):
        return np.zeros((0, width), np.int64)
    if len(numbers) < width:
        return numbers[None, :]
    keys, base = numbers[:len(numbers) - width + 1].astype(np.uint64), np.uint64(int(numbers.max()) + 1)
    if int(base) ** width >= 1 << 64:
        return np.unique(np.lib.stride_tricks.sliding_window_view(numbers, width), axis=0)
    for k in range(1, width):
        keys = keys * base + numbers[k:len(numbers) - width + 1 + k].astype(np.uint64)
    _, first = np.unique(keys, return_index=True)
    return numbers[first[:, None] + np.arange(width)]


def _bands(least):
    """A hash for each ROWS places of a signature."""
    grid, out = least.reshape(-1, ROWS), np.arange(len(least) // ROWS, dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        out = _mixed(out + GOLDEN ^ grid[:, k])
    return out.view(np.int64)


def words_of(text: bytes):
    return text.lower().split()


def digest(words) -> bytes:
    """128 bits that stand for a sequence of words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _slices(texts, size):
    offsets = np.cumsum([0] + [len(t) for t in texts])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, end
        start = end


def _signed(docs, width):
    """Every row: doc_id, copy (hex digest of its words), n_shingles, bands and marks (a byte a place)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for start, end in _slices(texts, SLICE_CHARS):
                numbers: dict[bytes, int] = {}
                cut = [words_of(t) for t in texts[start:end]]
                ids = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in cut]
                hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in numbers] or [0], np.uint64)
                counts, bands, marks = [], [], []
                for own in ids:
                    keys = shingle_keys(own, width)
                    mixed = np.full(len(keys), SEED, np.uint64)
                    for k in range(keys.shape[1]):
                        mixed = _mixed((mixed + GOLDEN) ^ hashes[keys[:, k]])
                    least = signature(mixed)
                    counts.append(len(keys))
                    bands.append(_bands(least) if len(keys) else np.zeros(0, np.int64))
                    marks.append(least.astype(np.uint8).tobytes() if len(keys) else b"")
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(start, end - start), pa.array([digest(w).hex() for w in cut]),
                    pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["doc_id", "copy", "n_shingles", "bands", "marks"])

    return docs.mapInArrow(run, f"doc_id {kind}, copy string, n_shingles long, bands array<long>, marks binary")


def _texts_of(docs, wanted):
    """node and body (text) of the texts named in wanted (copy, node); a task names a copy once."""
    def run(batches):
        seen = set()
        for b in batches:
            names = [digest(words_of(t or b"")) for t in b.column(0).cast(pa.binary()).to_pylist()]
            new = []
            for k, n in enumerate(names):
                if n not in seen:
                    seen.add(n)
                    new.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([names[k].hex() for k in new], pa.string()), b.column(0).take(pa.array(new, pa.int64()))],
                                             names=["copy", "body"])

    named = docs.select("_text").mapInArrow(run, "copy string, body string")
    side = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    return named.join(side, "copy").dropDuplicates(["node"]).select("node", "body")


def _shingle_set(text, width):
    words = words_of((text or "").encode())
    return set(zip(*[words[k:] for k in range(width)])) if len(words) >= width else {tuple(words)} if words else set()


def confirmed(pairs: DataFrame, bodies: DataFrame, width=SHINGLE, percent=LEAST_PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough.

    The pairs of a are cut into chunks; a's text goes to each chunk once, first in order, and the
    others stream past its set, so a node with any number of pairs is spread over tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    many = sizes.filter("chunks > 1")
    spread = pairs.join(F.broadcast(many) if many.count() <= FEW else many, "a", "left")
    chunk = F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int")
    others = spread.select("a", chunk.alias("chunk"), F.lit(1).alias("side"), F.col("b").alias("node"))
    hubs = others.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("side"), F.col("a").alias("node"))
    rows = hubs.unionByName(others).join(bodies, "node").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side")

    def run(batches):
        at, own = None, set()
        for batch in batches:
            links = []
            for a, c, side, node, body in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if side == 0:
                    at, own = (a, c), _shingle_set(body, width)
                elif at == (a, c):
                    other = _shingle_set(body, width)
                    both = len(own & other)
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        links.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                                             names=["a", "b"])

    return rows.select("a", "chunk", "side", "node", "body").mapInArrow(run, "a long, b long")


def _joined(links):
    """Union-find within each task: links that its earlier ones imply are left out."""
    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in kept], pa.int64()), pa.array([b for _, b in kept], pa.int64())],
                                             names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _close_pairs(floor):
    """Texts of a block that are in pairs to check, each once, with its partners (``others``).

    A pair is named if its groups differ, its signatures agree in enough places, this is the first
    band that it shares, and neither is the crowd's hub, against which all were checked before.
    """
    columns = ["band", "i", "j", "node", "others"]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        def side(rows):
            marks = np.frombuffer(b"".join(rows.marks), np.uint8).reshape(len(rows), -1)
            return rows.node.to_numpy(), rows.root.to_numpy(), marks, np.stack(list(rows.bands))

        group = group[group.node != group.hub]
        if group.side.nunique() < 2:
            return pd.DataFrame([], columns=columns)
        main, here = group.main.iloc[0], group.k.iloc[0]
        node, root, marks, bands = side(group[group.side == 0])
        nodes, roots, all_marks, all_bands = side(group[group.side == 1])
        partners: dict[int, list[int]] = {}
        for k in range(len(node)):
            agree = (all_marks == marks[k]).sum(axis=1)
            # of two texts outside the largest group, each meets the other: the smaller one names the pair
            hit = np.flatnonzero((agree >= floor * all_marks.shape[1]) & (roots != root[k]) & ((roots == main) | (nodes > node[k])))
            hit = hit[(all_bands[hit] == bands[k]).argmax(axis=1) == here] if len(hit) else hit
            if len(hit):
                partners.setdefault(int(node[k]), []).extend(nodes[hit].tolist())
        for x in {x for found in partners.values() for x in found} - set(partners):
            partners[x] = []
        return pd.DataFrame([(*key, x, found) for x, found in partners.items()], columns=columns)

    return run


def _confirmed_in_block(width, percent):
    """The pairs of a block whose full shingle sets are similar enough; shingles get exact numbers."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        cut = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t.encode())], np.int64) for t in group.body]
        lengths = np.array([len(c) for c in cut])
        words, owner = np.concatenate(cut), np.repeat(np.arange(len(cut)), lengths)
        at = np.flatnonzero(np.cumsum(lengths)[owner] - np.arange(len(words)) >= width)
        # a sequence of fewer words than that is equal to no other text's
        ids = words[at]
        for k in range(1, width):
            ids = np.unique(ids * len(numbers) + words[at + k], return_inverse=True)[1]
        top = int(ids.max()) + 1 if len(ids) else 1
        entries = np.unique(owner[at] * top + ids)  # each text's shingles once, text by text
        sizes = np.bincount(entries // top, minlength=len(cut))
        sets = np.split(entries % top, np.cumsum(sizes)[:-1])
        place, own = {n: k for k, n in enumerate(group.node)}, np.zeros(top, bool)
        links = []
        for a, others in zip(group.node, group.others):
            if not len(others):
                continue
            mine = sets[place[a]]
            own[mine] = True
            for b in others:
                both = int(own[sets[place[b]]].sum())
                if both and 100 * both >= percent * (len(mine) + len(sets[place[b]]) - both):
                    links.append((a, b))
            own[mine] = False
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _placed(entries, rooted):
    """The entries with the smallest node of each one's group so far."""
    found = rooted.withColumnRenamed("node", "_node")
    return entries.join(found, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))


def _apart(placed):
    """Pairs of a crowd's hub with each other text that is still in another group."""
    heads = cut_lineage(placed.filter("node = hub").select("band", "n", F.col("root").alias("hub_root")))
    met = join_hot(placed.drop("n"), heads, "band", "n", placed.count())
    return met.filter("root <> hub_root").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _left_over(placed, nodes):
    """Texts to check by blocks, in crowds that still fall into several groups; see the head of the module."""
    groups = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    # the largest group, ties to the smallest root, in one number each: fixed-width aggregation
    most = groups.groupBy("band").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.sum("shingles").alias("shingles"),
                                      F.count(F.lit(1)).alias("groups")).filter("groups > 1 and all > 2")  # the one pair of two texts was checked
    main = groups.drop("shingles").join(most, "band").filter("n = top").groupBy("band").agg(
        F.min("root").alias("main"), F.first("all").alias("all"), F.first("shingles").alias("crowd_shingles"))
    signs = nodes.select("node", "marks", "bands")
    crowd = join_hot(placed.drop("n_shingles"), cut_lineage(main), "band", "all", placed.count()).join(signs, "node")
    blocks = F.ceil(F.greatest(F.col("all") / BLOCK, F.col("crowd_shingles") / BLOCK_SHINGLES)).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    carried = ["k", "node", "root", "main", "hub", "marks", "bands"]
    minor = crowd.filter("root <> main").select("band", part.alias("i"), F.explode(every).alias("j"), *carried, F.lit(0).alias("side"))
    whole = crowd.select("band", F.explode(every).alias("i"), part.alias("j"), *carried, F.lit(1).alias("side"))
    return minor.unionByName(whole).groupBy("band", "i", "j").applyInPandas(
        _close_pairs(FLOOR), "band long, i int, j int, node long, others array<long>")


def near_groups(docs: DataFrame, key="doc_id", text="text", width=SHINGLE, percent=LEAST_PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Texts are linked if 100 * shared shingles >= ``percent`` * shingles of both; ``component_id``
    is the smallest key that links reach, the row's own included. Null and empty texts have no
    shingles and no links: their component is their own key. Null keys are never the smallest; a
    component of null keys alone has a null id and its rows are kept. Rows that share a key are
    rows of their own. Equal rows get equal rows; the input's other columns don't matter.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    signed = cut_lineage(_signed(rows, width).withColumn("_at", F.monotonically_increasing_id()))
    copies = signed.filter("n_shingles > 0").groupBy("copy").agg(
        F.min("_at").alias("_at"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"))
    first = copies.withColumnRenamed("_at", "node").withColumnRenamed("copy", "_copy")
    # the first row of each text carries its signature; its place is the text's number
    nodes = cut_lineage(signed.join(first, signed["_at"] == first["node"]).select("node", "copy", "n_shingles", "least", "times", "bands", "marks"))
    shared = nodes.select("node", "n_shingles", F.posexplode("bands").alias("k", "hash")).select(
        F.xxhash64("k", "hash").alias("band"), "k", "node", "n_shingles")
    crowds = shared.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut_lineage(join_hot(shared, cut_lineage(crowds), "band", "n", shared.count()))
    # A text in large crowds throughout is near the middle of its group: it is the hub of its crowds.
    fit, total = fitted(ROWS_PER_TASK), met.count()
    ranked = cut_lineage(fit(met.join(met.groupBy("node").agg((-F.sum("n")).alias("order")), "node"), total))
    hubs = ranked.groupBy("band", "n").agg(F.min(F.struct("order", "node")).alias("hub"))
    entries = cut_lineage(fit(
        join_hot(ranked.select("band", "k", "node", "n_shingles"), cut_lineage(fit(hubs, total)), "band", "n", total)
        .select("band", "k", "node", "n_shingles", "n", F.col("hub.node").alias("hub"), F.col("hub.order").alias("order")), total))
    named = cut_lineage(nodes.select("copy", "node").join(entries.select("node").distinct(), "node"))
    bodies = cut_lineage(_texts_of(rows, named))

    def check(pairs):
        return cut_lineage(_joined(confirmed(cut_lineage(fit(pairs, total)), bodies, width, percent)))

    def placed(links):
        return cut_lineage(fit(_placed(entries, components(links, ROWS_PER_TASK)), total))

    others = entries.filter("node <> hub")
    links = check(others.groupBy("node").agg(F.min(F.struct("order", "hub")).alias("a")).select(F.col("a.hub").alias("a"), F.col("node").alias("b")))
    links = links.unionByName(check(_apart(placed(links))))
    left_over = cut_lineage(_left_over(placed(links), nodes))
    in_blocks = left_over.join(bodies, "node").groupBy("band", "i", "j").applyInPandas(_confirmed_in_block(width, percent), "a long, b long")
    links = links.unionByName(cut_lineage(_joined(in_blocks)))
    rooted = cut_lineage(components(links, ROWS_PER_TASK))
    tops = nodes.join(rooted, "node").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = join_hot(rooted, tops, "root", "n", rooted.count()).select("node", "component_id")
    final = nodes.join(linked, "node", "left").select("copy", "times", F.coalesce("component_id", "least").alias("component_id"))
    light = signed.select("doc_id", "n_shingles", "copy")
    grouped = left_join_hot(light.filter("n_shingles > 0"), final, "copy", "times", signed.count())
    single = light.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return grouped.unionByName(single).select("doc_id", "n_shingles", "component_id",
                                              F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
