"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

Words are runs of letters in lower case. Words and pairs of neighbours are counted over all texts,
every one of them. A pair seen at least LEAST_SEEN times has the score count(pair) / count(first
word); any other backs off to BACKOFF * count(word) / count(all words).

A word's key is its 64-bit hash; a pair's key is 64 bits of both hashes, and its bucket comes from
64 others, so equal keys in two buckets are two pairs. The number of buckets follows the words. Texts travel in chunks: a chunk holds its texts as numbers of its own
distinct words. It sends each of its distinct words and pairs once, with the count in the chunk,
to the bucket, which adds up the counts of each key and answers every chunk in the order in which
the chunk asked. So a pair in a third of all texts costs one entry a chunk, like any other pair,
and a bucket holds about the same share of every chunk. The answers are laid back over the texts.
"""

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from postsift.operators.lineage import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
HOT = 512  # not read any more (no word is treated apart); a test sets it
LEAST_SEEN, BACKOFF = 2, 0.4
BUCKET_WORDS, LEAST_BUCKETS = 4_000_000, 64
OTHER = np.uint64(0xD6E8FEB86659FD93)  # sets the bits for the bucket of a pair apart from those of its key
CHUNK_WORDS, CHUNK_TEXTS = 1 << 20, 1 << 15  # a chunk is full at either


def text_words(text):
    return WORD.findall(text.lower()) if text else []


def _packed(values):
    """Whole numbers as bytes: their count, then first bytes, second bytes and so on together, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(packed, kind):
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(packed[8:], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def _chunks(docs, key, text):
    """chunk, n_words, docs (keys), lengths (words of each text), ids (numbers of the words, packed), hashes (64 bits of each distinct word)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        chunk, key_type = TaskContext.get().partitionId() << 40, None

        def start():
            return defaultdict(count().__next__), [], [], [], 0

        def row():
            flat = np.concatenate([np.zeros(0, np.uint32), *ids])
            columns = [[chunk], [total], [keys], [lengths], [_packed(flat)],
                       [b"".join(xxhash.xxh3_64_digest(w.encode()) for w in number)]]
            types = [pa.int64(), pa.int64(), pa.list_(key_type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "n_words", "docs", "lengths", "ids", "hashes"])

        number, keys, lengths, ids, total = start()
        for b in batches:
            key_type = b.column(0).type
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text_words(t)
                keys.append(doc)
                lengths.append(len(words))
                ids.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                total += len(words)
                if total >= CHUNK_WORDS or len(keys) >= CHUNK_TEXTS:
                    yield row()
                    number, keys, lengths, ids, total = start()
                    chunk += 1
        if keys:
            yield row()

    return rows.mapInArrow(run, f"chunk long, n_words long, docs array<{kind}>, lengths array<int>, ids binary, hashes binary")


def _mixed(left, right):
    """64 bits of a pair from 64 bits of each of its words; the order counts."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ right >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


class Ngrams:
    """Distinct words and pairs of a chunk, and where its texts have them."""

    def __init__(self, lengths, ids, hashes):
        self.lengths = np.asarray(lengths, np.int64)
        self.ids = _unpacked(ids, np.uint32).astype(np.int64)
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)  # of each word
        self.words = len(hashes) // 8
        inside = np.flatnonzero(self.text[1:] == self.text[:-1])
        self.pair_text = self.text[inside]
        distinct, self.pair_at, self.pair_n = np.unique(self.ids[inside] * max(self.words, 1) + self.ids[inside + 1], return_inverse=True, return_counts=True)
        self.left, self.right = np.divmod(distinct, max(self.words, 1))
        self.hashes = np.frombuffer(hashes, np.uint64)

    def by_bucket(self, buckets):
        """Order of the n-grams (words, then pairs) by bucket and key, their keys and counts in it, and the buckets with the places where they start."""
        left, right = self.hashes[self.left], self.hashes[self.right]
        keys = np.concatenate((self.hashes, _mixed(left, right)))
        other = np.concatenate((self.hashes, _mixed(right ^ OTHER, left)))
        at = (other % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(keys)
        order = order[np.argsort(at[order], kind="stable")]
        n = np.concatenate((np.bincount(self.ids, minlength=self.words), self.pair_n))
        starts = np.flatnonzero(np.diff(at[order].astype(np.int64), prepend=-1))
        return order, keys[order], n[order], at[order][starts], starts

    def scores(self, n, all_words):
        """Per text: words, pairs in the table, sum of log10 scores; n: counts over all texts, words first."""
        words, pairs = n[:self.words].astype(np.float64), n[self.words:]
        seen = pairs >= LEAST_SEEN
        alone = np.log10(np.maximum(words, 1) / max(all_words, 1))
        score = np.where(seen, np.log10(np.maximum(pairs, 1) / np.maximum(words[self.left], 1)), alone[self.right] + np.log10(BACKOFF))
        texts = len(self.lengths)
        sums = np.bincount(self.pair_text, score[self.pair_at], texts).astype(np.float64)  # whole numbers if there is no pair
        some = np.flatnonzero(self.lengths)
        sums[some] += alone[self.ids[(np.cumsum(self.lengths) - self.lengths)[some]]]
        return self.lengths, np.bincount(self.pair_text, seen[self.pair_at], texts).astype(np.int64), sums


def _ngrams(row):
    return Ngrams(row["lengths"], row["ids"], row["hashes"])


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, keys, n: a chunk's distinct n-grams in one row per bucket, each key once; keys as packed steps from key to key."""
    def run(batches):
        for b in batches:
            for row in b.select(["chunk", "lengths", "ids", "hashes"]).to_pylist():
                _, keys, n, at, starts = _ngrams(row).by_bucket(buckets)
                parts = [slice(s, e) for s, e in zip(starts, [*starts[1:], len(keys)])]
                columns = [[row["chunk"]] * len(parts), at.tolist(), [_packed(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], [_packed(n[p]) for p in parts]]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "bucket", "keys", "n"])

    return chunks.select("chunk", "lengths", "ids", "hashes").mapInArrow(run, "chunk long, bucket long, keys binary, n binary")


def _answered(asked: pa.Table) -> pa.Table:
    """The bucket's part of the count table, joined to what the chunks asked: n over all texts."""
    keys = [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in asked["keys"].to_pylist()]
    here = np.concatenate([_unpacked(n, np.int64) for n in asked["n"].to_pylist()])
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, here).astype(np.int64)[back]  # exact below 2^53
    answers = [_packed(part) for part in np.split(n, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "n": pa.array(answers, pa.binary())})


def score_texts(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_seen (pairs in the table), log_score, mean_log_score.

    ``log_score`` is the sum of log10 scores of all words (the first has no context: its share of
    all words); null and empty texts have 0 words, score 0 and a null mean. Rows with null or
    repeated keys are scored one by one.
    """
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    chunks = cut_lineage(_chunks(docs, key, text))
    all_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-all_words // BUCKET_WORDS))

    def add_up(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        chunk = _ngrams(row)
        order = chunk.by_bucket(buckets)[0]
        n = np.empty(len(order), np.int64)
        n[order] = np.concatenate([np.zeros(0, np.int64), *(_unpacked(p, np.int64) for p in answers.sort_by("bucket")["n"].to_pylist())])
        n_words, n_seen, score = chunk.scores(n, all_words)
        keys = pc.list_flatten(own["docs"].combine_chunks())
        return pa.table({"doc_id": keys, "n_words": n_words, "n_seen": n_seen, "log_score": score})

    answers = _asked(chunks, buckets).groupBy("bucket").applyInArrow(_answered, "chunk long, bucket long, n binary")
    summed = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, f"doc_id {kind}, n_words long, n_seen long, log_score double")
    return summed.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
