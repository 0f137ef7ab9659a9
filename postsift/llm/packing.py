"""Packing token ids into sequences of a fixed length, online and in bounded space.

Each partition keeps a fixed number of open windows. What a document has beyond whole sequences is
placed in the window that it fills best. When none has room, the fullest is topped up with a cut
of the piece and emitted, so emitted sequences carry no padding. At the end the leftover windows
of many partitions are merged, level by level, in groups of bounded size; the last tail is cut at
powers of two, which need no padding either.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.hot import require_keys
from postsift.llm.word_bpe import word_bpe
from postsift.operators.lineage import cut_lineage

LENGTH, END_ID = 4096, 2
OPEN = 16  # windows of a partition
FAN = 64  # leftovers of so many partitions are merged in one task: 64 x 16 x 4096 ids at most
WIDTH = 4  # bytes of an id
PIECES = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


class Windows:
    """Open windows of one task. Pieces are (document, start, ids as bytes, ids of the document)."""

    def __init__(self, first_id: int, length: int, count: int):
        self.next_id, self.length, self.count = first_id, length, count
        self.open: list[list] = []  # pieces of each window
        self.filled: list[int] = []
        self.rows: list[tuple] = []

    def emit(self, pieces):
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // WIDTH
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, None))
            offset += n
        self.next_id += 1

    def add(self, doc, start, ids, total):
        size = self.length * WIDTH
        whole = len(ids) // size * size
        for k in range(0, whole, size):
            self.emit([(doc, start + k // WIDTH, ids[k:k + size], total)])
        start, ids = start + whole // WIDTH, ids[whole:]
        while ids:
            n = len(ids) // WIDTH
            rooms = [(self.length - f - n, k) for k, f in enumerate(self.filled) if f + n <= self.length]
            if rooms:
                k = min(rooms)[1]
            elif len(self.open) < self.count:
                k = len(self.open)
                self.open.append([])
                self.filled.append(0)
            else:  # none fits: a cut of the piece tops up the fullest
                k = max(range(len(self.filled)), key=self.filled.__getitem__)
                n = self.length - self.filled[k]
            self.open[k].append((doc, start, ids[:n * WIDTH], total))
            self.filled[k] += n
            start, ids = start + n, ids[n * WIDTH:]
            if self.filled[k] == self.length:
                self.emit(self.open.pop(k))
                self.filled.pop(k)

    def leftovers(self):
        """Rows of the pieces in open windows; they have ids and no sequence yet."""
        for pieces in self.open:
            for doc, start, ids, total in pieces:
                self.rows.append((doc, start, len(ids) // WIDTH, zlib.crc32(ids), total, None, None, ids))
        self.open, self.filled = [], []

    def tail(self):
        """Cut what is left at powers of two, largest first: sequences without padding."""
        pieces = [p for window in self.open for p in window]
        left = sum(len(p[2]) for p in pieces) // WIDTH
        while left:
            size = min(self.length, 1 << (left.bit_length() - 1))
            left, taken, row = left - size, 0, []
            while taken < size:
                doc, start, ids, total = pieces.pop(0)
                n = min(len(ids) // WIDTH, size - taken)
                row.append((doc, start, ids[:n * WIDTH], total))
                taken += n
                if len(ids) > n * WIDTH:
                    pieces.insert(0, (doc, start + n, ids[n * WIDTH:], total))
            self.emit(row)
        self.open, self.filled = [], []

    def take(self):
        rows, self.rows = self.rows, []
        return rows


def _batch(rows, key_type):
    columns = list(zip(*rows)) if rows else [[]] * len(FIELDS)
    types = [key_type] + [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=FIELDS)


def pack(docs: DataFrame, path: str, key="doc_id", text="text", length=LENGTH, end_id=END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is the ids of its text (null: none) and ``end_id``; empty ones have that id alone.
    Every id is in exactly one piece. ``ids`` is null here; ``with_ids`` cuts them from the text.
    Null and repeated keys are packed row by row like any other.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    schema = PIECES.format(key=rows.schema["doc_id"].dataType.simpleString())
    closing = np.array([end_id], "<u4").tobytes()

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe, windows, key_type = word_bpe(path), Windows(part << 36, length, OPEN), None
        for b in batches:
            key_type = b.column(0).type
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.ids(body or "") + closing
                windows.add(doc, 0, ids, len(ids) // WIDTH)
                if len(windows.rows) >= 4096:
                    yield _batch(windows.take(), key_type)
        if key_type is not None:
            windows.leftovers()
            yield _batch(windows.take(), key_type)

    packed = cut_lineage(rows.mapInArrow(first, schema).withColumn("_part", F.spark_partition_id()))
    done = packed.filter("sequence_id is not null").drop("_part")
    left = packed.filter("sequence_id is null")
    parts = packed.rdd.getNumPartitions()
    level = 0
    while True:
        level, parts = level + 1, -(-parts // FAN)
        merged = cut_lineage(left.withColumn("_part", (F.col("_part") / FAN).cast("int")).groupBy("_part").applyInArrow(
            _merge(length, level << 60, last=parts <= 1), schema + ", _part int"))
        done = done.unionByName(merged.filter("sequence_id is not null").drop("_part"))
        left = merged.filter("sequence_id is null")
        if parts <= 1:
            return done


def _merge(length, first_id, last):
    """Packs the leftovers of one group; keys stay Arrow values of their own type, nulls included."""
    def run(key, group):
        part, key_type = key[0].as_py(), group.schema.field("doc_id").type
        windows = Windows(first_id + (part << 36), length, OPEN)
        pieces = list(zip(*[group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "length")]))
        pieces.sort(key=lambda p: (-p[4], p[0] is None, 0 if p[0] is None else p[0], p[1]))
        for doc, start, ids, total, _ in pieces:
            windows.add(doc, start, ids, total)
        windows.tail() if last else windows.leftovers()
        rows = _batch(windows.take(), key_type)
        return pa.Table.from_batches([rows]).append_column("_part", pa.array([part] * rows.num_rows, pa.int32()))

    return run


def with_ids(pieces: DataFrame, docs: DataFrame, path: str, key="doc_id", text="text", end_id=END_ID) -> DataFrame:
    """The pieces with their ids (array of long), for writing; keys must be unique and not null, or it raises."""
    require_keys(docs, key)
    closing = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf("array<long>")
    def cut(texts: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        bpe = word_bpe(path)
        return pd.Series([np.frombuffer(bpe.ids(t or "") + closing, "<u4")[s:s + n].astype("int64")
                          for t, s, n in zip(texts, start, length)])

    body = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    return pieces.drop("ids").join(body, "doc_id").withColumn("ids", cut("_text", "start", "length")).drop("_text")
