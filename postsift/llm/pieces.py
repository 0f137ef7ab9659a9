"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can cross (before a space mark that follows another
character), and the different parts are joined into one text. Its suffixes are sorted as far as
the longest piece reaches, each piece of the vocabulary finds its range of suffixes by binary
search, and the occurrences, sorted by position, are the edges of a lattice. The relaxation merges
along the edges: the vocabulary is of the merging kind, where a text's pieces are those that come
from always taking the best-scored edge over two neighbouring pieces, leftmost first. All parts
of a batch are relaxed together, a merge of each part per round; long parts use a queue.

Texts are read in slices of bounded size, a text at least, and the ids of parts that are kept for
later slices are bounded in bytes.

Reading the vocabulary is left to the library; encoding and decoding are done here.
"""

import heapq
import re
import zlib
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LONG = 64  # symbols from which a part is relaxed by a queue
REMEMBERED = 48 << 20  # bytes of parts whose ids are kept between slices; the rest are found again
ENTRY = 180  # bytes that a kept part takes beside its characters and ids
BATCH_CHARS = 1 << 18  # characters of new parts that one suffix array holds, a part at least
SLICE_CHARS = 1 << 20  # bytes of the texts that are encoded together, a text at least
NO_RANK = 1 << 30


class Pieces:
    """A vocabulary of the merging kind, and the encoder."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(k) for k in range(n)]
        self.bytes = {int(self.text[k][3:5], 16): k for k in range(n) if lib.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.control = {k for k in range(n) if lib.is_control(k)}
        self.unknown = lib.unk_id()
        plain = [k for k in range(n) if not (lib.is_byte(k) or lib.is_control(k) or lib.is_unknown(k) or lib.is_unused(k))]
        self.piece_ids = np.array(plain, np.int32)
        score = np.full(n, -np.inf)
        score[plain] = [lib.get_score(k) for k in plain]
        order = np.argsort(-score[plain], kind="stable")
        self.rank = np.full(n + 1, NO_RANK, np.int64)  # the last entry is for no piece
        self.rank[np.array(plain)[order]] = np.arange(len(plain))
        self.longest = max(len(self.text[k]) for k in plain)
        self.codes = np.zeros((len(plain), self.longest), np.int32)
        for row, k in enumerate(plain):
            self.codes[row, :len(self.text[k])] = [ord(c) for c in self.text[k]]
        self.lengths = np.array([len(self.text[k]) for k in plain])
        self.spelled = [self._spelled(k) for k in range(n)]
        self.known: dict[str, bytes] = {}  # ids of parts, little-endian
        self.held = 0  # bytes that ``known`` takes

    # Encoding

    def parts(self, text: str) -> list[str]:
        """A text as the vocabulary sees it, cut before space marks that follow other characters."""
        return PART.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts) -> list[np.ndarray]:
        """Ids of each text; null texts have none."""
        cut = [self.parts(t or "") for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new, size = [], 0
        for part in {p for c in cut for p in c if p not in self.known}:
            new.append(part)
            size += len(part)
            if size >= BATCH_CHARS:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)
        known = self.known
        return [np.frombuffer(b"".join([known[p] for p in c]), "<i4") for c in cut]

    def _learn(self, parts):
        found = self._encode_parts(parts)
        self.known.update(zip(parts, found))
        self.held += sum(4 * len(p) + len(f) + ENTRY for p, f in zip(parts, found))

    def _encode_parts(self, parts):
        text = np.frombuffer("\0".join(parts).encode("utf-32-le"), np.int32)
        text = np.concatenate((text, np.zeros(self.longest + 1, np.int32)))
        edges = self._edges(text)
        lengths = np.array([len(p) for p in parts])
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        out = [None] * len(parts)
        short = np.flatnonzero(lengths <= LONG)
        if len(short):
            part, at, size = self._relax_together(edges, starts[short], lengths[short])
            ids = self._pieces_at(edges, at, size)
            odd = np.unique(part[ids == len(self.text)])
            joined, ends = ids.astype("<i4").tobytes(), np.cumsum(np.bincount(part, minlength=len(short))) * 4
            for k, a, b in zip(short.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                out[k] = joined[a:b]
            for k in odd.tolist():
                own = slice(*np.searchsorted(part, (k, k + 1)))
                out[short[k]] = self._with_bytes(ids[own], text, at[own])
        for k in np.flatnonzero(lengths > LONG):
            at, size = self._relax_long(edges, int(starts[k]), int(lengths[k]))
            out[k] = self._with_bytes(self._pieces_at(edges, at, size), text, at)
        return out

    def _edges(self, text):
        """The occurrences of pieces sorted by position, then length: (position and length in one number, piece)."""
        n = len(text) - self.longest - 1
        suffixes = self._suffix_array(text, n)
        low, high = np.zeros(len(self.codes), np.int64), np.full(len(self.codes), n, np.int64)
        # Binary search of all pieces at once, a character after the other: the range of suffixes
        # that begin with a piece's first d characters narrows to those that go on with the next.
        for d in range(self.longest):
            live = np.flatnonzero((self.lengths > d) & (low < high))
            if not len(live):
                break
            want, before = self.codes[live, d], (low[live], high[live])
            for bound, go_on in ((low, np.less), (high, np.less_equal)):
                a, b = before[0].copy(), before[1].copy()
                while (a < b).any():
                    open_ = a < b
                    mid = (a + b) >> 1
                    right = open_ & go_on(text[suffixes[np.minimum(mid, n - 1)] + d], want)
                    a = np.where(right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                bound[live] = a
        counts = np.maximum(high - low, 0)
        rows = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        first = np.repeat(low - (np.cumsum(counts) - counts), counts)
        key = suffixes[first + np.arange(len(rows))] * (self.longest + 1) + self.lengths[rows]
        order = np.argsort(key)
        return key[order], self.piece_ids[rows[order]]

    def _pieces_at(self, edges, at, size):
        """The piece of ``size`` characters at each position, or the entry beyond the last piece."""
        key, piece = edges
        if not len(key):
            return np.full(len(at), len(self.text), np.int32)
        want = at * (self.longest + 1) + size
        spot = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[spot] == want, piece[spot], np.int32(len(self.text)))

    def _suffix_array(self, text, n):
        """Positions sorted by the characters there, as far as the longest piece reaches."""
        _, rank = np.unique(text[:n], return_inverse=True)
        rank, reach = rank.astype(np.int64) + 1, 1
        order = np.argsort(rank)
        while reach < self.longest and n:
            after = np.zeros(n, np.int64)
            after[:max(n - reach, 0)] = rank[reach:]
            key = rank * (n + 2) + after
            order = np.argsort(key)
            moved = key[order]
            rank[order] = np.cumsum(np.concatenate(([1], moved[1:] != moved[:-1])))
            reach *= 2
        return order

    def _joint_rank(self, edges, part, at, size, k):
        """Rank of the edge over the k-th piece and the next of the same part."""
        k = k[k + 1 < len(part)]
        joint = size[k] + size[k + 1]
        fits = (part[k] == part[k + 1]) & (joint <= self.longest)
        rank = np.full(len(k), NO_RANK, np.int64)
        rank[fits] = self.rank[self._pieces_at(edges, at[k[fits]], joint[fits])]
        return k, rank

    def _relax_together(self, edges, starts, lengths):
        """Part, start and length of the pieces of short parts; one merge of every part per round."""
        part = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[part]
        size = np.ones(len(part), np.int64)
        rank = np.full(len(part), NO_RANK, np.int64)
        where, found = self._joint_rank(edges, part, at, size, np.arange(len(part)))
        rank[where] = found
        done = [[] for _ in range(3)]
        while len(part):
            heads = np.flatnonzero(np.diff(part, prepend=-1))
            best = np.minimum.reduceat(rank * len(part) + np.arange(len(part)), heads)
            pick = best[best // len(part) < NO_RANK] % len(part)
            going = np.zeros(len(starts), bool)
            going[part[pick]] = True
            stay = ~going[part]
            for store, values in zip(done, (part, at, size)):
                store.append(values[stay])
            size[pick] += size[pick + 1]
            keep = ~stay
            keep[pick + 1] = False
            moved = (np.cumsum(keep) - 1)[pick]  # where the merged pieces stand now
            part, at, size, rank = part[keep], at[keep], size[keep], rank[keep]
            changed = np.concatenate((moved, moved[moved > 0] - 1))
            rank[changed] = NO_RANK
            where, found = self._joint_rank(edges, part, at, size, changed)
            rank[where] = found
        part, at, size = (np.concatenate(x) for x in done)
        order = np.argsort(part, kind="stable")
        return part[order], at[order], size[order]

    def _relax_long(self, edges, start, length):
        """The same for one part, with a queue of edges: best score first, leftmost at equal score.

        Sizes, neighbours and ranks stand in arrays by position; a queue entry is one number, of
        the rank and the position, and counts only while the position still has that rank.
        """
        begin, stop = np.searchsorted(edges[0], (start * (self.longest + 1), (start + length) * (self.longest + 1)))
        key, piece = array("q", edges[0][begin:stop].astype(np.int64).tobytes()), edges[1][begin:stop]
        size, before = array("i", bytes(4 * length)), array("q", range(-1, length - 1))
        rank = array("i", bytes(4 * length))
        for k in range(length):
            size[k] = 1

        def measure(a):
            b, best = a + size[a], NO_RANK
            if b < length and size[a] + size[b] <= self.longest:
                want = (start + a) * (self.longest + 1) + size[a] + size[b]
                spot = bisect_left(key, want)
                if spot < len(key) and key[spot] == want:
                    best = int(self.rank[piece[spot]])
            rank[a] = best
            return best

        queue = [r * length + a for a in range(length) if (r := measure(a)) < NO_RANK]
        heapq.heapify(queue)
        while queue:
            best, a = divmod(heapq.heappop(queue), length)
            if not size[a] or rank[a] != best:
                continue
            b = a + size[a]
            size[a] += size[b]
            size[b] = 0
            if a + size[a] < length:
                before[a + size[a]] = a
            for c in (a, before[a]):
                if c >= 0:
                    old = rank[c]
                    r = measure(c)
                    if r < NO_RANK and (r != old or c == a):
                        heapq.heappush(queue, r * length + c)
        sizes = np.frombuffer(size, np.int32)
        at = np.flatnonzero(sizes)
        return at + start, sizes[at].astype(np.int64)

    def _with_bytes(self, ids, text, at):
        """Ids as bytes; characters outside the vocabulary are spelled in byte pieces."""
        out = []
        for k, p in zip(ids.tolist(), at.tolist()):
            out += [k] if k < len(self.text) else [self.bytes.get(b, self.unknown) for b in chr(text[p]).encode()]
        return np.array(out, "<i4").tobytes()

    # Decoding

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are read as UTF-8, and the mark added in front goes."""
        text = b"".join(map(self.spelled.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _spelled(self, k):
        if k in self.byte_of:
            return bytes([self.byte_of[k]])
        if k == self.unknown:
            return " ⁇ ".encode()
        return b"" if k in self.control else self.text[k].replace(SPACE, " ").encode()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per Python worker."""
    return Pieces(path)


def _encoded(docs, path, key, text, shape, columns):
    """A table of what ``columns`` makes of each slice's texts and ids; one row per input row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches):
        encoder = pieces(path)
        for b in batches:
            sizes = np.cumsum([0] + pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist())
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE_CHARS, "right")) - 1)
                texts = b.column(1).slice(start, end - start).to_pylist()
                values = columns(encoder, texts, encoder.encode_batch(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), *values.values()], names=["doc_id", *values])
                start = end

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {shape}")


def encode(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, whole texts; null and empty texts have no ids.

    Keys may be null or repeated, equal rows get equal rows, other columns don't matter.
    """
    return _encoded(docs, path, key, text, "ids array<int>", lambda p, texts, ids: {"ids": pa.array(ids, pa.list_(pa.int32()))})


def decode(encoded: DataFrame, path: str, ids="ids") -> DataFrame:
    """Adds the column ``text``; null ids give null."""
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else pieces(path).decode(x))

    return encoded.withColumn("text", run(ids))


def _digests(encoder, texts, ids):
    same = [encoder.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts)]
    return {"n_ids": pa.array([len(i) for i in ids], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), "round_trip": pa.array(same, pa.bool_())}


def encode_digest(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """One row per input row: doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), round_trip.

    ``round_trip``: the decoded ids give the text again (null: the empty one), space marks as
    spaces. Keys may be null or repeated, equal rows get equal rows, other columns don't matter.
    """
    return _encoded(docs, path, key, text, "n_ids long, ids_crc32 long, round_trip boolean", _digests)
