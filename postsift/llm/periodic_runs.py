"""Runs of repeated words inside a text, by a sparse table of diagonals read online.

Words q apart that are equal lie on diagonal q of the table "word against earlier word". A run of
period q is a stretch of its diagonal with at least q equal words. The table is read word by word:
each earlier occurrence of a word lengthens the match of its lag, and a lag that finds no
occurrence ends there and gives its run at once, if it is long enough.

Most cells never matter, and these are left out without a loss:
- A run of at least ``least`` words has at least least / 2 equal words on its diagonal, and at
  least q. So a lag from m to 2m needs the last m words to have occurred before, not only the
  last one: occurrences are looked up by spans of 6, 12, 24 ... words (least = 12), each span
  for the lags from its own length to twice that. Spans that occur once are dropped at each step.
- Inside a run of period p that shorter lags gave, the earlier occurrences p, 2p, 3p ... back lie
  on diagonals that begin and end with that run. They are skipped, so a text of one word repeated
  costs no more than its length.

Texts are read in slices of bounded size, a text at least; only words of the slice are held.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST = 12  # words of the shortest run
SLICE_CHARS = 1 << 21  # characters of the texts that are read together, a text at least
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
WORD_HASH, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _repeated(owner, words, span):
    """Positions at which a span of words ends that its text holds twice or more, and span ids.

    A hash names the positions that can be such; ids by words, not hashes, decide.
    """
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = owner[:n].astype(np.uint64) * MIX
    for k in range(span):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * WORD_HASH + words[k:k + n].astype(np.uint64) * MIX
    inside = np.flatnonzero(owner[:n] == owner[span - 1:])
    mixed = mixed[inside]
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    often = np.zeros(len(mixed), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    first = inside[often]
    ids, base = owner[first].astype(np.int64), int(words.max()) + 1
    for k in range(span):
        _, ids = np.unique(ids * base + words[first + k], return_inverse=True)
    return _twice(first + span - 1, ids)


def _twice(ends, ids):
    keep = np.bincount(ids, minlength=1)[ids] > 1
    return ends[keep], ids[keep]


def _doubled(ends, ids, span, owner):
    """The same for spans of twice as many words: a span that follows a span."""
    at = np.full(len(owner), -1, np.int64)
    at[ends] = np.arange(len(ends))
    left = at[np.maximum(ends - span, 0)]
    joined = np.flatnonzero((ends >= span) & (left >= 0) & (owner[ends - span] == owner[ends]))
    if not len(joined):
        return ends[:0], ids[:0]
    _, both = np.unique(ids[left[joined]] * (int(ids.max()) + 1) + ids[joined], return_inverse=True)
    return _twice(ends[joined], both)


def _cells(ends, ids, low, high, skipped):
    """(end, lag) of all earlier occurrences with low <= lag < high, by end; some may be skipped."""
    order = np.lexsort((ends, ids))
    spot, group = ends[order], ids[order]
    head = np.searchsorted(group, group, "left")  # where the occurrences of a span begin
    here = np.arange(len(order))
    back = here - 1 - skipped[spot]
    found = [[], []]
    while True:
        live = back >= head[here]
        here, back = here[live], back[live]
        lag = spot[here] - spot[back]
        near = lag < high
        here, back, lag = here[near], back[near], lag[near]
        if not len(here):
            break
        found[0].append(spot[here][lag >= low])
        found[1].append(lag[lag >= low])
        back = back - 1
    if not found[0]:
        return spot[:0], spot[:0]
    end, lag = (np.concatenate(x) for x in found)
    order = np.lexsort((lag, end))
    return end[order], lag[order]


def _diagonals(ends, lags):
    """Read the cells word by word; a lag without a cell at the next word ends: (lag, first, last)."""
    active, before, k, ends, lags, n = {}, -2, 0, ends.tolist(), lags.tolist(), len(ends)
    while k < n:
        word = ends[k]
        if word != before + 1:
            for lag, first in active.items():
                yield lag, first, before
            active = {}
        grown = {}
        while k < n and ends[k] == word:
            lag = lags[k]
            grown[lag] = active.pop(lag, word)
            k += 1
        for lag, first in active.items():
            yield lag, first, before
        active, before = grown, word
    for lag, first in active.items():
        yield lag, first, before


def runs_of(word_lists, least=LEAST):
    """Lists of (start, length, period) of each list of word numbers, by start, then period."""
    sizes = np.array([len(w) for w in word_lists], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    words = np.concatenate([np.asarray(w, np.int64) for w in word_lists] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = [[] for _ in word_lists]
    span = max(1, (least + 1) // 2)
    low, periods = 1, {}  # periods: (start, last) of a run to its smallest period
    ends, ids = _repeated(owner, words, span)
    while len(ends):
        skipped = np.zeros(len(words), np.int64)
        for (start, last), period in periods.items():
            if last - start + 1 >= span:
                inside = slice(start + span - 1, last + 1)
                own = np.arange(last - start - span + 2) // period
                skipped[inside] = np.maximum(skipped[inside], own)
        for lag, first, last in _diagonals(*_cells(ends, ids, low, 2 * span, skipped)):
            match = last - first + span
            start = last - match + 1 - lag
            if match < max(lag, least - lag):
                continue
            doc = owner[last]
            left, right = start > bounds[doc], last + 1 < bounds[doc + 1]
            if left and words[start - 1] == words[start - 1 + lag] or right and words[last + 1] == words[last + 1 - lag]:
                continue  # a piece of a diagonal of which the rest was skipped: a known run's
            periods[start, last] = min(lag, periods.get((start, last), lag))
        ends, ids = _doubled(ends, ids, span, owner)
        low, span = 2 * span, 2 * span
    for (start, last), period in sorted(periods.items(), key=lambda r: (r[0][0], r[1])):
        out[owner[start]].append((int(start - bounds[owner[start]]), int(last - start + 1), int(period)))
    return out


def _collapsed(words, runs):
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def _slices(batch, size):
    """Row ranges of a batch whose texts have about ``size`` bytes, a row at least."""
    offsets = np.cumsum([0] + [len(t) for t in batch])
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, end
        start = end


def find_runs(docs: DataFrame, key="doc_id", text="text", least=LEAST) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period) and collapsed.

    A run is a stretch of words with smallest period q, of at least ``least`` and 2q words, that
    no neighbouring word extends; ``runs`` is sorted by start, then period. ``collapsed`` are the
    words that remain if of each run the first q words stay, joined by blanks. Null and empty
    texts have no words, no runs and an empty ``collapsed``. Keys may be null or repeated, equal
    rows get equal rows, and the input's other columns don't matter.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for start, end in _slices(texts, SLICE_CHARS):
                cut = [t.split() for t in texts[start:end]]
                numbers: dict[bytes, int] = {}
                found = runs_of([[numbers.setdefault(w, len(numbers)) for w in words] for words in cut], least)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(start, end - start),
                    pa.array([len(w) for w in cut], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], RUNS),
                    pa.array([_collapsed(w, r) for w, r in zip(cut, found)], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    shape = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, shape)


def with_planted_loops(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Columns doc_id and text, where a tenth of the texts goes on repeating from some word on.

    With h = crc32 of the key in decimals, g = h / 10 and n words, the words from a = g % n on are
    those of a stretch of p = 1 + (n - a) / (3 + g % 8) words from a, if h % 10 = 0. Null keys and
    texts without words stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    cut = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.floor(h / 10).alias("_g"),
                      F.when(h % 10 == 0, words).alias("_words"))
    sized = cut.withColumn("_n", F.size("_words")).withColumn("_a", F.expr("if(_n > 0, cast(_g % _n as int), 0)"))
    looped = sized.withColumn("_p", F.expr("cast(1 + floor((_n - _a) / (3 + _g % 8)) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast(ceil((_n - _a) / _p) as int))), 1, _n - _a)")
    again = F.array_join(F.concat(F.expr("slice(_words, 1, _a)"), tail), " ")
    return looped.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The columns of ``find_runs`` as facts per row: n_runs, the longest run, and two sha256.

    Of the longest runs the first counts, then the one of the smallest period; rows without runs
    have nulls there.
    """
    best = F.expr("""array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))""")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    facts = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
                         F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                         F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("_best.length"), -F.col("_best.period")
    return facts.select("doc_id", "n_runs", (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
                        F.expr("(1000 * _best.length) div -_best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
