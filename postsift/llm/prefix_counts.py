"""Exact token counts of every prefix of a text, by dynamic programming over its prefixes.

In byte-pair encoding the ids of a prefix are the ids of a shorter prefix and one more token, and
that token is the only one that stands against the last id of the shorter prefix as those two
would come out of encoding both together. So one pass from left to right finds, for each prefix of
a word, its last token and its count from the counts before it. Counts of whole words add up along
the text. Questions (how long may a text be to keep a budget of tokens, how many tokens has its
first part) are answered by a lookup in the counts, without encoding again.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postsift.llm.word_bpe import REMEMBERED, word_bpe

LIMIT = 2048
END = "</w>"


class PrefixCounts:
    """Counts of the prefixes of words under one vocabulary."""

    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        special = self.bpe.special.values()
        ids = [(t, k) for t, k in self.bpe.vocab.items() if k not in special]
        self.endings: dict = {}  # tokens by their letters from the last to the first; True: it ends a word
        for t, k in ids:
            whole = t.endswith(END) and t != END
            node = self.endings
            for letter in reversed(t[:-len(END)] if whole else t):
                node = node.setdefault(letter, {})
            node[whole] = k
        self.rank, self.parts = {}, {}
        vocab = self.bpe.vocab
        for k, (left, right) in enumerate(self.bpe.merges):
            pair = vocab[left], vocab[right]
            self.rank[pair] = k
            self.parts.setdefault(vocab[left + right], pair)
        self.edges: dict[tuple, list] = {}  # of a token and a side
        self.fits: dict[int, bool] = {}
        self.counts: dict[str, int] = {}  # of whole words

    def _edge(self, token, side):
        """The tokens that stand at one side of a token while it is put together, and until which merge."""
        got = self.edges.get((token, side))
        if got is None:
            got, at = [(token, 1 << 30)], token
            while at in self.parts:
                pair = self.parts[at]
                at, until = pair[side], self.rank[pair]
                got.append((at, until))
            self.edges[(token, side)] = got
        return got

    def _adjacent(self, a, b):
        """Whether encoding both together gives these two: no merge joins them across the border
        while its two sides stand there. At one rank the left merge comes first."""
        rank = self.rank
        return not any((r := rank.get((x, y))) is not None and r < until_x and r <= until_y
                       for x, until_x in self._edge(a, 1) for y, until_y in self._edge(b, 0))

    def _fits(self, a, b):
        key = a << 20 | b
        got = self.fits.get(key)
        if got is None:
            got = self.fits[key] = self._adjacent(a, b)
        return got

    def word(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, by characters: entry k is for its first k + 1."""
        if word in self.bpe.special:
            return [1] * len(word)  # one token; the words of a text never hold a part of it
        text = self.bpe.spelled(word)
        last, inner, ends, fits = [-1], [0], [], self.fits
        for k in range(1, len(text) + 1):
            node, j, token, total = self.endings, k, None, None
            while j and (token is None or total is None):
                j -= 1
                node = node.get(text[j])
                if node is None:
                    break
                before = last[j] << 20
                if token is None and False in node:
                    t = node[False]
                    if not j or (fits[before | t] if before | t in fits else self._fits(last[j], t)):
                        token, count = t, inner[j] + 1
                if total is None and True in node:
                    t = node[True]
                    if not j or (fits[before | t] if before | t in fits else self._fits(last[j], t)):
                        total = inner[j] + 1
            last.append(token)
            inner.append(count)
            ends.append(total)
        if not word.isascii():  # keep the bytes that end a character
            at = np.cumsum([len(c.encode()) for c in word]) - 1
            ends = [ends[k] for k in at]
        return ends

    def total(self, text: str) -> int:
        """Tokens of a whole text: the last entries of its words' counts, added."""
        words, counts = self.bpe.words(text), self.counts
        try:
            return sum([counts[w] for w in words])
        except KeyError:
            if len(counts) > REMEMBERED:
                counts.clear()
            for w in words:
                if w not in counts:
                    counts[w] = self.word(w)[-1]
            return sum([counts[w] for w in words])

    def prefixes(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words, and the counts of all prefixes of the words joined together."""
        words = self.bpe.words(text)
        counts = [np.array(self.word(w), np.int32) for w in words]
        before = np.cumsum([0] + [int(c[-1]) for c in counts])
        return words, np.concatenate([c + b for c, b in zip(counts, before)] or [np.zeros(0, np.int32)])


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixCounts:
    """One per Python worker."""
    return PrefixCounts(path)


def count_tokens(docs: DataFrame, path: str, key="doc_id", text="text", limit=LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. Null texts count as empty."""
    @F.pandas_udf("long")
    def total(texts: pd.Series) -> pd.Series:
        table = prefix_table(path)
        return texts.map(lambda t: table.total(t or "")).astype("int64")

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), total("_text").alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """doc_id, words (joined: the normalized text without space) and counts of all its prefixes."""
    @F.pandas_udf("words array<string>, counts array<int>")
    def store(texts: pd.Series) -> pd.DataFrame:
        table = prefix_table(path)
        return pd.DataFrame([table.prefixes(t or "") for t in texts], columns=["words", "counts"])

    return docs.select(F.col(key).alias("doc_id"), store(text).alias("_p")).select("doc_id", "_p.words", "_p.counts")


def longest_within(counts, budget: int):
    """Column: how many characters of the joined words fit a budget of tokens.

    Counts may fall as a word goes on, so the last prefix within the budget is taken.
    """
    at = F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True)
    return F.when(at == 0, 0).otherwise(F.size(counts) - at + 1)
