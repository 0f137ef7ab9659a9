"""A public word-level BPE vocabulary (.json) inside tasks: words of a text, ids of a word.

Texts are cut into words the way the file says: special strings of the raw text first, then
NFC, lower case, and the file's word pattern. Each different word is encoded once by the library
and remembered, so a text costs a dictionary lookup per word.
"""

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

import regex

REMEMBERED = 600_000  # words; the memory is emptied beyond, results don't depend on it
# The file's word pattern, for ASCII texts and for others.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def _members(kind):
    """The characters below U+10000 of a kind, as ranges for a character class."""
    marks = [bool(regex.match(rf"\p{{{kind}}}", chr(c))) if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)] + [False]
    edges = [c for c in range(0x10001) if marks[c] != (marks[c - 1] if c else False)]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))


@lru_cache(maxsize=1)
def _short_words():
    """WORDS for texts below U+10000, by plain classes, which match faster."""
    letters, digits, blank = _members("L"), _members("N"), _members("White_Space")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+")


def byte_letters():
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.vocab, self.merges = stored["model"]["vocab"], stored["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"] if t["special"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special strings stand as they are."""
        if "<|" not in text:
            return self._plain(text)
        return [w for k, part in enumerate(self.apart.split(text)) for w in ([part] if k % 2 else self._plain(part))]

    def _plain(self, text):
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if "Σ" in text or max(text) > "\uffff":  # lower case by context; characters beyond the classes
            return WORDS.findall(self.library.normalizer.normalize_str(text))
        return _short_words().findall(unicodedata.normalize("NFC", text).lower())

    def spelled(self, word: str) -> str:
        """A word in the letters of its bytes."""
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.letters[b] for b in word.encode()])

    def learn(self, words) -> None:
        """Encode the words that aren't known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        tokenize = self.library.model.tokenize
        for w in words:
            if w not in self.known:
                ids = [self.special[w]] if w in self.special else [t.id for t in tokenize(self.spelled(w))]
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        words = self.words(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self.learn(words)
            return b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)
