"""Text cleaning, segmentation and tokenizing as native column expressions."""

import operator
import unicodedata
from functools import reduce
from html.entities import html5, name2codepoint

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from postsift import vocab
from postsift.functions import markup


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.btrim(_col(c), F.lit(vocab.WS_CHARS))


def spaces(c, chars=vocab.WS_CHARS) -> Column:
    """The given whitespace characters as plain spaces.

    A pattern, since ``translate`` looks up each character as a string; printable ASCII fails its first test.
    """
    return F.regexp_replace(_col(c), f"[[^ -~]&&[{chars.replace(' ', '')}]]", " ")


def count_by_loss(c, pattern: str) -> Column:
    """Matches of a pattern that takes one character each, by what the text loses without them; no match becomes a string."""
    return F.length(_col(c)) - F.length(F.regexp_replace(_col(c), pattern, ""))


def beyond_ascii(c) -> Column:
    return F.octet_length(_col(c)) > F.length(_col(c))


def collapse(c) -> Column:
    """Each run of whitespace becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(spaces(c), "  +", " "))


def blank_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


# --- markup ----------------------------------------------------------------

DROPPED_ELEMENTS = ("script", "style", "noscript")
ENTITY = r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31})(;?)"
# The names that count without a semicolon, and what they stand for; a longer name goes first.
BARE_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
BARE_ENTITY = "^&(" + "|".join(sorted(BARE_NAMES, key=lambda n: (-len(n), n))) + ")"


def drop_elements(c, elements=DROPPED_ELEMENTS) -> Column:
    return markup.drop_elements(c, elements)


def _entity_table() -> Column:
    names = {name: chr(cp) for name, cp in name2codepoint.items()} | {"apos": "'"} | BARE_NAMES
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _code_point(number) -> Column:
    ok = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(ok, text).otherwise(F.lit("�"))


def _decode_piece(in_attribute):
    def decode(piece):
        text, name = piece["text"], piece["name"]
        past = lambda n: F.substring(text, n, F.length(text))
        # Leading zeros go; nine digits are enough to be beyond all characters.
        plain = F.substring(F.regexp_replace(name, "^#[xX]?0*(?=.)", ""), 1, 9)
        digits = F.when(name.rlike("^#[xX]"), F.conv(plain, 16, 10)).otherwise(plain)
        rest = past(F.length(name) + F.length(piece["end"]) + 2)
        numeric = F.when(name.startswith("#"), F.concat(_code_point(digits.cast("bigint")), rest))
        named = F.when(piece["end"] == ";", F.concat(F.try_element_at(_entity_table(), name), rest))
        # Without its semicolon, the longest known name that the text begins with.
        bare = F.regexp_extract(text, BARE_ENTITY + ("(?![=A-Za-z0-9])" if in_attribute else ""), 1)
        prefix = F.when(bare != "", F.concat(F.try_element_at(_entity_table(), bare), past(F.length(bare) + 2)))
        return F.when(name == "", text).otherwise(F.coalesce(numeric, named, prefix, text))

    return decode


def decode_entities(c, in_attribute=False) -> Column:
    """Character references, named or numeric, replaced once from left to right.

    Some names count without a semicolon too; in an attribute only if no letter, digit or "="
    follows, since addresses hold such names by chance.
    """
    c = _col(c)
    pieces = F.transform(
        F.split(c, "(?=&)"),
        lambda p: F.struct(p.alias("text"), F.regexp_extract(p, ENTITY, 1).alias("name"), F.regexp_extract(p, ENTITY, 2).alias("end")),
    )
    decoded = F.array_join(F.transform(pieces, _decode_piece(in_attribute)), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def strip_tags(c, tag_text=" ") -> Column:
    return decode_entities(F.regexp_replace(_col(c), markup.NODE_BREAK, tag_text))


def node_text(c, joiner: str) -> Column:
    """Text of an element's nodes, each trimmed and the empty ones left out, joined."""
    tags = F.regexp_replace(_col(c), rf"(?:{vocab.WS}*+(?:{markup.NODE_BREAK}))++{vocab.WS}*+", joiner)
    return strip(decode_entities(tags))


def bare_text(c, elements=DROPPED_ELEMENTS, tag_text=" ") -> Column:
    """Markup removed in one pass, entities left; plain text skips the pattern."""
    c = _col(c)
    pattern = "|".join([*(markup.whole_element(e) for e in elements), markup.NODE_BREAK])
    return F.when(c.contains("<"), F.regexp_replace(c, markup.from_bracket(pattern), tag_text)).otherwise(c)


def strip_html(c, elements=DROPPED_ELEMENTS, tag_text=" ") -> Column:
    """Visible text of an HTML fragment."""
    return decode_entities(bare_text(c, elements, tag_text))


# --- look-alike characters -------------------------------------------------


def _already_nfkc() -> str:
    """Character class of larger ranges beyond ASCII whose characters, in any order, are NFKC text.

    They are their own NFKC form, have combining class zero and never merge with a character before them.
    """
    letters = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000]
    pairs = [d.split() for d in map(unicodedata.decomposition, letters) if d and not d.startswith("<")]
    merging = {chr(int(pair[1], 16)) for pair in pairs if len(pair) == 2}
    merging |= {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul
    ranges = []
    for c in letters:
        if c not in merging and not unicodedata.combining(c) and unicodedata.normalize("NFKC", c) == c:
            if ranges and ord(ranges[-1][1]) == ord(c) - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    # Western letters and punctuation, and ranges of some length: more would only slow the search.
    kept = [(ord(a), ord(b)) for a, b in ranges if a < "\u0180" or "\u2010" <= a < "\u2040" or ord(b) - ord(a) > 60]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in kept)


_MAY_CHANGE = rf"[[^\x00-\x7f]&&[^{_already_nfkc()}]]"
_ROWS_AT_ONCE = 256


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """Python's own tables: Arrow's kernel leaves composed letters apart.

    A few rows at a time become Python strings; the rest of a batch stays as bytes.
    """
    normalize = unicodedata.normalize
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    parts = (texts.slice(k, _ROWS_AT_ONCE) for k in range(0, len(texts), _ROWS_AT_ONCE))
    return pa.concat_arrays([pa.array([None if s is None else normalize("NFKC", s) for s in part.to_pylist()], pa.string()) for part in parts])


def nfkc(c) -> Column:
    """NFKC form. Only text with a character that it may change leaves the JVM, a batch at a time."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(beyond_ascii(c) & c.rlike(_MAY_CHANGE), c)), c)


def map_homoglyphs(c) -> Column:
    """Look-alikes as Latin letters; only text that holds one is read by character."""
    c = _col(c)
    mapped = F.translate(c, vocab.HOMOGLYPH_FROM, vocab.HOMOGLYPH_TO)
    return F.when(beyond_ascii(c) & c.rlike(f"[{min(vocab.HOMOGLYPH_FROM)}-{max(vocab.HOMOGLYPH_FROM)}]"), mapped).otherwise(c)


def normalize_homoglyphs(c) -> Column:
    return map_homoglyphs(nfkc(c))


# --- cleaning --------------------------------------------------------------


def mask_tokens(c) -> Column:
    """Hashed contact tokens such as ``#EMAIL_9f3a#`` become `` [email] ``."""
    c = _col(c)
    out = c
    for kind in ("EMAIL", "URL", "PHONE"):
        out = F.regexp_replace(out, f"#{kind}_[0-9a-f]+#", f" [{kind.lower()}] ")
    return F.when(c.contains("#"), out).otherwise(c)


def has_any(c, chars) -> Column:
    """Whether any of the characters occurs; plain searches beat a pattern here."""
    return reduce(operator.or_, [_col(c).contains(ch) for ch in chars])


# Whitespace beyond blanks and line feeds that NFKC leaves.
_RARE_WS = "\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"


def collapse_keep_lines(c) -> Column:
    """Blanks collapse to one space and blank lines vanish; takes NFKC text.

    One test sends text of printable ASCII and line feeds past the search for other whitespace.
    """
    c = _col(c)
    single = lambda s: F.regexp_replace(s, "  +", " ")
    usual = lambda spaced: F.regexp_replace(F.replace(spaced, F.lit(" \n"), F.lit("\n")), r"\n[ \n]++", "\n")
    spaced = single(spaces(c, "\t\r\f\x0b"))
    rare = F.regexp_replace(spaced, f"[ \\n{_RARE_WS}]*\\n[ \\n{_RARE_WS}]*", "\n")
    other = F.when(c.rlike(f"[[^ -~]&&[{_RARE_WS}]]"), rare).otherwise(usual(spaced))
    return strip(F.when(c.rlike(r"[^\n -~]"), other).otherwise(usual(single(c))))


def _staged(df, columns, steps):
    """Apply steps to columns (target: source) as separate projections: each reads its
    input more than once, so Catalyst keeps them apart and every pattern runs once per row.

    The last step leaves through a one-element generator. Later filters on what was
    made of the text stop there instead of repeating the whole chain below it, while
    filters on other columns still reach the scan.
    """
    df = df.withColumns({target: _col(source) for target, source in columns.items()})
    for step in steps[:-1]:
        df = df.withColumns({target: step(F.col(target)) for target in columns})
    order = df.columns
    last = F.struct(*[steps[-1](F.col(target)).alias(target) for target in columns])
    done = df.select(*[c for c in order if c not in columns], F.inline(F.array(last)))
    return done.select(*order)


def _markup_steps(elements, tag_text=" "):
    return [lambda c: bare_text(c, elements, tag_text), decode_entities]




def with_clean_columns(df, columns: dict, elements=DROPPED_ELEMENTS, tag_text=" ", finish=collapse):
    """:func:`with_clean_html` of several columns at once, so rows go to Python once."""
    last = lambda c: or_empty(finish(c))
    return _staged(df, columns, [*_markup_steps(elements, tag_text), nfkc, map_homoglyphs, last])


def with_clean_html(df, source, target: str, elements=DROPPED_ELEMENTS, tag_text=" ", finish=collapse):
    """One line of visible text, look-alikes mapped; null and blank give ''."""
    return with_clean_columns(df, {target: source}, elements, tag_text, finish)


def with_clean_lines(df, source, target: str):
    """Visible text with line breaks kept, since they end sentences."""
    last = lambda c: or_empty(collapse_keep_lines(c))
    return _staged(df, {target: source}, [*_markup_steps(DROPPED_ELEMENTS), mask_tokens, nfkc, map_homoglyphs, last])


# --- segmentation and tokens -----------------------------------------------


def segment(c) -> Column:
    """Bullets and glued words (``...InstituteOur``) start a new line."""
    c = _col(c)
    bullet_lines = F.regexp_replace(c, f"{vocab.WS}*+[{vocab.BULLETS}]{vocab.WS}*", "\n")
    lines = F.when(beyond_ascii(c) & has_any(c, vocab.BULLETS), bullet_lines).otherwise(c)
    return F.regexp_replace(lines, r"[A-Z](?=[a-z])(?<=[a-z0-9)\]:][A-Z])", "\n$0")


def split_sentences(segmented) -> Column:
    """Sentences of segmented text: lines, cut after ``.``, ``!`` or ``?`` and a gap.

    Blanks other than line breaks come out as plain spaces.
    """
    spaced = spaces(segmented, vocab.WS_CHARS.replace("\n", ""))
    lines = F.split(F.regexp_replace(spaced, r"[ \n](?<=[.!?][ \n])[ \n]*+", "\n"), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")


def split_words(segmented) -> Column:
    return F.regexp_extract_all(_col(segmented), F.lit(vocab.WORD), F.lit(0))


def sentences(cleaned) -> Column:
    return split_sentences(segment(cleaned))


def words(cleaned) -> Column:
    return split_words(segment(cleaned))


def alnum_words(tokens) -> Column:
    """Tokens that hold at least one letter or digit."""
    return F.filter(_col(tokens), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def count_term(lowered, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    lowered = _col(lowered)
    gone = F.length(lowered) - F.length(F.replace(lowered, F.lit(term), F.lit("")))
    return F.when(lowered.contains(term), (gone / len(term)).cast("int")).when(lowered.isNotNull(), 0)


def count_terms(c, terms) -> Column:
    lowered = F.lower(_col(c))
    total = count_term(lowered, terms[0])
    for term in terms[1:]:
        total = total + count_term(lowered, term)
    return total


# --- display ---------------------------------------------------------------


def snippet(c) -> Column:
    return F.substring(_col(c), 1, 60)


def display_snippet(c) -> Column:
    cut = snippet(c)
    return F.when(F.length(cut) >= 60, F.concat(cut, F.lit("…"))).otherwise(cut)


def whitespace_word_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(vocab.JS_WS.replace("[", "[^", 1) + "+"))
