"""The fifteen features of a posting, all from one pass over its text."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from postsift import vocab
from postsift.functions import email, text
from postsift.functions.text import _col

# --- syllables: vowel groups, less a silent final e, at least one ----------

_VOWEL_GROUP = "[aeiouy]+"
_SILENT_END = "[^aeiouyl]e$"


def syllables(word) -> Column:
    low = F.lower(_col(word))
    groups = F.regexp_count(low, F.lit(_VOWEL_GROUP))
    return F.greatest(groups - low.rlike(_SILENT_END).cast("int"), F.lit(1))


def syllables_per_word(words) -> Column:
    return F.transform(_col(words), syllables)


# The same counts over a whole line of lower-cased words, each between single spaces. Every match takes
# one character: the last vowel of a group that is no silent e, or the space before a word counted.
_SYLLABLE = "[aeiouy](?![aeiouy])(?<![^aeiouyl ]e(?= ))"
_FLOORED = " (?=[^aeiouy ]++(?: |(?<!l)e ))"
_COMPLEX = " (?=[^aeiouy ]*+(?:[aeiouy]++[^aeiouy ]++){2}(?!(?<!l)e )[aeiouy])"


def word_line(words) -> Column:
    """All words in one string, each between single spaces; pattern counts over it
    stand in for a lambda per word."""
    return F.concat(F.lit(" "), F.array_join(_col(words), " "), F.lit(" "))


def syllable_total(low_line) -> Column:
    return text.count_by_loss(low_line, f"{_SYLLABLE}|{_FLOORED}")


def complex_total(low_line) -> Column:
    """Words of three syllables or more."""
    return text.count_by_loss(low_line, _COMPLEX)


# --- ratios ----------------------------------------------------------------


def _ratio(top, bottom) -> Column:
    bottom = _col(bottom)
    return F.when(bottom > 0, _col(top).cast("double") / bottom).otherwise(F.lit(0.0))


def _per_word(count, n_words) -> Column:
    return count.cast("double") / F.greatest(_col(n_words), F.lit(1))


def ttr(words) -> Column:
    words = _col(words)
    return _ratio(F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))), F.size(words))


def sentence_lengths(sentences) -> Column:
    """Words of each sentence; single blanks are counted by their loss, without a pattern."""
    def words(s):
        return F.when(s.contains("  ") | s.startswith(" ") | s.endswith(" ") | (s == ""), F.regexp_count(s, F.lit("[^ ]++"))).otherwise(
            F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)

    return F.transform(_col(sentences), words)


def mean_length(lengths) -> Column:
    lengths = _col(lengths)
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _ratio(total, F.size(lengths))


def length_variance(lengths) -> Column:
    """Population variance from integer sums, so it takes a single division."""
    lengths = _col(lengths)
    n = F.size(lengths).cast("bigint")
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(lengths, zero, lambda a, x: a + x)
    squares = F.aggregate(lengths, zero, lambda a, x: a + x.cast("bigint") * x)
    return F.when(n < 2, F.lit(0.0)).otherwise((n * squares - total * total).cast("double") / (n * n))


def punctuation_density(c) -> Column:
    c = _col(c)
    marks = text.count_by_loss(c, f"[{re.escape(vocab.PUNCTUATION)}]++")
    return _ratio(marks, F.length(c))


def exclamation_density(c, n_words) -> Column:
    c = _col(c)
    return _per_word(text.count_term(c, "!"), n_words)


def readability(n_words, n_sentences, n_syllables) -> Column:
    w, s, y = (_col(c).cast("double") for c in (n_words, n_sentences, n_syllables))
    score = 206.835 - 1.015 * (w / s) - 84.6 * (y / w)
    return F.when((w > 0) & (s > 0), score).otherwise(F.lit(0.0))


def gunning_fog(n_words, n_sentences, n_complex) -> Column:
    w, s, x = (_col(c).cast("double") for c in (n_words, n_sentences, n_complex))
    return F.when((w > 0) & (s > 0), 0.4 * (w / s + 100 * (x / w))).otherwise(F.lit(0.0))


def urgency_term_count(c) -> Column:
    return text.count_terms(c, vocab.URGENCY_TERMS)


def free_email_flag(c) -> Column:
    return email.is_free_email(email.email_domain(c))


def letter_words(line, letters=r"\p{L}") -> Column:
    """Words of three letters or more in a word line, all of them of the given kind."""
    return text.count_by_loss(line, rf" (?={letters}{{3,}}+ )")


def caps_word_ratio(line, long_words=None) -> Column:
    """Words in capitals among words of three letters or more, from a word line.

    The latter are read twice here; ``long_words`` names a column that has them already.
    """
    return _ratio(letter_words(line, r"\p{Lu}"), letter_words(line) if long_words is None else long_words)


def fold(c) -> Column:
    """Text for the content patterns: lower case, every blank a plain space, the
    dotted and dotless i an i."""
    c = _col(c)
    plain_i = F.when(text.has_any(c, "İı"), F.translate(c, "İı", "ii")).otherwise(c)
    return F.lower(text.spaces(plain_i))


# The content patterns over folded text. A word edge is a look-around that is only
# tried at a fitting first letter, since that test is the dear one.
_WORD_CHAR = r"[\p{L}\p{N}_]"


def _folded(pattern) -> str:
    return pattern.replace(r"\b", f"(?!{_WORD_CHAR})").replace(r"\s", " ").replace(r"\d", r"\p{Nd}")


def _at_word_start(first, pattern) -> str:
    return f"(?=[{first}])(?<!{_WORD_CHAR})(?:{_folded(pattern)})"


_PAYMENT_OR_ID = _at_word_start("rpatimbsndk", rf"(?:{'|'.join(vocab.PAYMENT_OR_ID)})\b|{vocab.PAYMENT_AMOUNT}")
# Group 1 is an amount. A number without a currency matches too, outside the group,
# so that a long one is read once and not again from each of its digits.
_NUMBER = _at_word_start(r"\p{Nd}", r"\d[\d,.]*+")
_MONEY = "({}|{}|{})|{}".format(
    _at_word_start("ku", vocab.MONEY_AFTER_WORD),
    _folded(vocab.MONEY_AFTER_SIGN),
    _at_word_start(r"\p{Nd}", vocab.MONEY_BEFORE_WORD.replace("]*", "]*+")),
    _NUMBER,
)
_SECOND_PERSON = _at_word_start("y", vocab.SECOND_PERSON + r"\b")
_MESSAGING_APP = _at_word_start("wt", vocab.MESSAGING_APP + r"\b")


def money_mention_density(folded, n_words) -> Column:
    folded = _col(folded)
    found = F.filter(F.regexp_extract_all(folded, F.lit(_MONEY), F.lit(1)), lambda m: m != "")
    hits = F.when(folded.rlike(r"\p{Nd}"), F.size(found)).otherwise(F.lit(0))
    return _per_word(100 * hits, n_words)


def payment_or_id_request_count(folded) -> Column:
    return F.regexp_count(_col(folded), F.lit(_PAYMENT_OR_ID))


def second_person_density(folded, n_words) -> Column:
    return _per_word(100 * F.regexp_count(_col(folded), F.lit(_SECOND_PERSON)), n_words)


def messaging_app_mention(folded) -> Column:
    return _col(folded).rlike(_MESSAGING_APP).cast("int")


# --- the whole vector ------------------------------------------------------


def extract_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the fifteen features and ``contact_email_domain``.

    Cleaned text, tokens and counts are separate projections: each is read more
    than once further down, so Catalyst keeps them apart and no pattern runs twice.
    """
    kept = df.columns
    staged = (
        text.with_clean_lines(df, text_col, "_clean")
        .withColumn("_seg", text.segment("_clean"))
        .withColumns({
            "_words": text.split_words("_seg"),
            "_lengths": sentence_lengths(text.split_sentences("_seg")),
        })
        .withColumn("_line", word_line("_words"))
        .withColumns({
            "_low": F.lower("_line"),
            "_fold": fold("_clean"),
            "_w": F.size("_words"),
            "_s": F.size("_lengths"),
            "_domain": email.email_domain("_clean"),
        })
        .withColumns({"_syl": syllable_total("_low"), "_cplx": complex_total("_low"), "_long": letter_words("_line")})
    )
    distinct_words = F.size(F.array_distinct(F.split(F.trim("_low"), " ")))
    return staged.select(
        *kept,
        _ratio(F.when(F.col("_w") > 0, distinct_words).otherwise(F.lit(0)), "_w").alias("ttr"),
        mean_length("_lengths").alias("avg_sentence_length"),
        length_variance("_lengths").alias("sentence_length_variance"),
        punctuation_density("_clean").alias("punctuation_density"),
        exclamation_density("_clean", "_w").alias("exclamation_density"),
        readability("_w", "_s", "_syl").alias("readability_score"),
        gunning_fog("_w", "_s", "_cplx").alias("gunning_fog_index"),
        urgency_term_count("_clean").alias("urgency_term_count"),
        email.is_free_email("_domain").alias("free_email_flag"),
        F.log1p(F.col("_w").cast("double")).alias("log_word_count"),
        caps_word_ratio("_line", "_long").alias("caps_word_ratio"),
        money_mention_density("_fold", "_w").alias("money_mention_density"),
        payment_or_id_request_count("_fold").alias("payment_or_id_request_count"),
        second_person_density("_fold", "_w").alias("second_person_density"),
        messaging_app_mention("_fold").alias("messaging_app_mention"),
        F.col("_domain").alias("contact_email_domain"),
    )


def feature_columns() -> list[Column]:
    """The model inputs as doubles, in model order."""
    return [F.col(name).cast("double").alias(name) for name in vocab.FEATURE_ORDER]
