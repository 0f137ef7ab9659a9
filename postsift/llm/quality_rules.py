"""Quality rules: a table of thresholds compiled into one projection of native columns.

Words are runs of other characters than blank, tab, line feed, vertical tab, form feed and
carriage return. A null text has no words; so has an empty one. Nothing is rounded, and a text
of any length is read whole. Equal rows get equal rows; the input's other columns don't matter.
"""

from pyspark.sql import DataFrame, functions as F

from postsift.operators.rows import filter_here

# Function words of the four languages, as written in lower case.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on are as with be by at from this or an he",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur avec",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más",
}
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
# ratio, least, most; null: open. Ratios are defined in ``_ratios``.
THRESHOLDS = [
    ("chars_per_word", 2.0, 20.0),
    ("symbols_per_word", None, 0.1),
    ("stop_words_per_word", 0.005, None),
    ("dup_line_share", None, 0.5),
    ("ellipsis_line_share", None, 0.3),
    ("bullet_line_share", None, 0.9),
]


def _forms():
    words = sorted({w for text in STOP_WORDS.values() for w in text.split()})
    return sorted({f for w in words for f in (w, w.capitalize(), w.upper())})


def _windows(n):
    """Three-word windows with their first position, in the order of their words."""
    m = f"greatest({n} - 2, 0)"
    return F.expr(f"sort_array(arrays_zip(slice(_words, 1, {m}), slice(_words, 2, {m}), slice(_words, 3, {m}), sequence(0, greatest({n} - 3, 0))))")


def _same(pair):
    left, right = pair["0"], pair["1"]
    return (left["0"] == right["0"]) & (left["1"] == right["1"]) & (left["2"] == right["2"])


def _ratios():
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    blank = r"[\x20\x09-\x0D]*"
    return {
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_words_per_word": F.size(F.filter("_words", lambda w: w.isin(_forms()))) / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "ellipsis_line_share": F.size(F.filter("_lines", lambda x: x.rlike(rf"(\.\.\.|…){blank}$"))) / lines,
        "bullet_line_share": F.size(F.filter("_lines", lambda x: x.rlike(rf"^{blank}[-•]"))) / lines,
    }


def _passes(thresholds):
    passed = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            passed = passed & (F.col(name) >= least)
        if most is not None:
            passed = passed & (F.col(name) <= most)
    return passed


def judge(docs: DataFrame, key="doc_id", text="text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per input row: key, base counts, ratios, ``base_failed`` and ``kept``.

    A window counts as repeated if its three words occur twice or more in the text; windows may
    overlap, and ``n_repeat_words`` counts each word in such windows once. Rows without words fail.
    """
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cut = whole.select(
        "doc_id", "_text",
        F.array_remove(F.split(F.translate("_text", "\t\n\x0b\x0c\r", "     "), " "), "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    sorted_windows = cut.withColumn("_windows", _windows("size(_words)"))
    again = F.filter(F.arrays_zip(F.expr("slice(_windows, 1, size(_windows) - 1)").alias("0"),
                                  F.expr("slice(_windows, 2, size(_windows))").alias("1")), _same)
    found = sorted_windows.withColumn("_again", again).drop("_windows")
    starts = F.flatten(F.transform("_again", lambda p: F.array(p["0"]["3"], p["1"]["3"])))
    spots = F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda s: F.array(s, s + 1, s + 2))))
    length = F.char_length("_text").cast("long")
    counted = found.select(
        "doc_id", "_words", "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_again") == 0, 0).otherwise(F.size(spots)).cast("long").alias("n_repeat_words"))
    rated = counted.select("*", *[c.alias(n) for n, c in _ratios().items()]).drop("_words", "_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rated.withColumn("base_failed", failed).withColumn("kept", ~failed & _passes(thresholds))


def keep_good(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; keys may be null or repeated."""
    carried = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_body"))
    return filter_here(judge(carried, "_row", "_body"), F.col("kept")).select("doc_id.*")
