"""Annotation notes: ``1,4,5; comment`` or ``excluded | 1,2; comment``."""

from pyspark.sql import Column, functions as F

from postsift import vocab
from postsift.functions.text import _col, count_terms, or_empty, strip


def urgency_hint(c) -> Column:
    """How often urgency terms occur, the longer list for annotators."""
    return count_terms(c, vocab.ANNOTATION_URGENCY_TERMS)


def short_text_flag(c) -> Column:
    return (F.length(_col(c)) < vocab.SHORT_TEXT_CHARS).cast("int")


_RISK = rf"(?i)({vocab.RISK_PHRASES})"


def highlight_terms(c) -> Column:
    return F.regexp_replace(_col(c), _RISK, "<mark>$1</mark>")


def risk_matches(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(_RISK), F.lit(1))


def is_excluded(notes) -> Column:
    return or_empty(notes).contains("excluded")


def indicators(notes) -> Column:
    """Distinct indicator numbers 1 to 7, in the order they were noted."""
    listed = F.regexp_replace(or_empty(notes), r"^excluded\s*\|?\s*", "")
    parts = F.transform(F.split(F.get(F.split(listed, ";"), 0), ","), strip)
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p.rlike("^[1-7]$")), lambda p: p.cast("int")))


def comment(notes) -> Column:
    """Everything past the first semicolon."""
    notes = or_empty(notes)
    at = F.instr(notes, F.lit(";"))
    return F.when(at == 0, F.lit("")).otherwise(strip(F.substring(notes, at + 1, F.length(notes))))


def parse_notes(notes) -> Column:
    return F.struct(
        is_excluded(notes).alias("excluded"),
        indicators(notes).alias("indicators"),
        comment(notes).alias("comment"),
    )


def format_notes(indicator_list, comment_text, excluded) -> Column:
    """The inverse of :func:`parse_notes`; semicolons in a comment become commas."""
    said = strip(F.replace(or_empty(comment_text), F.lit(";"), F.lit(",")))
    body = F.concat(
        F.array_join(_col(indicator_list), ","),
        F.when(said != "", F.concat(F.lit("; "), said)).otherwise(F.lit("")),
    )
    marked = F.concat(F.lit("excluded"), F.when(body != "", F.concat(F.lit(" | "), body)).otherwise(F.lit("")))
    return F.when(_col(excluded), marked).otherwise(body)
