"""Fields of a board A page, read from its one-line visible text by label."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from postsift import vocab
from postsift.functions.text import _col, blank_to_null, strip

_BOARD = vocab.BOARD_A


def _quoted(c) -> Column:
    """A column value as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _longest_first(terms):
    return sorted(terms, key=len, reverse=True)


def _alternatives(terms) -> str:
    return "|".join(re.escape(t).replace(r"\ ", " ") for t in terms)


def labeled_field(c, label: str, stops) -> Column:
    """Text after ``label:`` up to the next known label or the end."""
    pattern = rf"{re.escape(label)}:\s*(.*?)(?=\s+(?:{_alternatives(stops)})|$)"
    return strip(F.regexp_extract(_col(c), pattern, 1))


def metadata_block(c) -> dict[str, Column]:
    """The six labelled fields; any of them may be missing from a page."""
    def others(label):
        return [x for x in vocab.METADATA_LABELS if x != label] + [_BOARD["body_start"]]

    return {label: labeled_field(c, label, others(label)) for label in vocab.METADATA_LABELS}


def main_description(c) -> Column:
    """Text between the start marker and the nearest end marker; all of it without a start."""
    c = _col(c)
    start = F.instr(c, F.lit(_BOARD["body_start"]))
    body = F.substring(c, start + len(_BOARD["body_start"]), F.length(c))
    ends = [F.nullif(F.instr(body, F.lit(m)), F.lit(0)) for m in _BOARD["body_ends"]]
    end = F.coalesce(F.least(*ends), F.length(body) + 1)
    return F.when(start == 0, c).otherwise(strip(F.substring(body, F.lit(1), end - 1)))


def company_and_function(c, title) -> dict[str, Column]:
    """Employer and job function from ``TITLE TITLE employer FUNCTION time-ago``."""
    c, title = _col(c), _col(title)
    functions = _alternatives(_longest_first(vocab.JOB_FUNCTIONS))
    pattern = F.concat(
        _quoted(title), F.lit(r"\s+"), _quoted(title),
        F.lit(rf"\s+(.*?)\s+({functions})\s+{vocab.TIME_AGO}"),
    )

    def part(n):
        return F.when(title == "", F.lit("")).otherwise(strip(F.call_function("regexp_extract", c, pattern, F.lit(n))))

    return {"company_profile": part(1), "function": part(2)}


def badge_window(c) -> Column:
    """Text before the body, where the badges sit; a body's own amounts stay out."""
    c = _col(c)
    start = F.instr(c, F.lit(_BOARD["body_start"]))
    return F.when(start > 0, F.substring(c, F.lit(1), start - 1)).otherwise(F.substring(c, 1, 800))


def industry(c) -> Column:
    """The longest known industry named before the body."""
    window = badge_window(c)
    cases = reduce(
        lambda chain, name: chain.when(window.contains(name), F.lit(name)),
        _longest_first(vocab.INDUSTRIES),
        F,
    )
    return cases.otherwise(F.lit(""))


_SALARY = rf"(KSh[\sA-Za-z0-9,.-]+|Confidential)\s*$"


def salary(c) -> Column:
    """The amount, or "Confidential", right before the share anchor."""
    window = badge_window(c)
    at = F.instr(window, F.lit(_BOARD["share_anchor"]))
    before = F.rtrim(F.substring(window, F.lit(1), at - 1), F.lit(vocab.WS_CHARS))
    ends_in_industry = (industry(c) != "") & before.endswith(industry(c))
    found = strip(F.regexp_extract(before, _SALARY, 1))
    return F.when((at == 0) | ends_in_industry, F.lit("")).otherwise(found)


def salary_and_industry(c) -> dict[str, Column]:
    return {"salary_range": salary(c), "industry": industry(c)}


def employment_type(working_hours) -> Column:
    """Working hours up to `` - ``, unless they begin with a known type."""
    hours = _col(working_hours)
    known = reduce(lambda chain, name: chain.when(hours.startswith(name), F.lit(name)), vocab.EMPLOYMENT_TYPES, F)
    return known.otherwise(strip(F.get(F.split(hours, " - "), 0)))


def required_experience(level, length) -> Column:
    return F.concat_ws(", ", blank_to_null(level), blank_to_null(length))


def board_a_fields(c, title) -> dict[str, Column]:
    """All nine fields of a page."""
    meta = metadata_block(c)
    return {
        **company_and_function(c, title),
        **salary_and_industry(c),
        "location": meta["Applicant Location"],
        "employment_type": employment_type(meta["Working Hours"]),
        "required_education": meta["Min Qualification"],
        "required_experience": required_experience(meta["Experience Level"], meta["Experience Length"]),
        "description": main_description(c),
    }
