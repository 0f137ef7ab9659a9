"""Fields of a board B page, read from the visible lines of its job section."""

from pyspark.sql import Column, functions as F

from postsift import vocab
from postsift.functions import markup, text
from postsift.functions.text import _col, strip

_BOARD = vocab.BOARD_B
DROPPED_ELEMENTS = (*text.DROPPED_ELEMENTS, "svg")


# --- elements of the page --------------------------------------------------


element = markup.element


def job_container(html) -> Column:
    """The job section, else the main element, else the body; a page without one is all body."""
    html = _col(html)
    return F.coalesce(element(html, "section", "job-content"), element(html, "main"), element(html, "body"), html)


def h1_html(html) -> Column:
    return F.coalesce(element(html, "h1"), F.lit(""))


def h1_title(html, joiner=" ") -> Column:
    """Text of the first h1 of a page without dropped elements."""
    return text.node_text(h1_html(html), joiner)


def company_link_texts(html) -> Column:
    """Inner HTML of the links to company pages; a link ends before the next one."""
    link = rf"(<(?i:a)(?=[\s/>]){markup.ATTRIBUTES}>(?:[^<]++|<(?!/?(?i:a)[\s/>]))*+</(?i:a)\s*+>)"
    links = F.regexp_extract_all(_col(html), F.lit(f"{link}|{markup.NODE_BREAK}"), F.lit(1))
    own = F.filter(links, lambda x: (x != "") & markup.attribute(x, "href").contains("/company/"))
    return F.transform(own, lambda x: F.regexp_extract(x, rf"^<[A-Za-z]{markup.ATTRIBUTES}>((?s:.*))</[aA]\s*+>$", 1))


def company_from_link(container) -> Column:
    """First employer link that carries a name; the logo has no text and a tab says "Company"."""
    shown = F.transform(company_link_texts(container), lambda link: F.rtrim(text.node_text(link, " "), F.lit(", ")))
    names = F.filter(shown, lambda n: (n != "") & (n != "Company"))
    return text.or_empty(F.get(names, 0))


# --- lines -----------------------------------------------------------------


def page_lines(visible) -> Column:
    """Trimmed lines of visible text, blank ones left out."""
    return F.filter(F.transform(F.split(_col(visible), "\n"), strip), lambda line: line != "")


def _position(lines, label, after) -> Column:
    """0-based index of a line at or past an index, -1 if missing."""
    rest = F.slice(lines, after + 1, F.greatest(F.size(lines) - after, F.lit(0)))
    at = F.array_position(rest, label)
    return F.when(at > 0, (at - 1 + after).cast("int")).otherwise(F.lit(-1))


def label_index(lines, label: str, after=None) -> Column:
    return _position(_col(lines), label, F.lit(0) if after is None else after)


def slice_between(lines, start: str, stops, after=None) -> Column:
    """Lines past the first ``start`` line, up to the next stop line or the end."""
    lines = _col(lines)
    at = label_index(lines, start, after)
    rest = F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0)))
    cuts = [F.nullif(F.array_position(rest, stop), F.lit(0)) for stop in stops]
    cut = F.coalesce(F.least(*cuts) if len(cuts) > 1 else cuts[0], (F.size(rest) + 1).cast("bigint"))
    found = F.slice(rest, F.lit(1), (cut - 1).cast("int"))
    return F.when(at >= 0, found).otherwise(F.array().cast("array<string>"))


def location_join(lines) -> Column:
    parts = slice_between(lines, "Location", _BOARD["detail_labels"])
    return F.array_join(F.filter(parts, lambda p: p != "•"), ", ")


def contract_type(lines) -> Column:
    return text.or_empty(F.get(slice_between(lines, "Contract Type", _BOARD["detail_labels"]), 0))


def salary_lines(lines) -> Column:
    return F.array_join(slice_between(lines, "Salary", _BOARD["detail_labels"]), " ")


def board_b_description(lines) -> Column:
    """Lines past the "Description" heading of the job tab."""
    about = F.greatest(label_index(lines, "About the job"), F.lit(0))
    return F.array_join(slice_between(lines, "Description", _BOARD["body_stops"], about), " ")


def tag_lines(lines) -> Column:
    return slice_between(lines, "Tags", _BOARD["tag_stops"])


def level_tag(tags) -> Column:
    known = [level.lower() for level in vocab.EXPERIENCE_LEVELS]
    levels = F.filter(_col(tags), lambda t: F.lower(t).contains("level") | F.lower(t).isin(known))
    return text.or_empty(F.get(levels, 0))


def category_tags(tags, level) -> Column:
    level = _col(level)
    return F.filter(_col(tags), lambda t: (t != level) & (t != _BOARD["country"]))


def posted_date(lines) -> Column:
    return F.regexp_extract(F.array_join(_col(lines), " "), "(?U)" + vocab.POSTED_DATE, 1)


def apply_by_date(lines) -> Column:
    return F.regexp_extract(F.array_join(_col(lines), " "), "(?U)" + vocab.APPLY_BY_DATE, 1)


def typed_date(c) -> Column:
    """A date such as "15 May 2025", null if it does not read as one."""
    return F.coalesce(F.try_to_date(_col(c), "d MMM yyyy"), F.try_to_date(_col(c), "d MMMM yyyy"))


def board_b_fields(df, html="html"):
    """Append the twelve fields of a page. Each step is its own projection so that
    lines and tags are found once per row."""
    kept = df.columns
    staged = df.withColumn("_page", text.drop_elements(html, DROPPED_ELEMENTS)).withColumns({
        "_box": job_container("_page"),
        "_h1": h1_html("_page"),
    })
    staged = text.with_clean_html(staged, "_box", "_text", (), "\n", finish=lambda c: c)
    staged = (
        staged.withColumn("title", text.node_text("_h1", " "))
        .withColumn("company_profile", company_from_link("_box"))
        .withColumn("_lines", page_lines("_text"))
        .withColumn("_tags", tag_lines("_lines"))
        .withColumns({
            "location": location_join("_lines"),
            "employment_type": contract_type("_lines"),
            "salary_range": salary_lines("_lines"),
            "required_experience": level_tag("_tags"),
            "description": board_b_description("_lines"),
            "posted_date": posted_date("_lines"),
            "apply_by": apply_by_date("_lines"),
        })
        .withColumn("_categories", category_tags("_tags", "required_experience"))
        .withColumns({
            "function": text.or_empty(F.get("_categories", 0)),
            "industry": F.array_join(F.slice("_categories", F.lit(2), F.greatest(F.size("_categories"), F.lit(1))), "; "),
            "is_job_page": (F.col("title") != "") & (F.col("description") != ""),
        })
    )
    names = ["title", "company_profile", "location", "employment_type", "salary_range", "required_experience",
             "function", "industry", "description", "posted_date", "apply_by", "is_job_page"]
    return staged.select(*[c for c in kept if c not in names], *names)
