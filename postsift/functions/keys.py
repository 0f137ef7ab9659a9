"""Keys that identify postings, texts and employers."""

from pyspark.sql import Column, functions as F

from postsift import vocab
from postsift.functions.text import _col, blank_to_null, collapse, strip


def build_text(fields=None) -> Column:
    """Posting body: the non-empty text fields, one per line."""
    parts = [blank_to_null(strip(f)) for f in (fields or vocab.TEXT_FIELDS)]
    return F.concat_ws("\n", *parts)


def normalize_key(c) -> Column:
    return collapse(F.lower(_col(c)))


def short_hash(c) -> Column:
    return F.substring(F.sha1(_col(c)), 1, 12)


def text_key(c) -> Column:
    """256-bit grouping key of a text, so shuffles move 32 bytes and not the text."""
    return F.unhex(F.sha2(_col(c), 256))


def posting_key(source, source_id, text_norm) -> Column:
    source_id = _col(source_id)
    tail = F.when(source_id != "", source_id).otherwise(short_hash(text_norm))
    return F.concat(_col(source), F.lit(":"), tail)


def group_key(source, company, domain, free_flag, text_norm) -> Column:
    """Employer, else its own mail domain, else the posting by itself."""
    name = normalize_key(company)
    host = F.lower(strip(domain))
    by_company = F.concat(_col(source), F.lit(":co:"), short_hash(name))
    by_domain = F.concat(F.lit("dom:"), host)
    by_post = F.concat(_col(source), F.lit(":post:"), short_hash(text_norm))
    return (
        F.when(~name.isin(vocab.ANONYMOUS_EMPLOYERS), by_company)
        .when((host != "") & (_col(free_flag) != "1"), by_domain)
        .otherwise(by_post)
    )


def source_id_from_url(url) -> Column:
    """Last path segment; query strings stay."""
    return F.element_at(F.split(F.rtrim(_col(url), F.lit("/")), "/"), -1)
