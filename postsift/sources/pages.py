"""Fetched board pages, as a table of (url, html), to postings and links."""

from pyspark.sql import Column, DataFrame, functions as F

from postsift import vocab
from postsift.functions import board_a, board_b, email, keys, markup, text
from postsift.operators.rows import filter_here
from postsift.sources.conform import conform_unified


def page_links(html, base_url: str, prefix: str) -> Column:
    """Distinct absolute links under a prefix, sorted."""
    hrefs = F.transform(markup.tags_of(html, "a"), lambda tag: markup.attribute(tag, "href"))
    decoded = F.transform(hrefs, lambda h: text.decode_entities(h, in_attribute=True))
    absolute = F.transform(decoded, lambda h: F.when(h.startswith(prefix), F.concat(F.lit(base_url), h)).otherwise(h))
    return F.array_sort(F.array_distinct(F.filter(absolute, lambda h: h.startswith(base_url + prefix))))


def extract_links(pages: DataFrame, base_url=vocab.BOARD_A["base_url"], prefix=vocab.BOARD_A["link_prefix"],
                  keep=("url",)) -> DataFrame:
    """One row per page and distinct link."""
    return pages.select(*keep, F.explode(page_links("html", base_url, prefix)).alias("link"))


def _contact_columns(df: DataFrame, ignored) -> DataFrame:
    return df.withColumn("contact_email_domain", text.or_empty(email.contact_domain("description", ignored, normalized=True))).withColumn(
        "is_free_email_provider", email.is_free_email("contact_email_domain").cast("int"))


def _scrape_time(df: DataFrame) -> DataFrame:
    if "scraped_at" in df.columns:
        return df
    return df.withColumn("scraped_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def board_a_postings(pages: DataFrame, source: str = vocab.BOARD_A["source"]) -> DataFrame:
    """Board A pages to unified postings, one per page."""
    df = pages.withColumn("_page", text.drop_elements("html")).withColumns({
        "_main": F.coalesce(board_b.element("_page", "main"), board_b.element("_page", "body"), F.col("_page")),
        "title": board_b.h1_title("_page", ""),
    })
    df = text.with_clean_html(df, "_main", "_text", ())
    df = df.withColumns(board_a.board_a_fields("_text", "title"))
    df = _contact_columns(df, vocab.BOARD_A["ignored_domains"])
    df = df.withColumns({"source": F.lit(source), "source_id": keys.source_id_from_url("url")})
    return conform_unified(_scrape_time(df))


def board_b_postings(pages: DataFrame, source: str = vocab.BOARD_B["source"]) -> DataFrame:
    """Board B pages to unified postings; pages without title and description are dropped."""
    df = filter_here(board_b.board_b_fields(pages), F.col("is_job_page"))
    df = _contact_columns(df, vocab.BOARD_B["ignored_domains"])
    df = df.withColumns({"source": F.lit(source), "source_id": keys.source_id_from_url("url")})
    return conform_unified(_scrape_time(df))
