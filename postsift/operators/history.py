"""Submission history."""

from pyspark.sql import DataFrame, functions as F

from postsift.functions import text, verdict


def user_postings(postings: DataFrame, user_id=None) -> DataFrame:
    return postings if not user_id else postings.filter(F.col("user_id") == user_id)


def history_page(postings: DataFrame, page=1, per_page=10, user_id=None, after=None) -> DataFrame:
    """One page of postings, newest first; a page past the end is empty, one before the first is the first.

    ``after`` is (submitted_at, posting_id) of the last row seen: the page then starts behind it,
    and its cost doesn't grow with its number.
    """
    mine, page = user_postings(postings, user_id), max(page, 1)
    if after is not None:
        at, last = (F.lit(v) for v in after)
        mine = mine.filter((F.col("submitted_at") < at) | ((F.col("submitted_at") == at) & (F.col("posting_id") > last)))
    return mine.orderBy(F.desc("submitted_at"), F.asc("posting_id")).offset((page - 1) * per_page).limit(per_page)


def history_totals(postings: DataFrame, per_page=10, user_id=None) -> DataFrame:
    total = F.count(F.lit(1))
    return user_postings(postings, user_id).agg(
        total.alias("total_items"), F.ceil(total / per_page).cast("bigint").alias("total_pages"))


def _snippets(postings: DataFrame, *more) -> DataFrame:
    """What a list shows of a posting; the raw text stays behind."""
    return postings.select("posting_id", text.snippet("raw_text").alias("title_snippet"), "source_platform", "submitted_at", *more)


def _with_label(shown: DataFrame, vectors: DataFrame, results: DataFrame) -> DataFrame:
    scored = vectors.select("posting_id").join(results.select("posting_id", "label"), "posting_id")
    return shown.join(scored, "posting_id", "left")


def history_join(postings: DataFrame, vectors: DataFrame, results: DataFrame) -> DataFrame:
    """Postings with their verdict; the label is null until vector and result exist."""
    return _with_label(_snippets(postings), vectors, results)


def history(postings: DataFrame, vectors: DataFrame, results: DataFrame, page=1, per_page=10, user_id=None, after=None) -> DataFrame:
    """A page of history. Only snippets are sorted; the ids of the page, ``per_page`` at most,
    are broadcast to shrink the result tables before the join."""
    shown = history_page(_snippets(postings, "user_id"), page, per_page, user_id, after).drop("user_id")
    ids = F.broadcast(shown.select("posting_id"))
    vectors, results = (t.join(ids, "posting_id", "left_semi") for t in (vectors, results))
    items = _with_label(shown, vectors, results)
    return items.withColumn("verdict", verdict.verdict_text("label")).orderBy(F.desc("submitted_at"), F.asc("posting_id"))
