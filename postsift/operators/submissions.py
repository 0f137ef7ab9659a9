"""Incoming submissions: which are accepted and under which id."""

from pyspark.sql import Column, DataFrame, functions as F

from postsift.functions.text import or_empty, strip

NO_TEXT = "Job posting text is required."
NO_USER = "user_id is required."


def rejection_reason() -> Column:
    """Blank text is reported before a missing user; null means accepted."""
    return F.when(strip(or_empty("text")) == "", NO_TEXT).when(or_empty(F.col("user_id").cast("string")) == "", NO_USER)


def validate_submissions(submissions: DataFrame) -> DataFrame:
    """Append the reason for a rejection and strip the text."""
    return submissions.withColumn("reason", rejection_reason()).withColumn("text", strip(or_empty("text")))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())


def stable_id(kind: str, c) -> Column:
    """The same id for the same row, however often it is processed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.sha2(F.concat(F.lit(kind + ":"), c.cast("string")), 256), 1, 32)
