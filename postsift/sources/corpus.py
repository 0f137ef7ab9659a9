"""The labelled base corpus."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postsift import vocab
from postsift.functions import email, text
from postsift.sources.conform import conform_unified

_STRINGS = ["title", "location", "department", "salary_range", "company_profile", "description", "requirements",
            "benefits", "employment_type", "required_experience", "required_education", "industry", "function"]
_FLAGS = ["telecommuting", "has_company_logo", "has_questions", "fraudulent"]
_HTML = ["company_profile", "description", "requirements", "benefits"]

CORPUS_SCHEMA = T.StructType(
    [T.StructField("job_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField(c, T.IntegerType()) for c in _FLAGS]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS_SCHEMA).csv(path, header=True, multiLine=True, escape='"')


def standardize_base(raw: DataFrame, source: str = vocab.CORPUS_SOURCE) -> DataFrame:
    """Map raw corpus rows onto the unified columns.

    The contact domain comes from profile, description and requirements; benefits
    take no part in it.
    """
    df = raw.withColumn("source_id", F.col("job_id"))
    df = text.with_clean_columns(df, {name: name for name in _HTML})
    df = df.withColumn("_contact", F.concat_ws(" ", "company_profile", "description", "requirements"))
    df = df.withColumn("contact_email_domain", text.or_empty(email.contact_domain("_contact", normalized=True))).withColumns({
        "source": F.lit(source),
        "is_free_email_provider": email.is_free_email("contact_email_domain").cast("int"),
    })
    return conform_unified(df)
