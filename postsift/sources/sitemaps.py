"""Sitemaps, as a table of XML texts, to the URLs worth fetching."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from postsift import vocab

_BLOCK = "(?s)<url>(.*?)</url>"
_LOC = r"<loc>\s*(.*?)\s*</loc>"
_LASTMOD = r"<lastmod>\s*(.*?)\s*</lastmod>"


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Whole sitemap files, gzipped or not, as (path, xml)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def sitemap_urls(sitemaps: DataFrame, prefix: str = vocab.BOARD_B["job_url_prefix"], keep=()) -> DataFrame:
    """One row per ``<url>`` block under the prefix; ``lastmod`` is '' where missing."""
    blocks = sitemaps.select(*keep, F.explode(F.regexp_extract_all("xml", F.lit(_BLOCK), F.lit(1))).alias("_block"))
    return blocks.select(
        *keep,
        F.regexp_extract("_block", _LOC, 1).alias("url"),
        F.regexp_extract("_block", _LASTMOD, 1).alias("lastmod"),
    ).filter(F.col("url").startswith(prefix))


def sitemap_locations(index: DataFrame, keep=()) -> DataFrame:
    """Locations listed by a sitemap index."""
    return index.select(*keep, F.explode(F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1))).alias("sitemap"))


def sitemap_category_filter(locations: DataFrame, categories=None) -> DataFrame:
    """Sitemaps of any of the categories; all of them without categories."""
    if not categories:
        return locations
    wanted = [F.col("sitemap").contains(f"sitemap-{c}-listings") for c in categories]
    return locations.filter(reduce(lambda a, b: a | b, wanted))


def crawl_frontier(urls: DataFrame, max_urls: int) -> DataFrame:
    """Newest URLs first, each once with its latest ``lastmod``."""
    latest = urls.groupBy("url").agg(F.max("lastmod").alias("lastmod"))
    return latest.orderBy(F.desc("lastmod"), F.desc("url")).limit(max_urls)


def frontier_union(*link_tables: DataFrame) -> DataFrame:
    """Distinct links of many listings, sorted."""
    links = reduce(DataFrame.unionByName, [t.select("link") for t in link_tables])
    return links.distinct().orderBy("link")
